"""Registered queries of what saved passages and links show today."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import lifecycle, saved
from ..session import load
from .inputs import PASSAGES, passages

#: A third of all passages and some documents are retired; some have moved on, in up to four steps, some have tombstones, some neither.
STATE = f"""{PASSAGES}, rows_ AS (SELECT doc_id * 100000 + position AS id, doc_id AS document, 'a' || position // 2 AS anchor, 'c' || position // 6 AS chapter, (doc_id * 7 + position) % 3 = 0 AS retired FROM passages),
docs AS (SELECT doc_id AS document, doc_id % 9 = 4 AS retired FROM documents),
moves AS (SELECT 'passage' AS entity, id AS old_id, id + CASE WHEN id % 2 = 0 THEN 3 ELSE 1 END AS new_id, CASE WHEN id % 4 = 0 THEN 'merged' ELSE 'moved' END AS kind FROM rows_ WHERE retired AND id % 5 < 3
  UNION ALL SELECT 'document', document, document + CASE WHEN document % 2 = 0 THEN 9 ELSE 1 END, 'edition' FROM docs WHERE retired AND document % 5 < 3),
stones AS (SELECT 'passage' AS entity, id, 'r' || id % 6 AS reason FROM rows_ WHERE id % 6 = 1 UNION ALL SELECT 'document', document, 'd' || document % 3 FROM docs WHERE retired AND document % 4 = 1)"""
#: Every walk, step by step; then the last step of each.
STATUS = """st AS (SELECT r.id, r.document, r.retired OR d.retired AS old, d.retired AS gone FROM rows_ r JOIN docs d USING (document)),
pw AS (SELECT id AS start, id AS spot, 0 AS hop, NULL::VARCHAR AS kind, false AS reached FROM st WHERE old UNION ALL
  SELECT start, new_id, hop + 1, coalesce(pw.kind, m.kind), coalesce((SELECT NOT old FROM st WHERE st.id = new_id), false) FROM pw JOIN moves m ON m.entity = 'passage' AND m.old_id = spot WHERE hop < 3 AND NOT reached),
dw AS (SELECT document AS start, document AS spot, 0 AS hop, false AS reached FROM docs WHERE retired UNION ALL
  SELECT start, new_id, hop + 1, coalesce((SELECT NOT retired FROM docs WHERE docs.document = new_id), false) FROM dw JOIN moves m ON m.entity = 'document' AND m.old_id = spot WHERE hop < 3 AND NOT reached),
pe AS (SELECT start AS id, max_by(spot, hop) AS spot, max(hop) AS hop, max_by(kind, hop) AS kind, bool_or(reached) AS reached FROM pw GROUP BY start),
de AS (SELECT start AS document, max_by(spot, hop) AS spot, max(hop) AS hop, bool_or(reached) AS reached FROM dw GROUP BY start),
j AS (SELECT st.id, st.document, old, gone, pe.spot, pe.kind, coalesce(pe.reached, false) AS reached, coalesce(s1.reason, s2.reason, CASE WHEN pe.hop > 0 THEN s3.reason END) AS reason, de.spot AS doc_at, gone AND coalesce(de.reached, false) AS doc_reached, CASE WHEN gone AND de.hop > 0 THEN s4.reason END AS doc_reason
  FROM st LEFT JOIN pe USING (id) LEFT JOIN de USING (document) LEFT JOIN stones s1 ON s1.entity = 'passage' AND s1.id = st.id LEFT JOIN stones s2 ON s2.entity = 'document' AND s2.id = st.document LEFT JOIN stones s3 ON s3.entity = 'passage' AND s3.id = pe.spot LEFT JOIN stones s4 ON s4.entity = 'document' AND s4.id = de.spot),
status AS (SELECT id, CASE WHEN NOT old THEN 'current' WHEN reached THEN 'moved' WHEN reason IS NOT NULL THEN 'removed' WHEN doc_reached THEN 'moved' WHEN doc_reason IS NOT NULL THEN 'removed' ELSE 'kept' END AS status,
  CASE WHEN reached THEN spot END AS target, CASE WHEN old AND NOT reached AND reason IS NULL AND doc_reached THEN doc_at END AS target_document, CASE WHEN reached THEN kind WHEN old AND reason IS NULL AND doc_reached THEN 'edition' END AS kind, CASE WHEN old AND NOT reached THEN coalesce(reason, CASE WHEN NOT doc_reached THEN doc_reason END) END AS reason FROM j)"""


def _state(spark, sf_dir):
    p = passages(spark, sf_dir)
    pid = F.col("doc_id") * 100000 + F.col("position")
    rows = p.select(pid.alias("id"), F.col("doc_id").alias("document"), F.concat(F.lit("a"), F.floor(F.col("position") / 2)).alias("anchor"), F.concat(F.lit("c"), F.floor(F.col("position") / 6)).alias("chapter"), ((F.col("doc_id") * 7 + F.col("position")) % 3 == 0).alias("retired"))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), (F.col("doc_id") % 9 == 4).alias("retired"))
    moves = rows.filter("retired AND id % 5 < 3").select(F.lit("passage").alias("entity"), F.col("id").alias("old_id"), (F.col("id") + F.when(F.col("id") % 2 == 0, 3).otherwise(1)).alias("new_id"), F.when(F.col("id") % 4 == 0, "merged").otherwise("moved").alias("kind"))
    moves = moves.unionByName(docs.filter("retired AND document % 5 < 3").select(F.lit("document").alias("entity"), F.col("document").alias("old_id"), (F.col("document") + F.when(F.col("document") % 2 == 0, 9).otherwise(1)).alias("new_id"), F.lit("edition").alias("kind")))
    stones = rows.filter("id % 6 = 1").select(F.lit("passage").alias("entity"), "id", F.concat(F.lit("r"), F.col("id") % 6).alias("reason"))
    stones = stones.unionByName(docs.filter("retired AND document % 4 = 1").select(F.lit("document").alias("entity"), F.col("document").alias("id"), F.concat(F.lit("d"), F.col("document") % 3).alias("reason")))
    return rows, docs, moves, stones


@register("passage_status", f"WITH RECURSIVE {STATE}, {STATUS} SELECT * FROM status")
def passage_status(spark, sf_dir):
    rows, docs, moves, stones = _state(spark, sf_dir)
    return lifecycle.passage_status(rows, rows, docs, moves, stones)


@register("restored_searches", f"""WITH RECURSIVE {STATE}, {STATUS}, saved AS (SELECT o_custkey AS search, o_orderkey AS rank, (o_orderkey % (SELECT max(doc_id) + 1 FROM documents)) * 100000 + o_orderkey // 7 % 9 AS passage FROM orders),
k AS (SELECT search, rank, passage, status, coalesce(target, id) AS shown, target_document, reason FROM saved JOIN status ON id = passage)
SELECT search, rank, passage, status, shown, target_document, NULL AS reason FROM (SELECT *, row_number() OVER (PARTITION BY search, shown ORDER BY rank, passage) AS rn FROM k WHERE status <> 'removed') WHERE rn = 1
UNION ALL SELECT search, rank, passage, status, NULL, target_document, reason FROM k WHERE status = 'removed'""")
def restored_searches(spark, sf_dir):
    """A search for each customer: its orders stand for saved ranks, and name passages."""
    rows, docs, moves, stones = _state(spark, sf_dir)
    n = F.broadcast(load(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("_n")))  # one row
    saved = load(spark, sf_dir, "orders").join(n).select(F.col("o_custkey").alias("search"), F.col("o_orderkey").alias("rank"), ((F.col("o_orderkey") % F.col("_n")) * 100000 + F.floor(F.col("o_orderkey") / 7) % 9).alias("passage"))
    return lifecycle.restored(saved, lifecycle.passage_status(saved.select(F.col("passage").alias("id")), rows, docs, moves, stones))


@register("location_status", f"""WITH RECURSIVE {STATE}, {STATUS}, asked AS (SELECT document * 100 + position * 2 + h AS request, entity, document, key FROM (SELECT document, (id % 100000) AS position, h, CASE WHEN h = 0 THEN 'anchor' ELSE 'chapter' END AS entity, CASE WHEN h = 0 THEN 'a' || (id % 100000) // 2 * 3 ELSE 'c' || id % 100000 // 2 END AS key FROM rows_, (VALUES (0), (1)) v(h) WHERE id % 100000 < 12)),
lm AS (SELECT DISTINCT 'anchor' AS entity, document AS old_document, 'a' || k AS old_key, document + k % 2 AS new_document, 'a' || k // 2 AS new_key, 'moved' AS kind FROM docs, range(0, 18) r(k) WHERE k % 4 > 0),
live AS (SELECT r.* FROM rows_ r JOIN docs d USING (document) WHERE NOT r.retired AND NOT d.retired),
shown AS (SELECT DISTINCT 'anchor' AS entity, document, anchor AS key FROM live UNION SELECT 'chapter', document, chapter FROM live),
w AS (SELECT request, entity, document, key, 0 AS hop, false AS reached FROM asked WHERE (entity, document, key) NOT IN (SELECT entity, document, key FROM shown) UNION ALL
  SELECT request, w.entity, new_document, new_key, hop + 1, (w.entity, new_document, new_key) IN (SELECT entity, document, key FROM shown) FROM w JOIN lm ON lm.entity = w.entity AND old_document = document AND old_key = key WHERE hop < 3 AND NOT reached),
e AS (SELECT request, max_by(entity, hop) AS entity, max_by(document, hop) AS document, max_by(key, hop) AS key, max(hop) AS hop, bool_or(reached) AS reached FROM w GROUP BY request),
gone AS (SELECT entity, document, key, max(id) AS id FROM (SELECT 'anchor' AS entity, document, anchor AS key, id FROM rows_ UNION ALL SELECT 'chapter', document, chapter, id FROM rows_) WHERE id NOT IN (SELECT id FROM live) GROUP BY ALL)
SELECT request, 'current' AS status, document, key, NULL AS target, NULL AS reason FROM asked WHERE (entity, document, key) IN (SELECT entity, document, key FROM shown)
UNION ALL SELECT request, 'moved', document, key, NULL, NULL FROM e WHERE reached
UNION ALL SELECT request, coalesce(s.status, CASE WHEN hop > 0 THEN 'moved' ELSE 'unknown' END), e.document, e.key, s.target, s.reason FROM e LEFT JOIN gone g USING (entity, document, key) LEFT JOIN status s ON s.id = g.id WHERE NOT reached""")
def location_status(spark, sf_dir):
    rows, docs, moves, stones = _state(spark, sf_dir)
    pos, h = F.col("id") % 100000, F.col("h")
    key = F.when(h == 0, F.concat(F.lit("a"), F.floor(pos / 2) * 3)).otherwise(F.concat(F.lit("c"), F.floor(pos / 2)))
    asked = rows.filter(pos < 12).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("document") * 100 + pos * 2 + h).alias("request"), F.when(h == 0, "anchor").otherwise("chapter").alias("entity"), "document", key.alias("key"))
    k = F.col("k")
    sent = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(17)))).filter(k % 4 > 0).select(F.lit("anchor").alias("entity"), F.col("document").alias("old_document"), F.concat(F.lit("a"), k).alias("old_key"), (F.col("document") + k % 2).alias("new_document"), F.concat(F.lit("a"), F.floor(k / 2)).alias("new_key"), F.lit("moved").alias("kind"))
    return lifecycle.location_status(asked, rows, docs, sent, moves, stones)


#: Events as changes of bookmarks: the type and number say what is done; the first day's orders are what was there before.
MARKS = """held AS (SELECT o_custkey AS "user", o_orderkey % 7 AS passage, min(o_orderpriority) AS note, min(epoch(o_orderdate)::BIGINT) AS created FROM orders GROUP BY ALL),
changes AS (SELECT user_id AS "user", event_id % 7 AS passage, event_id AS seq, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'put' END AS action, CASE WHEN event_id % 3 > 0 THEN event_type END AS note FROM events)"""


@register("bookmarks_after", f"""WITH {MARKS}, cut AS (SELECT "user", passage, max((t, seq)) AS c FROM changes WHERE action = 'delete' GROUP BY ALL),
puts AS (SELECT c.* FROM changes c LEFT JOIN cut USING ("user", passage) WHERE action = 'put' AND (cut.c IS NULL OR (t, seq) > cut.c)),
kept AS (SELECT h.* FROM held h ANTI JOIN cut USING ("user", passage)),
n AS (SELECT "user", passage, arg_max(note, (t, seq)) FILTER (note IS NOT NULL) AS note, arg_min(t, (t, seq)) AS created FROM puts GROUP BY ALL)
SELECT "user", passage, coalesce(n.note, k.note) AS note, coalesce(k.created, n.created) AS created FROM n FULL JOIN kept k USING ("user", passage)""")
def bookmarks_after(spark, sf_dir):
    held = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user"), (F.col("o_orderkey") % 7).alias("passage")).agg(F.min("o_orderpriority").alias("note"), F.min(F.unix_timestamp("o_orderdate")).alias("created"))
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 7).alias("passage"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("put").alias("action"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("note"))
    return saved.bookmarks_after(held, e)


@register("deleted_searches", """WITH gone AS (SELECT o_orderkey AS search FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey % 2 = 0)
SELECT 'searches' AS part, o_orderstatus AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT search FROM gone) GROUP BY ALL
UNION ALL SELECT 'results', l_linestatus, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT search FROM gone) GROUP BY ALL
UNION ALL SELECT 'labels', CASE WHEN l_orderkey IN (SELECT search FROM gone) THEN 'loose' ELSE 'tied' END, count(*) FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL""")
def deleted_searches(spark, sf_dir):
    """Orders stand for searches, their lines for results and, the first ones, for labels; wishes to delete another customer's do nothing."""
    o, l_ = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    searches = o.select(F.col("o_orderkey").alias("search"), F.col("o_custkey").alias("user"), F.col("o_orderstatus").alias("kind"))
    wishes = searches.filter("search % 4 = 1").select("search", (F.col("user") + F.col("user") % 2).alias("user"))
    lines = l_.select(F.col("l_orderkey").alias("search"), F.col("l_linestatus").alias("kind"), "l_linenumber")
    left, results, labels = saved.without_searches(wishes.union(wishes), searches, lines, lines.filter("l_linenumber = 1"))
    told = lambda d, part, kind: d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return told(left, "searches", F.col("kind")).unionByName(told(results, "results", F.col("kind"))).unionByName(told(labels, "labels", F.when(F.col("search").isNull(), "loose").otherwise("tied")))
