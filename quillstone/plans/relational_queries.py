"""Registered queries: scans, predicates, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import register
from ..functions.text import fold, words
from ..operators import relational as rel
from ..session import load
from .inputs import FUSED, PASSAGES, STOPS, fused, passages

@register("visible_counts", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS long FROM documents WHERE source <> 'src3' GROUP BY lang")
def visible_counts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("retired_at", F.when(F.col("source") == "src3", F.current_timestamp()))
    return rel.visible(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 500).alias("long"))


@register("point_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def point_lookup(spark, sf_dir):
    ids = load(spark, sf_dir, "labels").filter("toxic = 1")
    return rel.point_lookup(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ids, "doc_id")


@register("malformed_skip", "SELECT user_id, count(*) AS n FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND props LIKE '{%' GROUP BY user_id")
def malformed_skip(spark, sf_dir):
    e = load(spark, sf_dir, "events").filter(rel.all_of([F.col("event_type").isNotNull(), F.col("value").isNotNull(), F.col("props").like("{%")]))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("keep_floor", f"""WITH {FUSED}, w AS (SELECT *, bool_or(score >= 0.095) OVER (PARTITION BY query_id, collection) AS passed, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS rn FROM fused)
SELECT query_id, collection, item, score, score >= 0.095 AS include FROM w WHERE score >= 0.095 OR (NOT passed AND rn = 1)""")
def keep_floor(spark, sf_dir):
    rows = rel.keep_floor(fused(spark, sf_dir), ["query_id", "collection"], 0.095)
    return rows.select("query_id", "collection", "item", "score", (F.col("score") >= 0.095).alias("include"))


@register("collection_normalization", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL) GROUP BY conv_id")
def collection_normalization(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return c.groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])), ",").alias("roles"))


@register("substring_search", "SELECT p_partkey, p_name FROM part WHERE instr(lower(p_name), lower('RE')) > 0 AND p_type NOT LIKE 'X%' AND regexp_matches(p_brand, '[0-9]')")
def substring_search(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.filter(F.instr(F.lower("p_name"), "re") > 0).filter(~F.col("p_type").like("X%") & F.col("p_brand").rlike("[0-9]")).select("p_partkey", "p_name")


@register("keyset_page", "SELECT o_orderdate, o_orderkey, true AS has_more FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01', 5000) ORDER BY 1 DESC, 2 DESC LIMIT 50")
def keyset_page(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return rel.keyset_page(o, ["o_orderdate", "o_orderkey"], ("1996-06-01 00:00:00", 5000), 50)


@register("facts_diff", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 = 0 THEN 'lang,source' WHEN doc_id % 5 = 0 THEN 'lang' ELSE 'source' END AS changed FROM documents
WHERE (doc_id % 5 = 0 AND lang <> 'en') OR doc_id % 7 = 0 AND NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) AND doc_id % 5 <> 0 OR (doc_id % 35 = 0 AND lang <> 'en')
UNION ALL SELECT doc_id, 'source' AS changed FROM documents WHERE doc_id % 35 = 0 AND lang = 'en'""")
def facts_diff(spark, sf_dir):
    old = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = old.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    return rel.changed_columns(old, new, "doc_id", ["lang", "source"])


@register("backfill_cascade", """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, l.quality::VARCHAR, d.source) AS author FROM documents d LEFT JOIN labels l USING (doc_id)""")
def backfill_cascade(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.col("quality").cast("string"), "source").alias("author"))


@register("composed_text", "SELECT doc_id, concat_ws(chr(10), '[' || source || ']', CASE WHEN n_chars > 1000 THEN 'long' END, lang) AS body FROM documents")
def composed_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("\n", F.concat(F.lit("["), "source", F.lit("]")), F.when(F.col("n_chars") > 1000, "long"), "lang").alias("body"))


@register("reader_access", "SELECT d.doc_id, CASE max(CASE l.quality WHEN 1 THEN CASE l.toxic WHEN 1 THEN 2 ELSE 1 END WHEN 0 THEN 3 ELSE 2 END) WHEN 1 THEN 'full' WHEN 2 THEN 'excerpt' ELSE 'none' END AS access FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id")
def reader_access(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 2).otherwise(1)).when(F.col("quality") == 0, 3).otherwise(2)
    worst = F.max(level)
    return d.groupBy("doc_id").agg(F.when(worst == 1, "full").when(worst == 2, "excerpt").otherwise("none").alias("access"))


@register("inner_join_counts", "SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def inner_join_counts(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("term_pairs", f"""WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+') AS w FROM benchmark),
t AS (SELECT query_id, min(i) AS i, term FROM (SELECT query_id, unnest(range(len(w))) AS i, unnest(w) AS term FROM w) WHERE term NOT IN {STOPS} GROUP BY query_id, term) SELECT a.query_id, a.term AS first, b.term AS second FROM t a JOIN t b ON a.query_id = b.query_id AND a.i < b.i""")
def term_pairs(spark, sf_dir):
    from ..functions.text import lexemes

    t = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(lexemes(F.col("text"))).alias("i", "term"))
    a, b = t.select("query_id", F.col("i").alias("ai"), F.col("term").alias("first")), t.select("query_id", F.col("i").alias("bi"), F.col("term").alias("second"))
    return a.join(b, "query_id").filter("ai < bi").select("query_id", "first", "second")


@register("lateral_first", "SELECT c_custkey, o_orderkey, o_orderdate FROM (SELECT c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r = 1")
def lateral_first(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    w = W.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return c.join(o, o.o_custkey == c.c_custkey).withColumn("r", F.row_number().over(w)).filter("r = 1").select("c_custkey", "o_orderkey", "o_orderdate")


@register("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders").filter("o_totalprice > 300000"), load(spark, sf_dir, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@register("two_column_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
def two_column_semi(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.join(li.filter("l_quantity = 50").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@register("exists_either", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < -900)")
def exists_either(spark, sf_dir):
    s, li, c = (load(spark, sf_dir, t) for t in ("supplier", "lineitem", "customer"))
    a = s.join(li.filter("l_discount > 0.09"), s.s_suppkey == F.col("l_suppkey"), "left_semi")
    b = s.join(c.filter("c_acctbal < -900"), s.s_nationkey == F.col("c_nationkey"), "left_semi")
    return a.union(b).select("s_suppkey").distinct()


@register("windowed_self_join", f"WITH {PASSAGES} SELECT a.doc_id, a.position AS a, b.position AS b FROM passages a JOIN passages b ON a.doc_id = b.doc_id AND b.position > a.position AND b.position - a.position <= 2 AND length(a.content) = length(b.content)")
def windowed_self_join(spark, sf_dir):
    p = passages(spark, sf_dir).select("doc_id", "position", F.length("content").alias("n"))
    a = p.withColumn("at", F.explode(F.array(F.col("position") + 1, F.col("position") + 2)))
    b = p.select("doc_id", F.col("position").alias("at"), "n")
    return a.join(b, ["doc_id", "at", "n"]).select("doc_id", F.col("position").alias("a"), F.col("at").alias("b"))


@register("reconcile_stores", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS lang, source FROM documents WHERE doc_id % 10 <> 0),
v AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(r.doc_id, v.doc_id) AS doc_id, CASE WHEN v.doc_id IS NULL THEN 'unvectorised' WHEN r.doc_id IS NULL THEN 'orphan' WHEN trim(r.lang) <> '' AND r.lang <> v.lang THEN 'drifted' ELSE 'in_sync' END AS status,
CASE WHEN v.doc_id IS NOT NULL AND r.doc_id IS NOT NULL AND trim(r.lang) <> '' AND r.lang <> v.lang THEN 'lang' ELSE '' END AS differs FROM r FULL JOIN v ON r.doc_id = v.doc_id""")
def reconcile_stores(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    r = d.filter("doc_id % 10 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")))
    v = d.filter("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 6 == 0, "xx").otherwise(F.col("lang")))
    return rel.reconcile(r, v, "doc_id", ["lang", "source"])


@register("missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


REDIRECTS = """edges AS (SELECT doc_id AS old_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id + 7 END AS new_id, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE 'merged' END AS kind FROM documents WHERE doc_id % 3 <> 1),
cur AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 1), saved AS (SELECT doc_id AS id FROM documents)"""


def _redirects(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    new = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id") + 7)
    edges = d.filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("old_id"), new.alias("new_id"), F.when(F.col("doc_id") % 2 == 0, "moved").otherwise("merged").alias("kind"))
    return d.select(F.col("doc_id").alias("id")), edges, d.filter("doc_id % 3 = 1").select(F.col("doc_id").alias("id"))


@register("redirect_resolve", f"""WITH RECURSIVE {REDIRECTS}, hops AS (SELECT id, id AS here, NULL::VARCHAR AS kind, 0 AS n FROM saved
  UNION ALL SELECT h.id, e.new_id, coalesce(h.kind, e.kind), h.n + 1 FROM hops h JOIN edges e ON e.old_id = h.here WHERE h.n < 3 AND h.here NOT IN (SELECT id FROM cur)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM hops) WHERE r = 1),
s AS (SELECT l.id, l.here, l.kind, l.here IN (SELECT id FROM cur) AS live FROM last l)
SELECT id, CASE WHEN live THEN here END AS target, kind, CASE WHEN live AND id = here THEN 'current' WHEN live THEN 'moved' WHEN id % 5 = 0 THEN 'removed' ELSE 'unknown' END AS status FROM s""")
def redirect_resolve(spark, sf_dir):
    saved, edges, cur = _redirects(spark, sf_dir)
    return rel.resolve(saved, edges, cur, saved.filter("id % 5 = 0"))


@register("redirect_recursive", f"WITH RECURSIVE {REDIRECTS}, hops AS (SELECT old_id, new_id AS here, 1 AS n FROM edges UNION ALL SELECT h.old_id, e.new_id, h.n + 1 FROM hops h JOIN edges e ON e.old_id = h.here WHERE h.n < 3) SELECT DISTINCT old_id, here FROM hops")
def redirect_recursive(spark, sf_dir):
    _, edges, _ = _redirects(spark, sf_dir)
    edges.createOrReplaceTempView("_quillstone_edges")
    return spark.sql("""WITH RECURSIVE hops(old_id, here, n) AS (SELECT old_id, new_id, 1 FROM _quillstone_edges
      UNION ALL SELECT h.old_id, e.new_id, h.n + 1 FROM hops h JOIN _quillstone_edges e ON e.old_id = h.here WHERE h.n < 3) SELECT DISTINCT old_id, here FROM hops""")


@register("bijection_check", """WITH a AS (SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS missing, count(*) FILTER (WHERE a.doc_id IS NULL) AS unknown, count(*) FILTER (WHERE b.n > 1) AS repeated FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def bijection_check(spark, sf_dir):
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "toxic")
    a = d.filter("doc_id % 9 <> 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("an"))
    b = lab.union(lab.filter("toxic = 1")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("bn"))
    j = a.join(b, "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("bn").isNull()).alias("missing"), F.count_if(F.col("an").isNull()).alias("unknown"), F.count_if(F.col("bn") > 1).alias("repeated"))


@register("user_impact_pivot", "SELECT user_id % 10 AS cohort, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def user_impact_pivot(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("cohort", F.col("user_id") % 10)
    return e.groupBy("cohort").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


@register("chapter_vote", f"""WITH {PASSAGES}, c AS (SELECT doc_id, length(content) % 3 AS choice, count(*) AS votes, min(position) AS first FROM passages GROUP BY ALL)
SELECT doc_id, choice, votes, members, round(votes / members, 4) AS share FROM (SELECT *, sum(votes) OVER (PARTITION BY doc_id) AS members, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) AS rn FROM c) WHERE rn = 1""")
def chapter_vote(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("choice", F.length("content") % 3)
    return rel.vote(p, "doc_id", "choice", "position")


@register("nearest_rank_percentiles", "SELECT source, l[1] AS lowest, l[least(n - 1, floor(0.25::DOUBLE * n)::INT) + 1] AS p25, l[least(n - 1, floor(0.5::DOUBLE * n)::INT) + 1] AS median, l[least(n - 1, floor(0.75::DOUBLE * n)::INT) + 1] AS p75, l[n] AS highest FROM (SELECT source, list_sort(list(n_chars)) AS l, count(*) AS n FROM documents GROUP BY source)")
def nearest_rank_percentiles(spark, sf_dir):
    return rel.nearest_rank(load(spark, sf_dir, "documents"), ["source"], "n_chars", {"lowest": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "highest": 1.0})


@register("ordered_aggregates", f"WITH {PASSAGES} SELECT doc_id, position // 10 AS chapter, min(position) AS first, max(position) AS last, arg_min(content, position) AS label, string_agg(length(content)::VARCHAR, ',' ORDER BY position) AS lengths FROM passages GROUP BY ALL")
def ordered_aggregates(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("chapter", F.floor(F.col("position") / 10))
    lengths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.length("content").alias("n")))), lambda x: x["n"].cast("string")), ",")
    return p.groupBy("doc_id", "chapter").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.min_by("content", "position").alias("label"), lengths.alias("lengths"))


@register("cached_count", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 7 END, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)) AS n FROM supplier")
def cached_count(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("c"))
    s = load(spark, sf_dir, "supplier").join(n, "s_suppkey", "left")
    return s.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, 7), "c", F.lit(0)).cast("long").alias("n"))


@register("distinct_values", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def distinct_values(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@register("merge_survivor", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS survivor, left(string_agg(DISTINCT event_type, ' | ' ORDER BY event_type), 3000) AS notes, count(*) AS merged FROM events GROUP BY 1")
def merge_survivor(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("survivor"), F.left(F.array_join(F.array_sort(F.collect_set("event_type")), " | "), F.lit(3000)).alias("notes"), F.count(F.lit(1)).alias("merged"))


@register("duplicate_texts", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@register("outline", f"""WITH {PASSAGES}, c AS (SELECT doc_id, position // 10 AS chapter_key, min(position) AS first, arg_min(left(content, 20), position) AS label, count(*) AS n FROM passages GROUP BY ALL)
SELECT doc_id, chapter_key, label, n, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS ordinal FROM c""")
def outline(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("chapter_key", F.floor(F.col("position") / 10))
    c = p.groupBy("doc_id", "chapter_key").agg(F.min("position").alias("first"), F.min_by(F.left("content", F.lit(20)), "position").alias("label"), F.count(F.lit(1)).alias("n"))
    return c.select("doc_id", "chapter_key", "label", "n", F.row_number().over(W.partitionBy("doc_id").orderBy("first")).alias("ordinal"))


@register("neighbor_keys", f"WITH {PASSAGES}, c AS (SELECT DISTINCT doc_id, position // 10 AS k FROM passages) SELECT doc_id, k, lag(k) OVER w AS prev, lead(k) OVER w AS next FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)")
def neighbor_keys(spark, sf_dir):
    c = passages(spark, sf_dir).select("doc_id", F.floor(F.col("position") / 10).alias("k")).distinct()
    w = W.partitionBy("doc_id").orderBy("k")
    return c.select("doc_id", "k", F.lag("k").over(w).alias("prev"), F.lead("k").over(w).alias("next"))


@register("key_runs", f"""WITH {PASSAGES}, k AS (SELECT doc_id, position, length(content) % 2 AS k FROM passages), n AS (SELECT *, coalesce(k <> lag(k) OVER (PARTITION BY doc_id ORDER BY position), false)::INT AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM n) SELECT doc_id, run, k, min(position) AS first, count(*) AS n FROM r GROUP BY ALL""")
def key_runs(spark, sf_dir):
    p = passages(spark, sf_dir).select("doc_id", "position", (F.length("content") % 2).alias("k"))
    return rel.runs(p, ["doc_id"], "position", "k").groupBy("doc_id", "run", "k").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))


@register("contiguity_check", f"WITH {PASSAGES} SELECT doc_id, position FROM (SELECT doc_id, position, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS r FROM passages WHERE length(content) > 8) WHERE r <> position")
def contiguity_check(spark, sf_dir):
    p = passages(spark, sf_dir).filter(F.length("content") > 8)
    r = F.row_number().over(W.partitionBy("doc_id").orderBy("position")) - 1
    return p.withColumn("r", r).filter("r <> position").select("doc_id", "position")


@register("nulls_ordering", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def nulls_ordering(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc_nulls_last("quality"), "doc_id")).alias("place"))


@register("even_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 7 OR floor(i * 7::DOUBLE / n) <> floor((i - 1) * 7::DOUBLE / n)")
def even_sample(spark, sf_dir):
    return rel.even_sample(load(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 7)


@register("hashed_sample")
def hashed_sample(spark, sf_dir):
    return rel.hashed_sample(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 42, 50)


@register("set_operations", "(SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1) UNION (SELECT doc_id FROM documents WHERE lang = 'de' INTERSECT SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    lab, d = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents")
    a = lab.filter("quality = 1").select("doc_id").exceptAll(lab.filter("toxic = 1").select("doc_id")).distinct()
    return a.union(d.filter("lang = 'de'").select("doc_id").intersect(lab.select("doc_id"))).distinct()


@register("upsert_points", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, -1 FROM embeddings WHERE vec_id % 4 = 0")
def upsert_points(spark, sf_dir):
    live = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = live.filter("vec_id % 4 = 0").withColumn("label", F.lit(-1))
    return rel.upsert(live, new.union(new.withColumn("vec_id", F.col("vec_id") + 1000000)), ["vec_id"])


@register("insert_if_absent", "SELECT doc_id, 'old' AS kind FROM labels UNION ALL SELECT doc_id, 'new' AS kind FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_absent(spark, sf_dir):
    old = load(spark, sf_dir, "labels").select("doc_id", F.lit("old").alias("kind"))
    new = load(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("kind"))
    return old.union(new.join(old, "doc_id", "left_anti").select("doc_id", "kind"))


@register("cache_misses", "SELECT sha256(text) AS input_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def cache_misses(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("input_hash"), "doc_id")
    return d.join(d.filter("doc_id % 3 = 0").select("input_hash"), "input_hash", "left_anti").groupBy("input_hash").agg(F.min("doc_id").alias("doc_id"))


@register("relation_hash")
def relation_hash(spark, sf_dir):
    return rel.content_hash(load(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


@register("snapshot_export", f"WITH {PASSAGES} SELECT lang, count(*) AS passages, count(DISTINCT doc_id) AS documents, sum(length(content)) AS chars, count(DISTINCT source) AS sources FROM passages GROUP BY lang")
def snapshot_export(spark, sf_dir):
    return passages(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("doc_id").alias("documents"), F.sum(F.length("content")).alias("chars"), F.count_distinct("source").alias("sources"))


@register("unknown_word_rate", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+')) AS w FROM documents), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+')) AS w FROM benchmark) SELECT doc_id, count(*) AS words, round(count(*) FILTER (WHERE d.w IS NULL)::DOUBLE / count(*), 6) AS unknown FROM w LEFT JOIN d USING (w) GROUP BY doc_id")
def unknown_word_rate(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    known = load(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("w")).distinct().withColumn("k", F.lit(1))
    return w.join(known, "w", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.round(F.count_if(F.col("k").isNull()) / F.count(F.lit(1)), 6).alias("unknown"))


@register("exact_containment", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def exact_containment(spark, sf_dir):
    """Items that a document holds character by character."""
    d, b = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return rel.containing(d, b, "doc_id", "text", "item_id", "item")


@register("folded_lookup", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+', ' ', 'g')) AS folded FROM documents")
def folded_lookup(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", fold(F.concat_ws(" ", "source", "lang")).alias("folded"))
