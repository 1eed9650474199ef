"""Registered queries: whole searches, scorer contracts, the registry of passages and saved rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import register
from ..functions.text import uuid5
from ..operators import ranking, registry, retrieval, search
from ..session import load
from .inputs import FUSED, MATCHED, PASSAGES, fused, fused_once, passages, terms

VISIBLE = "facts AS (SELECT doc_id AS item, source FROM documents WHERE source <> 'src3')"


@register("search_both_paths", f"""WITH {MATCHED}, store AS (SELECT d.doc_id AS item, d.lang AS collection, CAST(e.embedding AS DOUBLE[]) AS vector FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), {VISIBLE},
asked AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
near AS (SELECT query_id, collection, item, round(list_cosine_similarity(q.vector, p.vector), 6) AS score FROM asked q JOIN store p ON p.item <> q.query_id),
v AS (SELECT query_id, collection, item, 'query' AS family, 0 AS path_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS rank FROM near WHERE score >= 0.1) WHERE rank <= 20),
most AS (SELECT *, max(matched) OVER (PARTITION BY query_id, collection) AS most FROM matched),
k AS (SELECT query_id, collection, item, 'keyword' AS family, 99 AS path_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY matched DESC, weight DESC, item) AS rank FROM most WHERE matched >= least(ceil(n_terms / 2), most)) WHERE rank <= 20),
votes AS (SELECT query_id, collection, item, family, max(1.0::DOUBLE / (20 + rank)) AS vote, min(rank) AS best, min((path_no, rank)) AS first FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY ALL),
sums AS (SELECT query_id, collection, item, round(sum(vote), 9) AS score, min(best) AS best, min(first) AS first FROM votes GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, first, item) AS rank FROM sums) WHERE rank <= 8 OR best <= 3),
f AS (SELECT query_id, collection, item, source, score FROM top JOIN facts USING (item)),
w AS (SELECT *, bool_or(score >= 0.06) OVER (PARTITION BY query_id, collection) AS passed, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS rn FROM f),
k1 AS (SELECT query_id, collection, item, source, score FROM w WHERE score >= 0.06 OR (NOT passed AND rn = 1)),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item) AS r FROM k1) WHERE r <= 2),
k3 AS (SELECT query_id, collection, item, source, score FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS r FROM k2) WHERE r <= 4),
add AS (SELECT query_id, collection, item, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS r FROM f WHERE score >= 0.03 AND (query_id, collection) NOT IN (SELECT query_id, collection FROM k3)) WHERE r = 1),
u AS (SELECT * FROM k3 UNION ALL SELECT * FROM add)
SELECT query_id, collection, item, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS place, CASE WHEN count(*) OVER (PARTITION BY query_id, collection) >= 4 THEN 'complete' ELSE 'underfilled' END AS delivery FROM u""")
def search_both_paths(spark, sf_dir):
    """Every benchmark item as a question, by its words and by the vector of its id, over all documents."""
    d, e = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    store = d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("item"), F.col("lang").alias("collection"), F.col("embedding").alias("vector"))
    known = F.broadcast(d.select("lang").distinct().agg(F.collect_set("lang").alias("_c")))  # one row: the collections
    q = load(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.lit("query").alias("family"), F.lit(0).alias("path_no"), F.col("item_id").alias("skip"), F.col("embedding").alias("vector"))
    q = q.join(known).withColumn("collection", F.explode("_c")).drop("_c")
    t = terms(spark, sf_dir)
    posted = retrieval.postings(d.select(F.col("lang").alias("collection"), F.col("doc_id").alias("item"), "text"), F.col("text"), t)
    return search.hybrid(q, t, store, posted, d.filter("source <> 'src3'").select(F.col("doc_id").alias("item"), "source"))


@register("enriched_results", f"""WITH {FUSED}, l AS (SELECT doc_id AS item, source, lang, n_chars FROM documents WHERE source <> 'src3')
SELECT query_id, f.collection, item, score, coalesce(CASE WHEN item % 3 = 0 THEN f.collection::VARCHAR END, l.lang) AS label, l.n_chars FROM fused f JOIN l USING (item)""")
def enriched_results(spark, sf_dir):
    """Results filled from the base rows only where they lack a value; results without a visible base row fall out."""
    base = load(spark, sf_dir, "documents").filter("source <> 'src3'").select(F.col("doc_id").alias("item"), "lang", "n_chars")
    rows = fused(spark, sf_dir).withColumn("label", F.when(F.col("item") % 3 == 0, F.col("collection").cast("string")))
    return rows.join(base, "item").select("query_id", "collection", "item", "score", F.coalesce("label", "lang").alias("label"), "n_chars")


@register("retrieval_depth", "SELECT o_orderkey, greatest(10, least(60, ceil((floor(o_totalprice)::BIGINT % 200) / (1 + o_orderkey % 5) * 1.5))) AS depth FROM orders")
def retrieval_depth(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", search.depth(F.floor("o_totalprice") % 200, 1 + F.col("o_orderkey") % 5).alias("depth"))


@register("token_estimates", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, greatest(1, ceil((least(greatest(1, length(text) // 4), 1500) + 40) / 500)) AS chunks FROM documents")
def token_estimates(spark, sf_dir):
    t = search.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", t.alias("tokens"), search.billing_chunks(t, F.lit(40)).alias("chunks"))


@register("plan_validation", "SELECT s_suppkey, CASE WHEN s_suppkey % 12 NOT IN (3, 4, 5, 10) THEN 'quota' WHEN s_nationkey % 4 < 1 THEN 'no_collection' WHEN s_suppkey % 12 = 10 AND s_nationkey % 4 > 1 THEN 'too_many_collections' END AS refused FROM supplier")
def plan_validation(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", search.valid_plan(F.col("s_suppkey") % 12, F.col("s_nationkey") % 4).alias("refused"))


@register("terminal_pool", f"""WITH {FUSED}, e AS (SELECT * FROM (SELECT query_id, collection, item, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS p FROM fused) WHERE p <= 6),
pools AS (SELECT query_id, collection, count(*) AS available FROM e GROUP BY ALL), b AS (SELECT *, least(available, 2) AS base FROM pools),
s AS (SELECT *, unnest(range(1, available + 1)) AS slot FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot > base, greatest(slot - base, 0), available - base DESC, collection) AS turn FROM s),
n AS (SELECT query_id, collection, count(*) FILTER (WHERE turn <= 30) AS seats FROM t GROUP BY ALL)
SELECT query_id, collection, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS place FROM e JOIN n USING (query_id, collection) WHERE p <= seats""")
def terminal_pool(spark, sf_dir):
    return search.terminal_pool(fused(spark, sf_dir).select("query_id", "collection", "item", "score"), 6, 30, 2)


@register("rerank_dispatch", f"""WITH {FUSED}, p AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS place FROM fused)
SELECT query_id, item, place, CASE WHEN query_id % 3 <> 1 THEN round((place % 10) / 10, 6) END AS final, CASE WHEN query_id % 3 <> 1 THEN 'listwise' ELSE 'upstream' END AS scorer FROM p""")
def rerank_dispatch(spark, sf_dir):
    """Some queries' answers name a place twice or leave the range; these keep their order."""
    pool = fused_once(spark, sf_dir).select("query_id", "item", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")).alias("place"))
    bad = F.col("query_id") % 3 == 1
    answers = pool.select("query_id", F.when(bad & (F.col("place") == 2), 1).otherwise(F.col("place")).alias("place"), F.round((F.col("place") % 10) / 10, 6).alias("score"))
    return search.listwise(pool, answers).select("query_id", "item", "place", "final", "scorer")


@register("weighted_vector", """WITH a AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(text || ' {{v:3}}', '\\{\\{v:\\d+\\}\\}', ' ', 'g')), '[\\pL\\pN\\pM]+'))) AS term FROM benchmark),
b AS (SELECT item_id, unnest(regexp_extract_all('ref ' || item_id || ':1', '[\\pL\\pN\\pM]+')) AS term FROM benchmark) SELECT item_id, term, min(weight) AS weight FROM (SELECT *, 'A' AS weight FROM a UNION ALL SELECT *, 'B' FROM b) GROUP BY ALL""")
def weighted_vector(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    return search.weighted_postings(b, "item_id", F.concat("text", F.lit(" {{v:3}}")), F.concat(F.lit("ref "), F.col("item_id").cast("string"), F.lit(":1")))


@register("term_pair_prefilter", f"WITH {MATCHED} SELECT query_id, collection, count(*) AS n FROM matched WHERE n_terms NOT BETWEEN 3 AND 40 OR matched >= 2 GROUP BY ALL")
def term_pair_prefilter(spark, sf_dir):
    t = terms(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").alias("item"), "text")
    some = retrieval.matched_terms(retrieval.postings(docs, F.col("text"), t), t)
    return some.filter("n_terms NOT BETWEEN 3 AND 40 OR matched >= 2").groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("n"))


@register("context_fetch", f"WITH {PASSAGES}, n AS (SELECT DISTINCT doc_id, position // 10 AS chapter FROM passages WHERE length(content) % 97 = 3) SELECT doc_id, position // 10 AS chapter, count(*) AS n, string_agg(length(content)::VARCHAR, ',' ORDER BY position) AS lengths FROM passages WHERE (doc_id, position // 10) IN (SELECT doc_id, chapter FROM n) GROUP BY ALL")
def context_fetch(spark, sf_dir):
    """All passages of the chapters that some result needs, in order."""
    p = passages(spark, sf_dir).select("doc_id", F.floor(F.col("position") / 10).alias("chapter"), "position", F.length("content").alias("n"))
    got = p.join(p.filter("n % 97 = 3").select("doc_id", "chapter").distinct(), ["doc_id", "chapter"], "left_semi")
    lengths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "n"))), lambda x: x["n"].cast("string")), ",")
    return got.groupBy("doc_id", "chapter").agg(F.count(F.lit(1)).alias("n"), lengths.alias("lengths"))


@register("degradation_policy", """WITH e AS (SELECT user_id AS query_id, event_type AS reason, event_id % 4 AS stage FROM events WHERE value > 50),
p AS (SELECT * FROM (VALUES ('click', 'allow'), ('view', 'quarantine'), ('login', 'allow')) t(reason, action))
SELECT query_id, CASE max(CASE action WHEN 'allow' THEN 1 WHEN 'quarantine' THEN 2 ELSE 3 END) WHEN 1 THEN 'allow' WHEN 2 THEN 'quarantine' ELSE 'raise' END AS action, count(DISTINCT stage) AS stages FROM e LEFT JOIN p USING (reason) GROUP BY query_id""")
def degradation_policy(spark, sf_dir):
    e = load(spark, sf_dir, "events").filter("value > 50").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("reason"), (F.col("event_id") % 4).alias("stage"))
    return search.degraded(e, spark.sql("SELECT * FROM VALUES ('click', 'allow'), ('view', 'quarantine'), ('login', 'allow') AS t(reason, action)"))


@register("collection_relevance", f"WITH {FUSED}, r AS (SELECT query_id, collection, greatest(0, least(1, round(sum(score) * 4 - 1, 6))) AS relevance FROM fused GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, collection) AS place FROM r")
def collection_relevance(spark, sf_dir):
    s = fused(spark, sf_dir).groupBy("query_id", "collection").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.sum("score") * 4 - 1, 6))).alias("relevance"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "collection")))


@register("hashed_shuffle", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-7'), doc_id) AS place FROM documents")
def hashed_shuffle(spark, sf_dir):
    """A seeded order that is the same on every run."""
    d = load(spark, sf_dir, "documents")
    return d.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.concat_ws("-", "doc_id", F.lit(7))), "doc_id")).alias("place"))


@register("optional_two_keys", "WITH w AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS most FROM lineitem WHERE l_quantity > 48 GROUP BY ALL) SELECT l_orderkey, l_linenumber, most FROM lineitem LEFT JOIN w USING (l_partkey, l_suppkey)")
def optional_two_keys(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.join(li.filter("l_quantity > 48").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("most")), ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "most")


@register("points_copied", "SELECT vec_id, label, 100 + label AS copied_to, count(*) OVER (PARTITION BY label) AS points FROM embeddings WHERE label % 2 = 0")
def points_copied(spark, sf_dir):
    """The points of some collections under a new collection's name, with the count of each."""
    p = load(spark, sf_dir, "embeddings").filter("label % 2 = 0").select("vec_id", "label")
    n = p.groupBy("label").agg(F.count(F.lit(1)).alias("points"))
    return p.join(n, "label").select("vec_id", "label", (F.col("label") + 100).alias("copied_to"), "points")


@register("result_sink", f"WITH {FUSED} SELECT query_id, place, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS place FROM fused) WHERE place <= 10")
def result_sink(spark, sf_dir):
    """The ten best of each query, appended to a table and read back."""
    from ..store import materialize

    top = ranking.first_n(fused(spark, sf_dir), ["query_id"], 10)
    return materialize(top.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")).alias("place"), "item", "score"), "results")


# --- the registry

PIECES = """old AS (SELECT doc_id AS id, doc_id // 10 AS document, 'a' || doc_id % 10 AS anchor, doc_id % 10 // 3 AS chapter, doc_id % 10 AS position FROM documents),
new AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS id, CASE WHEN doc_id % 21 = 0 THEN doc_id // 10 + 1 ELSE doc_id // 10 END AS document, CASE WHEN doc_id % 14 = 0 THEN 'b' ELSE 'a' END || doc_id % 10 AS anchor,
  CASE WHEN doc_id // 10 % 3 = 0 THEN 9 ELSE doc_id % 10 // 3 END AS chapter, doc_id % 10 AS position FROM documents WHERE doc_id % 11 <> 0),
moves AS (SELECT doc_id AS old_id, doc_id + 1000000 AS new_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id % 7 <> 0),
removed AS (SELECT doc_id AS id FROM documents WHERE doc_id % 22 = 0)"""


def _pieces(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    i = F.col("i")
    document, at = F.floor(i / 10), i % 10
    old = d.select(i.alias("id"), document.alias("document"), F.concat(F.lit("a"), at.cast("string")).alias("anchor"), F.floor(at / 3).alias("chapter"), at.alias("position"))
    new = d.filter("i % 11 <> 0").select(F.when(i % 7 == 0, i + 1000000).otherwise(i).alias("id"), F.when(i % 21 == 0, document + 1).otherwise(document).alias("document"),
        F.concat(F.when(i % 14 == 0, "b").otherwise("a"), at.cast("string")).alias("anchor"), F.when(document % 3 == 0, 9).otherwise(F.floor(at / 3)).alias("chapter"), at.alias("position"))
    moves = d.select(i.alias("old_id"), F.when(i % 7 == 0, i + 1000000).otherwise(i).alias("new_id"))
    return old, new, moves, d.filter("i % 22 = 0").select(i.alias("id"))


@register("registry_override", "SELECT d.doc_id, coalesce(CASE WHEN l.doc_id % 2 = 0 THEN 'q' || l.quality END, d.lang) AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def registry_override(spark, sf_dir):
    reg = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("lang"))
    return registry.overridden(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), reg, "doc_id", ["lang"])


@register("renumbered", f"WITH {PIECES} SELECT id, document, row_number() OVER (PARTITION BY document ORDER BY position, id) - 1 AS position FROM old WHERE id NOT IN (SELECT id FROM removed)")
def renumbered(spark, sf_dir):
    old, _, _, removed = _pieces(spark, sf_dir)
    return registry.without_removed(old, removed).select("id", "document", "position")


@register("open_removals", f"""WITH {PIECES}, r AS (SELECT id, document, anchor, id % 3 = 0 AS closed FROM old WHERE id % 22 = 0 UNION ALL SELECT NULL, document, anchor, false FROM old WHERE id % 31 = 0 UNION ALL SELECT NULL, document, NULL, false FROM old WHERE id % 170 = 0)
SELECT id, CASE WHEN id IN (SELECT id FROM r WHERE NOT closed AND id IS NOT NULL) THEN 'id' WHEN (document, anchor) IN (SELECT document, anchor FROM r WHERE NOT closed AND id IS NULL AND anchor IS NOT NULL) THEN 'anchor' ELSE 'document' END AS by FROM old
WHERE id IN (SELECT id FROM r WHERE NOT closed AND id IS NOT NULL) OR (document, anchor) IN (SELECT document, anchor FROM r WHERE NOT closed AND id IS NULL AND anchor IS NOT NULL) OR document IN (SELECT document FROM r WHERE NOT closed AND id IS NULL AND anchor IS NULL)""")
def open_removals(spark, sf_dir):
    old, *_ = _pieces(spark, sf_dir)
    none = F.lit(None).cast("long")
    r = old.filter("id % 22 = 0").select("id", "document", "anchor", (F.col("id") % 3 == 0).alias("closed"))
    r = r.union(old.filter("id % 31 = 0").select(none, "document", "anchor", F.lit(False))).union(old.filter("id % 170 = 0").select(none, "document", F.lit(None).cast("string"), F.lit(False)))
    return registry.open_removal(old, r)


@register("retirement_plan", f"""WITH {PIECES}, gone AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)),
t AS (SELECT g.id, arg_min(m.new_id, (n.document <> g.document, n.document, n.position, n.id)) AS target FROM gone g JOIN moves m ON m.old_id = g.id JOIN new n ON n.id = m.new_id GROUP BY g.id)
SELECT g.id, CASE WHEN t.target IS NOT NULL THEN 'redirect' WHEN g.id IN (SELECT id FROM removed) THEN 'tombstone' ELSE 'unexplained' END AS kind, t.target FROM gone g LEFT JOIN t USING (id)""")
def retirement_plan(spark, sf_dir):
    return registry.retirement(*_pieces(spark, sf_dir))


@register("anchor_redirects", f"WITH {PIECES} SELECT document, anchor, arg_min(new_id, (id, new_id)) AS target FROM old JOIN moves ON old_id = id WHERE (document, anchor) NOT IN (SELECT document, anchor FROM new) GROUP BY ALL")
def anchor_redirects(spark, sf_dir):
    old, new, moves, _ = _pieces(spark, sf_dir)
    return registry.anchor_redirects(old, new, moves)


@register("chapter_redirects", f"""WITH {PIECES}, v AS (SELECT o.document, o.chapter, n.chapter AS target, count(*) AS n FROM old o JOIN moves m ON m.old_id = o.id JOIN new n ON n.id = m.new_id WHERE (o.document, o.chapter) NOT IN (SELECT document, chapter FROM new) GROUP BY ALL)
SELECT document, chapter, target, round(n / total, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY document, chapter) AS total, row_number() OVER (PARTITION BY document, chapter ORDER BY n DESC, target) AS r FROM v) WHERE r = 1""")
def chapter_redirects(spark, sf_dir):
    old, new, moves, _ = _pieces(spark, sf_dir)
    return registry.chapter_redirects(old, new, moves)


@register("id_failures", f"""WITH {PIECES}, twice AS (SELECT * FROM new UNION ALL SELECT * FROM new WHERE id % 130 = 0)
SELECT id, 'duplicate_id' AS problem FROM twice GROUP BY id HAVING count(*) > 1 UNION SELECT o.id, 'anchor_reused' FROM old o JOIN twice n USING (document, anchor) WHERE o.id <> n.id
UNION SELECT id, 'removed_but_built' FROM removed WHERE id IN (SELECT id FROM twice) UNION SELECT id, 'unexplained' FROM old WHERE id NOT IN (SELECT id FROM twice) AND id NOT IN (SELECT id FROM removed)""")
def id_failures(spark, sf_dir):
    old, new, _, removed = _pieces(spark, sf_dir)
    return registry.id_failures(old, new.union(new.filter("id % 130 = 0")), removed)


@register("frozen_ids", f"WITH {PIECES} SELECT n.document, n.anchor, coalesce(o.id::VARCHAR, md5(n.document || '#' || n.anchor)) AS id FROM new n LEFT JOIN old o ON n.document = o.document AND n.anchor = o.anchor AND o.id % 2 = 0")
def frozen_ids(spark, sf_dir):
    """The frozen id of a place, else one made of its name (an MD5 here, so that SQL can follow; `passage_uuids` gives the UUIDs)."""
    old, new, _, _ = _pieces(spark, sf_dir)
    frozen = old.filter("id % 2 = 0").withColumn("id", F.col("id").cast("string"))
    return registry.frozen_ids(new.select("document", "anchor"), frozen, F.md5(F.concat_ws("#", "document", "anchor"))).select("document", "anchor", "id")


@register("passage_uuids")
def passage_uuids(spark, sf_dir):
    old, new, _, _ = _pieces(spark, sf_dir)
    frozen = old.filter("id % 2 = 0").withColumn("id", F.col("id").cast("string"))
    return registry.frozen_ids(new.select("document", "anchor"), frozen, uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("#", "document", "anchor"))).select("document", "anchor", "id")


@register("coverage_regressions", """WITH a AS (SELECT source AS file, round(avg((n_chars > 400)::INT), 6) AS share FROM documents WHERE source <> 'src1' GROUP BY 1), b AS (SELECT source AS file, round(avg((n_chars > 300)::INT), 6) AS share FROM documents WHERE source <> 'src2' GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'stale' WHEN b.file IS NULL THEN 'new' WHEN round(b.share - a.share, 9) > 0.005 THEN 'regressed' END AS status FROM a FULL JOIN b ON a.file = b.file) WHERE status IS NOT NULL""")
def coverage_regressions(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    share = lambda n, but: d.filter(F.col("source") != but).groupBy(F.col("source").alias("file")).agg(F.round(F.avg((F.col("n_chars") > n).cast("int")), 6).alias("share"))
    return registry.coverage_changes(share(400, "src1"), share(300, "src2"))


@register("fragment_status", """WITH l AS (SELECT page_id AS link_id, CASE WHEN page_id % 9 = 0 THEN -1 ELSE page_id END AS page_id, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 4 = 0 THEN '</p>' WHEN page_id % 4 = 1 THEN '</html>' ELSE 'no such words' END AS fragment FROM pages)
SELECT link_id, CASE WHEN p.html IS NULL THEN 'no_page' WHEN fragment = '' THEN 'no_fragment' WHEN len(string_split(p.html, fragment)) = 1 THEN 'missing' WHEN len(string_split(p.html, fragment)) = 2 THEN 'found' ELSE 'repeated' END AS status FROM l LEFT JOIN pages p ON p.page_id = l.page_id""")
def fragment_status(spark, sf_dir):
    p, i = load(spark, sf_dir, "pages"), F.col("page_id")
    links = p.select(i.alias("link_id"), F.when(i % 9 == 0, -1).otherwise(i).alias("page_id"), F.when(i % 5 == 0, "").when(i % 4 == 0, "</p>").when(i % 4 == 1, "</html>").otherwise("no such words").alias("fragment"))
    return registry.fragments_found(p.select("page_id", F.col("html").alias("text")), links)


@register("grouped_units", f"WITH {PASSAGES}, g AS (SELECT doc_id, length(content) AS n, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 600 AS grp FROM passages) SELECT doc_id, grp, count(*) AS units, sum(n) AS n FROM g GROUP BY ALL")
def grouped_units(spark, sf_dir):
    p = passages(spark, sf_dir).select("doc_id", "position", F.length("content").alias("n"))
    return registry.grouped_to(p, "doc_id", "position", "n", 600).groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"))


@register("expired_rows", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def expired_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return registry.expired(e.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("ts"), F.col("now"), 10).select("event_id")


@register("facet_index", "SELECT vec_id, i AS facet, embedding[i + 1] AS value FROM embeddings, range(3) t(i) WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 0, 0.5 FROM embeddings WHERE vec_id % 4 = 0")
def facet_index(spark, sf_dir):
    """A point for each facet; the points of replaced passages go before the new, fewer ones come."""
    e = load(spark, sf_dir, "embeddings")
    points = e.select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("facet", "value"))
    new = e.filter("vec_id % 4 = 0").select("vec_id", F.lit(0).alias("facet"), F.lit(0.5).alias("value"))
    return points.join(new.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(new)


@register("outline_refresh", f"""WITH {PASSAGES}, touched AS (SELECT DISTINCT doc_id FROM passages WHERE length(content) % 50 = 7), stored AS (SELECT doc_id, -1 AS chapter, 0 AS n FROM (SELECT DISTINCT doc_id FROM passages))
SELECT * FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM touched) UNION ALL SELECT doc_id, position // 10, count(*) FROM passages WHERE doc_id IN (SELECT doc_id FROM touched) GROUP BY ALL""")
def outline_refresh(spark, sf_dir):
    """Outlines of touched documents are made again; the others stay as stored."""
    p = passages(spark, sf_dir).select("doc_id", "position", F.length("content").alias("len"))
    touched = p.filter("len % 50 = 7").select("doc_id").distinct()
    stored = p.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("chapter"), F.lit(0).cast("long").alias("n"))
    made = p.join(touched, "doc_id", "left_semi").groupBy("doc_id", F.floor(F.col("position") / 10).alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    return stored.join(touched, "doc_id", "left_anti").unionByName(made)


@register("notes_valid", "SELECT event_id, json_extract_string(props, '$.page') IS NOT NULL AND length(trim(json_extract_string(props, '$.page'))) > 0 AS valid FROM events")
def notes_valid(spark, sf_dir):
    page = F.get_json_object("props", "$.page")
    return load(spark, sf_dir, "events").select("event_id", (page.isNotNull() & (F.length(F.trim(page)) > 0)).alias("valid"))


@register("step_costs", "SELECT user_id, event_type AS step, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def step_costs(spark, sf_dir):
    """Costs of a user's steps as a map, and opened again."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("c"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("step", "cost"))


@register("verse_ranges", "SELECT o_orderkey, unnest(range(1 + o_orderkey % 20, 1 + o_orderkey % 20 + o_custkey % 4 + 1)) AS verse FROM orders")
def verse_ranges(spark, sf_dir):
    """References of the form `Book 3:4-7` opened to their verses."""
    ref = F.concat(F.lit("Book 3:"), (1 + F.col("o_orderkey") % 20).cast("string"), F.lit("-"), (1 + F.col("o_orderkey") % 20 + F.col("o_custkey") % 4).cast("string"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    at = lambda g: F.regexp_extract("ref", r"(\d+):(\d+)[-–](\d+)", g).cast("long")
    return o.select("o_orderkey", F.explode(F.sequence(at(2), at(3))).alias("verse"))


@register("piece_units", f"WITH {PASSAGES}, p AS (SELECT doc_id || '/u' || position // 5 || CASE WHEN position % 5 > 0 THEN '/from-' || position ELSE '' END AS anchor FROM passages) SELECT string_split(anchor, '/from-')[1] AS unit, count(*) AS pieces FROM p GROUP BY 1")
def piece_units(spark, sf_dir):
    """Anchors of pieces lead back to their unit."""
    at = F.when(F.col("position") % 5 > 0, F.concat(F.lit("/from-"), F.col("position").cast("string"))).otherwise("")
    p = passages(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit("/u"), F.floor(F.col("position") / 5).cast("string"), at).alias("anchor"))
    return p.groupBy(F.element_at(F.split("anchor", "/from-"), 1).alias("unit")).agg(F.count(F.lit(1)).alias("pieces"))


@register("saved_labels", "WITH s AS (SELECT DISTINCT user_id, event_id % 40 AS passage, event_type AS label FROM events), d AS (SELECT user_id, passage FROM s WHERE label = 'purchase') SELECT user_id, label, count(*) AS n FROM s WHERE (user_id, passage) NOT IN (SELECT user_id, passage FROM d) GROUP BY ALL")
def saved_labels(spark, sf_dir):
    """Labels of saved passages, less those of passages whose saving was undone."""
    s = load(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("passage"), F.col("event_type").alias("label")).distinct()
    return s.join(s.filter("label = 'purchase'").select("user_id", "passage"), ["user_id", "passage"], "left_anti").groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("n"))
