"""Registered queries: retrieval, fusion and the ordering steps after it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import register
from ..functions.stems import stems
from ..functions.text import words
from ..functions.vectors import cosine
from ..operators import ranking, retrieval
from ..session import load
from .inputs import FUSED, MATCHED, PASSAGES, PATHS, POINTS, POSTINGS, VOCABULARY, asked, fused, fused_once, paths, passages, points, posted, terms


@register("vector_topk", f"WITH {PATHS} SELECT query_id, collection, item, score, rank FROM paths WHERE path_no = 0 AND rank <= 10")
def vector_topk(spark, sf_dir):
    q = asked(spark, sf_dir).filter("path_no = 0")
    return retrieval.vector_paths(q, retrieval.with_norms(points(spark, sf_dir)), 10, min_score=None).select("query_id", "collection", "item", "score", "rank")


@register("vector_threshold", f"WITH {PATHS} SELECT query_id, collection, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, path_no ORDER BY score DESC, item) AS r FROM near WHERE path_no = 0 AND score >= 0.2) WHERE r <= 10")
def vector_threshold(spark, sf_dir):
    q = asked(spark, sf_dir).filter("path_no = 0")
    return retrieval.vector_paths(q, retrieval.with_norms(points(spark, sf_dir)), 10, min_score=0.2).select("query_id", "collection", "item", "score")


@register("vector_multi_path", f"WITH {PATHS} SELECT query_id, collection, family, path_no, item, score, rank FROM paths")
def vector_multi_path(spark, sf_dir):
    return paths(spark, sf_dir).select("query_id", "collection", "family", "path_no", "item", "score", "rank")


@register("rrf_fusion", f"WITH {FUSED} SELECT * FROM fused")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir)


SOURCED = f"{FUSED}, sourced AS (SELECT *, item // 10 AS source FROM fused)"


@register("source_cap", f"WITH {SOURCED} SELECT query_id, item, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item) AS r FROM sourced) WHERE r <= 2")
def source_cap(spark, sf_dir):
    rows = fused(spark, sf_dir).withColumn("source", F.floor(F.col("item") / 10))
    return ranking.first_n(rows, ["query_id", "source"], 2).select("query_id", "item", "source", "score")


@register("quota_cap", f"WITH {FUSED} SELECT query_id, collection, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS r FROM fused) WHERE r <= 4")
def quota_cap(spark, sf_dir):
    return ranking.first_n(fused(spark, sf_dir), ["query_id", "collection"], 4).select("query_id", "collection", "item", "score")


@register("hybrid_search", f"""WITH {SOURCED}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item) AS r FROM sourced) WHERE r <= 2),
quoted AS (SELECT * FROM (SELECT query_id, collection, item, score, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS q FROM capped) WHERE q <= 4)
SELECT query_id, collection, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS place FROM quoted""")
def hybrid_search(spark, sf_dir):
    """The flagship: paths, fusion, per-source cap, quota, final order."""
    rows = fused(spark, sf_dir).withColumn("source", F.floor(F.col("item") / 10))
    kept = ranking.first_n(ranking.first_n(rows, ["query_id", "source"], 2), ["query_id", "collection"], 4)
    return kept.select("query_id", "collection", "item", "score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")).alias("place"))


@register("adaptive_grain", f"""WITH {FUSED}, c AS (SELECT *, CASE WHEN item % 7 = 0 AND collection < 3 THEN NULL ELSE item % 5 END AS chapter, item // 20 AS title FROM fused),
w AS (SELECT *, bool_and(chapter IS NOT NULL) OVER (PARTITION BY query_id, collection) AS whole FROM c)
SELECT query_id, item, CASE WHEN collection IN (0, 1, 2, 3, 4, 5) AND whole THEN 'chapter:' || title || ':' || chapter ELSE 'title:' || title END AS source_key FROM w""")
def adaptive_grain(spark, sf_dir):
    chapter = F.when((F.col("item") % 7 == 0) & (F.col("collection") < 3), F.lit(None)).otherwise(F.col("item") % 5)
    rows = fused(spark, sf_dir).withColumn("chapter", chapter).withColumn("title", F.floor(F.col("item") / 20))
    return ranking.adaptive_source(rows, [str(i) for i in range(6)], "chapter", "title").select("query_id", "item", "source_key")


KEPT = f"{FUSED}, kept AS (SELECT query_id, collection, item, score FROM fused WHERE score >= 0.09)"


@register("collection_guarantee", f"""WITH {KEPT}, wanted AS (SELECT DISTINCT query_id, collection FROM fused),
missing AS (SELECT * FROM wanted ANTI JOIN kept USING (query_id, collection)),
best AS (SELECT * FROM (SELECT f.query_id, f.collection, f.item, f.score, row_number() OVER (PARTITION BY query_id, collection ORDER BY f.score DESC, f.item) AS r FROM fused f SEMI JOIN missing USING (query_id, collection) WHERE f.score >= 0.04) WHERE r = 1)
SELECT * FROM kept UNION ALL SELECT query_id, collection, item, score FROM best""")
def collection_guarantee(spark, sf_dir):
    rows = fused_once(spark, sf_dir).select("query_id", "collection", "item", "score")
    return ranking.guarantee(rows.filter("score >= 0.09"), rows, rows.select("query_id", "collection").distinct(), 0.04)


@register("min_floor", f"""WITH {FUSED}, c AS (SELECT query_id, item, score, item // 20 AS work, item % 5 AS chapter FROM fused WHERE query_id % 2 = 0),
fine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, work, chapter ORDER BY score DESC, item) AS r FROM c) WHERE r = 1),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id, work ORDER BY score DESC, item) > 1 AS again FROM fine)
SELECT query_id, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, score DESC, item) AS n FROM again) WHERE n <= 5""")
def min_floor(spark, sf_dir):
    rows = fused_once(spark, sf_dir).withColumn("work", F.floor(F.col("item") / 20)).withColumn("chapter", F.col("item") % 5)
    return ranking.minimum_floor(rows.filter("query_id % 2 = 1"), rows, "work", "chapter", 5).select("query_id", "item", "score")


@register("greedy_pack", f"""WITH {FUSED}, c AS (SELECT query_id, item, score, 1 + item % 17 AS cost FROM fused),
p AS (SELECT *, row_number() OVER w AS packed, sum(cost) OVER w AS spent FROM c WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING))
SELECT query_id, item, packed, spent FROM p WHERE packed = 1 OR (spent <= 90 AND packed <= 100)""")
def greedy_pack(spark, sf_dir):
    rows = fused(spark, sf_dir).withColumn("cost", 1 + F.col("item") % 17)
    return ranking.greedy_pack(rows, "cost", 90, 100).select("query_id", "item", "packed", "spent")


@register("terminal_seats", f"WITH {FUSED} SELECT query_id, count(DISTINCT collection) AS collections, greatest(10, least(25, 80 // count(DISTINCT collection))) AS seats FROM fused GROUP BY query_id")
def terminal_seats(spark, sf_dir):
    n = fused(spark, sf_dir).groupBy("query_id").agg(F.count_distinct("collection").alias("collections"))
    return n.withColumn("seats", ranking.terminal_seats(F.lit(80), F.col("collections"), 10, 25))


@register("pool_allocation", f"""WITH {FUSED}, pools AS (SELECT query_id, collection, count(*) AS available FROM fused GROUP BY ALL),
b AS (SELECT *, least(available, 2) AS base FROM pools),
f AS (SELECT *, sum(base) OVER (PARTITION BY query_id) AS floors, row_number() OVER (PARTITION BY query_id ORDER BY available DESC, collection) AS big FROM b),
s AS (SELECT *, unnest(range(1, available + 1)) AS slot FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot > base, greatest(slot - base, 0), available - base DESC, collection) AS turn FROM s)
SELECT query_id, collection, available, CASE WHEN any_value(floors) > 40 THEN (any_value(big) <= 40)::BIGINT ELSE count(*) FILTER (WHERE turn <= 40) END AS seats FROM t GROUP BY ALL""")
def pool_allocation(spark, sf_dir):
    pools = fused(spark, sf_dir).groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("available")).withColumn("arrival", F.col("collection"))
    return ranking.allocate(pools, 40, 2)


@register("fallback_scores", f"""WITH {FUSED}, s AS (SELECT query_id, collection, item, score * 2 AS s FROM fused WHERE collection % 3 <> 0 AND item % 4 <> 0),
h AS (SELECT DISTINCT query_id, collection FROM s),
j AS (SELECT f.query_id, f.collection, f.item, f.score, s.s, h.query_id IS NOT NULL AS has, row_number() OVER (PARTITION BY f.query_id, f.collection ORDER BY f.score DESC, f.item) - 1 AS place
  FROM fused f LEFT JOIN s USING (query_id, collection, item) LEFT JOIN h ON f.query_id = h.query_id AND f.collection = h.collection)
SELECT query_id, item, round(CASE WHEN has THEN coalesce(s, 0) ELSE greatest(0, 0.4::DOUBLE - 0.01::DOUBLE * place) END, 6) AS final, CASE WHEN has THEN 'scorer' ELSE 'rrf_fallback' END AS scorer FROM j""")
def fallback_scores(spark, sf_dir):
    rows = fused_once(spark, sf_dir)
    scored = rows.filter("collection % 3 <> 0 AND item % 4 <> 0").withColumn("score", F.col("score") * 2)
    return ranking.fallback_scores(rows, scored).select("query_id", "item", "final", "scorer")


PAIRS = f"""{POINTS}, r AS (SELECT item % 10 AS query_id, item // 50 AS document, (item // 10) % 5 AS position, item, vector, round(list_cosine_similarity(vector, (SELECT vector FROM points WHERE item = 0)), 6) AS score FROM points),
pairs AS (SELECT a.query_id, a.document, a.item AS a_item, b.item AS b_item FROM r a JOIN r b ON a.query_id = b.query_id AND a.document = b.document AND abs(a.position - b.position) <= 2
  AND (a.score > b.score OR (a.score = b.score AND a.item < b.item)) AND round(list_cosine_similarity(a.vector, b.vector), 6) > 0.05)"""


def _near(spark, sf_dir):
    p = points(spark, sf_dir)
    head = F.broadcast(p.filter("item = 0").select(F.col("vector").alias("_v")))  # one row
    rows = p.join(head).select((F.col("item") % 10).alias("query_id"), F.floor(F.col("item") / 50).alias("document"), (F.floor(F.col("item") / 10) % 5).alias("position"), "item", "vector", F.round(cosine(F.col("vector"), F.col("_v")), 6).alias("score"))
    return rows, ranking.near_pairs(rows, F.round(cosine(F.col("a_vector"), F.col("b_vector")), 6) > 0.05)


@register("near_dup_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    return _near(spark, sf_dir)[1].select(F.col("a_query_id").alias("query_id"), F.col("a_document").alias("document"), "a_item", "b_item")


@register("near_dup_drop", f"""WITH RECURSIVE {PAIRS}, o AS MATERIALIZED (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, p.document ORDER BY a.score DESC, a_item, b.score DESC, b_item) AS rn FROM pairs p JOIN r a ON a.item = a_item JOIN r b ON b.item = b_item),
g AS (SELECT DISTINCT query_id, document, 0::BIGINT AS rn, []::BIGINT[] AS gone FROM o
  UNION ALL SELECT o.query_id, o.document, o.rn, CASE WHEN list_contains(g.gone, o.a_item) OR list_contains(g.gone, o.b_item) THEN g.gone ELSE list_append(g.gone, o.b_item) END FROM g JOIN o ON o.query_id = g.query_id AND o.document = g.document AND o.rn = g.rn + 1),
l AS (SELECT unnest(arg_max(gone, rn)) AS item FROM g GROUP BY query_id, document)
SELECT query_id, item, score FROM r ANTI JOIN l USING (item)""")
def near_dup_drop(spark, sf_dir):
    rows, pairs = _near(spark, sf_dir)
    return ranking.drop_near_duplicates(rows, pairs).select("query_id", "item", "score")


@register("fts_and", f"WITH {MATCHED} SELECT query_id, collection, item, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY weight DESC, item) AS rank FROM matched WHERE matched = n_terms) WHERE rank <= 10")
def fts_and(spark, sf_dir):
    t = terms(spark, sf_dir)
    return retrieval.fts_and(posted(spark, sf_dir, t), t, 10).select("query_id", "collection", "item", "weight", "rank")


@register("fts_min_match", f"""WITH {MATCHED}, m AS (SELECT *, max(matched) OVER (PARTITION BY query_id, collection) AS most FROM matched)
SELECT query_id, collection, item, matched, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY matched DESC, weight DESC, item) AS rank FROM m WHERE matched >= least(ceil(n_terms / 2), most)) WHERE rank <= 10""")
def fts_min_match(spark, sf_dir):
    t = terms(spark, sf_dir)
    return retrieval.fts_min_match(posted(spark, sf_dir, t), t, 10).select("query_id", "collection", "item", "matched", "weight", "rank")


@register("bm25_weights", f"WITH {VOCABULARY}, {POSTINGS} SELECT item, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256)), 6) AS weight FROM postings")
def bm25_weights(spark, sf_dir):
    return posted(spark, sf_dir).select("item", "term", F.round(retrieval.bm25(F.col("tf"), F.col("length")), 6).alias("weight"))


@register("document_frequencies", f"WITH {VOCABULARY}, {POSTINGS} SELECT collection, term, count(*) AS df FROM postings GROUP BY ALL")
def document_frequencies(spark, sf_dir):
    return posted(spark, sf_dir).groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"))


@register("outcome_classification", f"""WITH {FUSED}, c AS (SELECT query_id, collection, count(*) AS candidates_before, count(*) FILTER (WHERE item % 3 > 0) AS candidates, count(*) FILTER (WHERE item % 3 > 0 AND item % 5 > 1) AS ranked,
  count(*) FILTER (WHERE item % 3 > 0 AND item % 5 > 1 AND score >= 0.08) AS final, collection % 4 = 0 AS degraded FROM fused GROUP BY ALL)
SELECT query_id, collection, CASE WHEN final > 0 AND degraded THEN 'results_degraded' WHEN final > 0 THEN 'results' WHEN candidates_before > 0 AND candidates = 0 THEN 'corpus_sync_failed'
  WHEN candidates = 0 AND degraded THEN 'retrieval_failed' WHEN candidates > 0 AND ranked = 0 THEN 'ranking_failed' WHEN candidates > 0 THEN 'below_threshold' ELSE 'no_candidates' END AS outcome FROM c""")
def outcome_classification(spark, sf_dir):
    kept, ranked = F.col("item") % 3 > 0, F.col("item") % 5 > 1
    c = fused(spark, sf_dir).groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("candidates_before"), F.count_if(kept).alias("candidates"), F.count_if(kept & ranked).alias("ranked"), F.count_if(kept & ranked & (F.col("score") >= 0.08)).alias("final"))
    c = c.withColumn("degraded", F.col("collection") % 4 == 0).withColumn("retrieval_degraded", F.col("degraded"))
    return ranking.outcomes(c).select("query_id", "collection", "outcome")


@register("interval_merge", """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 20000 + (event_id % 7) * 5000 AS e FROM events),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, min(s) AS s, max(e) AS e FROM r GROUP BY user_id, run""")
def interval_merge(spark, sf_dir):
    s = F.unix_timestamp("ts")
    rows = load(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + 20000 + (F.col("event_id") % 7) * 5000).alias("e"))
    return ranking.merged_intervals(rows, "user_id", "s", "e")


@register("stitch_context", f"""WITH {PASSAGES}, r AS (SELECT doc_id AS document, position // 10 AS chapter, position, CASE length(content) % 4 WHEN 0 THEN 'objection' WHEN 1 THEN 'reply' WHEN 2 THEN 'determination' END AS role FROM passages),
m AS (SELECT *, min(CASE WHEN role = 'determination' THEN position END) OVER w AS nd, min(CASE WHEN role = 'reply' THEN position END) OVER w AS nr, role IS DISTINCT FROM lag(role) OVER (PARTITION BY document, chapter ORDER BY position) AS new
  FROM r WINDOW w AS (PARTITION BY document, chapter ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY document, chapter ORDER BY position) AS run FROM m),
d AS (SELECT document, chapter, run, min(position) AS det_from, max(position) AS det_to FROM g WHERE role = 'determination' GROUP BY ALL)
SELECT g.document, g.chapter, g.position, d.det_from, d.det_to FROM g JOIN d ON g.document = d.document AND g.chapter = d.chapter AND g.nd = d.det_from WHERE role = 'objection' AND (nr IS NULL OR nd < nr)""")
def stitch_context(spark, sf_dir):
    kind = F.length("content") % 4
    role = F.when(kind == 0, "objection").when(kind == 1, "reply").when(kind == 2, "determination")
    rows = passages(spark, sf_dir).select(F.col("doc_id").alias("document"), F.floor(F.col("position") / 10).alias("chapter"), "position", role.alias("role"))
    return ranking.stitch(rows)


@register("stitched_texts", f"""WITH {PASSAGES}, r AS (SELECT doc_id AS document, position // 10 AS chapter, position, content FROM passages), asked AS (SELECT * FROM r WHERE length(content) % 4 = 0),
spans AS (SELECT document, chapter, position AS id, p FROM asked, (VALUES (0), (1), (2), (3), (6)) v(k), LATERAL (SELECT position + k - 1 AS p)),
held AS (SELECT DISTINCT s.document, s.chapter, s.id, r.position, r.content FROM spans s JOIN r ON r.document = s.document AND r.chapter = s.chapter AND r.position = s.p WHERE trim(r.content) <> '')
SELECT document, chapter, id AS position, min(position) AS first, max(position) AS last, count(*) AS n, md5(string_agg(content, chr(10) || chr(10) ORDER BY position)) AS digest FROM held GROUP BY ALL""")
def stitched_texts(spark, sf_dir):
    """Each asked passage with two spans that overlap (the one before to the one after, it to two on) and one further on."""
    rows = passages(spark, sf_dir).select(F.col("doc_id").alias("document"), F.floor(F.col("position") / 10).alias("chapter"), "position", "content")
    asked = rows.filter("length(content) % 4 = 0").select((F.col("document") * 100000 + F.col("position")).alias("id"), "document", "chapter", "position")
    pos = F.col("position")
    spans = asked.select("id", "document", "chapter", F.explode(F.array(*[F.struct((pos + a).alias("first"), (pos + b).alias("last")) for a, b in ((-1, 1), (0, 2), (5, 5))])).alias("s")).select("id", "document", "chapter", "s.first", "s.last")
    return ranking.assembled(asked, spans, rows).select("document", "chapter", "position", "first", "last", "n", F.md5("text").alias("digest"))


@register("word_stems", f"WITH {VOCABULARY} SELECT word, stem FROM st")
def word_stems(spark, sf_dir):
    both = load(spark, sf_dir, "documents").select("text").union(load(spark, sf_dir, "benchmark").select("text"))
    return stems(both.select(F.explode(words(F.col("text"))).alias("word")).distinct())
