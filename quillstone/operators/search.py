"""Whole searches over both kinds of path, and the contracts around scorers; rows are keyed by query_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..store import materialize
from . import ranking, relational, retrieval


@dataclass(frozen=True)
class SearchConfig:
    """What a named search varies: depth of its paths, fusion, floors and caps."""

    depth: int = 20
    least_cosine: float | None = 0.1
    rrf_k: int = 20
    top_n: int = 8
    floor: float = 0.06
    per_source: int = 2
    quota: int = 4
    guarantee: float = 0.03


#: The searches by name; each differs from the first in what its name says.
CONFIGS = {
    "both": SearchConfig(), "deep": SearchConfig(depth=40, top_n=16), "focused": SearchConfig(per_source=4, quota=10), "strict": SearchConfig(floor=0.09), "flat": SearchConfig(rrf_k=60),
}


def hybrid(queries: DataFrame, terms: DataFrame, points: DataFrame, posted: DataFrame, facts: DataFrame, config: SearchConfig = CONFIGS["both"]) -> DataFrame:
    """(query_id, collection, item, source, score, place, delivery): the whole search.

    queries: (query_id, collection, family, path_no, skip, vector); terms: (query_id, term,
    n_terms); points and posted: both stores; facts: (item, source) of visible items. Vector
    paths (above a cosine) and keyword paths (least matches) are fused; items without facts are
    orphans or hidden and fall out; the floor keeps the best one where none reaches it; sources
    and collections are capped; a collection left without a row gets its best candidate; a query
    left without any gets one a source. delivery tells whether each collection filled its quota.
    """
    vector = retrieval.vector_paths(queries, retrieval.with_norms(points), config.depth, config.least_cosine)
    keyword = retrieval.fts_min_match(posted, terms, config.depth).select("query_id", "collection", F.lit("keyword").alias("family"), F.lit(99).alias("path_no"), "item", "rank")
    paths = vector.select("query_id", "collection", "family", F.col("path_no").cast("int").alias("path_no"), "item", "rank").unionByName(keyword)
    fused = retrieval.rrf(paths, config.rrf_k, config.top_n).join(facts, "item").select("query_id", "collection", "item", "source", "score")
    fused = materialize(fused, "search-fused")  # capped rows a query; the steps below read them several times
    kept = relational.keep_floor(fused, ["query_id", "collection"], config.floor)
    kept = ranking.first_n(ranking.first_n(kept, ["query_id", "source"], config.per_source), ["query_id", "collection"], config.quota)
    kept = ranking.guarantee(materialize(kept, "search-kept"), fused, fused.select("query_id", "collection").distinct(), config.guarantee)
    kept = kept.unionByName(ranking.minimum_floor(kept, fused, "source", "collection", min(config.quota, 5)))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item")
    filled = F.count(F.lit(1)).over(W.partitionBy("query_id", "collection")) >= config.quota
    return kept.withColumn("place", F.row_number().over(order)).withColumn("delivery", F.when(filled, "complete").otherwise("underfilled"))


def depth(pool: Column, paths: Column, least: int = 10, most: int = 60) -> Column:
    """How many rows each path should bring so that paths together fill the pool half again."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(pool / paths * 1.5)))


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def billing_chunks(doc_tokens: Column, query_tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.least(doc_tokens, F.lit(1500)) + query_tokens) / 500))


def valid_plan(quota: Column, collections: Column) -> Column:
    """Why a plan is refused, or null: quotas are 3, 4, 5 or 10, and 10 goes with one collection only."""
    return F.when(~quota.isin(3, 4, 5, 10), "quota").when(collections < 1, "no_collection").when((quota == 10) & (collections > 1), "too_many_collections")


def terminal_pool(rows: DataFrame, keep: int, cap: int, floor: int) -> DataFrame:
    """The best `keep` of each collection, cut to the seats that its collection is dealt, in one order over all collections."""
    eligible = ranking.first_n(rows, ["query_id", "collection"], keep)
    pools = eligible.groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("available")).withColumn("arrival", F.col("collection"))
    seats = ranking.allocate(pools, cap, floor).select("query_id", "collection", "seats")
    place = F.row_number().over(W.partitionBy("query_id", "collection").orderBy(F.desc("score"), "item"))
    kept = eligible.join(seats, ["query_id", "collection"]).withColumn("_p", place).filter(F.col("_p") <= F.col("seats"))
    return kept.select("query_id", "collection", "item", "score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")).alias("place"))


def listwise(pool: DataFrame, answers: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """pool(query_id, place, ..) with final and scorer from answers(query_id, place, score).

    A query's answer counts if it scores every place exactly once, within the range; any
    violation leaves the order as it was.
    """
    want = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("_want"))
    got = answers.join(pool.select("query_id", "place", F.lit(1).alias("_in")), ["query_id", "place"], "left").groupBy("query_id")
    got = got.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("place").alias("_d"), F.count("_in").alias("_in"), F.min("score").alias("_low"), F.max("score").alias("_high"), F.count("score").alias("_s"))
    fine = (F.col("_n") == F.col("_want")) & (F.col("_d") == F.col("_n")) & (F.col("_in") == F.col("_n")) & (F.col("_s") == F.col("_n")) & F.col("_low").between(low, high) & F.col("_high").between(low, high)
    ok = want.join(got, "query_id").filter(fine).select("query_id", F.lit(True).alias("_ok"))
    out = pool.join(ok, "query_id", "left").join(answers.join(ok, "query_id", "left_semi").select("query_id", "place", F.col("score").alias("final")), ["query_id", "place"], "left")
    return out.withColumn("scorer", F.when(F.col("_ok"), "listwise").otherwise("upstream")).drop("_ok")


def weighted_postings(rows: DataFrame, key: str, content: Column, reference: Column) -> DataFrame:
    """(key, term, weight): distinct words of the content (A) and of the reference (B); markers and punctuation are no words."""
    word = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\pL\\pN\\pM]+"), 0))
    of = lambda c, w: rows.select(key, F.explode(word(c)).alias("term"), F.lit(w).alias("weight"))
    both = of(F.regexp_replace(content, r"\{\{v:\d+\}\}", " "), "A").union(of(reference, "B"))
    return both.groupBy(key, "term").agg(F.min("weight").alias("weight"))


def degraded(events: DataFrame, policy: DataFrame) -> DataFrame:
    """(query_id, action, stages): the hardest action that the policy(reason, action) names for a query's events(query_id, stage, reason).

    Actions in order: allow, quarantine, raise; a reason without a policy raises.
    """
    level = F.when(F.col("action") == "allow", 1).when(F.col("action") == "quarantine", 2).otherwise(3)
    j = events.join(policy, "reason", "left").groupBy("query_id").agg(F.max(level).alias("_l"), F.count_distinct("stage").alias("stages"))
    return j.select("query_id", F.element_at(F.array(*map(F.lit, ("allow", "quarantine", "raise"))), F.col("_l")).alias("action"), "stages")
