"""Ordering steps after fusion; rows are (query_id, collection, item, score, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def _best(*keys: str):
    return W.partitionBy(*keys).orderBy(F.desc("score"), "item")


def first_n(rows: DataFrame, keys: list[str], n: int | Column) -> DataFrame:
    """The best n rows of each key (quota cap, per-source cap)."""
    return rows.withColumn("_n", F.row_number().over(_best(*keys))).filter(F.col("_n") <= n).drop("_n")


def adaptive_source(rows: DataFrame, listed: list[str], chapter: str, title: str) -> DataFrame:
    """source_key: the chapter in listed collections, unless some candidate of that collection lacks one; else the title.

    The kind is part of the key, so a chapter never equals a title.
    """
    whole = F.min(F.col(chapter).isNotNull()).over(W.partitionBy("query_id", "collection"))
    fine = F.col("collection").cast("string").isin(listed) & whole
    return rows.withColumn("source_key", F.when(fine, F.concat_ws(":", F.lit("chapter"), F.col(title).cast("string"), F.col(chapter).cast("string"))).otherwise(F.concat_ws(":", F.lit("title"), F.col(title).cast("string"))))


def guarantee(kept: DataFrame, candidates: DataFrame, requested: DataFrame, least: float = 0.25) -> DataFrame:
    """kept plus, for each requested collection without a row, its best candidate of at least `least`."""
    missing = requested.join(kept.select("query_id", "collection").distinct(), ["query_id", "collection"], "left_anti")
    best = first_n(candidates.filter(F.col("score") >= least).join(missing, ["query_id", "collection"], "left_semi"), ["query_id", "collection"], 1)
    return kept.unionByName(best.select(*kept.columns))


def minimum_floor(kept: DataFrame, candidates: DataFrame, work: str, chapter: str, n: int) -> DataFrame:
    """Rows for queries whose kept is empty: the best of each work first, then of other chapters, to n."""
    bare = candidates.join(kept.select("query_id").distinct(), "query_id", "left_anti")
    fine = first_n(bare, ["query_id", work, chapter], 1)
    fine = fine.withColumn("_again", (F.row_number().over(_best("query_id", work)) > 1).cast("int"))
    order = W.partitionBy("query_id").orderBy("_again", F.desc("score"), "item")
    return fine.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n", "_again")


def greedy_pack(rows: DataFrame, cost: str, budget: float, most: int) -> DataFrame:
    """The prefix of each query's rows whose costs fit the budget; the first row always."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item")
    out = rows.withColumn("packed", F.row_number().over(order)).withColumn("spent", F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return out.filter((F.col("packed") == 1) | ((F.col("spent") <= budget) & (F.col("packed") <= most)))


def terminal_seats(total: Column, n_collections: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(total / n_collections)))


def allocate(pools: DataFrame, cap: int, floor: int) -> DataFrame:
    """pools (query_id, collection, arrival, available) plus seats.

    Each collection gets up to `floor`; the rest of the cap is dealt one at a time, the largest
    headroom first. If the floors alone exceed the cap, the `cap` largest pools get one each.
    """
    q = W.partitionBy("query_id")
    base = F.least(F.col("available"), F.lit(floor))
    p = pools.filter("available > 0").withColumn("base", base).withColumn("floors", F.sum(base).over(q))
    p = p.withColumn("big", F.row_number().over(q.orderBy(F.desc("available"), "arrival")))
    slots = p.select("*", F.explode(F.sequence(F.lit(1), "available")).alias("slot")).withColumn("room", F.col("available") - F.col("base"))
    order = q.orderBy((F.col("slot") > F.col("base")).cast("int"), F.greatest(F.col("slot") - F.col("base"), F.lit(0)), F.desc("room"), "arrival")
    slots = slots.withColumn("turn", F.row_number().over(order))
    seats = F.when(F.first("floors") > cap, (F.first("big") <= cap).cast("int")).otherwise(F.count_if(F.col("turn") <= cap)).cast("long")
    return slots.groupBy("query_id", "collection", "available").agg(seats.alias("seats"))


def fallback_scores(rows: DataFrame, scored: DataFrame, base: float = 0.4, step: float = 0.01) -> DataFrame:
    """Scorer output where a collection has any, else base - step * place, never below 0."""
    has = scored.select("query_id", "collection").distinct().withColumn("_has", F.lit(True))
    out = rows.join(scored.select("query_id", "collection", "item", F.col("score").alias("_s")), ["query_id", "collection", "item"], "left").join(has, ["query_id", "collection"], "left")
    place = F.row_number().over(_best("query_id", "collection")) - 1
    fallback = F.greatest(F.lit(0.0), F.lit(base) - step * place)
    return out.withColumn("final", F.round(F.when(F.col("_has"), F.coalesce("_s", F.lit(0.0))).otherwise(fallback), 6)).withColumn("scorer", F.when(F.col("_has"), F.lit("scorer")).otherwise(F.lit("rrf_fallback"))).drop("_s", "_has")


def near_pairs(rows: DataFrame, similar: Column, window: int = 2) -> DataFrame:
    """Pairs of a query's rows in one document, at most `window` positions apart, for which `similar` holds.

    Positions are dealt to neighbouring cells, so the join is on equal keys and no document is
    paired with itself whole.
    """
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]).withColumn("_p", F.explode(F.sequence(F.col("a_position") - window, F.col("a_position") + window)))
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    on = (F.col("a_query_id") == F.col("b_query_id")) & (F.col("a_document") == F.col("b_document")) & (F.col("_p") == F.col("b_position"))
    before = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_item") < F.col("b_item")))
    return a.join(b, on).filter(before & similar).drop("_p")


def drop_near_duplicates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows less the lower-scored of each pair, greedily: a pair with a dropped member is passed over.

    Pairs of a query and document are few (a query's rows are budgeted), so each such group is
    one task's small frame.
    """

    def lose(frame: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for r in frame.sort_values(["a_score", "a_item", "b_score", "b_item"], ascending=[False, True, False, True]).itertuples():
            if r.a_item not in gone and r.b_item not in gone:
                gone.add(r.b_item)
        return pd.DataFrame({"query_id": frame.a_query_id.iloc[0], "item": sorted(gone)}).astype({"query_id": "int64", "item": "int64"})

    lost = pairs.select("a_query_id", "a_document", "a_item", "b_item", "a_score", "b_score").groupBy("a_query_id", "a_document").applyInPandas(lose, "query_id long, item long")
    return rows.join(lost, ["query_id", "item"], "left_anti")


def outcomes(per_collection: DataFrame) -> DataFrame:
    """The outcome of each (query, collection) from its counts and flags; first match wins.

    Columns read: final, degraded, candidates_before, candidates, retrieval_degraded, ranked.
    """
    c = F.col
    return per_collection.withColumn("outcome", F.when((c("final") > 0) & c("degraded"), "results_degraded").when(c("final") > 0, "results")
        .when((c("candidates_before") > 0) & (c("candidates") == 0), "corpus_sync_failed").when((c("candidates") == 0) & c("retrieval_degraded"), "retrieval_failed")
        .when((c("candidates") > 0) & (c("ranked") == 0), "ranking_failed").when(c("candidates") > 0, "below_threshold").otherwise("no_candidates"))


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) with overlapping intervals of a key joined."""
    order = W.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = rows.withColumn("_new", F.when(F.col(start) <= seen, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return fresh.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def stitch(rows: DataFrame) -> DataFrame:
    """For each objection, the span of the determination that answers it in its chapter.

    rows: (document, chapter, position, role). The next determination counts if no reply comes
    before it; its whole run of neighbouring determinations is attached.
    """
    order = W.partitionBy("document", "chapter").orderBy("position")
    ahead = order.rowsBetween(1, W.unboundedFollowing)
    at = lambda role: F.min(F.when(F.col("role") == role, F.col("position"))).over(ahead)
    run = F.sum((~F.col("role").eqNullSafe(F.lag("role").over(order))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("next_det", at("determination")).withColumn("next_reply", at("reply")).withColumn("_run", run)
    runs = marked.filter("role = 'determination'").groupBy("document", "chapter", "_run").agg(F.min("position").alias("det_from"), F.max("position").alias("det_to"))
    open_ = marked.filter("role = 'objection' AND next_det IS NOT NULL AND (next_reply IS NULL OR next_det < next_reply)")
    joined = open_.drop("_run").join(runs.drop("_run"), ["document", "chapter"]).filter("next_det = det_from")
    return joined.select("document", "chapter", "position", "det_from", "det_to")



def assembled(results: DataFrame, spans: DataFrame, passages: DataFrame, between: str = "\n\n") -> DataFrame:
    """results (id, document, chapter, position) with first, last, n and text: the passage and its attached spans in reading order, each passage once.

    spans: (id, document, chapter, first, last), any number a result; passages: (document, chapter,
    position, content). Overlapping and touching spans merge before texts are fetched; blank
    passages are left out. Spans are met by blocks of 64 positions, so a long chapter's passages
    meet only the spans that reach their block.
    """
    own = results.select("id", "document", "chapter", F.col("position").alias("first"), F.col("position").alias("last"))
    order = W.partitionBy("id", "document", "chapter").orderBy("first", "last")
    all_ = own.unionByName(spans.select("id", "document", "chapter", "first", "last"))
    fresh = F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(False))
    runs = all_.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "document", "chapter", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    block = lambda c: F.floor(F.col(c) / 64)
    dealt = runs.withColumn("_b", F.explode(F.sequence(block("first"), block("last"))))
    held = passages.filter("trim(content) <> ''").withColumn("_b", block("position")).join(dealt, ["document", "chapter", "_b"]).filter(F.col("position").between(F.col("first"), F.col("last")))
    parts = F.sort_array(F.collect_list(F.struct("chapter", "position", "content")))
    told = held.groupBy("id").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n"), F.array_join(parts["content"], between).alias("text"))
    return results.join(told, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
