"""Comparing ranking pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Weights of the judged dimensions.
WEIGHTS = {"relevance": 0.35, "selection": 0.25, "diversity": 0.10, "redundancy": 0.15, "fit": 0.15}


def composite(parts: dict[str, Column]) -> Column:
    return sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))


def overlap(runs: DataFrame, pipelines: int) -> DataFrame:
    """For each query and passage: how many pipelines hold it, and how far ranks and scores differ."""
    p = runs.groupBy("query_id", "passage").agg(F.count_distinct("pipeline").alias("held"), (F.max("rank") - F.min("rank")).alias("rank_delta"), F.round(F.max("score") - F.min("score"), 6).alias("score_delta"))
    return p.withColumn("kind", F.when(F.col("held") == pipelines, "shared").when(F.col("held") == 1, "unique").otherwise("partial"))


def summary(scores: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, extremes, wins and mean rank of each pipeline over (query_id, pipeline, s)."""
    r = scores.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("s"))))
    return r.groupBy("pipeline").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("s"), 5).alias("mean"), F.round(F.median("s"), 5).alias("median"), F.round(F.stddev_samp("s"), 5).alias("stdev"), F.min("s").alias("lowest"), F.max("s").alias("highest"), F.count_if(F.col("place") == 1).alias("wins"), F.round(F.avg("place"), 6).alias("mean_rank"))
