"""Structured Streaming twins of the usage operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import shared_dir


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet events as a stream, ts as TIMESTAMP (watermarks refuse zoneless times)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{folder}/{name}*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there and returns its last result, from the shared folder."""
    spark, at = stream.sparkSession, _shared(stream.sparkSession)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def daily_quota(events: DataFrame) -> DataFrame:
    """(user_id, day, used) in tumbling days; late rows within two days still count."""
    w = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("used"))
    return w.select("user_id", F.to_date("w.start").alias("day"), "used")


def latest_wins(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("l")).select("user_id", "event_type", "l.event_id", "l.ts", "l.value")


def fixed_window(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(user_id, opened, n, refused) of each user's open window, kept as state between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n, refused = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        for t in rows["at"]:
            if not n or t - opened >= seconds:
                opened, n = int(t), 0
            n += 1
            refused += n > limit
        state.update((opened, n, refused))
        yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "n": [n], "refused": [refused]})

    rows = events.select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, opened long, n long, refused long", "opened long, n long, refused long", "update", GroupStateTimeout.NoTimeout)
