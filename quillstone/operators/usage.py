"""Usage limits and latest-wins state, over finished logs; streaming twins are in quillstone.streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fixed_window(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """events(user_id, event_id, at) plus in_window and allowed.

    A user's first event opens a window; one that comes `seconds` or more after the opening opens
    the next. Refused events count too. Users pass sorted through tasks that remember one window,
    so a user of any number of events needs no more memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, opened, n = None, 0, 0
        for f in frames:
            counts = []
            for u, t in zip(f["user_id"], f["at"], strict=True):
                if u != user or t - opened >= seconds:
                    user, opened, n = u, t, 0
                n += 1
                counts.append(n)
            yield f.assign(in_window=counts, allowed=[c <= limit for c in counts])

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return rows.mapInPandas(run, "user_id long, event_id long, at long, in_window long, allowed boolean")


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """Numbers each user's events within the UTC day; the first `limit` are allowed."""
    day = F.to_date("ts")
    n = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    wait = F.unix_timestamp(F.date_add("day", 1).cast("timestamp")) - F.unix_timestamp("ts")
    return events.withColumn("day", day).withColumn("used", n).withColumn("allowed", n <= limit).withColumn("retry_after", F.when(n > limit, wait))


def trailing_counts(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """For each event the number of the key's events in the `seconds` up to it, itself included."""
    at = F.unix_timestamp("ts")
    return events.withColumn("trailing", F.count(F.lit(1)).over(W.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)))


def latest_wins(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by (ts, event_id)."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("_l")).select(*keys, "_l.*")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, session, n, first, last): runs of events with gaps below the bound. An extension."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_timestamp("ts")
    new = (at - F.lag(at).over(w) >= gap_seconds).cast("int")
    s = events.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
