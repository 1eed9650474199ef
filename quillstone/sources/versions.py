"""Published versions of a table: immutable releases and a log that names the current one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "n long, release string, action string, at timestamp"
ROLLBACK_DAYS = 14


def _log(spark: SparkSession, root: str) -> list:
    """The switches so far, oldest first: one row per publish or rollback."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log").orderBy("n").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def _switch(spark: SparkSession, root: str, n: int, release: str, action: str, now: dt.datetime) -> None:
    spark.createDataFrame([(n, release, action, now)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def publish(rows: DataFrame, root: str, release: str, problems: DataFrame, now: dt.datetime) -> None:
    """Writes the release, then names it current. Any problem refuses it before a row is written."""
    found = problems.limit(10).collect()
    if found:
        raise ValueError(f"refused, first problems: {found}")
    spark = rows.sparkSession
    log = _log(spark, root)
    rows.write.parquet(f"{root}/release={release}")
    _switch(spark, root, len(log), release, "publish", now)


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/release={_log(spark, root)[-1].release}")


def rollback(spark: SparkSession, root: str, now: dt.datetime) -> str:
    """Names the release before the current one, if the current one is recent; returns its name."""
    log = _log(spark, root)
    # releases undone by earlier rollbacks don't count as predecessors
    stack: list = []
    for r in log:
        if r.action == "publish":
            stack.append(r)
        else:
            stack.pop()
    if len(stack) < 2:
        raise ValueError("nothing to roll back to")
    if now - stack[-1].at > dt.timedelta(days=ROLLBACK_DAYS):
        raise ValueError(f"the current release is older than {ROLLBACK_DAYS} days")
    _switch(spark, root, len(log), stack[-2].release, "rollback", now)
    return stack[-2].release


def ledger(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of rows that a remap changed, so that it can be undone."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return j.filter(~F.col("before").eqNullSafe(F.col("after")))


def undo(rows: DataFrame, entries: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the ledger's changes taken back where the row still holds what the remap put there."""
    j = rows.join(entries.select(key, F.col("before").alias("_b"), F.col("after").alias("_a"), F.lit(1).alias("_l")), key, "left")
    return j.withColumn(value, F.when(F.col("_l").isNotNull() & F.col(value).eqNullSafe(F.col("_a")), F.col("_b")).otherwise(F.col(value))).drop("_b", "_a", "_l")
