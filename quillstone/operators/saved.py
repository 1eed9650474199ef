"""What users keep: bookmarks, and searches deleted with what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bookmarks_after(held: DataFrame, changes: DataFrame) -> DataFrame:
    """(user, passage, note, created) after changes in the order of their times, then numbers.

    held: (user, passage, note, created), one row a user and passage; changes: (user, passage,
    seq, at, action, note), action `put` or `delete`. A put keeps the date of a bookmark that
    is there and takes its note only if it brings one; behind a delete it begins anew. Deleting
    what isn't there does nothing. Windows over one user and passage; nothing is gathered.
    """
    rows = held.select("user", "passage", F.lit(-1).cast("long").alias("seq"), F.col("created").alias("at"), F.lit("put").alias("action"), "note", F.lit(0).alias("_held"))
    rows = rows.unionByName(changes.select("user", "passage", F.col("seq").cast("long").alias("seq"), "at", "action", "note", F.lit(1).alias("_held")))
    key = W.partitionBy("user", "passage")
    order = ["_held", "at", "seq"]
    cut = F.sum((F.col("action") == "delete").cast("int")).over(key.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    life = rows.withColumn("_life", cut).withColumn("_last", F.max("_life").over(key)).filter("_life = _last AND action = 'put'")
    last = F.max_by("note", F.when(F.col("note").isNotNull(), F.struct(*order)))
    return life.groupBy("user", "passage").agg(last.alias("note"), F.min_by("at", F.struct(*order)).alias("created"))


def without_searches(deleted: DataFrame, searches: DataFrame, results: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(searches, results, labels) after users deleted searches: deleted(search, user).

    A search goes only by its own user's wish. Its results go with it; labels stay, for they judge
    passages, but lose the search they came from. searches: (search, user, ..); results and
    labels: (search, ..). Repeated wishes do no more.
    """
    gone = searches.join(deleted.select("search", "user").distinct(), ["search", "user"], "left_semi").select("search")
    marked = labels.join(gone.withColumn("_gone", F.lit(True)), "search", "left")
    loose = marked.withColumn("search", F.when(F.col("_gone").isNull(), F.col("search"))).select(*labels.columns)
    return searches.join(gone, "search", "left_anti"), results.join(gone, "search", "left_anti"), loose
