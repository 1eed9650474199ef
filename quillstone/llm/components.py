"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b) with a partner; root is the least node reached.

    Alternates large-star and small-star steps: each node hangs its greater, then its smaller
    neighbours on the least node it sees, until no link changes. A step is a grouped minimum and
    a join, both split by Spark for hot nodes; each round is written to the shared folder.
    """
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialize(both.join(low, "a").filter("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = materialize(small.distinct(), "links")
        discard(now, large)
        now, was = small, seen
        seen = mark(now)
        if seen == was:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
