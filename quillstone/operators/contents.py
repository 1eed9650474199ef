"""Contents trees as flat rows (document, ordinal, parent_ordinal, depth, ...) in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..store import materialize


def check(nodes: DataFrame, chapters: DataFrame) -> DataFrame:
    """(document, ordinal, problem): repeated keys, parents that don't come before, positions that run back, chapters no node reaches."""
    w = W.partitionBy("document").orderBy("ordinal")
    keyed = nodes.groupBy("document", "node_key").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("ordinal")).filter("n > 1")
    rows = [
        keyed.select("document", "ordinal", F.lit("repeated_key").alias("problem")),
        nodes.filter("parent_ordinal >= ordinal").select("document", "ordinal", F.lit("parent_order").alias("problem")),
        nodes.withColumn("_p", F.lag("position").over(w)).filter("position < _p").select("document", "ordinal", F.lit("reading_order").alias("problem")),
        chapters.join(nodes.select("document", "chapter_key"), ["document", "chapter_key"], "left_anti").select("document", F.lit(None).cast("long").alias("ordinal"), F.lit("unreached").alias("problem")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def with_ancestors(nodes: DataFrame, hit: DataFrame) -> DataFrame:
    """(document, ordinal) of the hit nodes and all their ancestors, however deep.

    A round climbs one level from the nodes that the round before added, so nothing is climbed
    twice; each round is written to the shared folder.
    """
    parents = nodes.filter("parent_ordinal IS NOT NULL").select("document", "ordinal", F.col("parent_ordinal").alias("_p"))
    new = materialize(hit.select("document", "ordinal").distinct(), "climb")
    seen = new
    while not new.isEmpty():
        up = new.join(parents, ["document", "ordinal"]).select("document", F.col("_p").alias("ordinal")).distinct()
        new = materialize(up.join(seen, ["document", "ordinal"], "left_anti"), "climb")
        seen = seen.unionByName(new)
    return seen


def filtered(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes whose label holds all terms, with all their ancestors."""
    hit = nodes
    for t in terms:
        hit = hit.filter(F.contains(F.lower("label"), F.lit(t.lower())))
    return nodes.join(with_ancestors(nodes, hit), ["document", "ordinal"], "left_semi")
