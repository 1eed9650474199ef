"""The registry of passages: overrides, removals, retirement, redirects and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overridden(built: DataFrame, registry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """built with a registry value in place of the built one wherever the registry has one."""
    r = registry.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return built.join(r, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in built.columns])


def without_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows(id, document, position, ..) less the removed ids, positions renumbered from 0."""
    left = rows.join(removed.select("id"), "id", "left_anti")
    return left.withColumn("position", F.row_number().over(W.partitionBy("document").orderBy("position", "id")) - 1)


def open_removal(rows: DataFrame, removals: DataFrame) -> DataFrame:
    """(id, by) for rows(id, document, anchor) that an open entry of removals(id, document, anchor, closed) explains.

    By id; by (document, anchor) only where the entry has no id; by the whole document where it
    has neither. Closed entries explain nothing.
    """
    r = removals.filter("NOT closed")
    by_id = rows.join(r.filter("id IS NOT NULL").select("id"), "id", "left_semi").select("id", F.lit(1).alias("k"))
    by_anchor = rows.join(r.filter("id IS NULL AND anchor IS NOT NULL").select("document", "anchor"), ["document", "anchor"], "left_semi").select("id", F.lit(2).alias("k"))
    whole = rows.join(r.filter("id IS NULL AND anchor IS NULL").select("document"), "document", "left_semi").select("id", F.lit(3).alias("k"))
    best = by_id.union(by_anchor).union(whole).groupBy("id").agg(F.min("k").alias("k"))
    return best.select("id", F.when(F.col("k") == 1, "id").when(F.col("k") == 2, "anchor").otherwise("document").alias("by"))


def retirement(old: DataFrame, new: DataFrame, moves: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, kind, target): what becomes of each old(id, document, anchor) that new lacks.

    A move gives a redirect to its first target: own document first, then by document and position;
    a removal that is explained gives a tombstone; the rest is unexplained.
    """
    gone = old.join(new.select("id"), "id", "left_anti")
    targets = moves.join(new.select(F.col("id").alias("new_id"), F.col("document").alias("_d"), F.col("position").alias("_p")), "new_id")
    first = gone.join(targets.withColumnRenamed("old_id", "id"), "id").groupBy("id").agg(F.min_by("new_id", F.struct((F.col("_d") != F.col("document")).alias("o"), "_d", "_p", "new_id")).alias("target"))
    j = gone.join(first, "id", "left").join(removed.select("id", F.lit(True).alias("_r")), "id", "left")
    return j.select("id", F.when(F.col("target").isNotNull(), "redirect").when(F.col("_r"), "tombstone").otherwise("unexplained").alias("kind"), "target")


def anchor_redirects(old: DataFrame, new: DataFrame, moves: DataFrame) -> DataFrame:
    """(document, anchor, target): where an old anchor leads that its document no longer carries; one for each anchor, by the least old id."""
    lost = old.join(new.select("document", "anchor"), ["document", "anchor"], "left_anti")
    j = lost.join(moves.withColumnRenamed("old_id", "id"), "id")
    return j.groupBy("document", "anchor").agg(F.min_by("new_id", F.struct("id", "new_id")).alias("target"))


def chapter_redirects(old: DataFrame, new: DataFrame, moves: DataFrame) -> DataFrame:
    """(document, chapter, target, share): the chapter that most moved passages of a lost chapter went to; ties to the least."""
    lost = old.join(new.select("document", "chapter").distinct(), ["document", "chapter"], "left_anti")
    to = moves.join(new.select(F.col("id").alias("new_id"), F.col("chapter").alias("target")), "new_id").select(F.col("old_id").alias("id"), "target")
    votes = lost.join(to, "id").groupBy("document", "chapter", "target").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("document", "chapter")
    ranked = votes.withColumn("_all", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "target")))
    return ranked.filter("_r = 1").select("document", "chapter", "target", F.round(F.col("n") / F.col("_all"), 4).alias("share"))


def id_failures(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, problem): duplicate ids, anchors given to another passage, removals of what still stands, and what is gone unexplained."""
    twice = new.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    reused = old.join(new.select("document", "anchor", F.col("id").alias("_n")), ["document", "anchor"]).filter("id <> _n").select("id", F.lit("anchor_reused").alias("problem"))
    standing = removed.join(new.select("id"), "id", "left_semi").select("id", F.lit("removed_but_built").alias("problem"))
    gone = old.join(new.select("id"), "id", "left_anti").join(removed.select("id"), "id", "left_anti").select("id", F.lit("unexplained").alias("problem"))
    return twice.union(reused).union(standing).union(gone).distinct()


def frozen_ids(built: DataFrame, frozen: DataFrame, fallback: Column) -> DataFrame:
    """built(document, anchor, ..) with id: the frozen one of its (document, anchor), else the fallback."""
    return built.join(frozen.select("document", "anchor", F.col("id").alias("_f")), ["document", "anchor"], "left").withColumn("id", F.coalesce("_f", fallback)).drop("_f")


def coverage_changes(now: DataFrame, before: DataFrame, drop: float = 0.005) -> DataFrame:
    """(file, status) of files whose share(file, share) fell by more than `drop`, are new, or are no longer there."""
    j = now.select("file", F.col("share").alias("a")).join(before.select("file", F.col("share").alias("b")), "file", "full_outer")
    status = F.when(F.col("a").isNull(), "stale").when(F.col("b").isNull(), "new").when(F.round(F.col("b") - F.col("a"), 9) > drop, "regressed")
    return j.select("file", status.alias("status")).filter("status IS NOT NULL")


def fragments_found(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, status) of links(link_id, page_id, fragment) against pages(page_id, text): found, repeated, missing, no_fragment or no_page."""
    j = links.join(pages.select("page_id", F.col("text").alias("_t")), "page_id", "left")
    n = (F.length("_t") - F.length(F.replace(F.col("_t"), F.col("fragment"), F.lit("")))) / F.length("fragment")
    status = F.when(F.col("_t").isNull(), "no_page").when(F.coalesce(F.col("fragment"), F.lit("")) == "", "no_fragment").when(n == 0, "missing").when(n == 1, "found").otherwise("repeated")
    return j.select("link_id", status.alias("status"))


def grouped_to(units: DataFrame, key: str, order: str, count: str, size: int) -> DataFrame:
    """units with grp: neighbours are put together by where their running count falls in steps of `size`; a unit is never cut."""
    before = F.coalesce(F.sum(count).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("grp", F.floor(before / size))


def expired(rows: DataFrame, at: Column, now: Column, days: int) -> DataFrame:
    """The rows that are older than `days` at `now`."""
    return rows.filter(at < now - F.expr(f"INTERVAL {days} DAYS"))
