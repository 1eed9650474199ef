"""Enrichment passes over passages, edition alignment and keyed state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(rows: DataFrame, key: str, texts: Column) -> DataFrame:
    """(key, facet_id, text): one row per facet, named f1, f2, ... by place."""
    return rows.select(key, F.posexplode(texts).alias("_i", "text")).select(key, F.concat(F.lit("f"), (F.col("_i") + 1).cast("string")).alias("facet_id"), "text")


def merge_passes(generated: DataFrame, classified: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Facets that all three passes hold."""
    return generated.join(classified, keys).join(annotated, keys)


def declared_redirects(declared: DataFrame, built: DataFrame) -> DataFrame:
    """(old_id, kind, target, problem) of declared(old_id, old_document, kind, new_id) against built(id, document, position).

    One kind only, all targets built, the old id not built. The target is the one in the old
    document, else by document and position.
    """
    j = declared.join(built.select(F.col("id").alias("new_id"), "document", "position"), "new_id", "left").join(built.select(F.col("id").alias("old_id"), F.lit(1).alias("_still")), "old_id", "left")
    g = j.groupBy("old_id").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.bool_and(F.col("document").isNotNull()).alias("all_built"), F.max("_still").alias("still"),
        F.min_by("new_id", F.when(F.col("document").isNotNull(), F.struct((F.col("document") != F.col("old_document")).alias("o"), "document", "position", "new_id"))).alias("target"))
    problem = F.when(F.col("kinds") > 1, "several_kinds").when(~F.col("all_built"), "target_not_built").when(F.col("still").isNotNull(), "old_still_built")
    return g.select("old_id", "kind", "target", problem.alias("problem"))


def align(left: list[str], right: list[str], skip: float = 0.15, least: float = 0.08, most: int = 4) -> list[tuple[int, int, int, int]]:
    """Order-preserving alignment of two editions' units: (left from, left to, right from, right to), ends exclusive.

    A unit may stand alone (at a cost), meet one unit, or up to `most` units of the other side;
    likeness is the shared share of six-letter word stems, less for unequal lengths.
    """
    stems = lambda s: {w[:6] for w in s.lower().split()}
    a, b = [stems(s) for s in left], [stems(s) for s in right]

    def like(i: int, j: int, k: int, m: int) -> float:
        x, y = set().union(*a[i:j]), set().union(*b[k:m])
        if not x or not y:
            return -1.0
        share = 2 * len(x & y) / (len(x) + len(y))
        return share * min(len(x), len(y)) / max(len(x), len(y)) if share >= least else -1.0

    best = {(0, 0): (0.0, None)}
    for i in range(len(a) + 1):
        for k in range(len(b) + 1):
            if (i, k) == (0, 0):
                continue
            options = []
            if i:
                options.append((best[i - 1, k][0] - skip, (i - 1, k)))
            if k:
                options.append((best[i, k - 1][0] - skip, (i, k - 1)))
            for n in range(1, most + 1):
                for p, q in {(n, 1), (1, n)}:
                    if i >= p and k >= q:
                        s = like(i - p, i, k - q, k)
                        if s > 0:
                            options.append((best[i - p, k - q][0] + s, (i - p, k - q)))
            best[i, k] = max(options, key=lambda o: (o[0], o[1]))
    out, at = [], (len(a), len(b))
    while best[at][1] is not None:
        was = best[at][1]
        if was[0] < at[0] and was[1] < at[1]:
            out.append((was[0], at[0], was[1], at[1]))
        at = was
    return out[::-1]


def align_editions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys plus (left_from, left_to, right_from, right_to) of pairs(*keys, left, right), both arrays of units in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*row[:-2], *r) for row in f.itertuples(index=False) for r in align(list(row[-2]), list(row[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "left_from", "left_to", "right_from", "right_to"])

    named = ", ".join(f"{k} long" for k in keys)
    return pairs.select(*[F.col(k).cast("long").alias(k) for k in keys], "left", "right").mapInPandas(run, f"{named}, left_from int, left_to int, right_from int, right_to int")


def leases(events: DataFrame, seconds: int) -> DataFrame:
    """events(key, event_id, at, action) plus state and granted, by a lease machine.

    claim: granted unless a lease younger than `seconds` is open or the key is finished; finish:
    ready; fail: open to claims again. Keys pass sorted through tasks that hold one key's state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, since = None, "pending", None
        for f in frames:
            states, granted = [], []
            for k, t, act in zip(f["key"], f["at"], f["action"], strict=True):
                if k != key:
                    key, state, since = k, "pending", None
                ok = False
                if act == "claim" and state != "ready" and (state != "claimed" or t - since >= seconds):
                    state, since, ok = "claimed", t, True
                elif act == "finish" and state == "claimed":
                    state, ok = "ready", True
                elif act == "fail" and state == "claimed":
                    state, ok = "failed", True
                states.append(state)
                granted.append(ok)
            yield f.assign(state=states, granted=granted)

    rows = events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"), "action")
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "key long, event_id long, at long, action string, state string, granted boolean")


def trailing_admission(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """events(key, event_id, at) plus admitted: fewer than `limit` admitted ones in the `seconds` before.

    Only admitted events count, so each key is walked in order; a task remembers `limit` times.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for f in frames:
            out = []
            for k, t in zip(f["key"], f["at"], strict=True):
                if k != key:
                    key, kept = k, []
                kept = [x for x in kept if t - x < seconds]
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield f.assign(admitted=out)

    rows = events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "key long, event_id long, at long, admitted boolean")


def interleave(text: Column, notes: Column) -> Column:
    """text with [n] put in at each note's offset; notes: array of (at, n), in any order."""
    placed = F.array_sort(notes)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["done"] + 1, x["at"] - s["done"]), F.lit("["), x["n"].cast("string"), F.lit("]")).alias("out"), x["at"].cast("int").alias("done"))
    return F.aggregate(placed, start, step, lambda s: F.concat(s["out"], F.substring(text, s["done"] + 1, F.length(text))))
