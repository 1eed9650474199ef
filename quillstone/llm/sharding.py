"""Minimax contiguous partition of ordered atomic groups. DataFrame functions only.

Groups are the sets of equal texts, ordered by the digest of their text. The smallest capacity
that fits all groups into the wanted number of contiguous shards is found by searching over
capacities; each trial walks greedily from cut to cut. Group sizes stay in a table: a trial asks
it for the last group end at or below a target, for many trial capacities in one job, and the
driver holds only the sizes of 4,096 fixed digest ranges.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import discard, materialize

BUCKETS = 4096


class Boundaries:
    """Answers "last group end <= x" and "first group end >= x" from a table of group ends."""

    def __init__(self, groups: DataFrame, starts: list[int]):
        self.groups, self.starts, self.spark = groups, starts, groups.sparkSession

    def _ask(self, xs: list[int], up: bool) -> dict[int, int]:
        """One job for all xs; the answer for x lies in x's digest range or at its edge."""
        at = {x: max(0, bisect.bisect_right(self.starts, x) - 1) for x in set(xs)}
        if up:
            at = {x: max(0, bisect.bisect_left(self.starts, x) - 1) for x in set(xs)}
        values = ", ".join(f"({b}, {x}L)" for x, b in at.items())
        asked = self.spark.sql(f"SELECT * FROM VALUES {values} AS t(bucket, x)")
        near = self.groups.filter(F.col("bucket").isin(sorted(set(at.values())))).join(F.broadcast(asked), "bucket")
        near = near.filter("end >= x").groupBy("x").agg(F.min("end")) if up else near.filter("end <= x").groupBy("x").agg(F.max("end"))
        got = dict(map(tuple, near.collect()))  # a row for each target at most
        return {x: got.get(x, self.starts[b + 1] if up else self.starts[b]) for x, b in at.items()}

    def floor(self, xs: list[int]) -> dict[int, int]:
        return self._ask(xs, False)

    def ceil(self, x: int) -> int:
        return 0 if x <= 0 else self._ask([x], True)[x]


def smallest_capacity(ends: Boundaries, total: int, largest: int, shards: int, width: int = 48) -> int:
    """The least capacity with which a greedy walk reaches `total` in `shards` steps.

    width trial capacities are walked side by side, so a round divides the range by width + 1.
    """
    low = max(-(-total // shards), largest)
    high = max(low, -(-total // shards) + largest)
    while low < high:
        step = max(1, math.ceil((high - low) / (width + 1)))
        trials = list(range(low, high, step))[:width]
        reach = dict.fromkeys(trials, 0)
        for _ in range(shards):
            going = [c for c in trials if reach[c] < total]
            if not going:
                break
            to = ends.floor([reach[c] + c for c in going])
            reach |= {c: to[reach[c] + c] for c in going}
        fits = [c for c in trials if reach[c] >= total]
        if fits:
            high = min(fits)
        below = [c for c in trials if c < high]
        if below:
            low = max(below) + 1
    return high


def cut_points(ends: Boundaries, total: int, capacity: int, shards: int) -> list[int]:
    """The ends of all shards but the last: none above capacity, each as near to its even share as that allows."""
    least, x = [total], total
    for _ in range(shards - 1):
        x = ends.ceil(x - capacity)
        least.append(x)
    least = least[::-1]
    cuts, start = [], 0
    for j in range(1, shards):
        want = min(start + capacity, max(total * j // shards, least[j - 1]))
        start = max(start, ends.floor([want])[want])
        cuts.append(start)
    return cuts


def assign(docs: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every row in one of `shards` shards by the law `bytes`.

    Equal texts stay together; a row's size is its text's UTF-8 bytes plus 1 (null text: 1).
    Shards are contiguous in digest order and the largest has the least size possible for that
    order. A group above the even share sets the capacity. Null and empty texts are two groups.
    Repeated rows and doc_ids: each row has its own slot. Empty table: no rows.
    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), shard_capacity.
    A hot group is numbered in about sqrt(rows) salted parts, never in one task.
    """
    digest = F.when(F.col(text).isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(F.col(text), 256)))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), digest.alias("g"),
    )
    rows = rows.withColumn("bucket", F.conv(F.substring(F.rpad(F.hex("g"), 3, "0"), 1, 3), 16, 10).cast("int"))
    rows = materialize(rows.withColumn("_m", F.monotonically_increasing_id()), "shard-rows")
    salts = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_m"), F.lit(salts)))  # the row's own number deals repeated rows too
    rows = rows.withColumn("idx", F.row_number().over(W.partitionBy("bucket", "g", "salt").orderBy("doc_id", "_m")) - 1)
    rows = materialize(rows, "shard-numbered")

    parts = rows.groupBy("bucket", "g", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    parts = materialize(parts, "shard-parts")
    sums = {r.bucket: r for r in parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}  # BUCKETS rows at most
    starts, firsts = [0], [0]
    for b in range(BUCKETS):
        r = sums.get(b)
        starts.append(starts[-1] + (r.bytes if r else 0))
        firsts.append(firsts[-1] + (r.n if r else 0))
    offsets = docs.sparkSession.createDataFrame([(b, starts[b], firsts[b]) for b in range(BUCKETS)], "bucket int, byte0 long, row0 long")

    groups = parts.groupBy("bucket", "g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    upto = W.partitionBy("bucket").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    groups = groups.join(F.broadcast(offsets), "bucket")
    groups = groups.select("bucket", "g", "bytes", (F.col("byte0") + F.sum("bytes").over(upto)).alias("end"), (F.col("row0") + F.sum("n").over(upto) - F.col("n")).alias("row_start"), "n")
    groups = materialize(groups.sortWithinPartitions("bucket", "end"), "shard-groups")

    total = starts[-1]
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    ends = Boundaries(groups.select("bucket", "end"), starts)
    capacity = smallest_capacity(ends, total, largest, shards) if total else 0
    cuts = cut_points(ends, total, capacity, shards) if total else []

    shard = sum([(F.col("end") > c).cast("int") for c in cuts], F.lit(0))
    placed = groups.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row_start").alias("shard_row"))
    placed = placed.join(F.broadcast(first), "shard").select("bucket", "g", "shard", (F.col("row_start") - F.col("shard_row")).alias("slot0"))
    before = W.partitionBy("bucket", "g").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    subs = parts.select("bucket", "g", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")).join(placed, ["bucket", "g"])
    subs = materialize(subs, "shard-places")
    out = rows.join(subs, ["bucket", "g", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("skip") + F.col("idx")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("shard_capacity"),
    )
    discard(parts, groups)
    return out
