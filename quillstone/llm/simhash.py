"""Near-duplicates by SimHash: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into tiles by the bit counts of their four 16-bit quarters. Two
fingerprints within r bits have quarter counts whose differences add up to r at most, so only
tile pairs within that distance meet; each pair is compared whole with numpy exclusive-or and
bit counts. Components of the links follow.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, materialize

TILE = 512
BLOCK, PARTNERS = 32768, 4  # fingerprints in a block of nearest(); how many partners in another block each may have
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all k-word shingles; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        return _hash(b" ".join(words))
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    shingles = map(b" ".join, zip(*[itertools.islice(words, i, None) for i in range(k)], strict=False))
    for i in range(0, n, 8192):
        h = np.fromiter(map(_hash, itertools.islice(shingles, 8192)), dtype="<u8", count=min(8192, n - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str | Column], text: str, k: int) -> DataFrame:
    """docs' keep columns and fp, the fingerprint as a signed long."""
    cols = docs.select(*keep, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), k) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            others = [i for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], pa.array(fp.view(np.int64))], [*[b.schema[i].name for i in others], "fp"])

    return cols.mapInArrow(run, cols.drop("text").schema.add("fp", "long"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius across two tiles: each node with the least it reaches."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    nodes, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    x, y = at[: len(a)][i], at[len(a) :][j]
    x, y = x[x != y], y[x != y]
    root = np.arange(len(nodes))
    while True:
        was = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == was).all():
            break
    m = root != np.arange(len(nodes))
    return nodes[m], nodes[root[m]]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints prints(fp) that keep all components.

    Within a tile pair, links are thinned to a forest, so a dense group of thousands sends a link
    for each member and tile pair, not one for each two members. A tile above TILE fingerprints
    is split by hash into blocks that meet pairwise.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))) for i in range(4)]
    tile = sum((q * 32**i for i, q in enumerate(quarter)), F.lit(0))
    tiled = prints.select("fp", tile.alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    tiled = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    arrays = materialize(tiled.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")

    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    deltas = sorted(x for d in steps if (x := sum(v * 32**i for i, v in enumerate(d))) >= 0)
    left = arrays.select(F.col("tile").alias("t"), F.col("block").alias("k"), F.col("fps").alias("a"), F.explode(F.array(*map(F.lit, deltas))).alias("d"))
    left = left.withColumn("tile", F.col("t") + F.col("d"))
    pairs = left.join(arrays, "tile").filter("d > 0 OR k <= block").select("a", F.col("fps").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                u, v = _forest(*[z.values.to_numpy().view(np.uint64) for z in (x, y)], radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _nearest(left: tuple, right: tuple, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (greater node, less node) across two blocks (nodes, fingerprints, sizes): each node of the left with its nearest partners."""
    n1, f1, s1 = left
    n2, f2, s2 = (x[np.argsort(right[0])] for x in right)  # so that ties go to the less node
    found = [np.empty((2, 0), np.int64)]
    for at in range(0, len(n1), 64):
        bits = np.bitwise_count(f1[at : at + 64, None] ^ f2[None])
        near = bits <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            j, n, s = np.flatnonzero(near[i]), n1[at + i], s1[at + i]
            j = j[(n2[j] != n) & (np.minimum(s2[j], s) >= ratio * np.maximum(s2[j], s))]
            if len(j):
                j = j[np.argsort(bits[i, j], kind="stable")[:PARTNERS]]
                found.append(np.stack([np.maximum(n2[j], n), np.minimum(n2[j], n)]))
    return tuple(np.concatenate(found, axis=1))


def nearest(prints: DataFrame, radius: int, ratio: float) -> DataFrame:
    """Pairs (a, b), a > b, of prints(node, fp, size) at `radius` or fewer differing bits and with sizes in the ratio or nearer.

    For a radius too wide for tiles of bit counts: tiles are classes of sizes, and only equal and
    neighbouring classes can hold the ratio, so all pairs that may count are compared. Of a
    node's partners in a block that its own meets the nearest PARTNERS go on, so a dense group
    sends a few pairs for each member. Work grows with the square of a class.
    """
    step = math.log(1 / ratio) * 1.001  # a little wider, so that rounding parts no pair by two classes
    tiled = prints.withColumn("tile", F.floor(F.log("size") / step))
    sizes = materialize(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "simhash-sizes")
    dealt = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    lists = [F.collect_list(F.col(c)).alias(c) for c in ("node", "fp", "size")]
    arrays = materialize(dealt.groupBy("tile", "block").agg(*lists), "simhash-blocks")

    # which blocks meet is told first, so that blocks are dealt by block and no size class is one key
    each = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    meet = each.select(F.col("tile").alias("t"), F.col("block").alias("k"), F.explode(F.array("tile", F.col("tile") + 1)).alias("tile"))
    meet = meet.join(each, "tile").filter("t < tile OR k <= block")
    left = arrays.select(F.col("tile").alias("t"), F.col("block").alias("k"), *[F.col(c).alias(f"{c}1") for c in ("node", "fp", "size")])
    pairs = meet.join(left, ["t", "k"]).join(arrays, ["tile", "block"]).select("node1", "fp1", "size1", "node", "fp", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                n1, f1, s1, n2, f2, s2 = (x.values.to_numpy() for x in row)
                a, b = _nearest((n1, f1.view(np.uint64), s1), (n2, f2.view(np.uint64), s2), radius, ratio)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = materialize(pairs.mapInArrow(run, "a long, b long"), "simhash-nearest")
    discard(arrays, sizes)
    return found


def near_duplicates(docs: DataFrame, keep: list[str | Column], *, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """docs' keep columns, fingerprint (16 hex digits) and component_id, the least doc_id reachable.

    keep must hold doc_id. Fingerprints at `radius` or fewer differing bits link. Null texts and
    texts without words have fingerprint 0 and link like any other. Fewer than k words: one
    shingle. Repeated rows share a fingerprint. Null doc_ids never name a component unless all
    of its doc_ids are null. Empty table: no rows.
    """
    rows = materialize(with_fingerprints(docs, keep, text, k), "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("first")), "simhash-prints")
    found = materialize(links(prints.select("fp"), radius).distinct(), "simhash-links")
    roots = components(found)
    members = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(members.join(least, "root").select("fp", "component_id"), "simhash-named")
    discard(found, prints)
    names = [c for c in rows.columns if c != "fp"]
    return rows.join(named, "fp").select(*names, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
