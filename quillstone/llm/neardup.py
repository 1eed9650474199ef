"""Near-duplicates by SimHash, decided by exact Jaccard similarity of word shingles.

SimHash fingerprints within RADIUS bits propose pairs (simhash.nearest), and MinHash bands propose
what a radius can't bound; every link is checked on the whole shingle sets. A first round links
each text with its nearest ones by fingerprint and with the least one of its band, so a large
group of copies sends a few links for each member. A second round compares whatever is still apart
within a band, in blocks: a task holds the shingle sets of two blocks, checks pairs there, and
sends on a link for each two groups that it joins, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from .components import components
from .scratch import discard, materialize

#: Differing bits of 64. At similarity 0.8 fingerprints differ in 10 bits or so; the radius is no bound, so bands follow.
RADIUS = 14
#: Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 24, 4
BLOCK, BLOCK_HASHES = 256, 2_000_000  # texts, and hashes of their sets, in a block of the second round
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(42)
_A = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all k-word runs; fewer than k words are one run, no words the run 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mixed(h, w[i : i + len(h)])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each hash function over the set."""
    low = np.full(len(_A), 2**32 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, ((_A * s[None, i : i + 1024] + _B) >> np.uint64(32)).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        h = _mixed(h, x)
    return h


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def _signed(rows: DataFrame, k: int) -> DataFrame:
    """rows' columns but text, node (of the shingle set), its size, fingerprint, signature's lower halves and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sig = np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, BANDS * ROWS), np.uint16)
            key, fp, size = np.empty((b.num_rows, BANDS), np.uint64), np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.int64)
            for i, t in enumerate(b.column("text")):
                s = shingles(t.as_py(), k)
                low = signature(s)
                node[i], sig[i], key[i] = _node(s), low.astype(np.uint16), bands(low)
                fp[i], size[i] = simhash.fingerprint(t.as_py(), k), len(s)
            keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, BANDS, dtype=np.int32), pa.array(key.view(np.int64).ravel()))
            others = [i for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in others], *map(pa.array, (node.view(np.int64), size, fp.view(np.int64))), pa.array([x.tobytes() for x in sig], pa.binary()), keys],
                [*[b.schema[i].name for i in others], "node", "size", "fp", "sig", "keys"],
            )

    return rows.mapInArrow(run, rows.drop("text").schema.add("node", "long").add("size", "long").add("fp", "long").add("sig", "binary").add("keys", ArrayType(LongType())))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(node, set) of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = [shingles(t.as_py(), k) for t in b.column("text").slice(i, 256)]
                nodes = np.fromiter(map(_node, s), np.uint64, count=len(s))
                ends = np.cumsum([0, *map(len, s)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(s).view(np.int64)))], ["node", "set"])

    return rows.select("text").mapInArrow(run, "node long, set array<long>")


def _sets_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame, digest: Column, text: str, k: int) -> DataFrame:
    """(node, set) of nodes(node), from the texts of docs."""
    one = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_digest").alias("_digest")).select("_digest").distinct()
    texts = docs.select(digest.alias("_digest"), F.col(text).alias("text")).join(materialize(one, "neardup-texts"), "_digest", "left_semi")
    return materialize(_sets(texts, k).dropDuplicates(["node"]), "neardup-sets")


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in more than half their places: what the first round checks.

    The others lose nothing: while their roots are apart, the second round compares them whole.
    """
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            yield b.filter(pa.array((x == y).mean(axis=1) > 0.5)).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return materialize(both.filter(F.col("n") >= similarity * (F.col("m") - F.col("n"))).select("a", "b"), "neardup-links")


class Groups:
    """Which roots a pair of blocks has joined so far."""

    def __init__(self):
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.of.setdefault(x, x)) != x:
            self.of[x] = x = self.of[up]
        return x


def joining(left: tuple, right: tuple, band: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (greater node, less node) that join what is alike across two blocks (nodes, roots, signatures, sets).

    A pair is checked in the first band that it shares, and only while its roots are apart, so
    there are fewer links than roots. (Bands are told from the signatures' lower halves; a false
    one hides a pair with probability 2**-16 at most.)
    """
    groups = Groups()
    (n1, r1, s1, x1), (n2, r2, s2, x2) = left, right
    size1, size2 = (np.array([len(x) for x in xs]) for xs in (x1, x2))
    for i in range(len(n1)):
        fits = (r2 != r1[i]) & (np.minimum(size2, size1[i]) >= similarity * np.maximum(size2, size1[i]))
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        same = s2[at] == s1[i]
        shared = same.reshape(len(at), BANDS, ROWS).all(axis=2)
        for j in at[shared[:, band] & (shared.argmax(axis=1) == band)].tolist():
            a, b = groups.find(int(r1[i])), groups.find(int(r2[j]))
            if a == b:
                continue
            n = len(np.intersect1d(x1[i], x2[j], assume_unique=True))
            if n >= similarity * (size1[i] + size2[j] - n):
                groups.of[max(a, b)] = min(a, b)
                yield max(int(n1[i]), int(n2[j])), min(int(n1[i]), int(n2[j]))


def _apart(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members(key, band, node, root, sig, set) of one key that join different roots."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("set")) / BLOCK_HASHES))  # few texts a block where they are long
    sizes = members.groupBy("key").agg(need.alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    lists = [F.collect_list(F.col(c)).alias(a) for c, a in (("node", "n"), ("root", "r"), ("sig", "s"), ("set", "x"))]
    arrays = materialize(dealt.groupBy("key", "band", "block").agg(*lists), "neardup-blocks")
    left = arrays.select("key", F.col("block").alias("k"), *[F.col(c).alias(f"{c}1") for c in "nrsx"])
    pairs = left.join(arrays, "key").filter("k <= block").select("band", *[f"{c}1" for c in "nrsx"], *"nrsx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                sides = []
                for n, r, s, x in (row[1:5], row[5:9]):
                    sig = np.frombuffer(b"".join(s.as_py()), np.uint16).reshape(-1, BANDS * ROWS)
                    sides.append((n.values.to_numpy(), r.values.to_numpy(), sig, [v.values.to_numpy() for v in x.values]))
                got = list(joining(*sides, row[0].as_py(), similarity))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, keep: list[str | Column], *, digest: Column, text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' keep columns and root, one value for all texts linked by similarity or more.

    similarity (0.8 or more) is Jaccard's over k-word shingles in lower case; links are transitive.
    digest: an expression that names a text. Texts of fewer than k words are one shingle; texts
    without words and null texts are alike. Empty table: no rows.
    """
    rows = materialize(_signed(docs.select(*keep, digest.alias("_digest"), F.col(text).alias("text")), k), "neardup-rows")
    # copies have one node: however many there are, it goes to its bands once
    once = [F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.min("fp").alias("fp")]
    nodes = materialize(rows.groupBy("node").agg(*once), "neardup-nodes")
    full, rows = rows, materialize(rows.drop("sig", "keys", "fp", "size"), "neardup-slim")
    discard(full)
    prints = simhash.nearest(nodes.filter(F.col("size") > 1).select("node", "fp", "size"), RADIUS, similarity)  # two sets of one are alike only as one node
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    first = materialize(keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").select("key", "b"), "neardup-bands")
    tied = materialize(keyed.join(first, "key").select("key", "band", "node", "b"), "neardup-tied")
    star = tied.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sigs = nodes.select("node", "sig")
    likely = materialize(_likely(prints.union(star).distinct(), sigs), "neardup-likely")
    sets = _sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), rows, docs, digest, text, k)
    close = _alike(likely, sets, similarity)
    roots = materialize(components(close), "neardup-roots")

    members = tied.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    members = materialize(members.join(mixed, "key", "left_semi"), "neardup-mixed")
    wanted = members.select("node").distinct()
    other = _sets_of(wanted.join(sets, "node", "left_anti"), rows, docs, digest, text, k)
    held = sigs.join(wanted, "node", "left_semi").join(sets.union(other), "node")
    more = materialize(_apart(members.join(held, "node"), similarity), "neardup-apart")
    if not more.isEmpty():
        roots = materialize(components(close.union(more)), "neardup-roots")
    discard(prints, first, tied, members, more, sets, other, likely, close, nodes)
    return rows.join(roots, "node", "left").select(*[c for c in rows.columns if c not in ("node", "_digest")], F.coalesce("root", "node").alias("root"))
