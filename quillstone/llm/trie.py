"""Prefix trie of conversations, kept as a table of compacted nodes found by hashes (a z-fast trie).

A compacted node is a prefix at which conversations end or part. Its edge covers the depths above
its parent's up to its own; it is stored under the hash of the prefix at the two-fattest depth of
that range, its handle. A sequence finds the deepest node that it starts with by fat binary
search: each step looks up one handle, so a conversation of n turns needs about log2(n) lookups.

Sequences are inserted in batches. All of a batch search at once; what lies below the nodes found
and the edges they leave are compared by grouping prefix hashes, which gives the new nodes and the
edges that they cut. At the end edges are expanded into one row for each distinct prefix.

A prefix hash is the exclusive-or of 128 bits for each (depth, turn), so it is a running aggregate
and a very long conversation is summed in blocks of depths. No row holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import discard, materialize

BLOCK = 4096  # depths (or turn numbers) that one group of a running aggregate covers
STEPS = 4  # steps of the search planned together
NODE = ["hi", "e1", "e2"]  # a prefix: its depth and hash


def two_fattest(a: Column, b: Column) -> Column:
    """The number above a and up to b that the greatest power of two divides (a < b)."""
    k = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k)


def numbered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, sym, bytes): turns in order, null turns first, equal turns by their digest; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    sym = F.unhex(F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    rows = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), sym.alias("sym"), F.octet_length(text).cast("long").alias("bytes")).filter("c IS NOT NULL")
    rows = rows.withColumn("blk", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = W.partitionBy("c", "blk").orderBy(F.col("turn").asc_nulls_first(), "sym")
    sizes = rows.groupBy("c", "blk").agg(F.count(F.lit(1)).alias("n"))
    skips = sizes.select("c", "blk", F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    return rows.withColumn("i", F.row_number().over(inside)).join(skips, ["c", "blk"]).select("c", (F.col("i") + F.col("skip")).alias("pos"), "sym", "bytes")


def shared_starts(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (c, d, sym, bytes) and all conv_ids (c).

    Each conversation gets the first h turns of the first one of its group of `group` ids in place
    of its own first h; h is its id's CRC-32 modulo `most`.
    """
    h, first = F.crc32(F.col("c").cast("string")) % most, F.col("c") - F.pmod("c", F.lit(group))
    ids = rows.groupBy("c").count().select("c", h.alias("h"), first.alias("g"))
    heads = rows.filter((F.pmod("c", F.lit(group)) == 0) & (F.col("pos") < most)).withColumnRenamed("c", "g")
    taken = heads.join(ids, "g").filter("pos <= h").select("c", F.col("pos").alias("d"), "sym", "bytes")
    have = heads.groupBy("g").agg(F.count(F.lit(1)).alias("have"))
    own = rows.withColumn("h", h).withColumn("g", first).filter("pos > h").join(have, "g", "left")
    own = own.select("c", (F.col("pos") - F.greatest(F.col("h") - F.coalesce("have", F.lit(0)), F.lit(0))).alias("d"), "sym", "bytes")
    return taken.union(own), ids.select("c")


def prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, d, h1, h2, x1, x2, bytes, cum) for every depth d from 0: hash of the prefix, the last turn's part of it, its bytes and the bytes so far."""
    rows = rows.withColumn("x1", F.xxhash64("d", "sym")).withColumn("x2", F.xxhash64("sym", "d", F.lit(1))).drop("sym").withColumn("blk", F.floor((F.col("d") - 1) / BLOCK))
    inside = W.partitionBy("c", "blk").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("c").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("c", "blk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes"))
    skips = whole.select("c", "blk", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"), F.sum("bytes").over(before).alias("s")).filter("blk > 0")
    run = rows.select("*", F.bit_xor("x1").over(inside).alias("h1"), F.bit_xor("x2").over(inside).alias("h2"), F.sum("bytes").over(inside).alias("cum")).join(skips, ["c", "blk"], "left")
    add = lambda h, s: F.col(h).bitwiseXOR(F.coalesce(s, F.lit(0)))
    run = run.select("c", F.col("d").cast("long").alias("d"), add("h1", "s1").alias("h1"), add("h2", "s2").alias("h2"), "x1", "x2", "bytes", (F.col("cum") + F.coalesce("s", F.lit(0))).alias("cum"))
    zero = F.lit(0).cast("long")
    return run.union(ids.select("c", *[zero] * 7))


def _edge_rows(paths: DataFrame, edges: DataFrame, low: Column) -> DataFrame:
    """Rows of paths on each of edges (c, lo, hi, ...) at depths from low to hi; met by blocks of depths."""
    spans = edges.withColumn("blk", F.explode(F.sequence(F.floor(low / BLOCK), F.floor(F.col("hi") / BLOCK))))
    return paths.withColumn("blk", F.floor(F.col("d") / BLOCK)).join(spans, ["c", "blk"]).filter((F.col("d") >= low) & (F.col("d") <= F.col("hi"))).drop("blk")


def locate(seqs: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, start): depth of the deepest node that each of seqs (c, n) starts with, by fat binary search.

    The last handle found names either that node or, if the sequence leaves its edge, the node
    below it; comparing the whole extent tells which.
    """
    zero = F.lit(0).cast("long")
    at = paths.select("c", F.col("d").alias("f"), "h1", "h2")
    handles = nodes.select("f", F.col("k1").alias("h1"), F.col("k2").alias("h2"), "lo", "hi", "e1", "e2")
    active, done = seqs.select("c", "n", zero.alias("a"), F.col("n").alias("b"), *[zero.alias(x) for x in ("lo", "hi", "e1", "e2")]), []
    while True:
        for _ in range(STEPS):  # rows that are done look up depth -1, which nothing has
            probe = active.withColumn("f", F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b"))).otherwise(F.lit(-1)))
            probe = probe.join(at, ["c", "f"], "left").withColumn("h1", F.coalesce("h1", "c")).withColumn("h2", F.coalesce("h2", "c")).alias("p")
            got = probe.join(handles.alias("t"), ["f", "h1", "h2"], "left")
            hit = F.col("t.hi").isNotNull()
            active = got.select("c", "n", F.when(hit, F.col("t.hi")).otherwise(F.col("a")).alias("a"), F.when(hit | (F.col("f") < 0), F.col("b")).otherwise(F.col("f") - 1).alias("b"), *[F.coalesce(f"t.{x}", f"p.{x}").alias(x) for x in ("lo", "hi", "e1", "e2")])
        active = materialize(active, "trie-search")
        done.append(active)
        rest = active.filter("a < b")
        if rest.isEmpty():
            break
        active = rest
    found = done[0].filter("a >= b")
    for x in done[1:]:
        found = found.union(x.filter("a >= b"))
    extent = paths.select("c", F.col("d").alias("hi"), "h1", "h2")
    same = (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    out = materialize(found.join(extent, ["c", "hi"], "left").select("c", "n", F.when(F.coalesce(same, F.lit(False)), F.col("hi")).otherwise(F.col("lo")).alias("start")), "trie-located")
    discard(*done)
    return out


def insert(nodes: DataFrame | None, seqs: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes (hi, e1, e2, lo, f, k1, k2, s1, s2, q1, q2, cum_lo, c) with the sequences seqs (c, n) in.

    e: hash at depth hi; k: at the handle's depth f; s: at lo + 1; q: at lo, the parent's; cum_lo:
    bytes down to lo; c: a sequence through the node.
    """
    at = paths.select("c", "d", "h1", "h2")
    if nodes is None:
        located, parts, kept = seqs.select("c", "n", F.lit(0).cast("long").alias("start")), None, None
    else:
        located = locate(seqs, paths, nodes)
        ways = located.filter("start < n").withColumn("d", F.col("start") + 1).join(at, ["c", "d"]).select("h1", "h2").distinct()
        ways = materialize(ways.withColumnsRenamed({"h1": "s1", "h2": "s2"}), "trie-ways")
        left = nodes.join(ways, ["s1", "s2"], "left_semi")
        kept = nodes.join(ways, ["s1", "s2"], "left_anti")
        parts = _edge_rows(paths, left.select("c", "lo", "hi"), F.col("lo")).select("c", "d", "h1", "h2", "x1", "x2", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    region = paths.drop("n").join(located.filter("start < n"), "c").filter("d >= start").select("c", "d", "h1", "h2", "x1", "x2", "start", F.col("n").alias("stop"))
    region = materialize(region if parts is None else region.union(parts), "trie-region")
    # prefixes with several next turns, and those at which something ends
    up = region.filter("d > start").groupBy((F.col("d") - 1).alias("hi"), F.col("h1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("e2"))
    parting = up.agg(*[f(x).alias(f"{g}{x}") for x in ("h1", "h2") for g, f in (("a", F.min), ("z", F.max))]).filter("ah1 <> zh1 OR ah2 <> zh2").select(*NODE)
    ending = region.filter("d = stop").select(F.col("d").alias("hi"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    marks = parting.union(ending).distinct()
    marked = region.filter("d > start").withColumnsRenamed({"d": "hi", "h1": "e1", "h2": "e2"}).join(marks, NODE, "left_semi")
    above = F.lag("hi").over(W.partitionBy("c", "start").orderBy("hi"))
    fresh = marked.withColumn("lo", F.coalesce(above, "start")).groupBy(*NODE).agg(F.min("lo").alias("lo"), F.min("c").alias("c")).withColumn("f", two_fattest(F.col("lo"), F.col("hi")))
    fresh = fresh.join(at.withColumnsRenamed({"d": "f", "h1": "k1", "h2": "k2"}), ["c", "f"])
    below = paths.select("c", (F.col("d") - 1).alias("lo"), F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("h1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("q2"), (F.col("cum") - F.col("bytes")).alias("cum_lo"))
    fresh = fresh.join(below, ["c", "lo"])
    out = materialize(fresh if kept is None else fresh.unionByName(kept), "trie-nodes")
    discard(region)
    if nodes is not None:
        discard(nodes, located, ways)
    return out


def busy_prefixes(rows: DataFrame, parts: int = 1000) -> DataFrame:
    """The prefixes (hi, e1, e2) that more than one in `parts` of all rows have: `parts` at most, whatever the size."""
    counts = materialize(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * parts > total).select(*NODE).collect()
    discard(counts)
    return rows.sparkSession.createDataFrame(found, rows.select(*NODE).schema)


def met(rows: DataFrame, nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """rows joined with nodes on the prefix; busy prefixes meet their few nodes where the rows lie, so none fills a task."""
    few = F.broadcast(busy)  # 1,000 rows at most
    near = rows.join(F.broadcast(nodes.join(few, NODE, "left_semi")), NODE)
    return near.unionByName(rows.join(few, NODE, "left_anti").join(nodes.join(few, NODE, "left_anti"), NODE))


def joined_digest(rows: DataFrame, key: str, value: str, size: int = 65536) -> DataFrame:
    """(key, sha256): of the values of each key in ascending order, in decimal and joined by commas.

    Ranges of (key, value) are joined to pieces of about `size` bytes wherever they lie, so a key
    of very many values reaches the task that hashes it as few rows; SHA-256 itself goes through
    them in order and holds one piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, n = None, None, [], 0
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (k != now or n >= size):
                    yield pa.RecordBatch.from_pydict({key: [now], "first": [first], "piece": [",".join(held)]})
                    held, n = [], 0
                if not held:
                    now, first = k, v
                held.append(str(v))
                n += len(held[-1]) + 1
        if held:
            yield pa.RecordBatch.from_pydict({key: [now], "first": [first], "piece": [",".join(held)]})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            keys, got = [], []
            for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    if sha:
                        keys.append(now)
                        got.append(sha.hexdigest())
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(got, pa.string())], [key, "sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], [key, "sha256"])

    cut = rows.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value).mapInArrow(pieces, f"{key} long, first long, piece string")
    return cut.repartition(key).sortWithinPartitions(key, "first").mapInArrow(digests, f"{key} long, sha256 string")


def prefix_trie(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", batches: int = 3) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations (shared_starts), the empty one included.

    conv_id: the smallest conversation with the prefix; depth: its turns; parent_conv_id; n_convs;
    n_children; n_leaves and saved_tokens over the subtree; ends_sha256 of the ids that end here.
    Each batch is four times the one before it. Null turns come first, equal turns go by a digest
    of role and text; null roles and texts are empty; rows without conv_id take no part; repeated
    rows are turns of their own. Very long texts are read once, as a digest and a length. Empty
    table: no rows. Other columns are ignored, whatever their names.
    """
    rows = materialize(numbered(conversations, conv_id, turn, role, text), "trie-turns")
    every = materialize(prefixes(*shared_starts(rows)), "trie-prefixes")
    whole = every.groupBy("c").agg(F.max(F.struct("d", "h1", "h2", "cum")).alias("z")).select("c", F.col("z.d").alias("n"), F.col("z.h1").alias("e1"), F.col("z.h2").alias("e2"), F.col("z.cum").alias("total"))
    whole = materialize(whole, "trie-whole")
    classes = materialize(whole.groupBy("n", "e1", "e2", "total").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("copies")), "trie-classes")
    paths = materialize(every.join(classes.select("c", "n", "total", "copies"), "c"), "trie-paths")
    discard(rows, every)

    nodes, share = None, F.pmod(F.xxhash64("c"), F.lit(1 << 20)) / (1 << 20)
    lows = [0.0, *(4.0 ** (i + 1 - batches) for i in range(batches))]
    for low, high in zip(lows, lows[1:], strict=False):
        some = classes.filter("n > 0").filter((share >= low) & (share < high)).select("c", "n")
        nodes = insert(nodes, some, paths)

    zero = F.lit(0).cast("long")
    children = nodes.groupBy(F.col("lo").alias("hi"), F.col("q1").alias("e1"), F.col("q2").alias("e2")).agg(F.count(F.lit(1)).alias("n_children"))
    root = classes.groupBy().agg(F.min("c").alias("c")).filter("c IS NOT NULL").select(*[zero.alias(x) for x in NODE], F.lit(-1).cast("long").alias("lo"), zero.alias("q1"), zero.alias("q2"), zero.alias("cum_lo"))
    shape = nodes.select(*NODE, "lo", "q1", "q2", "cum_lo").union(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))

    before, path_rows = F.col("cum") - F.col("bytes"), paths.withColumnsRenamed({"d": "hi", "h1": "e1", "h2": "e2"})
    busy = busy_prefixes(path_rows)
    hits = materialize(met(path_rows.withColumn("before", before), shape, busy).drop("x1", "x2", "bytes", "cum"), "trie-hits")
    size = materialize(hits.groupBy(*NODE).agg(F.min("c").alias("least"), F.sum("copies").alias("n_convs")), "trie-sizes")
    top = F.min(F.when(F.col("least") == F.col("c"), F.struct("lo", "cum_lo")))
    seqs = met(hits, size, busy).groupBy("c").agg(top.alias("top"), F.max(((F.col("hi") == F.col("n")) & (F.col("n_children") == 0)).cast("long")).alias("leaf"))
    # a sequence owns what lies below `top` on its path: nodes of which it is the smallest
    own = F.when(F.col("top").isNull(), 0).when(F.col("hi") > F.col("top.lo"), F.col("total") - F.col("before")).otherwise(F.col("total") - F.col("top.cum_lo"))
    sums = hits.join(seqs, "c").groupBy(*NODE, "lo", "q1", "q2", "n_children", "before").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("copies") * (F.col("total") - F.col("before")) - own).alias("saved"))

    many = whole.join(classes.filter("copies > 1").select("n", "e1", "e2", F.col("c").alias("rep")), ["n", "e1", "e2"]).select("rep", "c")
    hashed = joined_digest(many, "rep", "c").withColumnRenamed("rep", "c").union(classes.filter("copies = 1").select("c", F.sha2(F.col("c").cast("string").cast("binary"), 256)))
    ended = classes.select(F.col("n").alias("hi"), "e1", "e2", "c").join(hashed, "c").select(*NODE, "sha256")
    parents = size.select(F.col("hi").alias("lo"), F.col("e1").alias("q1"), F.col("e2").alias("q2"), F.col("least").alias("above"))
    edges = materialize(sums.join(size, NODE).join(ended, NODE, "left").join(parents, ["lo", "q1", "q2"], "left").withColumnsRenamed({"least": "c", "before": "before_hi"}).drop("e1", "e2", "q1", "q2"), "trie-edges")
    discard(hits, size, whole, classes, nodes)

    here = F.col("d") == F.col("hi")
    rows = _edge_rows(paths.select("c", "d", before.alias("before")), edges, F.col("lo") + 1)
    return rows.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == 0, None).when(F.col("d") > F.col("lo") + 1, F.col("c")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(here, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * (F.col("before_hi") - F.col("before"))).alias("saved_tokens"),
        F.coalesce(F.when(here, F.col("sha256")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
