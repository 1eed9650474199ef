"""Ranked lexical search turned round: documents stream past an index of the items' terms.

The items are the few, so an inverted index over their terms (term -> items) is sent to every
task, in blocks of items whose size is bounded. One pass cuts each document into terms and keeps
what the index knows of it; its sums give the corpus counts. A second pass takes those term counts
through the index and updates a bounded heap for each item; the heaps of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import discard, materialize

#: Bytes of text to term bytes: what can't be in a term becomes a blank, A-Z lower case.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK_BYTES = 16_000_000  # of items' texts whose terms are sent out together
ROOM = 4_000_000  # (document, item) sums held at once


def terms(text: bytes | str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(TERM_BYTES).split()


class Heaps:
    """The `top` best (score, document) of each item: higher scores first, then smaller document ids, null ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)
        self.item, self.doc, self.no_id, self.score = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def update(self, item: np.ndarray, doc: np.ndarray, no_id: np.ndarray, score: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.least[item])
        cols = [np.concatenate([a, b[keep]]) for a, b in ((self.item, item), (self.doc, doc), (self.no_id, no_id), (self.score, score))]
        order = np.lexsort((cols[1], cols[2], -cols[3], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) if len(order) else np.empty(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.item, self.doc, self.no_id, self.score = (c[rank < self.top] for c in cols)
        full = rank == self.top - 1
        self.least[cols[0][full]] = cols[3][full]


def _blocks(items: DataFrame, size: int) -> Iterator[DataFrame]:
    """items (item_id, text) in blocks of about `size` bytes of text, dealt by hash of the id."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for i in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)


def counted(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) for every document with terms: how many, and those that index knows with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            row, n, at, tf, ends = [], [], [], [], [0]
            for i, t in enumerate(b.column("text")):
                words = terms(t.as_py())
                if words:
                    some = {k: c for w, c in Counter(words).items() if (k := known.get(w)) is not None}
                    row.append(i)
                    n.append(len(words))
                    at.extend(some)
                    tf.extend(some.values())
                    ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _weights(seen: DataFrame, known: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term of the index."""
    n, length = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(known, np.int64)
    for r in seen.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row for each term of the bounded index
        df[r.term] = r["count"]
    return n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _best(seen: DataFrame, asked: list[list[int]], known: int, top: int) -> DataFrame:
    """(item, doc_id, score): the heaps of all tasks. asked: the terms of each item."""
    total, length, weight = _weights(seen, known)
    pairs = sorted((t, i) for i, ts in enumerate(asked) for t in ts)
    of_term = np.array([i for _, i in pairs], dtype=np.int64)
    first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(known + 1))
    shared = seen.sparkSession.sparkContext.broadcast((weight, of_term, first))
    n_items = len(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, items, start = shared.value
        heaps, many = Heaps(n_items, top), np.diff(start)
        step = max(1, ROOM // max(n_items, 1))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                n, doc = part.column("n").to_numpy(), part.column("doc_id")
                no_id, ids = np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
                m = 10 + np.array([90 * x * total // length for x in n.tolist()], dtype=np.int64)
                lists = part.column("term")
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                # each (document, term) goes to the items that hold the term
                reps = many[term]
                at = np.repeat(start[term] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
                cell = np.repeat(row, reps) * n_items + items[at]
                sums = np.zeros(part.num_rows * n_items, np.int64)
                np.add.at(sums, cell, np.repeat(gain, reps))
                sums = sums.reshape(part.num_rows, n_items)
                r, k = np.nonzero(sums >= np.maximum(heaps.least, 1))
                heaps.update(k, ids[r], no_id[r], sums[r, k])
        docs = pa.array(heaps.doc, pa.int64(), mask=heaps.no_id)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), docs, pa.array(heaps.score)], ["item", "doc_id", "score"])

    return seen.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item, scores above 0 only.

    Scores are sums of whole numbers, so they don't depend on order or partitioning; equal ones go
    by ascending doc_id, null ids last. A repeated doc_id is a document each time; item rows of one
    id are one item with the terms of all. Null texts hold no term, items without terms get no
    row. Long texts are cut whole. Items go in blocks of `block_bytes` of text, one pass over docs
    a block, so what tasks are sent is bounded. Empty tables: no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    found = None
    for block in _blocks(named, block_bytes):
        held: dict = {}
        for r in block.collect():  # block_bytes of text at most, but for a single longer item
            held.setdefault(r.item_id, set()).update(terms(r.text))
        index = {t: k for k, t in enumerate(sorted(set().union(*held.values())))}
        if not index:
            continue
        seen = materialize(counted(rows, index), "reversed-counts")
        best = _best(seen, [[index[t] for t in ts] for ts in held.values()], len(index), top)
        # heaps meet in two steps, so that an item's heaps of very many tasks don't meet in one
        best = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for key in (["item", "part"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(held)), f"item long, item_id {dict(named.dtypes)['item_id']}")
        done = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "reversed-best")  # names: the block's items
        discard(seen)
        found = done if found is None else found.union(done)
    if found is None:
        return spark.createDataFrame([], named.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    return found
