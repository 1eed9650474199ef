"""Nearest neighbours by block matrix join with int8 product tiles.

Queries and rows are dealt into cells; every group of queries meets every part of the rows. A cell's
queries come first and are held, its rows stream past them block by block. Products of
int8 codes give approximate distances whose error the codes' residual norms bound; pairs whose
least possible distance is not beyond the k-th greatest possible one are recomputed from the
original vectors in double precision and merged into each query's heap. Nothing is missed, so
recall is 1.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize

QUERY_BLOCK, ROW_BLOCK, GROUP = 1024, 4096, 65536
HELD = 16  # query blocks of a group: what a task holds at a time, with their heaps


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, squared norms of what the codes stand for, and norms of the residuals.

    Rows whose squares double precision can't hold get an infinite residual: nothing is known of them.
    """
    top = np.abs(x).max(axis=1)
    wild = (top > 1e140) | (top < 1e-140)
    x = np.where(wild[:, None], 1.0, x)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    stand = codes * scale[:, None]
    return codes, scale, (stand**2).sum(axis=1), np.where(wild, np.inf, np.sqrt(((x - stand) ** 2).sum(axis=1)))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows; components are added in order, as a plain loop does."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            total += (a - b) ** 2
    out = np.sqrt(total)
    for i in np.flatnonzero(~np.isfinite(total) | (total < 1e-290)).tolist():  # squares too large or too small for doubles
        by = 1.0 if total[i] < 1 else 2.0
        d = x[i] / by - y[i] / by
        top = np.abs(d).max()
        with np.errstate(over="ignore"):
            out[i] = np.sqrt(((d / top) ** 2).sum()) * top * by if top else 0.0
    return out


class Heaps:
    """The k nearest rows of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, vectors.astype(np.float64), k
        self.codes, self.scale, self.norm, self.error = _codes(self.x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        y = vectors.astype(np.float64)
        codes, scale, norm, error = _codes(y)
        wide = np.float32 if y.shape[1] <= 1000 else np.float64  # sums of int8 products stay exact
        dots = (self.codes.astype(wide) @ codes.astype(wide).T).astype(np.float64)
        dots *= -2 * self.scale[:, None]
        dots *= scale
        dots += self.norm[:, None]
        dots += norm
        near = np.sqrt(np.maximum(dots, 0, out=dots), out=dots)
        worst = np.array([-h[0][0] if len(h) == self.k else np.inf for h in self.heaps])
        open_ = np.flatnonzero(np.isinf(worst))
        if len(open_) and len(ids) > self.k:  # a full heap has a bound already
            far = near[open_] * (1 + 1e-9) + self.error[open_, None] + error + 1e-9
            far[self.ids[open_, None] == ids] = np.inf
            worst[open_] = np.minimum(worst[open_], np.partition(far, self.k - 1, axis=1)[:, self.k - 1])
        low = near
        low *= 1 - 1e-9
        low -= error
        rows, cols = np.nonzero(low <= (worst + self.error + 1e-9)[:, None])
        other = self.ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        for i in range(0, len(rows), 65536):
            r, c = rows[i : i + 65536], cols[i : i + 65536]
            exact = _distances(self.x[r], y[c])
            for q, d, v in zip(r.tolist(), exact.tolist(), ids[c].tolist(), strict=True):
                h = self.heaps[q]
                if len(h) < self.k:
                    heapq.heappush(h, (-d, -v))
                elif (-d, -v) > h[0]:
                    heapq.heapreplace(h, (-d, -v))

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for q, h in zip(self.ids.tolist(), self.heaps, strict=True):
            for d, v in h:
                yield q, -v, -d


def usable(vector: Column) -> Column:
    """False for vectors that are null, empty, zero or hold null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, is_query: Column, k: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by Euclidean distance.

    Queries are the rows for which is_query holds; candidates are all rows with another vec_id.
    Ties: smaller vec_id first. Unusable vectors and rows without vec_id take no part. Vectors are
    compared with those of their own length only. A repeated vec_id is one query, by its least
    vector, but as many candidates as it has rows. Very long vectors only make blocks larger.
    Fewer candidates than k: all. Empty table: no rows. Other columns are ignored.
    """
    ids, kind = F.col(vec_id).cast("long"), rows.schema[vector].dataType.simpleString()
    values = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    good = rows.filter(usable(F.col(vector)) & ids.isNotNull()).select(ids.alias("vec_id"), values.alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("_r"))
    good = materialize(good.withColumn("d", F.size("v")), "ann-rows")
    total, n_queries = good.agg(F.count(F.lit(1)), F.count_if("q")).first()
    spark = rows.sparkSession
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spread = max(-(-total // GROUP), int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = math.ceil(n_queries / (QUERY_BLOCK * HELD))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = good.filter("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    asked = asked.select("d", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("b"), every(spread).alias("g"), F.lit(False).alias("row"), "vec_id", "v")
    dealt = good.select("d", every(groups).alias("b"), F.pmod(F.xxhash64("_r"), F.lit(spread)).cast("int").alias("g"), F.lit(True).alias("row"), "vec_id", "v")
    cells = asked.unionByName(dealt).repartitionById(spread, F.col("g")).sortWithinPartitions("d", "b", "g", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int, int] | None = None
        held: list[Heaps] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            for h in held:
                out = list(h.rows())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "b", "g", "row")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                d, b, g, row = keys[:, low].tolist()
                if (d, b, g) != at:
                    yield from told()
                    at, held, waiting = (d, b, g), [], []
                part = batch.slice(low, high - low)
                x, i = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), part.column("vec_id").to_numpy(zero_copy_only=False)
                if not row:
                    waiting.append((i, x))
                    continue
                if waiting:
                    qi, qx = (np.concatenate(z) for z in zip(*waiting, strict=True))
                    held, waiting = [Heaps(qi[j : j + QUERY_BLOCK], qx[j : j + QUERY_BLOCK], k) for j in range(0, len(qi), QUERY_BLOCK)], []
                for j in range(0, len(i) if held else 0, ROW_BLOCK):
                    for h in held:
                        h.add(i[j : j + ROW_BLOCK], x[j : j + ROW_BLOCK])
        yield from told()

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
