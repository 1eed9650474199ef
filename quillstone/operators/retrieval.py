"""Retrieval of many queries at once: every operator is keyed by query_id."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stems import stems
from ..functions.text import STOP_WORDS, lexemes, words
from ..functions.vectors import cosine, dot

BM25_K, BM25_B, BM25_LENGTH = 1.2, 0.75, 256
LEAST_SALTS, PART = 8, 20_000  # parts of a collection at least, and points in a part
BLOCK, HELD = 4096, 2**19  # points that meet a group's queries at a time, and components of a group's vectors
HEAD, BODY = 1.0, 0.4  # weights of a word by its place


class Tops:
    """The k best points of each query by cosine to 6 places; ties take the smaller item.

    Matrix products tell which pairs may be among them; those are computed again component by component, as Spark adds them up.
    """

    def __init__(self, x: np.ndarray, norm: np.ndarray, skip: np.ndarray, k: int):
        self.x, self.norm, self.skip, self.k = x, norm, skip, k
        self.unit = x / np.where(norm == 0, 1.0, norm)[:, None]
        self.score, self.item = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)

    def add(self, items: np.ndarray, y: np.ndarray, norm: np.ndarray) -> None:
        unit = y / np.where(norm == 0, 1.0, norm)[:, None]
        for low in range(0, len(self.x), 1024):
            part = slice(low, low + 1024)
            near, least, skip = self.unit[part] @ unit.T, self.score[part, -1].copy(), self.skip[part]
            open_ = np.flatnonzero(np.isneginf(least))
            if len(open_) and len(items) > self.k:
                seen = near[open_]
                seen[skip[open_, None] == items] = -np.inf
                least[open_] = np.partition(seen, -self.k, axis=1)[:, -self.k] - 1e-6
            q, p = np.nonzero(near >= (least - 1e-6)[:, None])  # places beyond the sixth may change the order
            other = skip[q] != items[p]
            q, p = q[other] + low, p[other]
            for i in range(0, len(q), 65536):
                self._merge(q[i : i + 65536], items[p[i : i + 65536]], self._exact(q[i : i + 65536], y, norm, p[i : i + 65536]))

    def _exact(self, q: np.ndarray, y: np.ndarray, norm: np.ndarray, p: np.ndarray) -> np.ndarray:
        total, norms = np.zeros(len(q)), self.norm[q] * norm[p]
        for a, b in zip(self.x[q].T, y[p].T, strict=True):
            total += a * b
        s = np.where(norms == 0, 0.0, total / np.where(norms == 0, 1.0, norms))
        at = np.abs(s) * 1e6
        up = np.floor(at + 0.5)
        for i in np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-6).tolist():  # halves go by decimal places
            up[i] = float(Decimal(repr(float(abs(s[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) * 1e6
        return np.sign(s) * np.rint(up) / 1e6 + 0.0

    def _merge(self, q: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        of = np.unique(q)
        held = self.score[of] > -np.inf
        q, item, score = np.concatenate([q, np.repeat(of, held.sum(axis=1))]), np.concatenate([item, self.item[of][held]]), np.concatenate([score, self.score[of][held]])
        order = np.lexsort((item, -score, q))
        q, item, score = q[order], item[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        kept = rank < self.k
        self.score[of] = -np.inf
        self.score[q[kept], rank[kept]], self.item[q[kept], rank[kept]] = score[kept], item[kept]


def vector_paths(queries: DataFrame, points: DataFrame, k: int, min_score: float | None = 0.5) -> DataFrame:
    """Ranked paths (query_id, collection, family, path_no, rank, item, score).

    queries: (query_id, collection, family, path_no, skip, vector), a row for each requested
    collection, so vectors meet only points of that collection. points: (item, collection, vector,
    norm). skip: an item never returned for the query, or null. A collection's points are dealt
    into parts and its queries into groups; a task holds a group with its best k and streams a
    part past it, so memory hangs on neither table and only the best of each part are ranked.
    Null, non-finite, extreme or odd-sized vectors meet all others by column functions.
    """
    q = queries.withColumn("qnorm", F.sqrt(dot(F.col("vector"), F.col("vector")))).withColumnRenamed("vector", "qvector")
    usual = lambda norm: F.coalesce((F.col(norm) == 0) | F.col(norm).between(1e-140, 1e140), F.lit(False))
    q, points = q.withColumn("_fit", usual("qnorm")), points.withColumn("_fit", usual("norm") & F.col("item").isNotNull())
    whole = ("tinyint", "smallint", "int", "bigint")
    size = lambda c: [F.count(F.lit(1)).alias("n"), F.count_if("_fit").alias("fit"), F.min(F.when(F.col("_fit"), F.size(c))).alias("low"), F.max(F.when(F.col("_fit"), F.size(c))).alias("high")]
    have = points.agg(*size("vector")).first()
    ask = q.groupBy("collection").agg(*size("qvector")).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("fit").alias("fit"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    fast = bool(have.high) and dict(points.dtypes)["item"] in whole and dict(q.dtypes)["skip"] in (*whole, "void")
    same = fast and (have.n, have.low) == (have.fit, have.high) and (ask.n, ask.low, ask.high) == (ask.fit, have.high, have.high)
    order = W.partitionBy("query_id", "collection", "path_no").orderBy(F.desc("score"), "item")
    out = ["query_id", "collection", "family", "path_no", "item", "score"]
    near = _streamed(q.filter(F.col("_fit") & (F.size("qvector") == have.high)), points.filter(F.col("_fit") & (F.size("vector") == have.high)), k, have.n, ask.most or 1, have.high).select(*out) if fast else None
    if not same:
        salts = max(LEAST_SALTS, -(-have.n // PART))
        norms = F.col("qnorm") * F.col("norm")
        score = F.round(F.when(norms == 0, F.lit(0.0)).otherwise(dot(F.col("qvector"), F.col("vector")) / norms), 6)
        salted = points.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int")).withColumnRenamed("_fit", "_pfit")
        dealt = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        odd = salted.join(dealt, ["collection", "_salt"]).filter(F.coalesce(F.col("item") != F.col("skip"), F.lit(True)))
        if fast:
            odd = odd.filter(~(F.col("_fit") & F.col("_pfit") & (F.size("vector") == have.high) & (F.size("qvector") == have.high)))
        odd = odd.withColumn("score", score).select(*out)
        near = near.unionByName(odd) if fast else odd
    if min_score is not None:
        near = near.filter(F.col("score") >= min_score)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _streamed(queries: DataFrame, points: DataFrame, k: int, total: int, most: int, dim: int) -> DataFrame:
    """(query_id, collection, family, path_no, item, score): the best k of each part of a collection for each query; all vectors have `dim` finite components."""
    part = max(BLOCK, min(PART, total // 64))
    groups = -(-most // max(256, HELD // dim))
    counts = points.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kinds = dict(queries.dtypes)["qvector"], dict(points.dtypes)["vector"]
    kind = "array<float>" if set(kinds) == {"array<float>"} else "array<double>"
    of = lambda d, c: F.lit(None).cast(dict(d.dtypes)[c]).alias(c)
    asked = queries.join(counts, "collection").select("collection", every(F.col("_parts")).alias("_part"), F.pmod(F.xxhash64("query_id", "family", "path_no"), F.lit(groups)).cast("int").alias("_group"), F.lit(False).alias("_point"), "query_id", "family", "path_no", F.col("skip").cast("long").alias("skip"), of(points, "item"), F.col("qvector").cast(kind).alias("v"), F.col("qnorm").alias("norm"))
    held = points.join(counts, "collection").select("collection", F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int").alias("_part"), every(F.lit(groups)).alias("_group"), F.lit(True).alias("_point"), of(queries, "query_id"), of(queries, "family"), of(queries, "path_no"), F.lit(None).cast("long").alias("skip"), "item", F.col("vector").cast(kind).alias("v"), "norm")
    cell = ["collection", "_part", "_group"]
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, -(-total // part) * groups))
    rows = asked.unionByName(held).repartition(tasks, *cell).sortWithinPartitions(*cell, "_point")
    fields = rows.select("query_id", "collection", "family", "path_no", "item").schema.add("score", "double")
    nowhere = -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tops, asked_, waiting = None, None, None, []

        def told() -> Iterator[pa.RecordBatch]:
            if tops is not None:
                q, j = np.nonzero(tops.score > -np.inf)
                for i in range(0, len(q), 10000):
                    a, b = q[i : i + 10000], j[i : i + 10000]
                    cols = [c.combine_chunks().take(pa.array(a)) for c in asked_.columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(tops.item[a, b]).cast(kind_of), pa.array(tops.score[a, b])], ["query_id", "collection", "family", "path_no", "item", "score"])

        for batch in batches:
            kind_of = batch.schema.field("item").type
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*cell, "_point")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if keys[low][:3] != at:
                    yield from told()
                    at, tops, asked_, waiting = keys[low][:3], None, None, []
                b = batch.slice(low, high - low)
                if not keys[low][3]:
                    waiting.append(b)
                    continue
                values = lambda t: t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                if waiting:
                    x = np.concatenate([values(w) for w in waiting])
                    skip = np.concatenate([w.column("skip").fill_null(nowhere).to_numpy(zero_copy_only=False) for w in waiting])
                    asked_ = pa.Table.from_batches(waiting).select(["query_id", "collection", "family", "path_no"])
                    tops, waiting = Tops(x, np.concatenate([w.column("norm").to_numpy(zero_copy_only=False) for w in waiting]), skip, k), []
                if tops is not None:
                    y, norm, items = values(b), b.column("norm").to_numpy(zero_copy_only=False), b.column("item").cast(pa.int64()).to_numpy(zero_copy_only=False)
                    for i in range(0, len(y), BLOCK):
                        tops.add(items[i : i + BLOCK], y[i : i + BLOCK], norm[i : i + BLOCK])
        yield from told()

    return rows.mapInArrow(run, fields)


def with_norms(points: DataFrame) -> DataFrame:
    """Points with the norms that vector_paths needs, computed once per point."""
    return points.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def postings(passages: DataFrame, text: Column, asked: DataFrame | None = None) -> DataFrame:
    """(collection, item, term, tf, weight, length) of every passage, or of the asked terms(term) alone; terms are stems.

    tf counts a stem's words; weight adds up their weights by place: HEAD in the first line, BODY
    behind it. Markers like {{v:3}} are no words. The distinct words are
    stemmed, and only those whose stem is asked for go on, before anything else is dealt: the
    shuffle grows with what the queries match and not with the corpus's words.
    """
    plain = F.regexp_replace(text, r"\{\{v:\d+\}\}", " ")
    vocabulary = passages.select(F.explode(words(plain)).alias("word")).distinct()
    known = stems(vocabulary).filter(~F.col("word").isin(STOP_WORDS)).withColumnRenamed("stem", "term")
    if asked is not None:
        known = known.join(asked.select("term").distinct(), "term", "left_semi")
    toks = passages.select("collection", "item", words(plain).alias("w"), F.size(words(F.substring_index(plain, "\n", 1))).alias("head")).withColumn("length", F.size("w"))
    toks = toks.select("collection", "item", "length", "head", F.posexplode("w").alias("at", "word")).join(known, "word").withColumn("weight", F.when(F.col("at") < F.col("head"), HEAD).otherwise(BODY))
    return toks.groupBy("collection", "item", "length", "term").agg(F.count(F.lit(1)).alias("tf"), F.round(F.sum("weight"), 6).alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, n_terms, term) of queries (query_id, text): the distinct stems of their words, stop words left out."""
    w = queries.select("query_id", F.explode(lexemes(F.col("text"))).alias("word"))
    got = w.join(stems(w.select("word").distinct()), "word").select("query_id", F.col("stem").alias("term")).distinct()
    return got.join(got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id").select("query_id", "n_terms", "term")


def bm25(tf: Column, length: Column) -> Column:
    """Saturated term weight with fixed constants, so that no corpus fit is needed."""
    return tf * (BM25_K + 1) / (tf + BM25_K * (1 - BM25_B + BM25_B * length / BM25_LENGTH))


def matched_terms(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, collection, item, n_terms, matched, weight) of items with some query term.

    terms: (query_id, term, n_terms), terms distinct within a query. The join is on term;
    how terms are dealt, and the split of very common ones, is Spark's adaptive join's work.
    """
    hits = posted.join(terms, "term")
    return hits.groupBy("query_id", "collection", "item", "n_terms").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum(bm25(F.col("weight"), F.col("length"))), 6).alias("weight"))


def fts_and(posted: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Items with every term, by weight; the best k of each (query, collection)."""
    all_of = matched_terms(posted, terms).filter("matched = n_terms")
    order = W.partitionBy("query_id", "collection").orderBy(F.desc("weight"), "item")
    return all_of.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fts_min_match(posted: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Items with at least min(half the terms, the most that any item of the collection matches)."""
    some = matched_terms(posted, terms)
    most = F.max("matched").over(W.partitionBy("query_id", "collection"))
    kept = some.withColumn("most", most).filter(F.col("matched") >= F.least(F.ceil(F.col("n_terms") / 2), F.col("most")))
    order = W.partitionBy("query_id", "collection").orderBy(F.desc("matched"), F.desc("weight"), "item")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("most")


def rrf(paths: DataFrame, k: int = 20, top_n: int = 30, sure: int = 3) -> DataFrame:
    """Reciprocal rank fusion: a family votes once, with its best rank; families add up.

    Keeps the best top_n of each (query, collection) and every path's first `sure`.
    """
    votes = paths.groupBy("query_id", "collection", "item", "family").agg(F.max(1.0 / (k + F.col("rank"))).alias("vote"), F.min("rank").alias("best"), F.min(F.struct("path_no", "rank")).alias("first"))
    fused = votes.groupBy("query_id", "collection", "item").agg(F.round(F.sum("vote"), 9).alias("score"), F.min("best").alias("best"), F.min("first").alias("first"))
    order = W.partitionBy("query_id", "collection").orderBy(F.desc("score"), "first.path_no", "first.rank", "item")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= top_n) | (F.col("best") <= sure)).select("query_id", "collection", "item", "score", "rank")


__all__ = ["bm25", "cosine", "fts_and", "fts_min_match", "matched_terms", "postings", "query_terms", "rrf", "vector_paths", "with_norms"]
