"""Language identification by rank-order profiles of letter n-grams.

Profiles are the most frequent 1- to 3-grams of each language over all training rows. A text's
own ranking is compared with each profile by out-of-place distance: the sum of rank differences,
where an n-gram that the profile lacks costs the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import fresh, materialize

BLANK = 32
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def grams(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (group, code, count) of the 1- to 3-grams of all texts; texts of one group are pooled.

    Every text follows three blanks, so that no n-gram spans two texts. A code packs up to three code points of 21 bits. Words are framed by blanks.
    """
    texts = [t.lower() for t in texts]
    cps = np.frombuffer(("   " + "   ".join(texts) + "   ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 3 for t in texts), dtype=np.int64, count=len(texts))
    group = np.concatenate([np.repeat(groups, sizes), groups[-1:], groups[-1:], groups[-1:]])
    cps = np.where(_letters()[np.minimum(cps, 0x10FFFF)], cps, BLANK)
    cps = np.concatenate([[BLANK], cps, [BLANK]]).astype(np.int64)
    alphabet, c = np.unique(cps, return_inverse=True)
    c = c.astype(np.int64) + 1
    blank = cps == BLANK
    size = np.int64(len(alphabet) + 1)
    left, mid, right = c[:-2], c[1:-1], c[2:]
    in_word = ~blank[1:-1]
    two = in_word | ~blank[2:]
    keys = [(group[in_word] * size**3 + mid[in_word]), (group[two] * size**3 + mid[two] * size + right[two]), (group[in_word] * size**3 + (left[in_word] * size + mid[in_word]) * size + right[in_word])]
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    at, code = keys // size**3, keys % size**3
    wide = np.concatenate([[0], alphabet]).astype(np.int64)
    return at, (wide[code // size**2] << 42) | (wide[code // size % size] << 21) | wide[code % size], count


def _slices(column: pa.Array, chars: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about so many characters; a longer text is a run of its own."""
    texts = [t or "" for t in column.to_pylist()]
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t) + 3
        if n >= chars or i == len(texts) - 1:
            yield start, i + 1, texts[start : i + 1]
            start, n = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs: dict[str, int] = {}
    held: list[tuple] = []

    def pool() -> tuple:
        at, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(at):
            return at, code, n
        order = np.lexsort((code, at))
        at, code, n = at[order], code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (code[1:] != code[:-1])]))
        return at[first], code[first], np.add.reduceat(n, first)

    for b in batches:
        ids = np.array([langs.setdefault(x, len(langs)) for x in b.column("lang").to_pylist()], dtype=np.int64)
        for i, j, texts in _slices(b.column("text")):
            held.append(grams(texts, ids[i:j]))
            if len(held) >= 16:
                held[:] = [pool()]
    if held:
        at, code, n = pool()
        names = np.array(list(langs), dtype=object)
        for i in range(0, len(at), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[s]], pa.string()), pa.array(code[s]), pa.array(n[s], pa.int64())], ["lang", "code", "n"])


def profiles(train: DataFrame, top: int = 300) -> list[tuple[str, int, int]]:
    """(lang, code, rank) of the `top` n-grams of each language, over all rows of train(text, lang).

    Frequent first, ties to the smaller code. The driver gets `top` rows a language at most.
    """
    counts = train.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    for cell in (["lang", F.pmod("code", F.lit(16))], ["lang"]):  # first within sixteenths, so that no task ranks a whole language
        counts = counts.withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= top)
    return [(r.lang, r.code, r["rank"] - 1) for r in counts.select("lang", "code", "rank").collect()]


class Ranker:
    """Compares texts with the profiles."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.langs, self.top = sorted({r[0] for r in rows}), top
        self.codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        at = {x: i for i, x in enumerate(self.langs)}
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), at[lang]] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The nearest language of each text and 1 - distance / greatest distance."""
        n = len(texts)
        who, score = np.full(n, -1), np.zeros(n)
        at, code, count = grams(texts, np.arange(n, dtype=np.int64))
        if len(at) and self.langs:
            order = np.lexsort((np.arange(len(at)), -count, at))
            at, code = at[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            keep = rank < self.top
            at, code, rank = at[keep], code[keep], rank[keep]
            i = np.searchsorted(self.codes, code)
            i[(i == len(self.codes)) | (self.codes[np.minimum(i, len(self.codes) - 1)] != code)] = len(self.codes)
            ranks = self.ranks[i]
            far = np.where(ranks < 0, self.top, np.abs(ranks - rank[:, None]))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total = np.add.reduceat(far, first, axis=0, dtype=np.int64)
            most = np.diff(np.append(first, len(at))) * self.top
            best = total.argmin(axis=1)
            who[at[first]] = best
            score[at[first]] = 1 - total[np.arange(len(best)), best] / most
        return [self.langs[x] if x >= 0 else "und" for x in who], score.tolist()


def identify(docs: DataFrame, train: DataFrame, *, text: str = "text", lang: str = "lang", keep: list[str | Column], top: int = 300, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' `keep` columns plus lang_pred and score (or as `named`), learned from train's text and lang.

    Null text or one without letters: `und`, score 0; so is every text if nothing can be learned.
    Rows of train with null text or lang teach nothing. Equal distances: the first language in
    order of name. Whole texts count; repeated rows are scored alike. Empty docs: no rows.
    """
    spark = docs.sparkSession
    known = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = profiles(known, top)
    shared = spark.sparkContext.broadcast(rows)
    (own,) = fresh(docs.select(*keep), "text")
    cols = docs.select(*keep, F.col(text).alias(own))
    schema = cols.drop(own).schema.add(named[0], "string").add(named[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, top)
        for b in batches:
            names, scores = [], []
            for _, _, texts in _slices(b.column(own)):
                x, y = ranker.predict(texts)
                names += x
                scores += y
            others = [i for i, f in enumerate(b.schema) if f.name != own]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return cols.mapInArrow(run, schema)


def is_held_out(doc_id: Column, parts: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))
