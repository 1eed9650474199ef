"""Fingerprints that keep edit distance: random walks over characters, sampled.

All texts share one table of random bits. A walk stands at a character and moves on to the next
one after as many steps as the table's bits for (step, character) say, so two texts with few edits
between them soon walk in step again and see the same characters at the same steps. A fingerprint
holds a byte for the character seen at certain steps, the same for all texts: the first 32, and 24
of each later doubling. Fingerprints can be compared place by place whatever the lengths, and each
doubling of a text's length weighs the same. It ends where the walk has left the text.

Bands of sampled places bring texts with few edits together; an exact edit distance within a bound
decides.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

PERIOD = 8192  # steps after which the table of bits begins anew
FIRST, EACH, DOUBLINGS = 32, 24, 40
LONG = 1 << 20  # characters from which a text is walked by itself, in blocks of as many
FEW = 24  # texts from which walking side by side pays


@lru_cache(1)
def tables() -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """Steps to wait by class of character and step, the sampled steps, a salt for each of them, and the steps as an array."""
    r = np.random.default_rng(20130)
    bits = r.integers(0, 2, (256, PERIOD), dtype=np.int8)
    wait = np.empty((256, PERIOD), np.uint8)
    now = np.zeros(256, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        now = np.where(bits[:, j % PERIOD] == 1, 1, np.minimum(now + 1, 255))
        if j < PERIOD:
            wait[:, j] = now
    steps = list(range(FIRST))
    for d in range(DOUBLINGS):
        low = FIRST << d
        steps += sorted(low + int(x) for x in r.choice(min(low, 1 << 20), EACH, replace=False) * max(1, low >> 20))
    return [w.tobytes() for w in wait], steps, r.integers(1, 1 << 32, len(steps), dtype=np.uint64), np.array(steps)


@lru_cache(1)
def _flat() -> np.ndarray:
    return np.frombuffer(b"".join(tables()[0]), np.uint8).astype(np.int64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def classes(points: np.ndarray) -> np.ndarray:
    """256 classes of characters."""
    return ((points * np.uint32(2654435761)) >> np.uint32(15)).astype(np.uint8)


def _seen(points: np.ndarray, reached: np.ndarray, end: int) -> bytes:
    """A byte for each sampled step from the first one of reached up to end: the character seen then, hashed."""
    _, steps, salts, places = tables()
    low, high = bisect_left(steps, int(reached[0])), bisect_left(steps, end)
    seen = points[np.searchsorted(reached, places[low:high], side="right") - 1].astype(np.uint64)
    return (((seen + 1) * salts[low:high] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _alone(points: np.ndarray, step: int, mark: int) -> tuple[bytes, int, int]:
    """walks() of one text, in blocks of characters."""
    wait, last, out, marked = tables()[0], PERIOD - 1, [], step
    for i in range(0, len(points), LONG):
        part, reached = points[i : i + LONG], array("q")
        reach = reached.append
        for row in map(wait.__getitem__, classes(part).tobytes()):
            reach(step)
            step += row[step & last]
        if i <= mark < i + len(part):
            marked = reached[mark - i]
        out.append(_seen(part, np.frombuffer(reached, np.int64), step))
    return b"".join(out), step, step if mark >= len(points) else marked


def walks(texts: list[np.ndarray], starts: list[int], marks: list[int]) -> list[tuple[bytes, int, int]]:
    """For each text: its bytes, the step at which its last character is left, and the step at which the marked one is reached.

    Texts of a group take their characters one by one side by side; the few that are much longer
    than the others, or long by themselves, go on alone.
    """
    table = _flat()
    order = sorted((i for i, t in enumerate(texts) if 0 < len(t) <= LONG), key=lambda i: -len(texts[i]))
    out: list = [_alone(t, s, m) if len(t) > LONG else (b"", s, s) for t, s, m in zip(texts, starts, marks, strict=True)]
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    first = np.cumsum(sizes) - sizes
    points = np.concatenate([texts[i] for i in order])
    kinds = classes(points).astype(np.int32) * PERIOD
    reached, at, step = np.empty(len(points), np.int64), first.copy(), np.array([starts[i] for i in order])
    going = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()  # texts longer than i
    for n in going:
        if n < FEW:
            break
        p, s = at[:n], step[:n]
        reached[p] = s
        s += table[kinds[p] + (s & (PERIOD - 1))]
        p += 1
    wait = tables()[0]
    for k, i in enumerate(order):
        a, b, s = int(first[k]), int(first[k] + sizes[k]), int(step[k])
        if at[k] < b:
            rest, last = array("q"), PERIOD - 1
            for row in map(wait.__getitem__, classes(points[at[k] : b]).tobytes()):
                rest.append(s)
                s += row[s & last]
            reached[at[k] : b] = np.frombuffer(rest, np.int64)
        out[i] = _seen(points[a:b], reached[a:b], s), s, s if marks[i] >= b - a else int(reached[a + marks[i]])
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal places; places that only one has count as unequal. Two empty ones are alike."""
    n = min(len(a), len(b))
    same = int((np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)).sum())
    return same / max(len(a), len(b)) if a or b else 1.0


@dataclass
class Print:
    """A text, its fingerprint, and the step at which its second half begins."""

    text: str
    points: np.ndarray
    bytes: bytes
    half: int


def prints(texts: list[str]) -> list[Print]:
    points = [codes(t) for t in texts]
    done = walks(points, [0] * len(texts), [len(p) - len(p) // 2 for p in points])
    return [Print(t, p, f, half) for t, p, (f, _, half) in zip(texts, points, done, strict=True)]


def groups(texts: Iterable[str], rows: int = 1024, chars: int = 4_000_000) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        if held and (len(held) >= rows or n + len(t) > chars):
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def with_edits(pairs: list[tuple[Print, Print]]) -> list[tuple]:
    """For each (document, next one) the result's columns behind doc_id; the first half of a text isn't walked again."""
    steps = tables()[1]
    halves = [len(d.points) // 2 for d, _ in pairs]
    rest = walks([o.points[:h] for h, (_, o) in zip(halves, pairs, strict=True)], [d.half for d, _ in pairs], [0] * len(pairs))
    out = []
    for h, (d, o), (tail, _, _) in zip(halves, pairs, rest, strict=True):
        text, found = d.text[: len(d.text) - h] + o.text[:h], d.bytes[: bisect_left(steps, d.half)] + tail
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((len(d.points), sha, d.bytes.hex(), found.hex(), likeness(d.bytes, found), likeness(d.bytes, o.bytes)))
    return out


def compared(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and near_next of every row.

    The next document is the one before in ascending doc_id (after the last the first); equal ids
    go by a hash of the text, null ids come last. Rows are dealt by ranges of that order, so each
    meets its next one in its task; only the last of each range waits for the first of the next.
    Null texts are empty; an empty text has an empty fingerprint. Repeated rows are rows of their
    own. Texts are walked whole, one at a time. A single row is its own next one. Empty table: no
    rows. Other columns, whatever their names, are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # repeated rows are dealt on by their places, which change nothing in the result
    rows = rows.withColumn("m", F.pmod(F.monotonically_increasing_id(), F.lit(65536)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def columns(done: list[tuple]) -> list[pa.Array]:
        return [pa.array([d[i] for d in done], k) for i, k in enumerate(arrow)]

    def edge(own: pa.Array, text: str, which: int, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own, *[pa.nulls(1, k) for k in arrow], pa.array([text]), pa.array([which], pa.int32()), pa.array([part], pa.int32())], [*out, "text", "edge", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, TaskContext.get().partitionId()
        for b in batches:
            ids, row = b.column("doc_id"), 0
            for texts in groups(b.column("text").to_pylist()):
                now, own = prints(texts), ids.slice(row, len(texts))
                row += len(texts)
                if held is None:  # the range's first text, for the last one of the range before
                    yield edge(own.slice(0, 1), texts[0], 1, part)
                else:
                    own = pa.concat_arrays([held[0], own])
                    now.insert(0, held[1])
                held = own.slice(len(own) - 1), now[-1]
                done = with_edits(list(zip(now, now[1:], strict=False)))
                if done:
                    n = len(done)
                    yield pa.RecordBatch.from_arrays([own.slice(0, n), *columns(done), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32())], [*out, "text", "edge", "part"])
        if held:
            yield edge(held[0], held[1].text, 2, part)

    told = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, f"{types}, text string, edge int, part int")
    told = materialize(told, "prints")
    parts = sorted(r.part for r in told.filter("edge = 1").select("part").collect())  # one row for each range
    follow = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = told.filter("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("other"))
    waiting = told.filter("edge = 2").select("doc_id", "text", "part").join(F.broadcast(follow), "part").join(heads, "next").select("doc_id", "text", "other")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [with_edits([tuple(prints([t, o]))])[0] for t, o in zip(b.column("text").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns(done)], out)

    return told.filter("edge = 0").select(*out).union(waiting.mapInArrow(last, types))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits between a and b if there are `most` at most: furthest places on each diagonal, for one edit more at a time."""

    def equal(i: int, j: int) -> int:
        n, at, step = min(len(a) - i, len(b) - j), 0, 64
        while at < n:
            m = min(step, n - at)
            same = a[i + at : i + at + m] == b[j + at : j + at + m]
            if not same.all():
                return at + int(same.argmin())
            at, step = at + m, step * 2
        return n

    goal = len(b) - len(a)
    if abs(goal) > most:
        return None
    far = {0: equal(0, 0)}
    if goal == 0 and far[0] >= len(a):
        return 0
    for e in range(1, most + 1):
        now = {}
        for d in range(-e, e + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)  # change, insert, delete
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                now[d] = i + equal(i, i + d)
        if now.get(goal, -1) >= len(a):
            return e
        far = now
    return None


def bands(text: str, edits: int, count: int, places: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, band, places sampled): of the steps below a power of two that text and its neighbours' lengths share."""
    print_, n = prints([text])[0].bytes, len(text)
    slack, steps = min(edits, n // 4), tables()[1]
    for level in sorted({max(1, n - slack).bit_length() - 1, max(1, n + slack).bit_length() - 1}):
        have = bisect_left(steps, 1 << level)
        body = np.frombuffer(print_[:have].ljust(have, b"\0"), np.uint8)
        r = np.random.default_rng([7, level])
        for k in range(count):
            # places of one band lie in one of the last doublings: an edit puts walks out of step for a while only
            high = max(level - k % 4, min(level, 6))
            first, last = (bisect_left(steps, (1 << high) // 2) if high > 6 else 0), bisect_left(steps, 1 << high)
            yield level, k, body[first + np.sort(r.choice(last - first, min(places, last - first), replace=False))].tobytes()


def near_texts(docs: DataFrame, asked: Column, *, doc_id: str = "doc_id", text: str = "text", edits: int = 16, count: int = 24, places: int = 4) -> tuple[DataFrame, DataFrame]:
    """Pairs (query_id, doc_id, distance) of different texts, and the class of every row (doc_id, class_id).

    Queries are the texts of the rows for which asked is true, against all texts. A pair lies
    within `edits` edits and a fifth of the longer text, told exactly; `count` bands of `places`
    sampled steps bring pairs together (recall is measured by a test). A class is all rows of one
    text, named by its smallest doc_id, so copies cost one comparison. Null texts are empty.
    Empty table: no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    known = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("asked").alias("asked"), F.first("text").alias("text")), "prints-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, asks, keys = [], [], []
            for d, q, t in zip(*(b.column(c).to_pylist() for c in ("digest", "asked", "text")), strict=True):
                for level, k, sample in bands(t, edits, count, places):
                    digest.append(d)
                    asks.append(q)
                    keys.append(hashlib.blake2b(b"%d %d " % (level, k) + sample, digest_size=16).digest())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.string()), "asked": pa.array(asks, pa.bool_()), "key": pa.array(keys, pa.binary())})

    keyed = materialize(known.select("digest", "asked", "text").mapInArrow(cut, "digest string, asked boolean, key binary"), "prints-bands")
    left = keyed.filter("asked").select(F.col("digest").alias("a"), "key")
    pairs = left.join(keyed.select(F.col("digest").alias("b"), "key"), "key").filter("a <> b").select("a", "b").distinct()
    side = lambda x, y, i: known.select(F.col("digest").alias(x), F.col("text").alias(y), F.col("id").alias(i))
    pairs = pairs.join(side("a", "one", "query_id"), "a").join(side("b", "two", "doc_id"), "b").select("query_id", "doc_id", "one", "two")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x, y in zip(b.column("one").to_pylist(), b.column("two").to_pylist(), strict=True):
                got.append(edit_distance(codes(x), codes(y), min(edits, max(len(x), len(y)) // 5)))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(got, pa.int32())], ["query_id", "doc_id", "distance"])

    found = materialize(pairs.mapInArrow(told, "query_id long, doc_id long, distance int").filter("distance IS NOT NULL"), "prints-pairs")
    discard(keyed)
    return found, rows.join(known.select("digest", F.col("id").alias("class_id")), "digest").select("doc_id", "class_id")
