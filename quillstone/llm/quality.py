"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is described by numbers taken from its
bytes and words, encoded by a learned layer, weighted by gated attention and summed; the sum is
scored. Labels belong to documents only: which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

PASSAGE, HASHED, MARKS = 64, 128, 24
CLASSES = 8  # of bytes: white space, lower, upper, digit, mark of a sentence, other ASCII, first and later bytes of longer characters
N_FEATURES = CLASSES * CLASSES + HASHED + 6 + MARKS
_P = np.uint64(0x9E3779B97F4A7C15)


def _byte_class() -> np.ndarray:
    c = np.full(256, 5, dtype=np.int64)
    for chars, k in ((b" \t\n\r\x0b\x0c", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b".,;:!?", 4)):
        c[list(chars)] = k
    c[0x80:0xC0], c[0xC0:] = 7, 6
    return c


_CLASS = _byte_class()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and of its inverse."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    run = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)]), dtype=np.uint64)
    return run(_P), run(inverse)


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts and the index of each passage's text; a text without words is one passage."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    kind = _CLASS[data]
    gap = kind == 0
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    owner = doc[start] if len(start) else np.empty(0, np.int64)
    words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    per = np.maximum(1, -(-words // PASSAGE))
    first_passage = np.concatenate([[0], np.cumsum(per)[:-1]])
    total = int(per.sum())
    bag = np.repeat(np.arange(len(texts)), per)
    of_word = first_passage[owner] + (np.arange(len(start)) - first[owner]) // PASSAGE
    x = np.zeros((total, N_FEATURES), dtype=np.float32)
    if not len(start):
        return x, bag
    n = np.bincount(of_word, minlength=total).astype(np.float64)
    some = np.maximum(n, 1)
    # bytes belong to the passage of the word that they are in or follow
    word_of = np.maximum(np.cumsum(np.bincount(start, minlength=len(data))) - 1, 0)
    passage = of_word[word_of]
    passage = np.where(doc == owner[word_of], passage, first_passage[doc])
    size = np.maximum(np.bincount(passage, minlength=total), 1)
    pairs = np.bincount(passage[:-1] * 64 + kind[:-1] * 8 + kind[1:], minlength=total * 64).reshape(total, 64)
    x[:, :64] = np.sqrt(pairs / size[:, None])
    up, down = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    value = (sums[end] - sums[start]) * down[start]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed = np.bincount(of_word * HASHED + (value >> np.uint64(57)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
    x[:, 64 : 64 + HASHED] = np.sqrt(hashed / some[:, None])
    at = 64 + HASHED
    key = np.sort((of_word.astype(np.uint64) << np.uint64(36)) | (value >> np.uint64(28)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    x[:, at] = np.bincount((key[fresh] >> np.uint64(36)).astype(np.int64), minlength=total) / some
    same = np.concatenate([[False], (value[1:] == value[:-1]) & (of_word[1:] == of_word[:-1])])
    x[:, at + 1] = np.bincount(of_word, weights=same, minlength=total) / some
    length = end - start
    mean = np.bincount(of_word, weights=length, minlength=total) / some
    x[:, at + 2], x[:, at + 3] = mean / 10, np.sqrt(np.maximum(np.bincount(of_word, weights=length**2.0, minlength=total) / some - mean**2, 0)) / 10
    x[:, at + 4] = np.log1p(n) / 5
    x[:, at + 5] = np.bincount(of_word, weights=kind[end - 1] == 4, minlength=total) / some
    marks = b"!\"#$%&'()*+-/<=>@[]^_{|}~"[:MARKS]
    index = np.full(256, MARKS)
    index[list(marks)] = np.arange(MARKS)
    held = np.bincount(passage * (MARKS + 1) + index[data], minlength=total * (MARKS + 1)).reshape(total, MARKS + 1)[:, :MARKS]
    x[:, at + 6 :] = np.sqrt(held / size[:, None])
    return x, bag


class GatedAttention:
    """Encoder, gated attention and score; trained by Adam on the log loss of documents."""

    def __init__(self, width: int = 32, gate: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": make(N_FEATURES, width), "b": np.zeros(width, np.float32), "V": make(width, gate), "U": make(width, gate), "w": make(gate), "c": make(width), "c0": np.zeros(1, np.float32)}
        self.mean, self.sd = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def weights(self) -> dict[str, np.ndarray]:
        return self.p | {"mean": self.mean, "sd": self.sd}

    def load(self, weights: dict[str, np.ndarray]) -> GatedAttention:
        self.p = dict(weights)
        self.mean, self.sd = self.p.pop("mean"), self.p.pop("sd")
        return self

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        count = np.diff(np.append(first, len(bag)))
        h = np.tanh(((x - self.mean) / self.sd).clip(-6, 6) @ p["W"] + p["b"])
        a1, a2 = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a1 * a2) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        s = 1 / (1 + np.exp(-(z @ p["c"] + p["c0"]).clip(-30, 30)))
        return {"h": h, "a1": a1, "a2": a2, "a": a, "z": z, "s": s, "first": first, "count": count}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the documents' mean log loss; bag numbers the documents from 0 in order."""
        f, p = self.forward(x, bag), self.p
        d = ((f["s"] - y) / len(y)).astype(p["W"].dtype)
        dz = (d[:, None] * p["c"])[bag]
        da = (f["h"] * dz).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), f["count"]))
        dg = de[:, None] * p["w"]
        d1, d2 = dg * f["a2"] * (1 - f["a1"] ** 2), dg * f["a1"] * f["a2"] * (1 - f["a2"])
        dh = (f["a"][:, None] * dz + d1 @ p["V"].T + d2 @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": ((x - self.mean) / self.sd).clip(-6, 6).T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ d1, "U": f["h"].T @ d2, "w": (f["a1"] * f["a2"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 0.05
        first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        edges, r, p = np.append(first, len(bag)), np.random.default_rng(11), self.p
        m, v, t = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                some = order[i : i + batch]
                rows = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in some])
                xs, bs = x[rows], np.repeat(np.arange(len(some)), edges[some + 1] - edges[some])
                g = self.gradient(xs, bs, y[some])
                t += 1
                for k, q in p.items():
                    grad = g[k] + decay * q
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                    q -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.forward(*describe(texts))["s"]


def _runs(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < size):
            n += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample: int) -> GatedAttention | float:
    """A model fitted on at most `sample` labelled documents, chosen by hash of doc_id, each by all its passages.

    Of several rows with one doc_id, the one whose text has the least hash teaches. Without both
    labels there is nothing to learn: the labels' mean (or 0.5).
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.round(F.avg(label)).cast("float").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` rows, so it can be sent to all
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "y", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, h, t in zip(*(b.column(c).to_pylist() for c in ("_id", "y", "h", "text")), strict=True):
                x, _ = describe([t or ""])
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "y": pa.array([y], pa.float32()), "h": pa.array([h], pa.int64()), "x": [x.astype(np.float16).tobytes()]})

    got = rows.mapInArrow(run, "i long, y float, h long, x binary").groupBy("i").agg(F.min_by(F.struct("y", "x"), "h").alias("r")).select("i", "r.y", "r.x").orderBy(F.xxhash64("i")).collect()
    y = np.array([r.y for r in got], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r.x, dtype=np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in got]
    model = GatedAttention()
    model.fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)
    return model


def classify(docs: DataFrame, labels: DataFrame, *, keep: list[str | Column], doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = 2000) -> DataFrame:
    """docs' keep columns, score (0 to 1) and predicted (1 if score >= threshold).

    labels: rows (doc_id, label) to learn from; only labels 0 and 1 count, repeated rows of a
    doc_id are averaged. Null and empty texts are one passage without words; very long texts are
    described in full, in runs of about a million characters. Equal texts have equal scores.
    Other columns, whatever their names, are ignored. Empty docs: no rows.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, label=label, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else model.weights())
    (own,) = fresh(docs.select(*keep), "text")
    cols = docs.select(*keep, F.col(text).alias(own))
    schema = cols.drop(own).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(own).to_pylist()]
            m = shared.value if isinstance(shared.value, float) else GatedAttention().load(shared.value)
            s = np.full(len(texts), m) if isinstance(m, float) else np.concatenate([m.score(x) for x in _runs(texts)]) if texts else np.empty(0)
            s = s.astype(np.float64)
            others = [i for i, f in enumerate(b.schema) if f.name != own]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return cols.mapInArrow(run, schema)
