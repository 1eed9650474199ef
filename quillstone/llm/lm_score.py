"""Log-bilinear language model: trained with noise-contrastive estimation, scored normalised.

The model's leaves are all words of a least count (up to a bound the commonest) and a number of
forms, which share all other tokens by their last bytes. Leaves are dealt into classes of about
equal mass by frequency. A bilinear form of learned vectors, one matrix for each place of the
context, predicts first the class of a token, then its leaf within the class: two softmaxes of
about the root of the vocabulary each. Within a form a token has its smoothed share of the
form's count. All three parts are normalised, so the probabilities of all tokens, an unknown one
of each form included, sum to 1.

Training reads every distinct training text, weighted by its copies. Texts are dealt by hash into
shards of a fixed number of tokens, and a shard is learned from in the order of hashes, so the
parameters do not depend on how rows were partitioned. The first shard gives the start, in small
steps and twice. Then come rounds of 1, 1, 2, 4, 8 ... shards: the shards of a round continue side by side
from what the rounds before gave, and their results are averaged by tokens. So every text is
learned from once more, and the more there are, the longer the row of rounds that all parameters
have behind them.

Counts cover all training tokens and stay in a table: a text's rare tokens are joined with it,
only the commonest words are sent to every task. Each text is cut into tokens once in Python,
and its leaf ids are kept in a table that training and scoring read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

END = b" "  # no word holds a blank, so this stands for the end token


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training.

    words, least: words of at least `least` training tokens have a leaf of their own, the `words`
    commonest if there are more. shard: training tokens in a shard. common: words whose counts go
    to every task; the rest are joined. first_batch: tokens a step in the first shard, where most is learned.
    """

    words: int = 3840
    forms: int = 256
    least: int = 8
    classes: int = 64
    width: int = 16
    context: int = 3
    noise: int = 32
    leaf_noise: int = 8
    batch: int = 8192
    first_batch: int = 1024
    rate: float = 0.2
    shard: int = 2_000_000
    common: int = 131_072


def form(token: bytes, forms: int) -> int:
    return zlib.crc32(token[-3:]) % forms


class Tree:
    """Leaves in order of mass, their classes, and the part of a token's logarithm that its leaf doesn't tell.

    words: (token, count) of the words with leaves of their own; form_counts: (tokens, distinct
    tokens) of each form without those words. inside: log10 of what a token's count is divided by
    within its leaf; for a word's own leaf the word's smoothed count itself.
    """

    def __init__(self, words: list[tuple[bytes, int]], form_counts: np.ndarray, shape: Shape):
        k = len(words)
        own = np.array([c for _, c in words], dtype=np.float64)
        mass = np.concatenate([own, form_counts[:, 0] + 1])
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int64)
        place[order] = np.arange(len(mass))
        self.word_leaf, self.form_leaf = place[:k], place[k:]
        self.leaves = len(mass)
        self.inside = np.concatenate([np.log10(own + 1), np.log10(form_counts.sum(axis=1) + 1)])[order]
        mass = mass[order] / mass.sum()
        at = np.minimum((np.cumsum(mass) - mass / 2) * shape.classes, shape.classes - 1).astype(np.int64)
        _, self.of = np.unique(at, return_inverse=True)
        self.first = np.flatnonzero(np.concatenate([[True], self.of[1:] != self.of[:-1]]))
        self.size = np.diff(np.append(self.first, self.leaves))
        self.mass = np.add.reduceat(mass, self.first)
        self.log_class, self.log_leaf = np.log(self.mass), np.log(mass / self.mass[self.of])

    @staticmethod
    def load(state: dict) -> Tree:
        """The tree whose vars() are given; a broadcast holds plain arrays only."""
        t = object.__new__(Tree)
        t.__dict__.update(state)
        return t


def start(tree: Tree, shape: Shape) -> dict[str, np.ndarray]:
    """Without learning the model is the smoothed unigram: output vectors are zero, biases the logarithms of shares."""
    r, d = np.random.default_rng(5), shape.width
    return {
        "R": (r.standard_normal((tree.leaves + 1, d)) * 0.1).astype(np.float32),  # the last row stands for what precedes a text
        "C": np.stack([np.eye(d, dtype=np.float32) / shape.context] * shape.context),
        "Q": np.zeros((len(tree.first), d), np.float32), "b": tree.log_class.astype(np.float32),
        "W": np.zeros((tree.leaves, d), np.float32), "w": tree.log_leaf.astype(np.float32),
    }


def id_type(leaves: int) -> type:
    """What holds all leaves and the one number more that pads."""
    return np.uint16 if leaves < 1 << 16 else np.uint32


def contexts(y: np.ndarray, size: int, pad: int) -> np.ndarray:
    """The leaves before each of a text's leaves, nearest first, padded where the text begins."""
    out = np.full((len(y), size), pad, dtype=id_type(pad))
    for i in range(min(size, len(y) - 1)):
        out[i + 1 :, i] = y[: len(y) - i - 1]
    return out


def _add_sorted(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds to out the sums of the rows that share an index; at is sorted."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] += np.add.reduceat(rows, first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; np.exp of what single precision can't hold is infinite, and the result 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def gradients(p: dict[str, np.ndarray], tree: Tree, ctx: np.ndarray, y: np.ndarray, weight: np.ndarray, drawn: np.ndarray, leaf_drawn: np.ndarray) -> dict[str, np.ndarray]:
    """Of the noise-contrastive loss, for tokens in order of their leaves y.

    All tokens share the drawn classes, and those of a class its drawn leaves: leaf_drawn holds
    numbers from 0 to 1, scaled to each class (uniform noise; a class's leaves are about as frequent).
    """
    kind, k, m = tree.of[y], len(drawn), len(leaf_drawn)
    seen = [p["R"].take(ctx[:, i], axis=0) for i in range(ctx.shape[1])]
    h = seen[0] @ p["C"][0]
    for x, c in zip(seen[1:], p["C"][1:], strict=True):
        h += x @ c
    g = {name: np.zeros_like(x) for name, x in p.items()}

    ln = (np.log(k) + tree.log_class).astype(h.dtype)
    own, other = p["Q"].take(kind, axis=0), p["Q"][drawn]
    pos = weight * (_sigmoid(np.einsum("ij,ij->i", h, own) + (p["b"] - ln)[kind]) - 1)
    neg = _sigmoid(h @ other.T + (p["b"] - ln)[drawn])
    neg *= weight[:, None]
    dh = neg @ other
    own *= pos[:, None]
    dh += own
    _add_sorted(g["Q"], kind, pos[:, None] * h)
    _add_sorted(g["b"], kind, pos)
    np.add.at(g["Q"], drawn, neg.T @ h)
    np.add.at(g["b"], drawn, neg.sum(axis=0))

    lnw = np.log(m / tree.size).astype(h.dtype)
    own = p["W"].take(y, axis=0)
    pos = weight * (_sigmoid(np.einsum("ij,ij->i", h, own) + p["w"][y] - lnw[kind]) - 1)
    pos[tree.size[kind] == 1] = 0  # a class of one leaf tells all
    own *= pos[:, None]
    dh += own
    _add_sorted(g["W"], y, pos[:, None] * h)
    _add_sorted(g["w"], y, pos)
    edges = np.searchsorted(kind, np.arange(len(tree.first) + 1)).tolist()
    for c in np.flatnonzero((np.diff(edges) > 0) & (tree.size > 1)).tolist():
        part = slice(edges[c], edges[c + 1])
        leaf = tree.first[c] + (leaf_drawn * tree.size[c]).astype(np.int64)
        wl = p["W"][leaf]
        neg = _sigmoid(h[part] @ wl.T + (p["w"][leaf] - lnw[c]))
        neg *= weight[part, None]
        dh[part] += neg @ wl
        np.add.at(g["W"], leaf, neg.T @ h[part])
        np.add.at(g["w"], leaf, neg.sum(axis=0))

    at = ctx.T.ravel()
    order = np.argsort(at, kind="stable")
    _add_sorted(g["R"], at[order], np.concatenate([dh @ c.T for c in p["C"]]).take(order, axis=0))
    g["C"] = np.stack([x.T @ dh for x in seen])
    return g


class Learner:
    """Adagrad over batches of a fixed number of tokens; texts come one by one."""

    def __init__(self, p: dict[str, np.ndarray], g2: dict[str, np.ndarray], tree: Tree, shape: Shape, seed: int):
        self.p, self.g2 = {k: x.copy() for k, x in p.items()}, {k: x.copy() for k, x in g2.items()}
        self.tree, self.shape, self.r = tree, shape, np.random.default_rng([17, seed])
        self.edges = np.cumsum(tree.mass)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.seen = 0

    def text(self, y: np.ndarray, copies: int) -> None:
        self.held.append((contexts(y, self.shape.context, self.tree.leaves), y, np.full(len(y), copies, np.float32)))
        self.n += len(y)
        self.seen += len(y) * copies
        if self.n >= self.shape.batch:
            ctx, ys, weight = (np.concatenate(x) for x in zip(*self.held, strict=True))
            whole = self.n // self.shape.batch * self.shape.batch
            for i in range(0, whole, self.shape.batch):
                self.step(ctx[i : i + self.shape.batch], ys[i : i + self.shape.batch], weight[i : i + self.shape.batch])
            self.held, self.n = [(ctx[whole:], ys[whole:], weight[whole:])], self.n - whole

    def step(self, ctx: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        drawn = np.minimum(np.searchsorted(self.edges, self.r.random(self.shape.noise)), len(self.edges) - 1)
        order = np.argsort(y, kind="stable")
        weight = weight[order] / weight.mean()
        for name, g in gradients(self.p, self.tree, ctx[order], y[order].astype(np.int64), weight, drawn, self.r.random(self.shape.leaf_noise)).items():
            self.g2[name] += g * g
            g *= np.float32(self.shape.rate)
            g /= np.sqrt(self.g2[name])
            self.p[name] -= g

    def done(self) -> Learner:
        if self.n:
            self.step(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.n = [], 0
        return self


class Scorer:
    """log10 P(leaf | context) by batched matrix products, normalised over classes and over leaves of a class."""

    def __init__(self, p: dict[str, np.ndarray], tree: Tree):
        self.p, self.tree = p, tree
        self.seen = [p["R"] @ c for c in p["C"]]
        self.qt = np.ascontiguousarray(p["Q"].T)
        self.wt = [np.ascontiguousarray(p["W"][f : f + n].T) for f, n in zip(tree.first, tree.size, strict=True)]

    def __call__(self, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, t = np.empty(len(y)), self.tree
        for i in range(0, len(y), 16384):
            ys = y[i : i + 16384].astype(np.int64)
            h = self.seen[0][ctx[i : i + 16384, 0]]
            for j in range(1, ctx.shape[1]):
                h += self.seen[j][ctx[i : i + 16384, j]]
            kind = t.of[ys]
            got = self._log_share(h @ self.qt + self.p["b"], kind)
            order = np.argsort(kind.astype(np.uint16), kind="stable")
            edges = np.searchsorted(kind[order], np.arange(len(t.first) + 1))
            for c in np.flatnonzero((np.diff(edges) > 0) & (t.size > 1)):
                some, f = order[edges[c] : edges[c + 1]], t.first[c]
                got[some] += self._log_share(h[some] @ self.wt[c] + self.p["w"][f : f + t.size[c]], ys[some] - f)
            out[i : i + 16384] = got
        return out / np.log(10)

    @staticmethod
    def _log_share(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = s[np.arange(len(s)), at].astype(np.float64)
        if s.size and s.max() > 80:  # beyond what single precision can raise
            top = s.max(axis=1, keepdims=True).astype(np.float64)
            return own - top[:, 0] - np.log(np.exp(s - top).sum(axis=1))
        np.exp(s, out=s)
        return own - np.log(s.sum(axis=1, dtype=np.float64))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all of texts(text), A-Z in lower case; END counts once for each row."""
    words = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
    upper, lower = (F.lit("".join(map(chr, range(a, a + 26)))) for a in (65, 97))
    # a word that F.lower leaves as it is holds no A-Z; so few words pay for the slower translation
    token = F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.call_function("translate", F.col("w"), upper, lower))
    counts = words.select(token.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    ends = texts.agg(F.count(F.lit(1)).alias("c")).filter("c > 0").select(F.lit(END.decode()).alias("token"), "c")
    return counts.union(ends)


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The `most` commonest (token, c) of counts, frequent first; ties at the end go by hash.

    A histogram of frequencies in steps of a sixteenth of a doubling gives the step in which the
    bound lies; from that step come about as many tokens as are still wanted, by their hashes.
    So the driver gets a row for each step and then about `most` rows, however many tasks there are.
    """
    step = F.floor(F.log2("c") * 16)
    above, whole, share = 0, None, None
    for s, n in sorted(map(tuple, counts.groupBy(step).count().collect()), reverse=True):
        if above + n > most:
            share = s, int((1 << 40) * (most - above) / n)
            break
        above, whole = above + n, s
    wanted = F.lit(False) if whole is None else step >= whole
    if share:
        wanted |= (step == share[0]) & (F.pmod(F.xxhash64("token"), F.lit(1 << 40)) < share[1])
    got = sorted((-r.c, r.token) for r in counts.filter(wanted).collect())
    return [(t.encode("utf-8", "surrogatepass"), -c) for c, t in got]


def train(ids: DataFrame, tree: Tree, shape: Shape, total: int) -> dict[str, np.ndarray]:
    """Parameters learned from ids(h, h2, ids): the leaf ids of all training texts, equal texts with equal hashes."""
    spark = ids.sparkSession
    p = start(tree, shape)
    g2 = {k: np.ones_like(x) for k, x in p.items()}
    shards = max(1, round(total / shape.shard))
    parts = min(shards, 20_000)
    shard = F.pmod("h", F.lit(shards))
    round_of = F.when(shard == 0, 0).otherwise(F.length(F.bin(shard)))  # 0, 1, 2 and 3, 4 to 7 ...
    texts = ids.groupBy("h", "h2").agg(F.first("ids").alias("ids"), F.count(F.lit(1)).alias("copies")).select("h", "ids", "copies", shard.alias("shard"), round_of.alias("round"))
    texts, kind = materialize(texts, "lm-texts", by="round"), id_type(tree.leaves)

    def learned(some: DataFrame, parts: int, shape: Shape) -> dict[str, np.ndarray]:
        shared = spark.sparkContext.broadcast((p, g2, vars(tree)))
        names = [*p, *(f"2{k}" for k in p)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, squares, t = shared.value
            t = Tree.load(t)
            now, shard, seen, sums = None, None, 0, None

            def close() -> None:
                nonlocal seen, sums
                now.done()
                got = {k: x.astype(np.float64) * now.seen for k, x in (now.p | {f"2{k}": x for k, x in now.g2.items()}).items() if k in names}
                sums = got if sums is None else {k: sums[k] + x for k, x in got.items()}
                seen += now.seen

            for b in batches:
                for s, y, n in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), b.column("copies").to_pylist(), strict=True):
                    if s != shard:
                        if now:
                            close()
                        now, shard = Learner(params, squares, t, shape, s), s
                    now.text(np.frombuffer(y, dtype=kind), n)
            if now:
                close()
                for k in names:
                    flat = sums[k].ravel()
                    for i in range(0, len(flat), 4096):
                        yield pa.RecordBatch.from_pydict({"name": [k], "at": pa.array([i], pa.int64()), "seen": pa.array([seen], pa.int64()), "x": [flat[i : i + 4096].tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for b in batches:
                for k, i, n, x in zip(*(b.column(c).to_pylist() for c in ("name", "at", "seen", "x")), strict=True):
                    was = held.setdefault((k, i), [0, 0.0])
                    was[0] += n
                    was[1] = was[1] + np.frombuffer(x)
            for (k, i), (n, x) in held.items():
                yield pa.RecordBatch.from_pydict({"name": [k], "at": pa.array([i], pa.int64()), "seen": pa.array([n], pa.int64()), "x": [x.tobytes()]})

        kinds = "name string, at long, seen long, x binary"
        dealt = some.repartition(parts, "shard").sortWithinPartitions("shard", "h").select("shard", "ids", "copies")
        sums = dealt.mapInArrow(run, kinds).repartition("name", "at").mapInArrow(add, kinds)  # a row for each 4,096 parameters
        out: dict[str, list] = {}
        for r in sorted(sums.collect(), key=lambda r: (r["name"], r["at"])):
            out.setdefault(r["name"], []).append(np.frombuffer(r["x"]) / r["seen"])
        return {k: np.concatenate(x).astype(np.float32).reshape(p[k.lstrip("2")].shape) for k, x in out.items()}

    for r in [None, *range((shards - 1).bit_length() + 1)]:
        new = learned(texts.filter(F.col("round") == (r or 0)), min(parts, max(1, (1 << r) // 2)) if r else 1, shape if r else replace(shape, batch=shape.first_batch))
        if new:
            p, g2 = {k: new[k] for k in p}, {k: new[f"2{k}"] for k in p}
    discard(texts)
    return p


def _runs(column: pa.Array, size: int = 500_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about `size` bytes."""
    run, first, n = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or b""
        run.append(t)
        n += len(t)
        if n >= size:
            yield first, run
            run, first, n = [], i + 1, 0
    if run:
        yield first, run


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows for which held_out is false. base_score: add-one unigram; score: the
    model; both are log10 probabilities of the whole text. Null and empty texts: the end token.
    Repeated rows and doc_ids are scored each; ties and the partitioning of docs change nothing.
    Nothing to learn from: every token is unknown and both scores are 0 (one outcome). Empty
    docs: no rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(count_tokens(rows.filter(~F.col("held_out")).select("text")), "lm-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    common = commonest(counts, shape.common)
    own = [x for x in common[: shape.words] if x[1] >= shape.least]

    ending = F.crc32(F.expr("substring(cast(token as binary), -3)"))
    forms = np.zeros((shape.forms, 2))
    for f, n, kinds in counts.groupBy(F.pmod(ending, F.lit(shape.forms))).agg(F.sum("c"), F.count(F.lit(1))).collect():
        forms[f] = n, kinds
    for w, c in own:
        forms[form(w, shape.forms)] -= c, 1
    tree = Tree(own, forms, shape)
    kind_of = id_type(tree.leaves)
    shared = spark.sparkContext.broadcast(([w for w, _ in common], np.array([c for _, c in common], dtype=np.float64), tree.word_leaf, tree.form_leaf))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, word_leaf, form_leaf = shared.value
        at = {w: i for i, w in enumerate(words)}.get
        leaf = np.concatenate([word_leaf, [form_leaf[form(w, len(form_leaf))] for w in words[len(word_leaf) :]], [0]]).astype(kind_of)
        logs = np.append(np.log10(c + 1), 0.0)  # the last ones stand for a rare token
        for b in batches:
            for row, texts in _runs(b.column("text")):
                toks = [t.lower().split() for t in texts]
                for t in toks:
                    t.append(END)
                first = np.concatenate([[0], np.cumsum([len(t) for t in toks])])
                flat = list(itertools.chain.from_iterable(toks))
                ix = np.fromiter(map(at, flat, itertools.repeat(-1)), dtype=np.int64, count=len(flat))
                y, base = leaf[ix], np.add.reduceat(logs[ix], first[:-1])
                odd = np.flatnonzero(ix < 0)
                rare = [flat[i] for i in odd.tolist()]
                y[odd] = form_leaf[np.fromiter((zlib.crc32(w[-3:]) for w in rare), dtype=np.int64, count=len(rare)) % len(form_leaf)]
                cuts = np.searchsorted(odd, first)
                per = [Counter(rare[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                pairs = pa.StructArray.from_arrays([pa.array(list(itertools.chain.from_iterable(per)), pa.binary()).cast(pa.string()), pa.array(list(itertools.chain.from_iterable(x.values() for x in per)), pa.int64())], ["token", "n"])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in per])]).astype(np.int32), pairs)
                ids = [y[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)]
                n = np.diff(first)
                head = [b.column(k).slice(row, len(texts)) for k in ("doc_id", "held_out", "h", "h2")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(n), pa.array(n - np.diff(cuts)), pa.array(base), pa.array(ids, pa.binary()), lists], ["doc_id", "held_out", "h", "h2", "n_tokens", "known", "logs", "ids", "rare"])

    kind = dict(docs.dtypes)[doc_id]
    cols = rows.select("doc_id", "held_out", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("text").cast("binary").alias("text"))
    told = cols.mapInArrow(encode, f"doc_id {kind}, held_out boolean, h long, h2 long, n_tokens long, known long, logs double, ids binary, rare array<struct<token:string,n:long>>")
    told = materialize(told.withColumn("_r", F.monotonically_increasing_id()), "lm-rows")
    p = train(told.filter(~F.col("held_out")).select("h", "h2", "ids"), tree, shape, total)
    model = spark.sparkContext.broadcast((p, vars(tree)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t = model.value
        t = Tree.load(t)
        scorer = Scorer(q, t)
        for b in batches:
            out = []
            for first, texts in _runs(b.column("ids")):
                ys = [np.frombuffer(x, dtype=kind_of) for x in texts]
                flat = np.concatenate(ys)
                by_token = scorer(np.concatenate([contexts(y, shape.context, t.leaves) for y in ys]), flat) - t.inside[flat]
                out.append(np.add.reduceat(by_token, np.concatenate([[0], np.cumsum([len(y) for y in ys])[:-1]])))
            others = [k for k in b.schema.names if k != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in others], pa.array(np.concatenate(out) if out else np.empty(0))], [*others, "model"])

    scored = told.select("_r", "doc_id", "held_out", "n_tokens", "known", "logs", "ids").mapInArrow(run, f"_r long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, model double")
    rare = told.select("_r", F.explode("rare").alias("t")).select("_r", "t.token", "t.n").join(counts, "token")
    found = rare.groupBy("_r").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(found, "_r", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), (F.lit(0.0) if not total else F.col("model") + logs).alias("score"),
    )


__all__ = ["END", "Learner", "Scorer", "Shape", "Tree", "commonest", "contexts", "count_tokens", "discard", "form", "gradients", "id_type", "score", "start", "train"]
