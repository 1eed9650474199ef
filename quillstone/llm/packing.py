"""Packing of token pieces into sequences by minimum bin slack.

Token counts are bounded by the sequence length, so the open pieces are a histogram of at most
that many lengths. For each bin, bitset subset-sum dynamic programming over the lengths still
available finds the fullest combination with the longest open piece; that combination is taken
out as often as the counts allow. Spark does the rest: tokens, counts, ranks and places.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .scratch import materialize

#: Fixed value: the pattern by which byte-level tokenizers of this kind cut text before encoding.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_in_order(spec: dict) -> bool:
    """Whether a tokenizers file is plain byte-level BPE whose ids follow its merges.

    Then merging by rank of id is the same as merging by its list: no normalizer, the usual cut
    without an added blank, every byte a token, none of BPE's options, and merge i makes the i-th
    of the tokens that merges make.
    """
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True) and not spec.get("normalizer")
    options = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if not plain or model.get("type") != "BPE" or any(options) or not byte_of().keys() <= model["vocab"].keys():
        return False
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(t, -1) for t in made]
    top = max(model["vocab"][c] for c in byte_of())
    return len(model["vocab"]) == len(ids) + 256 and all(x < y for x, y in zip([top, *ids], ids, strict=False))


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by a tokenizers file.

    Where the file's structure allows (merges_in_order), its vocabulary drives a faster byte-pair
    encoder, which makes the same ids; otherwise, and for texts that hold a special token's
    string, the tokenizers library itself encodes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if merges_in_order(spec):
            at = byte_of()
            ranks = {bytes(at[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = lambda t: not self.fast or any(s in t for s in self.special)
        return [np.array(self.ids(t) if slow(t) else self.fast.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]


def pieces(docs: DataFrame, keep: list[str], *, text: str = "text", tokenizer: str | Callable[[], str] = public_tokenizer, end_id: int = 2, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """Rows (keep..., piece, start, length, ids_crc32[, ids]) of every text's tokens and its end id.

    A text of up to `size` tokens is one piece; a longer one is cut into whole sequences behind a
    first piece that takes the rest. Null and empty texts are the end id alone.
    """
    cols = docs.select(*keep, F.col(text).alias("text"))
    schema = cols.drop("text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer() if callable(tokenizer) else tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < 1_000_000):
                    n += len(texts[j])
                    j += 1
                for row, got in enumerate(enc.encode(texts[i:j]), i):
                    got += last
                    total = len(got) // 4
                    edges = [0, *range(total % size or size, total + 1, size)] if total > size else [0, total]
                    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append(row)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(got[4 * x : 4 * y]))
                        if with_ids:
                            ids.append(np.frombuffer(got[4 * x : 4 * y], dtype="<u4").astype(np.int32))
                i = j
            others = [k for k, f in enumerate(b.schema) if f.name != "text"]
            at = pa.array(rows, pa.int64())
            out = [*[b.column(k).take(at) for k in others], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return cols.mapInArrow(run, schema)


def _fullest(have: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to room (subset sums as bits)."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n in have if n <= room), reverse=True):
        left, k = min(have[n], room // n), 1
        while left and not reach >> room & 1:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, use = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            use[n] = use.get(n, 0) + k
            total -= n * k
    return use


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: uses}) for each kind of bin, until all counts are placed."""
    have, bins = {n: c for n, c in counts.items() if c}, []
    while have:
        top = max(have)
        have[top] -= 1
        use = _fullest({n: c for n, c in have.items() if c}, size - top)
        have[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(have[n] // k for n, k in use.items())
        for n, k in use.items():
            have[n] -= k * times
            if not have[n]:
                del have[n]
        bins.append((times, use))
    return bins


def _places(bins: list[tuple[int, dict[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of ranks within a length: first key (length, rank), uses a bin, first bin, first offset, length; sorted."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, use in bins:
        offset = 0
        for n, k in sorted(use.items(), reverse=True):
            rows.append(((n << 44) | taken.get(n, 0), k, base, offset, n))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        base += times
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def pack(cut: DataFrame, key: list[str], size: int = 1024) -> DataFrame:
    """cut (rows with a `length` from 1 to size) plus sequence_id and offset.

    key orders rows of one length. Rows are ranked within (length, salt) parts of about
    sqrt(rows) rows, so a length that many share is not ranked by one task. The driver sees the
    histogram of lengths (`size` rows at most) and plans from it. Empty input: no rows.
    """
    cut = materialize(cut.withColumn("_m", F.monotonically_increasing_id()), "pack-pieces")
    spark = cut.sparkSession
    tally = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_places(minimum_bin_slack(tally, size), size))
    salts = max(1, math.isqrt(sum(tally.values())))
    cell = W.partitionBy("length", "salt").orderBy(*key, "_m")
    # the row's own number takes part, so that repeated or null keys are dealt too
    ranked = cut.withColumn("salt", F.pmod(F.xxhash64(*key, "_m"), F.lit(salts))).withColumn("_i", F.row_number().over(cell) - 1)
    ranked = materialize(ranked, "pack-ranked")
    parts = ranked.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_skip"))
    placed = ranked.join(materialize(parts, "pack-parts"), ["length", "salt"]).withColumn("_rank", F.col("_i") + F.col("_skip")).drop("salt", "_i", "_skip", "_m")
    schema = placed.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, uses, base, offset, n = plan.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(first, (length << 44) | rank, side="right") - 1
            r = rank - (first[at] & ((1 << 44) - 1))
            others = [i for i, f in enumerate(b.schema) if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], pa.array(base[at] + r // uses[at]), pa.array(offset[at] + r % uses[at] * n[at])], names=schema.names)

    return placed.mapInArrow(run, schema)
