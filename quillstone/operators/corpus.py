"""Building and checking passages: splitting, inputs for embedding, health, coverage, sequence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import FUNCTION_WORDS, fold, words
from ..store import materialize


def split_text(text: str, cap: int, overshoot: int) -> list[str]:
    """Pieces of about cap characters, cut at the strongest boundary in reach; no word is lost.

    Boundaries in order of strength: blank line, line end, sentence, clause, blank. A piece has at
    least a quarter of cap; a stronger boundary may lie up to overshoot beyond the cap.
    """
    out, rest = [], text.strip()
    while len(rest) > cap + overshoot:
        for pattern in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"(?<=[;:,])\s+", r"\s+"):
            ends = [m for m in re.compile(pattern).finditer(rest, cap // 4, cap + overshoot)]
            near = [m for m in ends if m.start() <= cap] or ends
            if near:
                cut = max(near, key=lambda m: m.start()) if near[0].start() <= cap else near[0]
                out.append(rest[: cut.start()].rstrip())
                rest = rest[cut.end() :].lstrip()
                break
        else:
            out.append(rest[:cap])
            rest = rest[cap:]
    return [*out, rest] if rest else out


def split_passages(docs: DataFrame, key: str, text: str, cap: int = 3500, overshoot: int = 500) -> DataFrame:
    """(key, position, content) of every document's pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, p) for k, t in zip(f["key"], f["text"], strict=True) for i, p in enumerate(split_text(t or "", cap, overshoot))]
            yield pd.DataFrame(rows, columns=["key", "position", "content"])

    got = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, position int, content string")
    return got.withColumnRenamed("key", key)


def embedding_input(passages: DataFrame, before: int, after: int) -> DataFrame:
    """input: the end of the last and the start of the next searchable passage around each passage's own text.

    passages: (doc_id, position, run, content, searchable); a neighbour counts only within its run
    of passages of one chapter, and unsearchable ones are passed over.
    """
    w = W.partitionBy("doc_id", "run").orderBy("position")
    text = F.when(F.col("searchable"), F.col("content"))
    prev = F.last(text, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    nxt = F.first(text, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return passages.withColumn("input", F.concat_ws(" ", F.right(prev, F.lit(before)), F.col("content"), F.left(nxt, F.lit(after))))


def health(passages: DataFrame) -> DataFrame:
    """Violations of the block and report rules over passages(doc_id, position, content): (rule, severity, doc_id, position).

    Rules: blank; debris (no letter or digit); positions out of sequence; boilerplate notice;
    short; duplicate text (normalised, from 100 characters: all but the first); mostly unlettered;
    heading at the end; note start; several blank runs joined; bracketed numbers; ligatures.
    Texts are read once: their findings and digests go to a table of keys, from which the rules
    across rows follow.
    """
    c = F.col("content")
    filled, letters = F.trim(c) != "", F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    folded = fold(c)
    rules = [
        ("blank", "block", ~filled), ("debris", "block", filled & ~c.rlike("[A-Za-z0-9]")), ("boilerplate", "block", c.rlike("(?i)all rights reserved|public license")),
        ("short", "report", filled & (F.length(c) < 20)), ("unlettered", "report", (F.length(c) >= 40) & (letters * 2 < F.length(c))),
        ("note_start", "report", c.rlike(r"^\s*(\[?\d+\]|\*|†)\s")), ("joined", "report", c.rlike(r"[.!?][A-Z][a-z]")), ("bracket_number", "report", c.rlike(r"\[\d+\]")), ("ligature", "report", c.rlike("[ﬁﬂ]")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, cond in rules]))
    heading = filled & (F.length(c) < 60) & ~c.rlike(r"[.!?:;,]\s*$")
    facts = materialize(passages.select("doc_id", "position", found.alias("found"), heading.alias("heading"), F.when(F.length(folded) >= 100, F.sha2(folded, 256)).alias("digest")), "health")
    rows = facts.select(F.explode("found").alias("f"), "doc_id", "position").select("f.rule", "f.severity", "doc_id", "position")
    w = W.partitionBy("doc_id").orderBy("position")
    placed = facts.select("doc_id", "position", "heading", (F.row_number().over(w) - 1).alias("_i"), F.lead("position").over(w).alias("_next"))
    # the earliest holder is found by a grouped minimum, so a very common text is not ranked in one task
    keyed = facts.filter("digest IS NOT NULL").select("digest", "doc_id", "position")
    first = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "position")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = keyed.join(first, "digest").filter(F.struct("doc_id", "position") != F.col("_first"))
    named = lambda df, rule, severity: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "doc_id", "position")
    return rows.union(named(placed.filter("_i <> position"), "positions", "block")).union(named(placed.filter("heading AND _next IS NULL"), "last_heading", "block")).union(named(copies, "duplicate", "report"))


def known_defects(found: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, doc_id, position, status): new, known or stale, against the table of known defects."""
    keys = ["rule", "doc_id", "position"]
    j = found.select(*keys).distinct().withColumn("_f", F.lit(1)).join(known.select(*keys).distinct().withColumn("_k", F.lit(1)), keys, "full_outer")
    return j.select(*keys, F.when(F.col("_k").isNull(), "new").when(F.col("_f").isNull(), "stale").otherwise("known").alias("status"))


def foreign_runs(texts: DataFrame, key: str, text: Column, home: Column, least: int = 5, marks: int = 2) -> DataFrame:
    """(key, run, n, marks): stretches of words unknown at home that hold function words of another language.

    A word belongs to the first listed language whose function words hold it; words without a
    language go with their stretch. A stretch ends where a word of the home language stands.
    """
    lang = F.lit(None).cast("string")
    for name, ws in reversed(FUNCTION_WORDS.items()):
        lang = F.when(F.col("w").isin(ws), F.lit(name)).otherwise(lang)
    w = texts.select(key, home.alias("home"), F.posexplode(words(text)).alias("i", "w")).withColumn("lang", lang)
    w = w.withColumn("stop", (F.col("lang") == F.col("home")).cast("int"))
    w = w.withColumn("run", F.sum(F.coalesce("stop", F.lit(0))).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    inner = w.filter(F.coalesce("stop", F.lit(0)) == 0)
    return inner.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang").isNotNull()).alias("marks")).filter((F.col("n") >= least) & (F.col("marks") >= marks))


def coverage(sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """(file, sentences, found, share): which source sentences the corpus holds, both as (.., folded).

    Only corpus sentences whose hash some source sentence has are dealt; texts decide.
    """
    wanted = sources.select(F.xxhash64("folded").alias("_h")).distinct()
    held = corpus.withColumn("_h", F.xxhash64("folded")).join(wanted, "_h", "left_semi").select("folded").distinct().withColumn("_in", F.lit(1))
    j = sources.join(held, "folded", "left")
    return j.groupBy("file").agg(F.count(F.lit(1)).alias("sentences"), F.count("_in").alias("found"), F.round(F.count("_in") / F.count(F.lit(1)), 6).alias("share"))


def sequence_gaps(units: DataFrame, key: str, number: str, limits: DataFrame) -> DataFrame:
    """(key, number, problem): missing, duplicated or out_of_range against 1..last of limits(key, last)."""
    seen = units.groupBy(key, number).agg(F.count(F.lit(1)).alias("_n"))
    wanted = limits.filter("last >= 1").select(key, "last", F.explode(F.sequence(F.lit(1), "last")).alias(number))
    j = wanted.drop("last").withColumn("_w", F.lit(1)).join(seen, [key, number], "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "out_of_range").when(F.col("_n") > 1, "duplicated")
    return j.select(key, number, problem.alias("problem")).filter("problem IS NOT NULL")


def not_contiguous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, runs) of values that come back after another value stood between."""
    w = W.partitionBy(key).orderBy(order)
    starts = rows.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    return starts.groupBy(key, value).agg(F.count_if("_new").alias("runs")).filter("runs > 1")


def rising_run(units: DataFrame, key: str, order: str, number: str, step: int) -> DataFrame:
    """(key, length, last): the longest rising subsequence of numbers whose neighbours differ by at most step.

    Keeps the best length for each last number only, so memory follows the distinct numbers of
    the document at hand; documents pass through sorted, none is gathered whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, out = None, {}, []
        flush = lambda: out.append((at, *max((n, -v) for v, n in best.items())))
        for f in frames:
            for k, v in zip(f[key], f[number], strict=True):
                if k != at:
                    if best:
                        flush()
                    at, best = k, {}
                n = 1 + max((best.get(v - d, 0) for d in range(1, step + 1)), default=0)
                best[v] = max(best.get(v, 0), n)
            if out:
                yield pd.DataFrame([(a, b, -c) for a, b, c in out], columns=[key, "length", "last"])
                out = []
        if best:
            flush()
            yield pd.DataFrame([(a, b, -c) for a, b, c in out], columns=[key, "length", "last"])

    sorted_ = units.select(F.col(key).cast("long").alias(key), F.col(order), F.col(number).cast("long").alias(number)).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(run, f"{key} long, length long, last long")
