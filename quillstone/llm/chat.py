"""Conversations in reply order, with quoted passages linked to the messages that said them.

Nested quote levels are parsed, quoted passages are normalised, hashed and joined with the
passages that messages say themselves. The original of a quote is the first message of its own
conversation that says the passage; a passage from elsewhere links only if it is long and a single
conversation says it, since short or common words tell nothing. A message answers the original of
its outermost linked quote (the latest, if several), else the message before it. Threads follow
from the answers, and quotes are cut out of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_SAID = re.compile(r"\b(?:wrote|schrieb|a écrit|escribió)\b", re.I)
FAR = 8  # words from which a passage may be quoted from another conversation


def _hash(passage: str) -> str:
    return hashlib.md5(" ".join(passage.lower().split()).encode("utf-8", "surrogatepass")).hexdigest()


def _announces(line: str) -> bool:
    """Whether a line names whom the quote behind it is from: it holds a verb of saying and ends with a colon."""
    return line.rstrip().endswith(":") and _SAID.search(line) is not None


def parse(text: str | None) -> tuple[str, list[tuple[str, bool]], list[tuple[int, str]]]:
    """The text without quotes, (hash, long?) of its own passages, and (level, hash) of each quoted one.

    A passage is a run of lines of one level without blank lines between. The line that names
    whom a quote is from goes with the quote.
    """
    blocks: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _QUOTE.fullmatch(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if blocks and blocks[-1][0] == level:
            blocks[-1][1].append(rest)
        else:
            if level and blocks and not blocks[-1][0]:
                said = [i for i, x in enumerate(blocks[-1][1]) if x.strip()][-1:]
                if said and _announces(blocks[-1][1][said[0]]):
                    del blocks[-1][1][said[0] :]
            blocks.append((level, [rest]))
    own, quoted = [], []
    for level, lines in blocks:
        for passage in re.split(r"\n\s*\n", "\n".join(lines)):
            if passage.strip():
                (quoted.append((level, _hash(passage))) if level else own.append((_hash(passage), len(passage.split()) >= FAR)))
    said = "\n".join("\n".join(lines) for level, lines in blocks if not level)
    return said.strip() if quoted else said, list(dict.fromkeys(own)), list(dict.fromkeys(quoted))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with column `name`: 0, 1, ... in the given order, which must be total.

    Ranges are dealt by sampled bounds and numbered within; the driver adds up one count for
    each range. No key, however frequent, has to fit a task.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranges = materialize(ranges.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33).cast("int")
    first, at = [], 0
    for p, n in sorted(map(tuple, ranges.groupBy(part).count().collect())):
        first.append(f"({p}, {at}L)")
        at += n
    if not first:
        return ranges.drop("_m").withColumn(name, F.lit(0).cast("long"))
    bounds = spark.sql(f"SELECT * FROM VALUES {', '.join(first)} AS t(_part, _first)")
    out = ranges.withColumn("_part", part).join(F.broadcast(bounds), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_first")


def reached(parents: DataFrame) -> DataFrame:
    """(node, root, depth) of parents(node, parent); parent is null at a root and always smaller.

    Each round doubles the steps that are known, so a chain of n takes log2(n) rounds.
    """
    now = materialize(parents.select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("over")), "jumps")
    while not now.filter("NOT over").isEmpty():
        far = now.select(F.col("node").alias("root"), F.col("root").alias("to"), F.col("depth").alias("more"), F.col("over").alias("there"))
        step = now.filter("NOT over").join(far, "root").select("node", F.col("to").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("over"))
        was, now = now, materialize(now.filter("over").union(step), "jumps")
        discard(was)
    return now.select("node", "root", "depth")


def threads(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, in reply-ordered threads without quotes.

    Columns: conv_id, turn, role, parent_conv_id, parent_turn (null at a thread's start),
    thread_conv_id, thread_turn, depth, position (0.. in its thread: by depth, then order),
    n_quotes, n_linked, max_level, text (quotes cut out).
    A quote links to the first message of its own conversation that says it, else, from FAR words
    on, to the first of the one conversation that says it, provided that comes before; unlinked
    quotes are cut too. Null conversations are one conversation, null turns come first, equal turns
    and repeated rows follow one another. Null text: no passages, empty text. Very long texts are
    parsed line by line. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    schema = f"conv_id {kinds[conversation]}, turn {kinds[turn]}, role {kinds[role]}, text string, max_level int, own array<struct<hash:string,far:boolean>>, quotes array<struct<level:int,hash:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_kind, quote_kind = pa.struct([("hash", pa.string()), ("far", pa.bool_())]), pa.struct([("level", pa.int32()), ("hash", pa.string())])
        for b in batches:
            got = [parse(t) for t in b.column("text").to_pylist()]
            out = [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([g[0] for g in got], pa.string()), pa.array([max((q[0] for q in g[2]), default=0) for g in got], pa.int32())]
            out.append(pa.array([[{"hash": h, "far": x} for h, x in g[1]] for g in got], pa.list_(own_kind)))
            out.append(pa.array([[{"level": x, "hash": h} for x, h in g[2]] for g in got], pa.list_(quote_kind)))
            yield pa.RecordBatch.from_arrays(out, names=["conv_id", "turn", "role", "text", "max_level", "own", "quotes"])

    # texts stay in this table; ordering and linking work on keys and hashes alone
    told = materialize(rows.mapInArrow(run, schema).withColumn("_r", F.monotonically_increasing_id()), "chat-parsed")
    keys = materialize(numbered(told.select("conv_id", "turn", "_r"), ["conv_id", "turn", "_r"], "rn"), "chat-keys")
    asked = told.filter(F.size("quotes") > 0).select("_r", F.explode("quotes").alias("q")).join(keys, "_r").select("conv_id", "rn", "q.level", "q.hash")
    asked = materialize(asked, "chat-asked")
    links = None
    if not asked.isEmpty():
        said = told.select("_r", F.explode("own").alias("o")).select("_r", "o.hash", "o.far").join(asked.select("hash").distinct(), "hash", "left_semi").join(keys, "_r")
        here = materialize(said.groupBy("hash", "conv_id").agg(F.min("rn").alias("here"), F.bool_or("far").alias("far")), "chat-said")
        ever = here.groupBy("hash").agg(F.min("here").alias("ever"), F.bool_and("far").alias("far"), F.count(F.lit(1)).alias("n")).filter("far AND n = 1").select("hash", "ever")
        here = here.select(F.col("hash").alias("_h"), F.col("conv_id").alias("_c"), "here")
        linked = asked.join(here, (asked.hash == here["_h"]) & asked.conv_id.eqNullSafe(here["_c"]), "left").join(ever, "hash", "left")
        linked = linked.withColumn("orig", F.when(F.col("here").isNotNull(), F.when(F.col("here") < F.col("rn"), F.col("here"))).when(F.col("ever") < F.col("rn"), F.col("ever")))
        links = linked.groupBy("rn").agg(F.count("orig").alias("n_linked"), F.max(F.when(F.col("orig").isNotNull(), F.struct((-F.col("level")).alias("l"), "orig")))["orig"].alias("orig"))
    starts = keys.groupBy("conv_id").agg(F.min("rn").alias("rn")).select("rn", F.lit(True).alias("first"))
    base = keys.join(starts, "rn", "left")
    base = base.withColumns({"n_linked": F.lit(0).cast("long"), "orig": F.lit(None).cast("long")}) if links is None else base.join(materialize(links, "chat-links"), "rn", "left")
    parent = F.coalesce("orig", F.when(F.col("first").isNull(), F.col("rn") - 1))
    base = materialize(base.select("rn", "_r", "conv_id", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), parent.alias("parent")), "chat-parents")
    order = materialize(numbered(reached(base.select(F.col("rn").alias("node"), "parent")), ["root", "depth", "node"], "at"), "chat-order")
    opening = order.groupBy("root").agg(F.min("at").alias("opens"))
    order = order.join(opening, "root").select(F.col("node").alias("rn"), "root", "depth", (F.col("at") - F.col("opens")).alias("position"))
    of = base.select("rn", F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    out = base.drop("conv_id", "turn").join(order, "rn").join(of.select(F.col("rn").alias("parent"), F.col("c").alias("parent_conv_id"), F.col("t").alias("parent_turn")), "parent", "left")
    out = materialize(out.join(of.select(F.col("rn").alias("root"), F.col("c").alias("thread_conv_id"), F.col("t").alias("thread_turn")), "root").drop("rn", "parent", "root"), "chat-places")
    discard(keys, asked, base, order)
    return told.join(out, "_r").select("conv_id", "turn", "role", "parent_conv_id", "parent_turn", "thread_conv_id", "thread_turn", "depth", "position", F.size("quotes").cast("long").alias("n_quotes"), "n_linked", "max_level", "text")
