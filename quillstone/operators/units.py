"""Source units in order: packed whole into pieces, and matched forward with the passages of another build."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .curation import overlap_chunks


def packed(units: DataFrame, cap: int, gap: int = 2) -> DataFrame:
    """units (document, unit, label, text) as parts (document, unit, label, part, text, piece), pieces of at most `cap` characters.

    A unit of up to `cap` characters is never cut; a longer one is cut at blanks first, and its
    first and last part may share pieces with its neighbours. Parts go in order into the open
    piece while they fit, `gap` characters counted between two. Sorted rows stream through tasks
    that hold one number a document, so a document of any length needs no more memory. Blank
    units are left out; null ones too.
    """
    cut = F.when(F.length("text") <= cap, F.array(F.trim("text"))).otherwise(overlap_chunks(F.col("text"), cap, 0, 0, 0))
    parts = units.filter("trim(text) <> ''").select("document", "unit", "label", F.posexplode(cut).alias("part", "text")).withColumn("n", F.length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, held = None, 0, 0
        for b in batches:
            out = []
            for d, n in zip(b.column("document").to_pylist(), b.column("n").to_pylist(), strict=True):
                if d != now:
                    now, piece, held = d, 0, n
                elif held + gap + n <= cap:
                    held += gap + n
                else:
                    piece, held = piece + 1, n
                out.append(piece)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "piece"])

    order = ["document", "unit", "part"]
    return parts.repartition("document").sortWithinPartitions(*order).mapInArrow(run, parts.schema.add("piece", "integer")).drop("n")


def pieces(parts: DataFrame, between: str = "\n\n") -> DataFrame:
    """(document, piece, first, last, opens, text) of packed parts: the units a piece holds and whether it opens with a unit's start."""
    held = parts.groupBy("document", "piece").agg(F.sort_array(F.collect_list(F.struct("unit", "part", "text"))).alias("z"), F.min("unit").alias("first"), F.max("unit").alias("last"))
    return held.select("document", "piece", "first", "last", (F.get("z", F.lit(0))["part"] == 0).alias("opens"), F.array_join("z.text", between).alias("text"))


def matched_forward(passages: DataFrame, units: DataFrame, opening: int = 6, ahead: int = 50) -> DataFrame:
    """(document, position, unit, at_start) for each passage (document, position, content), matched in order with units (document, unit, text).

    A passage matches a unit that begins with its opening words (at_start), that it begins with,
    or that holds its opening words further in. Each takes the first match from the unit of the
    passage before it on, `ahead` units at most; without one unit and at_start are null and the
    next passage looks from the same place. Candidates come from joins on hashes of word runs; the
    walk streams through them in order and remembers one place a document. Passages and units
    of fewer words than `opening` match by all their words at the start only.
    """
    split = lambda d, key, text: d.select("document", key, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    parts = [F.slice("w", i + 1, F.greatest(F.size("w") - (opening - 1), F.lit(1))).alias(f"w{i}") for i in range(opening)]
    runs = split(units, "unit", "text").select("document", "unit", F.posexplode(F.arrays_zip(*parts)).alias("at", "z"))
    runs = runs.select("document", "unit", "at", F.xxhash64(*[F.col("z")[f"w{i}"] for i in range(opening)]).alias("h"))
    heads = split(passages, "position", "content").select("document", "position", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(opening)]).alias("h"))
    # sorted joins: the runs of a small compressed table are many, and the driver would have to hold them to send them out
    met = runs.join(heads.hint("merge"), ["document", "h"]).select("document", "position", "unit", (F.col("at") == 0).alias("start"))
    met = met.groupBy("document", "position", "unit").agg(F.max("start").alias("start"))
    some = passages.select("document", "position").join(met.hint("merge"), ["document", "position"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, place, now, found = None, None, None, None
        for b in batches:
            rows: list[tuple] = []
            for d, p_, u_, s in zip(*(b.column(c).to_pylist() for c in ("document", "position", "unit", "start")), strict=True):
                if (d, p_) != now:
                    if now is not None:
                        rows.append((*now, *(found or (None, None))))
                    if d != doc:
                        doc, place = d, None
                    now, found = (d, p_), None
                if found is None and u_ is not None and (place is None or place <= u_ <= place + ahead):
                    found, place = (u_, s), u_
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["document", "position", "unit", "at_start"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, *(found or (None, None))), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["document", "position", "unit", "at_start"])

    rows = some.select(F.col("document").cast("long").alias("document"), F.col("position").cast("long").alias("position"), F.col("unit").cast("long").alias("unit"), "start")
    return rows.repartition("document").sortWithinPartitions("document", "position", F.col("unit").asc_nulls_last()).mapInArrow(run, "document long, position long, unit long, at_start boolean")
