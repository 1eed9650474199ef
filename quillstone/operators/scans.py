"""Scanned pages: furniture, mended lines, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def furniture(lines: DataFrame, least: int = 3) -> DataFrame:
    """(document, page, line, kind): page numbers and running heads among the first and last lines of pages.

    lines: (document, page, line, text). A head is a text that, without its numbers, stands at an
    edge of `least` pages or more of its document; counts are taken before lines are joined.
    """
    page = W.partitionBy("document", "page")
    edges = lines.withColumn("_a", F.min("line").over(page)).withColumn("_b", F.max("line").over(page)).filter("line = _a OR line = _b")
    edges = edges.select("document", "page", "line", "text", F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("_key"))
    heads = edges.filter("_key <> ''").groupBy("document", "_key").agg(F.count_distinct("page").alias("_n")).filter(F.col("_n") >= least).select("document", "_key", F.lit(True).alias("_head"))
    kind = F.when(F.col("text").rlike("^[^A-Za-z0-9]*[0-9]{1,4}[^A-Za-z0-9]*$"), "page_number").when(F.col("_head"), "running_head")
    return edges.join(heads, ["document", "_key"], "left").select("document", "page", "line", kind.alias("kind")).filter("kind IS NOT NULL")


def mended(lines: DataFrame) -> DataFrame:
    """(document, paragraph, lines, text): lines joined to paragraphs, words broken at a line's end made whole.

    lines: (document, paragraph, line, text). A hyphen at the end goes where the next line starts with
    a small letter. A paragraph's lines stand in one row, as its text does.
    """
    order = W.partitionBy("document", "paragraph").orderBy("line")
    broken = F.col("text").rlike("-$") & F.coalesce(F.lead("text").over(order), F.lit("")).rlike("^[a-z]")
    part = lines.withColumn("_part", F.when(broken, F.regexp_replace("text", "-$", "")).otherwise(F.concat(F.trim("text"), F.lit(" "))))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_part"))), lambda x: x["_part"]), "")
    return part.groupBy("document", "paragraph").agg(F.count(F.lit(1)).alias("lines"), F.trim(parts).alias("text"))


def gutters(boxes: DataFrame, least: float = 0.02, noise: float = 0.1, wide: float = 0.6) -> DataFrame:
    """(page, middle) of the gaps between a page's columns, found in its projection profile.

    boxes: (page, id, x0, x1, ..). How many boxes lie over each x is a running sum over their
    edges; a gap is a stretch, `least` of the text block's width wide at least, over which no more
    than `noise` of the boxes lie; its middle is that of its widest stretch with fewest. Boxes over `wide` of the block's width (headings, and the
    lines of a page in one column) and boxes without a width take no part; a gap has boxes of columns
    on both sides, so a column's ragged edge is none, however far a heading reaches beyond it.
    """
    page = W.partitionBy("page")
    known = boxes.filter("x1 > x0").withColumn("_l", F.min("x0").over(page)).withColumn("_r", F.max("x1").over(page))
    known = known.filter(F.col("x1") - F.col("x0") < (F.col("_r") - F.col("_l")) * wide)
    sizes = known.groupBy("page").agg(F.first(F.col("_r") - F.col("_l")).alias("_w"), F.min("x0").alias("_l"), F.max("x1").alias("_r"), F.count(F.lit(1)).alias("_n"))
    edges = known.select("page", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy("page", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d")).withColumn("over", F.sum("d").over(page.orderBy("x").rowsBetween(W.unboundedPreceding, 0))).withColumn("to", F.lead("x").over(page.orderBy("x")))
    free = steps.join(sizes, "page").withColumn("free", F.col("over") <= F.col("_n") * noise).filter("to IS NOT NULL")
    run = F.sum((~F.col("free").eqNullSafe(F.lag("free").over(page.orderBy("x")))).cast("int")).over(page.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    gaps = free.withColumn("run", run).filter("free").groupBy("page", "run", "_l", "_r", "_w").agg(F.min("x").alias("a"), F.max("to").alias("b"), F.min_by((F.col("x") + F.col("to")) / 2, F.struct("over", F.col("x") - F.col("to"))).alias("middle"))
    return gaps.filter((F.col("a") > F.col("_l")) & (F.col("b") < F.col("_r")) & (F.col("b") - F.col("a") >= F.col("_w") * least)).select("page", "middle")


def reading_order(boxes: DataFrame, keep: str = "all", least: float = 0.02, noise: float = 0.1) -> DataFrame:
    """boxes (page, id, x0, x1, y) plus column and place, from 1: column by column, each top to bottom.

    The columns of each page are found (gutters), however many. A box over a gutter stands across
    the columns beside it (column -1) and cuts the page into bands read one after the other. keep:
    "all"; of texts side by side only the "left" or "right" column, with what runs across; of
    texts one above the other only the "lower", below the widest gap between rows in the middle
    three fifths of the page. Equal heights go by x0, then id.
    """
    page = W.partitionBy("page")
    if keep == "lower":
        order = page.orderBy("y", "x0", "id")
        b = boxes.withColumn("_gap", F.col("y") - F.lag("y").over(order)).withColumn("_t", F.min("y").over(page)).withColumn("_h", F.max("y").over(page) - F.col("_t"))
        middle = F.when(F.col("y").between(F.col("_t") + F.col("_h") * 0.2, F.col("_t") + F.col("_h") * 0.8), F.struct(F.col("_gap"), (-F.col("y")).alias("y")))
        boxes = b.withColumn("_cut", -F.max(middle).over(page)["y"]).filter(F.col("_cut").isNull() | (F.col("y") >= F.col("_cut"))).drop("_gap", "_t", "_h", "_cut")
    lines = gutters(boxes, least, noise).groupBy("page").agg(F.sort_array(F.collect_list("middle")).alias("_g"))  # a handful a page
    b = boxes.join(lines, "page", "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<double>")))
    left, right = (F.size(F.filter("_g", lambda g: g < F.col(c))) for c in ("x0", "x1"))
    b = b.withColumn("column", F.when(left < right, -1).otherwise(left))
    if keep in ("left", "right"):
        b = b.filter((F.col("column") == -1) | (F.col("column") == (F.lit(0) if keep == "left" else F.size("_g"))))
    across = F.col("column") == -1
    above = F.sum(across.cast("int")).over(page.orderBy("y", "id").rowsBetween(W.unboundedPreceding, 0))
    b = b.withColumn("_band", above * 2 - across.cast("int"))
    return b.withColumn("place", F.row_number().over(page.orderBy("_band", "column", "y", "x0", "id"))).drop("_band", "_g")


#: How a printed note opens.
NOTE_START = "^\\s*(?:[*†‡§¶]|\\(?\\d{1,3}[).]?\\s)"


def note_blocks(lines: DataFrame, region: float = 0.4, tighter: float = 0.95, wider: float = 1.3) -> DataFrame:
    """lines (document, page, line, x0, x1, y, text) plus note: whether the line is in the block of notes at its page's foot.

    The block begins where the page's line spacing changes: the first line in the lower part
    (below `region` of the printed height) before which the gap is `wider` times the usual one, from
    which on lines stand closer than above (`tighter` times the mean step; a single line needs the
    gap alone), and which opens like a note, or goes on with the note that the page before ended
    in: then no paragraph of the body may be indented there. Means before and after each line are
    running sums, so a page is passed once.
    """
    page = W.partitionBy("document", "page")
    order = page.orderBy("y", "x0", "line")
    b = lines.withColumn("_step", F.col("y") - F.lag("y").over(order)).withColumn("_i", F.row_number().over(order))
    b = b.withColumn("_usual", F.median("_step").over(page)).withColumn("_top", F.min("y").over(page)).withColumn("_high", F.max("y").over(page) - F.col("_top"))
    before = F.avg("_step").over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.avg("_step").over(order.rowsBetween(1, W.unboundedFollowing))
    b = b.withColumn("_before", before).withColumn("_after", after).withColumn("_left", F.median("x0").over(page))
    gap = (F.col("_step") >= F.col("_usual") * wider) & (F.col("y") >= F.col("_top") + F.col("_high") * region)
    close = F.col("_after").isNull() | (F.col("_after") <= F.coalesce("_before", "_usual") * tighter)
    b = b.withColumn("_may", gap & close).withColumn("_opens", F.col("text").rlike(NOTE_START))
    start = lambda c: F.min(F.when(c, F.col("_i"))).over(page)
    b = b.withColumn("_start", start(F.col("_may") & F.col("_opens")))
    noted = b.filter("_start IS NOT NULL").select("document", (F.col("page") + 1).alias("page")).distinct().withColumn("_carried", F.lit(True))
    b = b.join(noted, ["document", "page"], "left")
    carried = start(F.col("_may") & F.coalesce("_carried", F.lit(False)) & (F.col("x0") <= F.col("_left")))
    b = b.withColumn("_start", F.least(F.col("_start"), carried))
    return b.withColumn("note", F.coalesce(F.col("_i") >= F.col("_start"), F.lit(False))).drop("_step", "_i", "_usual", "_top", "_high", "_before", "_after", "_left", "_may", "_opens", "_start", "_carried")


def paragraph_starts(lines: DataFrame, indent: float = 0.02, short: float = 0.08) -> DataFrame:
    """lines (document, page, line, x0, x1, text) plus paragraph, a number from 1 within the document.

    A line opens a paragraph if it is indented against the lines around it (three either side),
    or if the line before ends short of them and it begins with a capital or a digit. The rest of
    a word broken at the end of the line before never does. Pages are passed over, so a paragraph
    goes on across a page break.
    """
    doc = W.partitionBy("document").orderBy("page", "line")
    width = F.max("x1").over(W.partitionBy("document")) - F.min("x0").over(W.partitionBy("document"))
    near = doc.rowsBetween(-3, 3)
    middle = lambda c: F.get(F.sort_array(F.collect_list(c).over(near)), F.floor(F.count(c).over(near) / 2).cast("int"))
    b = lines.withColumn("_w", width).withColumn("_left", middle("x0")).withColumn("_right", middle("x1"))
    b = b.withColumn("_prev", F.lag("x1").over(doc)).withColumn("_tail", F.lag("text").over(doc))
    broken = F.col("_tail").rlike("\\pL-$") & F.col("text").rlike("^\\p{Ll}")
    opens = (F.col("x0") - F.col("_left") > F.col("_w") * indent) | ((F.col("_prev") < F.col("_right") - F.col("_w") * short) & F.col("text").rlike("^[^\\pL\\pN]*[\\p{Lu}\\pN]"))
    first = F.when(F.col("_tail").isNull(), True).when(broken, False).otherwise(opens)
    return b.withColumn("paragraph", F.sum(first.cast("int")).over(doc.rowsBetween(W.unboundedPreceding, 0))).drop("_w", "_left", "_right", "_prev", "_tail")
