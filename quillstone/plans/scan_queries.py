"""Registered queries over pages: furniture, mended lines, reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import scans
from ..session import load
from .inputs import PASSAGES, passages

#: Six lines a page; some documents have a head above and a number below.
PRINTED = f"""{PASSAGES}, printed AS (SELECT doc_id AS document, position // 6 AS page, position % 6 AS line, content AS text FROM passages
  UNION ALL SELECT DISTINCT doc_id, position // 6, -1, 'Works of ' || source || ' ' || position // 6 FROM passages WHERE doc_id % 2 = 0 UNION ALL SELECT DISTINCT doc_id, position // 6, 9, '- ' || position // 6 || ' -' FROM passages WHERE doc_id % 3 = 0)"""


@register("page_furniture", f"""WITH {PRINTED}, e AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS key FROM (SELECT *, min(line) OVER (PARTITION BY document, page) AS a, max(line) OVER (PARTITION BY document, page) AS b FROM printed) WHERE line = a OR line = b),
h AS (SELECT document, key FROM e WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3), k AS (SELECT e.document, page, line, CASE WHEN regexp_matches(text, '^[^A-Za-z0-9]*[0-9]{{1,4}}[^A-Za-z0-9]*$') THEN 'page_number' WHEN h.key IS NOT NULL THEN 'running_head' END AS kind FROM e LEFT JOIN h ON h.document = e.document AND h.key = e.key)
SELECT * FROM k WHERE kind IS NOT NULL""")
def page_furniture(spark, sf_dir):
    p, page = passages(spark, sf_dir), F.floor(F.col("position") / 6)
    body = p.select(F.col("doc_id").alias("document"), page.alias("page"), (F.col("position") % 6).alias("line"), F.col("content").alias("text"))
    tops = p.select("doc_id", "source", page.alias("page")).distinct()
    heads = tops.filter("doc_id % 2 = 0").select("doc_id", "page", F.lit(-1), F.concat_ws(" ", F.lit("Works of"), "source", F.col("page").cast("string")))
    numbers = tops.filter("doc_id % 3 = 0").select("doc_id", "page", F.lit(9), F.concat_ws(" ", F.lit("-"), F.col("page").cast("string"), F.lit("-")))
    return scans.furniture(body.union(heads).union(numbers))


#: Lines of 60 characters; a hyphen where a word of plain letters is broken.
CUT = f"""{PASSAGES}, cut AS (SELECT doc_id AS document, position AS paragraph, i AS line, substr(content, i * 60 + 1, 60) || CASE WHEN regexp_matches(substr(content, i * 60 + 60, 2), '^[a-z][a-z]$') THEN '-' ELSE '' END AS text FROM (SELECT *, unnest(range((length(content) + 59) // 60)) AS i FROM passages))"""


@register("mended_lines", f"""WITH {CUT}, n AS (SELECT *, regexp_matches(text, '-$') AND regexp_matches(coalesce(lead(text) OVER (PARTITION BY document, paragraph ORDER BY line), ''), '^[a-z]') AS broken FROM cut)
SELECT document, paragraph, count(*) AS lines, md5(trim(string_agg(CASE WHEN broken THEN left(text, length(text) - 1) ELSE trim(text) || ' ' END, '' ORDER BY line))) AS digest FROM n GROUP BY ALL""")
def mended_lines(spark, sf_dir):
    p = passages(spark, sf_dir).filter("content <> ''").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") + 59) / 60).cast("int") - 1)))
    start = F.col("i") * 60
    broken = F.substr("content", start + 60, F.lit(2)).rlike("^[a-z][a-z]$")
    lines = p.select(F.col("doc_id").alias("document"), F.col("position").alias("paragraph"), F.col("i").alias("line"), F.concat(F.substr("content", start + 1, F.lit(60)), F.when(broken, "-").otherwise("")).alias("text"))
    return scans.mended(lines).select("document", "paragraph", "lines", F.md5("text").alias("digest"))


def _slots(spark, sf_dir):
    """Twelve passages a page, and the page's number of columns (one to three)."""
    p = passages(spark, sf_dir)
    return p.select((F.col("doc_id") * 1000 + F.floor(F.col("position") / 12)).alias("page"), (F.col("position") % 12).alias("slot"), (1 + F.col("doc_id") % 3).alias("n"), (F.crc32(F.col("content").cast("binary")) % 20).alias("z"))


@register("reading_order", f"""WITH {PASSAGES}, s AS (SELECT doc_id * 1000 + position // 12 AS page, position % 12 AS slot, 1 + doc_id % 3 AS n FROM passages),
a AS (SELECT page, slot * 2 AS slot, CASE WHEN n = 1 THEN 0 ELSE slot % 6 // (6 // n) END AS col FROM s UNION ALL SELECT DISTINCT page, 11, -1 FROM s WHERE page % 2 = 0 AND n > 1 AND page IN (SELECT page FROM s WHERE slot > 5))
SELECT page, slot, CASE WHEN page IN (SELECT page FROM a GROUP BY page HAVING max(col) > 0) OR col <= 0 THEN greatest(col, -1) ELSE 0 END AS col, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page IN (SELECT page FROM a WHERE col = -1) THEN (slot > 11)::INT * 2 + (slot = 11)::INT ELSE 0 END, col, slot) AS place FROM a""")
def reading_order(spark, sf_dir):
    """SQL knows in which column and band each line was set; the operator sees the boxes alone, and the order in them is not the order of rows."""
    s = _slots(spark, sf_dir)
    per = F.floor(6 / F.col("n"))  # rows of a column in each of two bands
    col = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.floor(F.col("slot") % 6 / per))
    row = F.when(F.col("n") == 1, F.col("slot")).otherwise(F.floor(F.col("slot") / 6) * 7 + F.col("slot") % per)
    x0 = col * 100.0 + F.col("z") % 4
    lines = s.select("page", (F.col("slot") * 2).alias("id"), x0.alias("x0"), (x0 + 70 + F.col("z")).alias("x1"), (row * 10.0).alias("y"))
    heads = s.filter("page % 2 = 0 AND n > 1").groupBy("page", "n").agg(F.max("slot").alias("m")).filter("m > 5").select("page", F.lit(11).cast("long").alias("id"), F.lit(5.0), F.col("n") * 100.0 - 20, F.lit(65.0))
    got = scans.reading_order(lines.union(heads))
    return got.select("page", F.col("id").alias("slot"), F.col("column").cast("long").alias("col"), "place")


#: Ten lines a page ten units apart, every fifth indented; at the foot of some pages notes six units apart, opened by a number or going on from the page before.
SET = f"""{PASSAGES}, s AS (SELECT doc_id AS document, position // 10 AS page, position % 10 AS i, position FROM passages),
full_ AS (SELECT document, page FROM s GROUP BY ALL HAVING count(*) = 10),
notes AS (SELECT document, page, unnest(range(2 + page % 3)) AS k FROM full_ WHERE page % 4 < 2)"""


def _set_lines(spark, sf_dir):
    p = passages(spark, sf_dir)
    s = p.select(F.col("doc_id").alias("document"), F.floor(F.col("position") / 10).alias("page"), (F.col("position") % 10).alias("i"), "position", "content")
    indent = F.when(F.col("position") % 5 == 0, 6.0).otherwise(0.0)
    body = s.select("document", "page", F.col("i").alias("line"), indent.alias("x0"), F.lit(200.0).alias("x1"), (F.col("i") * 10.0).alias("y"), F.concat(F.lit("Body "), "content").alias("text"))
    full = s.groupBy("document", "page").agg(F.count(F.lit(1)).alias("n")).filter("n = 10 AND page % 4 < 2")
    note = full.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("page").cast("int") % 3 + 1)))
    opens = F.when((F.col("k") == 0) & (F.col("page") % 4 == 0), "1. see there").otherwise("and so on")
    return body.union(note.select("document", "page", (F.col("k") + 10).cast("long"), F.lit(0.0), F.lit(180.0), 90.0 + 16 + F.col("k") * 6.0, opens))


@register("note_blocks", f"""WITH {SET} SELECT document, page, i AS line, false AS note FROM s UNION ALL SELECT document, page, k + 10, page % 4 = 0 OR (document, page - 1) IN (SELECT document, page FROM notes) FROM notes""")
def note_blocks(spark, sf_dir):
    return scans.note_blocks(_set_lines(spark, sf_dir)).select("document", "page", "line", "note")


@register("page_paragraphs", f"""WITH {SET} SELECT document, page, i AS line, 1 + position // 5 AS paragraph FROM s""")
def page_paragraphs(spark, sf_dir):
    """Body lines alone: what the notes leave; paragraphs of five lines run on across page breaks."""
    body = scans.note_blocks(_set_lines(spark, sf_dir)).filter("NOT note AND line < 10")
    return scans.paragraph_starts(body).select("document", "page", "line", "paragraph")
