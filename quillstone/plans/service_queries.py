"""Registered queries: enrichment, declared redirects, reports and what callers of a service ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import register
from ..functions.text import fold, sentences
from ..operators import alignment, enrichment
from ..session import load
from .inputs import PASSAGES, passages

SENT = "list_filter(list_transform(regexp_split_to_array({0}, '[.!?]+\\s+'), lambda s: trim(s)), lambda s: s <> '')"
FACETS = f"facets AS (SELECT item_id, 'f' || unnest(range(1, len(l) + 1)) AS facet_id, unnest(l) AS text FROM (SELECT item_id, {SENT.format('text')} AS l FROM benchmark))"


def _facets(spark, sf_dir):
    return enrichment.facets(load(spark, sf_dir, "benchmark"), "item_id", sentences(F.col("text")))


@register("facet_ids", f"WITH {FACETS} SELECT * FROM facets")
def facet_ids(spark, sf_dir):
    return _facets(spark, sf_dir)


@register("merged_passes", f"WITH {FACETS} SELECT item_id, facet_id, text, length(text) AS n, CASE WHEN text LIKE '%,%' THEN 'clause' ELSE 'plain' END AS kind FROM facets WHERE item_id % 3 <> 0 AND length(text) > 10")
def merged_passes(spark, sf_dir):
    f = _facets(spark, sf_dir)
    classified = f.filter("item_id % 3 <> 0").select("item_id", "facet_id", F.when(F.col("text").like("%,%"), "clause").otherwise("plain").alias("kind"))
    annotated = f.filter(F.length("text") > 10).select("item_id", "facet_id", F.length("text").alias("n"))
    return enrichment.merge_passes(f, classified, annotated, ["item_id", "facet_id"])


@register("enrichment_telemetry", f"WITH {FACETS}, k AS (SELECT CASE WHEN text LIKE '%,%' THEN 'clause' WHEN length(text) < 10 THEN 'short' ELSE 'plain' END AS label FROM facets) SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, count(*)::DOUBLE / sum(count(*)) OVER () > 0.6 AS saturated FROM k GROUP BY label")
def enrichment_telemetry(spark, sf_dir):
    label = F.when(F.col("text").like("%,%"), "clause").when(F.length("text") < 10, "short").otherwise("plain")
    counts = _facets(spark, sf_dir).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))  # one row
    share = F.col("n") / F.col("_t")
    return counts.join(F.broadcast(total)).select("label", "n", F.round(share, 6).alias("share"), (share > 0.6).alias("saturated"))


@register("takeaway_check", f"SELECT item_id, len({SENT.format('text')}) > 4 AS too_many FROM benchmark")
def takeaway_check(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", (F.size(sentences(F.col("text"))) > 4).alias("too_many"))


@register("declared_redirects", """WITH d AS (SELECT doc_id AS old_id, doc_id // 10 AS old_document, CASE WHEN doc_id % 4 = 0 AND k = 1 THEN 'split' ELSE 'moved' END AS kind, doc_id + 1 + k * 9 AS new_id FROM documents, range(2) t(k) WHERE doc_id % 5 = 0),
b AS (SELECT doc_id AS id, doc_id // 10 AS document, doc_id % 10 AS position FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 50 = 0),
j AS (SELECT d.*, b.document, b.position, (SELECT max(1) FROM b s WHERE s.id = d.old_id) AS still FROM d LEFT JOIN b ON b.id = d.new_id)
SELECT old_id, min(kind) AS kind, arg_min(new_id, (document <> old_document, document, position, new_id)) FILTER (WHERE document IS NOT NULL) AS target,
  CASE WHEN count(DISTINCT kind) > 1 THEN 'several_kinds' WHEN NOT bool_and(document IS NOT NULL) THEN 'target_not_built' WHEN max(still) = 1 THEN 'old_still_built' END AS problem FROM j GROUP BY old_id""")
def declared_redirects(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    declared = d.filter("doc_id % 5 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("doc_id").alias("old_id"), F.floor(F.col("doc_id") / 10).alias("old_document"),
        F.when((F.col("doc_id") % 4 == 0) & (F.col("k") == 1), "split").otherwise("moved").alias("kind"), (F.col("doc_id") + 1 + F.col("k") * 9).alias("new_id"))
    built = d.filter("doc_id % 5 <> 0 OR doc_id % 50 = 0").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("document"), (F.col("doc_id") % 10).alias("position"))
    return enrichment.declared_redirects(declared, built)


@register("title_disambiguation", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) > 1 THEN p_type || ' (' || p_brand || ')' ELSE p_type END AS title FROM part")
def title_disambiguation(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    n = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "p_type").select("p_partkey", F.when(F.col("n") > 1, F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_type")).alias("title"))


@register("footnote_interleave", "SELECT item_id, left(text, 10) || '[1]' || substr(text, 11, 15) || '[2]' || substr(text, 26) AS marked FROM benchmark")
def footnote_interleave(spark, sf_dir):
    notes = F.array(F.struct(F.lit(25).alias("at"), F.lit(2).alias("n")), F.struct(F.lit(10).alias("at"), F.lit(1).alias("n")))
    return load(spark, sf_dir, "benchmark").select("item_id", enrichment.interleave(F.col("text"), notes).alias("marked"))


@register("adjacent_duplicates", f"WITH {PASSAGES} SELECT doc_id, position FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY position) AS p FROM passages) WHERE content = p")
def adjacent_duplicates(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("p", F.lag("content").over(W.partitionBy("doc_id").orderBy("position")))
    return p.filter("content = p").select("doc_id", "position")


@register("outline_compare", f"""WITH {PASSAGES}, derived AS (SELECT doc_id, position // 10 AS k, count(*) AS n FROM passages GROUP BY ALL), stored AS (SELECT doc_id, k, CASE WHEN doc_id % 8 = 0 THEN n + 1 ELSE n END AS n FROM derived WHERE (doc_id + k) % 6 <> 0)
SELECT coalesce(d.doc_id, s.doc_id) AS doc_id, coalesce(d.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'not_stored' WHEN d.k IS NULL THEN 'stale' ELSE 'differs' END AS problem FROM derived d FULL JOIN stored s ON d.doc_id = s.doc_id AND d.k = s.k WHERE s.k IS NULL OR d.k IS NULL OR s.n <> d.n""")
def outline_compare(spark, sf_dir):
    derived = passages(spark, sf_dir).groupBy("doc_id", F.floor(F.col("position") / 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = derived.filter("(doc_id + k) % 6 <> 0").withColumn("m", F.when(F.col("doc_id") % 8 == 0, F.col("n") + 1).otherwise(F.col("n"))).drop("n")
    j = derived.join(stored, ["doc_id", "k"], "full_outer").filter("n IS NULL OR m IS NULL OR n <> m")
    return j.select("doc_id", "k", F.when(F.col("m").isNull(), "not_stored").when(F.col("n").isNull(), "stale").otherwise("differs").alias("problem"))


@register("rights_inventory", f"WITH {PASSAGES} SELECT doc_id, count(*) AS passages, max(len(string_split(content, ' '))) AS longest, max(len(string_split(content, ' '))) <= 60 AS within FROM passages GROUP BY doc_id")
def rights_inventory(spark, sf_dir):
    n = F.max(F.size(F.split("content", " ")))
    return passages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), n.alias("longest"), (n <= 60).alias("within"))


@register("page_hosts", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@register("description_leak", f"""WITH b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(f) - 38, 1)), lambda i: substr(f, i, 40)))) AS g FROM (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+', ' ', 'g')) AS f FROM benchmark) WHERE length(f) >= 40),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+', ' ', 'g')) AS f FROM documents) SELECT DISTINCT item_id, doc_id FROM b JOIN d ON contains(d.f, b.g)""")
def description_leak(spark, sf_dir):
    """Items of which some run of 40 folded characters stands in a document.

    Such a run covers one of the document's blocks of 20 characters whole; only those blocks, a
    twentieth of all runs, meet the item's runs of 20, and what stands beside them decides.
    """
    half = 20
    docs = load(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("f"))
    items = load(spark, sf_dir, "benchmark").select("item_id", fold(F.col("text")).alias("f")).filter(F.length("f") >= 2 * half)
    blocks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("f", F.lit(f"(?s).{{{half}}}"), F.lit(0))).alias("at", "m")).select("doc_id", "at", F.xxhash64("m").alias("h"))
    runs = items.select("item_id", "f", F.explode(F.sequence(F.lit(1), F.length("f") - half + 1)).alias("p"))
    beside = lambda p: [F.substring("f", p, F.lit(half)).alias("m"), F.substring("f", F.greatest(p - half, F.lit(1)), F.least(p - 1, F.lit(half))).alias("l"), F.substring("f", p + half, F.lit(half)).alias("r")]
    runs = runs.select("item_id", *beside(F.col("p"))).distinct().withColumn("h", F.xxhash64("m"))
    met = blocks.join(runs.select("h").distinct().hint("merge"), "h", "left_semi")
    found = docs.join(met.hint("merge"), "doc_id").select("doc_id", "h", *beside(F.col("at") * half + 1)).distinct().alias("d").join(runs.hint("merge").alias("i"), ["h"])
    # n characters before the block and 20 - n behind it
    same = [(F.least(F.length("d.l"), F.length("i.l")) >= n) & (F.right("d.l", F.lit(n)) == F.right("i.l", F.lit(n))) & (F.least(F.length("d.r"), F.length("i.r")) >= half - n) & (F.left("d.r", F.lit(half - n)) == F.left("i.r", F.lit(half - n))) for n in range(half + 1)]
    return found.filter(F.col("d.m") == F.col("i.m")).filter(reduce(lambda x, y: x | y, same)).select("item_id", "doc_id").distinct()


@register("resumable_remaining", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resumable_remaining(spark, sf_dir):
    done = load(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("item_id"))
    return load(spark, sf_dir, "benchmark").join(done, "item_id", "left_anti").select("item_id")


@register("history_page", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE (conv_id, turn) < (60, 1) AND contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 20")
def history_page(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter(F.struct("conv_id", "turn") < F.struct(F.lit(60).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"))).filter(F.contains(F.lower("text"), F.lit("the")))
    return c.orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", F.length("text").alias("n"))


@register("sources_list", "SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def sources_list(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@register("preferences_merge", "SELECT d.doc_id, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def preferences_merge(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@register("printed_year_mismatch", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) <> 1992 + o_orderkey % 7")
def printed_year_mismatch(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter(F.year("o_orderdate") != 1992 + F.col("o_orderkey") % 7).select("o_orderkey")


@register("sentinels", "WITH m AS (SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY lang) SELECT lang, n < 100 AS too_few, longest < 5000 AS too_short FROM m")
def sentinels(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg((F.count(F.lit(1)) < 100).alias("too_few"), (F.max("n_chars") < 5000).alias("too_short"))


@register("edition_align")
def edition_align(spark, sf_dir):
    """Each item's sentences against those of the documents that hold its first one: units of two editions in order."""
    s = sentences(F.col("text"))
    b = load(spark, sf_dir, "benchmark").select("item_id", s.alias("left")).withColumn("h", F.xxhash64(fold(F.get("left", F.lit(0)))))
    d = load(spark, sf_dir, "documents").select("doc_id", s.alias("all"))
    places = d.select("doc_id", F.posexplode("all").alias("at", "first")).select("doc_id", "at", F.xxhash64(fold(F.col("first"))).alias("h"))
    met = places.join(b, "h").select("item_id", "doc_id", "at", "left")  # only places where an item's first sentence stands get the sentences after it
    right = F.slice("all", F.col("at") + 1, F.size("left") + 2)
    return enrichment.align_editions(met.join(d, "doc_id").select("item_id", "doc_id", "at", "left", right.alias("right")), ["item_id", "doc_id", "at"])


def _keyed(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_timestamp("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "claim").when(F.col("event_id") % 11 == 0, "finish").when(F.col("event_id") % 3 == 1, "fail").otherwise("claim").alias("action"))


KEYED = """e AS MATERIALIZED (SELECT user_id AS key, event_id, floor(epoch(ts))::BIGINT AS "at", CASE WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 11 = 0 THEN 'finish' WHEN event_id % 3 = 1 THEN 'fail' ELSE 'claim' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events)"""
#: What an event does to a lease, from the state before it: l.state and l.since.
GRANTED = """CASE e.action WHEN 'claim' THEN l.state <> 'ready' AND (l.state <> 'claimed' OR e."at" - l.since >= 7200) ELSE l.state = 'claimed' END"""
BECOMES = "CASE e.action WHEN 'claim' THEN 'claimed' WHEN 'finish' THEN 'ready' ELSE 'failed' END"


@register("lease_states", f"""WITH RECURSIVE {KEYED}, l AS (SELECT DISTINCT key, 0::BIGINT AS event_id, 0::BIGINT AS "at", '' AS action, 0::BIGINT AS rn, 'pending' AS state, 0::BIGINT AS since, false AS granted FROM e
  UNION ALL SELECT e.*, CASE WHEN {GRANTED} THEN {BECOMES} ELSE l.state END, CASE WHEN e.action = 'claim' AND {GRANTED} THEN e."at" ELSE l.since END, {GRANTED} FROM l JOIN e ON e.key = l.key AND e.rn = l.rn + 1)
SELECT key, event_id, "at", action, state, granted FROM l WHERE rn > 0""")
def lease_states(spark, sf_dir):
    return enrichment.leases(_keyed(spark, sf_dir), 7200)


@register("trailing_admission", f"""WITH RECURSIVE {KEYED}, l AS (SELECT DISTINCT key, 0::BIGINT AS event_id, 0::BIGINT AS "at", 0::BIGINT AS rn, []::BIGINT[] AS kept, false AS admitted FROM e
  UNION ALL SELECT e.key, e.event_id, e."at", e.rn, CASE WHEN len(list_filter(l.kept, lambda x: e."at" - x < 86400)) < 2 THEN list_append(list_filter(l.kept, lambda x: e."at" - x < 86400), e."at") ELSE list_filter(l.kept, lambda x: e."at" - x < 86400) END, len(list_filter(l.kept, lambda x: e."at" - x < 86400)) < 2 FROM l JOIN e ON e.key = l.key AND e.rn = l.rn + 1)
SELECT key, event_id, "at", admitted FROM l WHERE rn > 0""")
def trailing_admission(spark, sf_dir):
    return enrichment.trailing_admission(_keyed(spark, sf_dir), 86400, 2)


@register("edition_units")
def edition_units(spark, sf_dir):
    """The lines of every document against a second edition of it: every fifth line is joined to the one before, every eleventh is missing, some words are left out.

    SQL has no program over two orders; a test holds the sums against a full one.
    """
    p = passages(spark, sf_dir).select(F.col("doc_id").alias("pair"), F.col("position").alias("k"), F.col("content").alias("text"))
    fewer = F.array_join(F.filter(F.split("text", " "), lambda w: F.crc32(w.cast("binary")) % 9 > 0), " ")
    place = F.col("k") - F.floor(F.col("k") / 5)  # a fifth line goes with the line before it
    other = p.filter("k % 11 <> 7").groupBy("pair", place.alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", fewer.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    other = other.select("pair", F.lit(1).alias("side"), (F.row_number().over(W.partitionBy("pair").orderBy("g")) - 1).cast("long").alias("k"), "text")
    return alignment.aligned(p.select("pair", F.lit(0).alias("side"), F.col("k").cast("long").alias("k"), "text").unionByName(other))
