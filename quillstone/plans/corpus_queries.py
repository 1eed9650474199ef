"""Registered queries: passages, their checks, remapping, versions, contents, usage, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import register
from ..functions.text import clean, fold, sentences, slug, uuid5
from ..operators import contents, corpus, evaluation, remap, usage
from ..session import load
from ..streaming import jobs
from .inputs import FUSED, PASSAGES, fused, passages

FOLD = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@register("slugs", "SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM benchmark")
def slugs(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", slug(F.col("text")).alias("slug"))


@register("passage_ids")
def passage_ids(spark, sf_dir):
    p = passages(spark, sf_dir)
    return p.select("doc_id", "position", uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("#", "doc_id", "position")).alias("passage_id"))


@register("clean_text", f"WITH {PASSAGES} SELECT doc_id, position, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(content, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'), '[ \\t\\x{{a0}}]+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'), '\\[\\d+\\]', '', 'g')) AS content FROM passages")
def clean_text(spark, sf_dir):
    return passages(spark, sf_dir).select("doc_id", "position", clean(F.col("content")).alias("content"))


@register("split_passages")
def split_passages(spark, sf_dir):
    return corpus.split_passages(load(spark, sf_dir, "documents"), "doc_id", "text", 1200, 200)


@register("embedding_input", f"""WITH {PASSAGES}, p AS (SELECT *, position // 10 AS run, CASE WHEN length(content) % 5 <> 0 THEN content END AS t FROM passages)
SELECT doc_id, position, concat_ws(' ', right(last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 30), content,
left(first_value(t IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 30)) AS input FROM p""")
def embedding_input(spark, sf_dir):
    p = passages(spark, sf_dir).withColumn("run", F.floor(F.col("position") / 10)).withColumn("searchable", F.length("content") % 5 != 0)
    return corpus.embedding_input(p, 30, 30).select("doc_id", "position", "input")


@register("vector_source_cascade", "SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) THEN 'cache' WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'live' ELSE 'embed' END AS vector_source FROM documents")
def vector_source_cascade(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    cache = d.filter("doc_id % 4 = 0").select("h").distinct().withColumn("c", F.lit(1))
    live = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).withColumn("v", F.lit(1))
    j = d.join(cache, "h", "left").join(live, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("c").isNotNull(), "cache").when(F.col("v").isNotNull(), "live").otherwise("embed").alias("vector_source"))


HEALTH = f"""passages AS (SELECT doc_id, unnest(range(len(l))) + (CASE WHEN doc_id % 7 = 0 AND len(l) > 3 THEN 1 ELSE 0 END) AS position, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
f AS (SELECT *, {FOLD.format('content')} AS f, length(regexp_replace(content, '[^A-Za-z]', '', 'g')) AS letters, trim(content) <> '' AS filled FROM passages),
d AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id, position) AS r FROM f WHERE length(f) >= 100),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS i, lead(position) OVER (PARTITION BY doc_id ORDER BY position) AS next FROM f),
found AS (SELECT 'blank' AS rule, 'block' AS severity, doc_id, position FROM f WHERE NOT filled
UNION ALL SELECT 'debris', 'block', doc_id, position FROM f WHERE filled AND NOT regexp_matches(content, '[A-Za-z0-9]')
UNION ALL SELECT 'positions', 'block', doc_id, position FROM p WHERE i <> position
UNION ALL SELECT 'last_heading', 'block', doc_id, position FROM p WHERE next IS NULL AND filled AND length(content) < 60 AND NOT regexp_matches(content, '[.!?:;,]\\s*$')
UNION ALL SELECT 'boilerplate', 'block', doc_id, position FROM f WHERE regexp_matches(content, '(?i)all rights reserved|public license')
UNION ALL SELECT 'short', 'report', doc_id, position FROM f WHERE filled AND length(content) < 20
UNION ALL SELECT 'duplicate', 'report', doc_id, position FROM d WHERE r > 1
UNION ALL SELECT 'unlettered', 'report', doc_id, position FROM f WHERE length(content) >= 40 AND letters * 2 < length(content)
UNION ALL SELECT 'note_start', 'report', doc_id, position FROM f WHERE regexp_matches(content, '^\\s*(\\[?\\d+\\]|\\*|†)\\s')
UNION ALL SELECT 'joined', 'report', doc_id, position FROM f WHERE regexp_matches(content, '[.!?][A-Z][a-z]')
UNION ALL SELECT 'bracket_number', 'report', doc_id, position FROM f WHERE regexp_matches(content, '\\[\\d+\\]')
UNION ALL SELECT 'ligature', 'report', doc_id, position FROM f WHERE regexp_matches(content, '[ﬁﬂ]'))"""


def _lines(spark, sf_dir):
    """All lines, blank ones too, as passages; some documents' positions start at 1."""
    late = ((F.col("doc_id") % 7 == 0) & (F.size("l") > 3)).cast("int")
    d = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", late.alias("late"), F.posexplode("l").alias("i", "content")).select("doc_id", (F.col("i") + F.col("late")).alias("position"), "content")


@register("health_violations", f"WITH {HEALTH} SELECT * FROM found")
def health_violations(spark, sf_dir):
    return corpus.health(_lines(spark, sf_dir))


@register("known_defect_status", f"""WITH {HEALTH}, k AS (SELECT DISTINCT rule, doc_id, CASE WHEN doc_id % 9 = 0 THEN position + 1000 ELSE position END AS position FROM found WHERE doc_id % 3 = 0), g AS (SELECT DISTINCT rule, doc_id, position FROM found)
SELECT coalesce(g.rule, k.rule) AS rule, coalesce(g.doc_id, k.doc_id) AS doc_id, coalesce(g.position, k.position) AS position, CASE WHEN k.rule IS NULL THEN 'new' WHEN g.rule IS NULL THEN 'stale' ELSE 'known' END AS status
FROM g FULL JOIN k ON g.rule = k.rule AND g.doc_id = k.doc_id AND g.position = k.position""")
def known_defect_status(spark, sf_dir):
    found = corpus.health(_lines(spark, sf_dir))
    known = found.filter("doc_id % 3 = 0").withColumn("position", F.when(F.col("doc_id") % 9 == 0, F.col("position") + 1000).otherwise(F.col("position")))
    return corpus.known_defects(found, known)


@register("foreign_runs", """WITH w AS (SELECT doc_id, lang AS home, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+') AS l FROM documents)),
m AS (SELECT *, CASE WHEN w IN ('le','la','les','des','et','que','une','dans') THEN 'fr' WHEN w IN ('el','los','las','de','que','y','en','una') THEN 'es' WHEN w IN ('der','die','das','und','nicht','ein','mit','den') THEN 'de' END AS lang FROM w),
r AS (SELECT *, coalesce((lang = home)::INT, 0) AS stop, sum(coalesce((lang = home)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, run, count(*) AS n, count(lang) AS marks FROM r WHERE stop = 0 GROUP BY ALL HAVING count(*) >= 5 AND count(lang) >= 2""")
def foreign_runs(spark, sf_dir):
    return corpus.foreign_runs(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("lang"))


SENT = "list_filter(list_transform(regexp_split_to_array({0}, '[.!?]+\\s+'), lambda s: trim(s)), lambda s: s <> '')"


@register("coverage", f"""WITH s AS (SELECT item_id AS file, {FOLD.format('s')} AS folded FROM (SELECT item_id, unnest({SENT.format('text')}) AS s FROM benchmark)),
c AS (SELECT DISTINCT {FOLD.format('s')} AS folded FROM (SELECT unnest({SENT.format('text')}) AS s FROM documents))
SELECT file, count(*) AS sentences, count(c.folded) AS found, round(count(c.folded)::DOUBLE / count(*), 6) AS share FROM s LEFT JOIN c USING (folded) GROUP BY file""")
def coverage(spark, sf_dir):
    src = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.explode(sentences(F.col("text"))).alias("s")).select("file", fold(F.col("s")).alias("folded"))
    held = load(spark, sf_dir, "documents").select(F.explode(F.split("text", "[.!?]+\\s+")).alias("s")).filter(F.trim("s") != "").select(fold(F.col("s")).alias("folded"))
    return corpus.coverage(src, held)


@register("sequence_gaps", """WITH u AS (SELECT o_custkey AS key, CASE WHEN l_linenumber = 3 THEN 2 ELSE l_linenumber END AS number FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT key, number, count(*) AS n FROM u GROUP BY ALL), w AS (SELECT DISTINCT key, unnest(range(1, 5)) AS number FROM u)
SELECT coalesce(n.key, w.key) AS key, coalesce(n.number, w.number) AS number, CASE WHEN n.n IS NULL THEN 'missing' WHEN w.key IS NULL THEN 'out_of_range' ELSE 'duplicated' END AS problem
FROM n FULL JOIN w ON n.key = w.key AND n.number = w.number WHERE n.n IS NULL OR w.key IS NULL OR n.n > 1""")
def sequence_gaps(spark, sf_dir):
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    u = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("key"), F.when(F.col("l_linenumber") == 3, 2).otherwise(F.col("l_linenumber")).alias("number"))
    return corpus.sequence_gaps(u, "key", "number", u.select("key").distinct().withColumn("last", F.lit(4)))


@register("chapter_contiguous", f"""WITH {PASSAGES}, k AS (SELECT doc_id, position, length(content) % 4 AS k FROM passages), n AS (SELECT *, coalesce(k IS DISTINCT FROM lag(k) OVER (PARTITION BY doc_id ORDER BY position), true) AS new FROM k)
SELECT doc_id, k, count(*) FILTER (WHERE new OR position = 0) AS runs FROM n GROUP BY ALL HAVING count(*) FILTER (WHERE new OR position = 0) > 1""")
def chapter_contiguous(spark, sf_dir):
    p = passages(spark, sf_dir).select("doc_id", "position", (F.length("content") % 4).alias("k"))
    return corpus.not_contiguous(p, "doc_id", "position", "k")


@register("rising_run", f"""WITH RECURSIVE {PASSAGES}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rn, length(content) % 50 AS v FROM passages),
r(doc_id, rn, best) AS (SELECT DISTINCT doc_id, 0::BIGINT, list_transform(range(50), lambda x: 0::BIGINT) FROM p UNION ALL
  SELECT r.doc_id, p.rn, list_transform(range(50), lambda x: CASE WHEN x = v THEN greatest(best[x + 1], 1 + coalesce(list_max(best[greatest(v - 8, 0) + 1:v]), 0)) ELSE best[x + 1] END) FROM r JOIN p ON p.doc_id = r.doc_id AND p.rn = r.rn + 1)
SELECT doc_id, list_max(best) AS length, list_position(best, list_max(best)) - 1 AS last FROM (SELECT doc_id, arg_max(best, rn) AS best FROM r GROUP BY doc_id)""")
def rising_run(spark, sf_dir):
    p = passages(spark, sf_dir).select("doc_id", "position", (F.length("content") % 50).alias("n"))
    return corpus.rising_run(p, "doc_id", "position", "n", 8)


def _versions(spark, sf_dir):
    """Old and new passages: some keep their id, some move, some lose or gain their last words."""
    p = passages(spark, sf_dir).select((F.col("doc_id") * 100000 + F.col("position")).alias("id"), F.col("doc_id").alias("document"), "position", "content")
    cut = F.array_join(F.slice(F.split("content", " "), 1, F.greatest(F.size(F.split("content", " ")) - 2, F.lit(1))), " ")
    new = p.filter("id % 13 <> 0").select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000_000).alias("id"), "document", "position", F.when(F.col("id") % 5 == 0, cut).otherwise(F.col("content")).alias("content"))
    return p, new


OLDNEW = f"""{PASSAGES}, old AS (SELECT doc_id * 100000 + position AS id, doc_id AS document, position, content FROM passages),
new AS (SELECT CASE WHEN id % 3 = 0 THEN id ELSE id + 10000000000 END AS id, document, position,
  CASE WHEN id % 5 = 0 THEN array_to_string(string_split(content, ' ')[1:greatest(len(string_split(content, ' ')) - 2, 1)], ' ') ELSE content END AS content FROM old WHERE id % 13 <> 0)"""
SH = "CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) ELSE [] END"
WORDS = "regexp_extract_all(lower({0}), '[\\pL\\pN\\pM]+')"


@register("similarity_shingles", f"""WITH {OLDNEW}, o AS (SELECT id AS old_id, document, {SH.format(k=8)} AS s FROM (SELECT *, {WORDS.format('content')} AS w FROM old)), n AS (SELECT id AS new_id, document, {SH.format(k=8)} AS s FROM (SELECT *, {WORDS.format('content')} AS w FROM new)),
p AS (SELECT old_id, new_id, o.s AS a, n.s AS b, len(list_intersect(o.s, n.s)) AS c FROM o JOIN n ON o.document = n.document AND list_has_any(o.s, n.s))
SELECT old_id, new_id, round(greatest(c::DOUBLE / len(a), c::DOUBLE / len(b)), 6) AS contained, round(c::DOUBLE / (len(a) + len(b) - c), 6) AS alike FROM p""")
def similarity_shingles(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return remap.candidates(old, new, 8)


#: As OLDNEW, but every seventh document has its passages cut in two after 60 % of their words, and some removed ids are redirected.
SPLIT = f"""{OLDNEW}, new2 AS (SELECT id, document, position * 2 AS position, content FROM new WHERE document % 7 <> 0 OR len(string_split(content, ' ')) < 24
  UNION ALL SELECT id * 2 + 500000000000 + h, document, position * 2 + h, array_to_string(CASE WHEN h = 0 THEN w[1:len(w) * 6 // 10] ELSE w[len(w) * 6 // 10 + 1:] END, ' ') FROM (SELECT *, string_split(content, ' ') AS w FROM new WHERE document % 7 = 0), (VALUES (0), (1)) v(h) WHERE len(w) >= 24),
removals AS (SELECT id FROM old WHERE id % 26 = 0), redirects AS (SELECT id AS old_id, id - 1 AS new_id FROM old WHERE id % 39 = 13)"""


def _split_versions(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    w = F.split("content", " ")
    cut = (F.col("document") % 7 == 0) & (F.size(w) >= 24)
    at = F.floor(F.size(w) * 6 / 10).cast("int")
    part = F.when(F.col("h") == 0, F.slice(w, F.lit(1), at)).otherwise(F.slice(w, at + 1, F.size(w)))
    halves = new.filter(cut).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("id") * 2 + 500_000_000_000 + F.col("h")).alias("id"), "document", (F.col("position") * 2 + F.col("h")).alias("position"), F.array_join(part, " ").alias("content"))
    return old, new.filter(~cut).select("id", "document", (F.col("position") * 2).alias("position"), "content").unionByName(halves)


@register("remap_outcomes", f"""WITH {SPLIT}, same AS (SELECT id AS old_id, id AS new_id, 'id' AS method FROM old WHERE id IN (SELECT id FROM new2)),
r0 AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new2) AND id NOT IN (SELECT id FROM removals)),
sent AS (SELECT old_id, new_id, 'redirect' AS method FROM redirects WHERE old_id IN (SELECT id FROM r0) AND new_id IN (SELECT id FROM new2)),
r1 AS (SELECT * FROM r0 WHERE id NOT IN (SELECT old_id FROM sent)),
h AS (SELECT document, {FOLD.format('content')} AS f, min(id) AS new_id FROM new2 GROUP BY ALL),
hashed AS (SELECT r.id AS old_id, h.new_id, 'text_hash' AS method FROM r1 r JOIN h ON r.document = h.document AND {FOLD.format('r.content')} = h.f),
r2 AS (SELECT * FROM r1 WHERE id NOT IN (SELECT old_id FROM hashed)),
o AS (SELECT id AS old_id, document, {SH.format(k=8)} AS s FROM (SELECT *, {WORDS.format('content')} AS w FROM r2)), n AS (SELECT id AS new_id, document, position, w, {SH.format(k=8)} AS s FROM (SELECT *, {WORDS.format('content')} AS w FROM new2)),
p AS (SELECT old_id, o.document, min(new_id) AS new_id, len(list_intersect(o.s, n.s)) AS c, len(o.s) AS a, len(n.s) AS b FROM o JOIN n ON o.document = n.document AND list_has_any(o.s, n.s) GROUP BY old_id, o.document, n.w, o.s, n.s),
sw AS (SELECT id, document, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT *, {WORDS.format('content')} AS w FROM r2) WHERE len(w) BETWEEN 1 AND 7),
m AS (SELECT old_id, new_id, round(c::DOUBLE / a, 6) AS score FROM p WHERE round(c::DOUBLE / a, 6) >= 0.9
  UNION ALL SELECT s.id, n.new_id, 1.0 FROM sw s JOIN n ON s.document = n.document AND contains(' ' || array_to_string(n.w, ' ') || ' ', s.t)),
held AS (SELECT old_id, new_id, 'containment' AS method FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS rn FROM m) WHERE rn = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY position, new_id) AS seq FROM n WHERE len(w) >= 8),
cand AS (SELECT old_id, o.document, o.s AS os, q.s AS ns, seq FROM o JOIN q ON o.document = q.document AND list_has_any(o.s, q.s) WHERE old_id NOT IN (SELECT old_id FROM held)),
isl AS (SELECT *, seq - row_number() OVER (PARTITION BY old_id ORDER BY seq) AS run FROM cand),
occ AS (SELECT old_id, document, os, run, seq, unnest(list_intersect(os, ns)) AS h FROM isl),
l AS (SELECT old_id, run, min(z) AS low FROM (SELECT old_id, run, h, max(seq) AS z FROM occ GROUP BY ALL) GROUP BY ALL),
e AS (SELECT old_id, document, os, run, low, max(z) AS high FROM (SELECT old_id, document, os, run, low, h, min(seq) AS z FROM occ JOIN l USING (old_id, run) WHERE seq >= low GROUP BY ALL) GROUP BY ALL HAVING max(z) > low),
j AS (SELECT e.old_id, e.os, e.run, flatten(list(n.w ORDER BY n.position, n.new_id)) AS w, list(n.new_id ORDER BY n.position, n.new_id) FILTER (len(n.w) >= 8) AS ids, list(n.s ORDER BY n.position, n.new_id) FILTER (len(n.w) >= 8) AS parts
  FROM e JOIN q x ON x.document = e.document AND x.seq = e.low JOIN q y ON y.document = e.document AND y.seq = e.high JOIN n ON n.document = e.document AND n.position BETWEEN x.position AND y.position GROUP BY e.old_id, e.os, e.run),
g AS (SELECT old_id, run, ids, parts, os, round(len(list_intersect(os, {SH.format(k=8)}))::DOUBLE / len(os), 6) AS score FROM j),
runs AS (SELECT old_id, ids, ids[coalesce(list_position(list_transform(parts, lambda x: list_contains(x, opening)), true), 1)] AS lead FROM (SELECT old_id, ids, parts, opening, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, run) AS rn FROM g JOIN (SELECT id AS old_id, array_to_string({WORDS.format('content')}[1:8], ' ') AS opening FROM r2) USING (old_id) WHERE score >= 0.9) WHERE rn = 1),
jac AS (SELECT old_id, new_id, 'jaccard' AS method FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS rn FROM (SELECT *, round(c::DOUBLE / (a + b - c), 6) AS score FROM p) WHERE score >= 0.5 AND old_id NOT IN (SELECT old_id FROM held) AND old_id NOT IN (SELECT old_id FROM runs)) WHERE rn = 1),
kept AS (SELECT * FROM same UNION ALL SELECT * FROM sent UNION ALL SELECT * FROM hashed UNION ALL SELECT * FROM held UNION ALL SELECT * FROM jac), c AS (SELECT *, count(*) OVER (PARTITION BY new_id) AS n FROM kept)
SELECT old_id, new_id, CASE WHEN method = 'id' THEN 'same' WHEN n > 1 THEN 'merged' ELSE 'moved' END AS outcome, method, new_id::VARCHAR AS targets FROM c
UNION ALL SELECT old_id, lead, 'split', 'union', array_to_string(list_concat([lead], list_filter(ids, lambda x: x <> lead)), ' ') FROM runs
UNION ALL SELECT id, NULL, 'removed', 'registry', '' FROM removals WHERE id NOT IN (SELECT id FROM new2)
UNION ALL SELECT id, NULL, 'removed', 'unexplained', '' FROM r2 WHERE id NOT IN (SELECT old_id FROM held UNION ALL SELECT old_id FROM runs UNION ALL SELECT old_id FROM jac)""")
def remap_outcomes(spark, sf_dir):
    old, new = _split_versions(spark, sf_dir)
    sent = old.filter("id % 39 = 13").select(F.col("id").alias("old_id"), (F.col("id") - 1).alias("new_id"))
    return remap.remap(old, new, old.filter("id % 26 = 0").select("id"), sent).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), " "))


@register("stability_failures", f"""WITH {OLDNEW}, n2 AS (SELECT id, CASE WHEN id % 6 = 0 THEN array_to_string(list_reverse(string_split(content, ' ')), ' ') ELSE content END AS content FROM new),
j AS (SELECT o.id, {WORDS.format('o.content')} AS ow, {WORDS.format('n.content')} AS nw FROM old o JOIN n2 n USING (id) WHERE o.content <> n.content),
s AS (SELECT id, {SH.format(k=8).replace('w)', 'ow)').replace('w[', 'ow[')} AS a, {SH.format(k=8).replace('w)', 'nw)').replace('w[', 'nw[')} AS b FROM j), c AS (SELECT *, len(list_intersect(a, b)) AS c FROM s WHERE len(a) > 0 AND len(b) > 0)
SELECT id, round(greatest(c::DOUBLE / len(a), c::DOUBLE / len(b)), 6) AS similarity FROM c WHERE round(greatest(c::DOUBLE / len(a), c::DOUBLE / len(b)), 6) < 0.5 AND id % 12 <> 0""")
def stability_failures(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    turned = new.withColumn("content", F.when(F.col("id") % 6 == 0, F.array_join(F.reverse(F.split("content", " ")), " ")).otherwise(F.col("content")))
    return remap.stability_failures(old, turned, old.filter("id % 12 = 0").select("id"))


@register("drift_counts", f"""WITH {OLDNEW}, j AS (SELECT n.content AS source, o.content AS stored, o.id % 30 = 0 AS label, list_distinct({WORDS.format('n.content')}) AS a, list_distinct({WORDS.format('o.content')}) AS b FROM new n JOIN old o USING (id)),
k AS (SELECT *, source = stored AS same, (len(a) + len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) > 0.5) OR starts_with(source, stored) OR starts_with(stored, source) AS related,
  {FOLD.format("regexp_replace(source, '^[^a-zA-Z0-9_]*[a-zA-Z0-9_]*[0-9]+[^a-zA-Z0-9_]*', '')")} = {FOLD.format("regexp_replace(stored, '^[^a-zA-Z0-9_]*[a-zA-Z0-9_]*[0-9]+[^a-zA-Z0-9_]*', '')")} AS marker FROM j)
SELECT CASE WHEN trim(source) = '' THEN 'blank_source' WHEN NOT same AND NOT related THEN 'content_unrelated' WHEN NOT same AND label THEN 'label_drift' WHEN NOT same AND marker THEN 'marker_prefix' WHEN NOT same THEN 'minor_text' WHEN label THEN 'label_drift' ELSE 'in_sync' END AS drift, count(*) AS n FROM k GROUP BY 1""")
def drift_counts(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    j = new.select("id", F.col("content").alias("source"), F.lit("a").alias("source_label")).join(old.select("id", F.col("content").alias("stored"), F.when(F.col("id") % 30 == 0, "b").otherwise("a").alias("stored_label")), "id")
    return remap.drift(j).groupBy("drift").agg(F.count(F.lit(1)).alias("n"))


@register("retired_positions", f"""WITH {PASSAGES}, r AS (SELECT doc_id * 100000 + position AS id, doc_id AS document, CASE WHEN position % 7 = 6 THEN -1000000 - position ELSE position END AS position FROM passages),
m AS (SELECT document, min(position) AS low FROM r WHERE position <= -1000000 GROUP BY 1)
SELECT id, r.document, least(-1000000, coalesce(low - 1, -1000000)) - (row_number() OVER (PARTITION BY r.document ORDER BY position, id) - 1) AS position FROM r LEFT JOIN m USING (document) WHERE position % 3 = 0 AND position >= 0""")
def retired_positions(spark, sf_dir):
    old, _ = _versions(spark, sf_dir)
    rows = old.withColumn("position", F.when(F.col("position") % 7 == 6, -1_000_000 - F.col("position")).otherwise(F.col("position")))
    return remap.retired_positions(rows, rows.filter("position % 3 = 0 AND position >= 0"))


APPLIED = f"""{OLDNEW}, live AS (SELECT *, id % 17 = 0 AS retired FROM old),
v AS (SELECT coalesce(n.id, l.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.content ELSE l.content END AS content, n.id IS NULL AS retired,
  CASE WHEN n.id IS NOT NULL AND l.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL AND l.retired THEN 'returned' WHEN n.id IS NOT NULL AND n.content <> l.content THEN 'updated' WHEN n.id IS NOT NULL THEN 'kept' WHEN l.retired THEN 'retired before' ELSE 'retired' END AS change
  FROM live l FULL JOIN new n ON l.id = n.id)"""


@register("apply_upsert", f"WITH {APPLIED} SELECT id, retired, change, length(content) AS n, CASE WHEN change = 'retired' THEN '#retired-r1' END AS anchor_suffix FROM v")
def apply_upsert(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    out = remap.apply_version(old.withColumn("retired", F.col("id") % 17 == 0), new, "r1")
    return out.select("id", "retired", "change", F.length("content").alias("n"), "anchor_suffix")


@register("rollback_tombstones", f"WITH {APPLIED} SELECT id FROM v WHERE change = 'inserted'")
def rollback_tombstones(spark, sf_dir):
    """Rolling back points to the old version; only rows that the release inserted need tombstones."""
    old, new = _versions(spark, sf_dir)
    return remap.apply_version(old.withColumn("retired", F.col("id") % 17 == 0), new, "r1").filter("change = 'inserted'").select("id")


@register("user_remap_survivors", """WITH s AS (SELECT user_id, event_id AS passage, ts AS created, event_type AS note FROM events), m AS (SELECT passage AS old_id, passage // 500 AS new_id FROM s WHERE passage % 2 = 0),
a AS (SELECT *, coalesce(new_id, passage) AS target FROM s LEFT JOIN m ON old_id = passage), f AS (SELECT user_id, target, note, min((created, passage)) AS first FROM a GROUP BY ALL)
SELECT a.user_id, a.target, arg_min(a.passage, (a.created, a.passage)) AS survivor, count(*) AS merged, (SELECT left(string_agg(note, chr(10) ORDER BY first), 3000) FROM f WHERE f.user_id = a.user_id AND f.target = a.target) AS notes FROM a GROUP BY a.user_id, a.target""")
def user_remap_survivors(spark, sf_dir):
    s = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("passage"), F.col("ts").alias("created"), F.col("event_type").alias("note"))
    moves = s.filter("passage % 2 = 0").select(F.col("passage").alias("old_id"), F.floor(F.col("passage") / 500).alias("new_id"))
    return remap.remap_saved(s, moves)


@register("retention_purge", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def retention_purge(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter("doc_id % 4 = 0")
    return d.join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


NODES = f"""{PASSAGES}, nodes AS (SELECT doc_id AS document, position AS ordinal, CASE WHEN position > 0 THEN position // 3 END AS parent_ordinal, 'k' || CASE WHEN position % 20 = 19 THEN position - 1 ELSE position END AS node_key, position // 10 AS chapter_key,
  CASE WHEN position % 15 = 7 THEN position - 3 ELSE position END AS position, left(content, 40) AS label FROM passages)"""


def _nodes(spark, sf_dir):
    p = F.col("position")
    return passages(spark, sf_dir).select(F.col("doc_id").alias("document"), p.cast("long").alias("ordinal"), F.when(p > 0, F.floor(p / 3)).alias("parent_ordinal"),
        F.concat(F.lit("k"), F.when(p % 20 == 19, p - 1).otherwise(p)).alias("node_key"), F.floor(p / 10).alias("chapter_key"), F.when(p % 15 == 7, p - 3).otherwise(p).alias("position"), F.left("content", F.lit(40)).alias("label"))


@register("contents_check", f"""WITH {NODES} SELECT document, max(ordinal) AS ordinal, 'repeated_key' AS problem FROM nodes GROUP BY document, node_key HAVING count(*) > 1
UNION ALL SELECT document, ordinal, 'reading_order' FROM (SELECT *, lag(position) OVER (PARTITION BY document ORDER BY ordinal) AS p FROM nodes) WHERE position < p
UNION ALL SELECT doc_id, NULL, 'unreached' FROM (SELECT DISTINCT doc_id, (position + 10) // 10 AS c FROM passages) ANTI JOIN (SELECT document AS doc_id, chapter_key AS c FROM nodes) USING (doc_id, c)""")
def contents_check(spark, sf_dir):
    chapters = passages(spark, sf_dir).select(F.col("doc_id").alias("document"), F.floor((F.col("position") + 10) / 10).alias("chapter_key")).distinct()
    return contents.check(_nodes(spark, sf_dir), chapters)


@register("contents_filter", f"""WITH RECURSIVE {NODES}, hit AS (SELECT document, ordinal FROM nodes WHERE contains(lower(label), 'th') AND contains(lower(label), 'er')),
up AS (SELECT document, ordinal FROM hit UNION SELECT n.document, n.parent_ordinal FROM up JOIN nodes n ON n.document = up.document AND n.ordinal = up.ordinal WHERE n.parent_ordinal IS NOT NULL)
SELECT document, ordinal, label FROM nodes SEMI JOIN up USING (document, ordinal)""")
def contents_filter(spark, sf_dir):
    return contents.filtered(_nodes(spark, sf_dir), ["th", "er"]).select("document", "ordinal", "label")


#: Each user's events one after the other: all users advance together, one event a step.
WALK = """RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS "at", row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
w AS (SELECT *, "at" AS opened, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.*, CASE WHEN e."at" - w.opened >= 21600 THEN e."at" ELSE w.opened END, CASE WHEN e."at" - w.opened >= 21600 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)"""


@register("fixed_window_rate", f'WITH {WALK} SELECT user_id, event_id, "at", n AS in_window, n <= 5 AS allowed FROM w')
def fixed_window_rate(spark, sf_dir):
    return usage.fixed_window(load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("at")), 6 * 3600, 5)


@register("daily_quota", """SELECT event_id, used, used <= 2 AS allowed, CASE WHEN used > 2 THEN (epoch(CAST(ts AS DATE) + INTERVAL 1 DAY) - floor(epoch(ts)))::BIGINT END AS retry_after
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used FROM events)""")
def daily_quota(spark, sf_dir):
    return usage.daily_quota(load(spark, sf_dir, "events"), 2).select("event_id", "used", "allowed", "retry_after")


@register("trailing_admission_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS trailing FROM events")
def trailing_admission_counts(spark, sf_dir):
    return usage.trailing_counts(load(spark, sf_dir, "events"), "user_id", 86400).select("event_id", "trailing")


@register("latest_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_wins(spark, sf_dir):
    return usage.latest_wins(load(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@register("cost_rollup", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS cost, bool_and(value < 400) AS eligible FROM events GROUP BY ALL")
def cost_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.bool_and(F.col("value") < 400).alias("eligible"))


@register("event_sessions", """WITH g AS (SELECT *, coalesce((floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) >= 21600)::INT, 0) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""")
def event_sessions(spark, sf_dir):
    return usage.sessions(load(spark, sf_dir, "events"), 21600)


@register("stream_daily_quota", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL")
def stream_daily_quota(spark, sf_dir):
    return jobs.drain(jobs.daily_quota(jobs.events_stream(spark, f"{sf_dir}/events.parquet")), "complete")


@register("stream_latest_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_latest_wins(spark, sf_dir):
    return jobs.drain(jobs.latest_wins(jobs.events_stream(spark, f"{sf_dir}/events.parquet")), "complete")


@register("stream_fixed_window", f"WITH {WALK} SELECT user_id, arg_max(opened, rn) AS opened, arg_max(n, rn) AS n, count(*) FILTER (n > 5) AS refused FROM w GROUP BY user_id")
def stream_fixed_window(spark, sf_dir):
    return jobs.drain(jobs.fixed_window(jobs.events_stream(spark, f"{sf_dir}/events.parquet"), 6 * 3600, 5), "update")


RUNS = f"{FUSED}, runs AS (SELECT query_id, item, score, rank, CASE collection % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS pipeline, item % 40 AS passage FROM fused)"


def _runs(spark, sf_dir):
    k = F.col("collection") % 3
    return fused(spark, sf_dir).select("query_id", "item", "score", "rank", F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("pipeline"), (F.col("item") % 40).alias("passage"))


@register("overlap_report", f"""WITH {RUNS}, p AS (SELECT query_id, passage, count(DISTINCT pipeline) AS held, max(rank) - min(rank) AS rank_delta, round(max(score) - min(score), 6) AS score_delta FROM runs GROUP BY ALL)
SELECT *, CASE held WHEN 3 THEN 'shared' WHEN 1 THEN 'unique' ELSE 'partial' END AS kind FROM p""")
def overlap_report(spark, sf_dir):
    return evaluation.overlap(_runs(spark, sf_dir), 3)


@register("eval_summary", f"""WITH {RUNS}, q AS (SELECT query_id, pipeline, round(avg(score), 6) AS s FROM runs GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS place FROM q)
SELECT pipeline, count(*) AS queries, round(avg(s), 5) AS mean, round(median(s), 5) AS median, round(stddev_samp(s), 5) AS stdev, min(s) AS lowest, max(s) AS highest, count(*) FILTER (WHERE place = 1) AS wins, round(avg(place), 6) AS mean_rank FROM r GROUP BY pipeline""")
def eval_summary(spark, sf_dir):
    q = _runs(spark, sf_dir).groupBy("query_id", "pipeline").agg(F.round(F.avg("score"), 6).alias("s"))
    return evaluation.summary(q)


@register("eval_composite", "SELECT doc_id, round(0.35::DOUBLE * (doc_id % 7) / 7 + 0.25::DOUBLE * (doc_id % 5) / 5 + 0.10::DOUBLE * quality + 0.15::DOUBLE * toxic + 0.15::DOUBLE * (doc_id % 3) / 3, 6) AS composite FROM labels")
def eval_composite(spark, sf_dir):
    lab = load(spark, sf_dir, "labels")
    parts = {"relevance": F.col("doc_id") % 7 / 7, "selection": F.col("doc_id") % 5 / 5, "diversity": F.col("quality"), "redundancy": F.col("toxic"), "fit": F.col("doc_id") % 3 / 3}
    return lab.select("doc_id", F.round(evaluation.composite(parts), 6).alias("composite"))


@register("paired_quarantine", f"WITH {RUNS}, q AS (SELECT query_id, bool_and(score > 0.03) AS fit FROM runs GROUP BY 1) SELECT query_id, pipeline, count(*) AS n FROM runs SEMI JOIN (SELECT * FROM q WHERE fit) USING (query_id) GROUP BY ALL")
def paired_quarantine(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("fit", F.bool_and(F.col("score") > 0.03).over(W.partitionBy("query_id")))
    return r.filter("fit").groupBy("query_id", "pipeline").agg(F.count(F.lit(1)).alias("n"))


@register("collision_rate", """WITH p AS (SELECT vec_id, label, vec_id % 20 AS position, vec_id // 20 AS document, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.document, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM p a JOIN p b ON a.document = b.document AND b.position - a.position IN (1, 2))
SELECT document, count(*) AS pairs, round(avg((sim > 0.2)::INT), 6) AS rate, round(avg((sim > 0.2)::INT), 6) > 0.05 AS flagged FROM s GROUP BY 1""")
def collision_rate(spark, sf_dir):
    from ..functions.vectors import cosine

    p = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("position"), F.floor(F.col("vec_id") / 20).alias("document"), F.col("embedding").alias("v"))
    a = p.withColumn("at", F.explode(F.array(F.col("position") + 1, F.col("position") + 2))).select("document", "at", F.col("v").alias("av"))
    s = a.join(p.withColumnRenamed("position", "at"), ["document", "at"]).select("document", F.round(cosine(F.col("av"), F.col("v")), 6).alias("sim"))
    return s.groupBy("document").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("sim") > 0.2).cast("int")), 6).alias("rate")).withColumn("flagged", F.col("rate") > 0.05)


@register("role_order_check", "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE role = p")
def role_order_check(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("p", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.filter("role = p").select("conv_id", "turn")


@register("json_fields", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_fields(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@register("html_blocks")
def html_blocks(spark, sf_dir):
    from ..sources.markup import html_units

    return html_units(load(spark, sf_dir, "pages"), "page_id", "html")


