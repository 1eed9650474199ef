"""Registered queries of this subpackage; each derives the digest columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import ann, chat, decontam, editprints, langid, lm_score, packing, quality, reversed, secret_scan, sharding, simhash, trie

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {
    "op2_ann": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))) WHERE rank <= 10""",
    # h by the bits of CRC-32; a prefix is the list of its turns' digests
    "op11_prefix_trie": """WITH t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sym) AS pos, sym, strlen(text) AS bytes FROM (
  SELECT conv_id AS c, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sym FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, ((c % 5) + 5) % 5 AS off, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h FROM (SELECT DISTINCT c, c::BIGINT FROM t)),
lists AS (SELECT c, list(sym ORDER BY pos) AS s, list(bytes ORDER BY pos) AS b FROM t GROUP BY c),
built AS (SELECT i.c, list_concat(coalesce(g.s, [])[1:h], o.s[h + 1:]) AS s, list_concat(coalesce(g.b, [])[1:h], o.b[h + 1:]) AS b FROM ids i JOIN lists o USING (c) LEFT JOIN lists g ON g.c = i.c - i.off),
pre AS (SELECT c, d, len(s) AS n, array_to_string(s[1:d], ' ') AS p, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], ' ') END AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM built)),
node AS (SELECT p, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM pre GROUP BY p),
kids AS (SELECT up AS p, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
leaf AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)),
sub AS (SELECT p, sum(own) AS saved, sum(l) AS leaves FROM (SELECT DISTINCT pre.p, below.p AS q, below.own, (below.k = 0)::BIGINT AS l FROM pre JOIN pre b2 ON b2.c = pre.c AND b2.d >= pre.d JOIN leaf below ON below.p = b2.p) GROUP BY p)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n_convs, n.k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM leaf n JOIN sub USING (p) LEFT JOIN node u ON u.p = n.up""",
    "op12_reversed_search": r"""WITH cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT * FROM cut WHERE len(w) > 0), tot AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, n),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN weight USING (term)
  JOIN (SELECT r, 10 + (90 * len(w) * n) // l AS m FROM d, tot) USING (r) GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored JOIN d USING (r) WHERE score > 0) WHERE rank <= 10""",
}


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def op4_sharding(spark, sf_dir):
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


@_register
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_register
def op5_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_duplicates(docs, ["doc_id"])


@_register
def op7_decontamination(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontam.contaminated(docs, items)


@_register
def op10_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = langid.is_held_out(F.col("doc_id"), 5, 0)
    return langid.identify(docs, docs.filter(~held_out), keep=["doc_id", held_out.alias("held_out")])


@_register
def op2_ann(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(rows, F.col("vec_id") % 100 == 0)


@_register
def op9_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(packing.pieces(docs, ["doc_id"]), ["doc_id", "piece"])


@_register
def op3_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = langid.is_held_out(F.col("doc_id"), 5, 0)
    return quality.classify(docs, labels.filter(~held_out), keep=["doc_id", held_out.alias("held_out")])


@_register
def op6_chat(spark, sf_dir):
    return chat.threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_register
def op1_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_score.score(docs, langid.is_held_out(F.col("doc_id"), 7, 2))


@_register
def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_register
def op12_reversed_search(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return reversed.search(docs, items)


@_register
def op13_edit_fingerprints(spark, sf_dir):
    return editprints.compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
