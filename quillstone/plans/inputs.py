"""Shared inputs of the registered queries: the given tables seen as passages, points and queries.

For each builder, the SQL of the same name is what DuckDB runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stems_sql
from ..operators import retrieval
from ..session import load
from ..store import materialize

STOPS = "('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')"

PASSAGES = """passages AS (
  SELECT doc_id, lang, source, unnest(range(len(l))) AS position, unnest(l) AS content
  FROM (SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"""
POINTS = "points AS (SELECT vec_id AS item, label AS collection, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
PATHS = f"""{POINTS}, asked AS (
  SELECT item // 100 AS query_id, item % 100 AS path_no, CASE WHEN item % 100 = 0 THEN 'query' ELSE 'hyde' END AS family, item AS skip, vector FROM points WHERE item % 100 < 3),
near AS (SELECT q.query_id, p.collection, q.family, q.path_no, p.item, round(list_cosine_similarity(q.vector, p.vector), 6) AS score
  FROM asked q JOIN points p ON p.item <> q.skip),
paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, path_no ORDER BY score DESC, item) AS rank FROM near) WHERE rank <= 20)"""
FUSED = f"""{PATHS}, votes AS (
  SELECT query_id, collection, item, family, max(1.0::DOUBLE / (20 + rank)) AS vote, min(rank) AS best, min((path_no, rank)) AS first FROM paths GROUP BY ALL),
sums AS (SELECT query_id, collection, item, round(sum(vote), 9) AS score, min(best) AS best, min(first) AS first FROM votes GROUP BY ALL),
fused AS (SELECT query_id, collection, item, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, first, item) AS rank FROM sums) WHERE rank <= 8 OR best <= 3)"""
#: The number of collections each query asks for comes from the points themselves.
VOCABULARY = f"""vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)), {stems_sql('vocabulary')}"""
TERMS = f"""{VOCABULARY}, words_of AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+'))) AS word FROM benchmark),
terms AS (SELECT DISTINCT query_id, stem AS term, count(DISTINCT stem) OVER (PARTITION BY query_id) AS n_terms FROM words_of JOIN st USING (word) WHERE word NOT IN {STOPS})"""
#: Words of a document's first line weigh 1, the others 0.4.
POSTINGS = f"""toks AS (SELECT lang AS collection, doc_id AS item, regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+') AS w, len(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\pL\\pN\\pM]+')) AS head FROM documents),
postings AS (SELECT collection, item, length, stem AS term, count(*) AS tf, round(sum(CASE WHEN i <= head THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END), 6) AS weight FROM (SELECT collection, item, len(w) AS length, head, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM toks) JOIN st USING (word) WHERE word NOT IN {STOPS} GROUP BY ALL)"""
MATCHED = f"""{TERMS}, {POSTINGS}, matched AS (
  SELECT query_id, collection, item, n_terms, count(*) AS matched, round(sum(p.weight * 2.2 / (p.weight + 1.2 * (0.25 + 0.75 * length / 256))), 6) AS weight
  FROM postings p JOIN terms USING (term) GROUP BY query_id, collection, item, n_terms)"""


def passages(spark, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, position, content): the lines of every document that aren't blank."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(lines).alias("position", "content"))


def points(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))


def asked(spark, sf_dir: str) -> DataFrame:
    """A query for every vector whose id is divisible by 100, the two behind it as its further paths, asked of every collection there is."""
    p = points(spark, sf_dir)
    known = F.broadcast(p.select("collection").distinct().agg(F.sort_array(F.collect_set("collection")).alias("_c")))  # one row: the collections
    path = F.col("item") % 100
    q = p.filter("item % 100 < 3").select(F.floor(F.col("item") / 100).alias("query_id"), path.alias("path_no"), F.when(path == 0, "query").otherwise("hyde").alias("family"), F.col("item").alias("skip"), "vector")
    return q.join(known).withColumn("collection", F.explode("_c")).drop("_c")


def paths(spark, sf_dir: str, k: int = 20) -> DataFrame:
    return retrieval.vector_paths(asked(spark, sf_dir), retrieval.with_norms(points(spark, sf_dir)), k, min_score=None)


def fused(spark, sf_dir: str) -> DataFrame:
    return retrieval.rrf(paths(spark, sf_dir), k=20, top_n=8)


def fused_once(spark, sf_dir: str) -> DataFrame:
    """The same for queries that read it several times: paths are found once."""
    return materialize(fused(spark, sf_dir), "fused")


def terms(spark, sf_dir: str) -> DataFrame:
    return retrieval.query_terms(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def posted(spark, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Postings of all documents, or of the asked terms(term) alone."""
    docs = load(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").alias("item"), "text")
    return retrieval.postings(docs, F.col("text"), asked)
