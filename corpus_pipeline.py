"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, langid, neardup, packing, secret_scan
from quillstone.llm.scratch import discard, fresh, materialize

#: Below this nearness to every profile, a text is taken for none of the learned languages. Prose of the given tables scores
#: 0.418 or more; random letters, codes, other scripts and a word over and over reach 0.39 at most. Texts under 100
#: characters have few n-grams and scatter more, so only what scores below 0.3 is rejected there.
LEAST_LANGUAGE_SCORE, LEAST_SHORT_SCORE, SHORT = 0.4, 0.3, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too) and those far from every language profile.

    Rows are judged one by one, so ties, repeated rows and doc_ids, and null doc_ids don't matter;
    profiles are learned from rows that aren't held out. Extra columns stay, whatever their names.
    Nothing to learn from, or an empty table: no rows.
    """
    train = docs.filter(~langid.is_held_out(F.col("doc_id"), 5, 0))
    lang, score = fresh(docs, "lang_pred", "score")
    told = langid.identify(docs, train, keep=docs.columns, named=(lang, score))
    least = F.when(F.length("text") < SHORT, LEAST_SHORT_SCORE).otherwise(LEAST_LANGUAGE_SCORE)
    return told.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 0.8 or more in common 5-word shingles: the one with the least doc_id.

    Null doc_ids come last; ties go by hashes of the text, then of the whole row. Of equal rows
    one stays. Null texts and texts without words are one group. Groups have roots of their own,
    so repeated or null doc_ids never join different texts. Empty table: no rows.
    """
    key, whole = fresh(docs, "key", "whole")
    digest = F.xxhash64("text", F.length("text"))
    row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    groups = neardup.groups(docs, ["doc_id", digest.alias("_text"), row.alias("_row")], digest=digest)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row")).alias("k"))
    kept = kept.select(F.xxhash64("k.doc_id", "k._text", "k._row").alias(key))
    # one key column, so that the rows dealt for the join need not be dealt again to drop repeated ones
    rows = docs.withColumn(key, F.xxhash64("doc_id", digest, row))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    All rows of a text go or stay together, whatever their doc_ids. Null and empty texts hold
    nothing and stay. Empty table: no rows; empty benchmark: all rows.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a live-looking credential; widely copied samples do no harm.

    All rows of a text go or stay together. Null and empty texts hold none and stay; a null
    source is a repository of its own. Empty table: no rows.
    """
    (at,) = fresh(docs, "digest")
    digest = F.xxhash64("text", F.length("text"))
    found = secret_scan.scan(docs.select(digest.alias("_digest"), "text", "source"), doc_id="_digest")
    live = materialize(found.filter("n_live > 0").select(F.col("doc_id").alias(at)).distinct(), "pipeline-live")
    return docs.withColumn(at, digest).join(live, at, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of up to 1024: a row for each piece.

    Null and empty texts are their end token. Rows with a repeated or null doc_id are packed each.
    Empty table: no rows. Extra columns are ignored.
    """
    return packing.pack(packing.pieces(docs, ["doc_id"]), ["doc_id", "piece"])


STAGES = [("language_id", language), ("near_dedup", dedup), ("decontamination", decontaminate), ("secret_scan", secrets), ("packing", pack)]

#: SQL can't express rank-order profiles, near-duplicate components or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        was, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(was)  # the given table has no folder of ours
    return STAGES[-1][1](spark, docs, sf_dir)
