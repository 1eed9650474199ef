"""File sources and sinks that refuse damaged input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import content_hash


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: list[str]) -> DataFrame:
    """Rows of JSON lines; a corrupt line fails the read, a repeated key is refused at once."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(10).collect()
    if twice:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in twice]}")
    return rows


def append_rows(rows: DataFrame, path: str, partition: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Gzipped JSON lines and, beside them, the count and order-free digest of all rows."""
    rows.write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/rows")
    content_hash(rows, rows.columns).write.json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a snapshot, refused if they aren't those that were written."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    want, got = spark.read.schema("rows long, digest string").json(f"{path}/manifest").first(), content_hash(rows, rows.columns).first()
    if want != got:
        raise ValueError(f"snapshot {path} holds {got}, its manifest says {want}")
    return rows


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_lock(found: DataFrame, lock: DataFrame) -> DataFrame:
    """(path, status) of files that are missing, changed or unlocked against lock(path, sha256)."""
    j = found.select("path", F.col("sha256").alias("_f")).join(lock.select("path", F.col("sha256").alias("_l")), "path", "full_outer")
    return j.select("path", F.when(F.col("_f").isNull(), "missing").when(F.col("_l").isNull(), "unlocked").when(F.col("_f") != F.col("_l"), "changed").alias("status")).filter("status IS NOT NULL")


def cached(inputs: DataFrame, cache: DataFrame, text: str, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Inputs with a cached value, and those without; the cache is keyed by content, model and size."""
    keyed = inputs.withColumn("input_hash", F.sha2(F.col(text), 256))
    held = cache.filter((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("input_hash", "value")
    return keyed.join(held, "input_hash"), keyed.join(held, "input_hash", "left_anti")
