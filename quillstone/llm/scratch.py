"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is named, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark, "_quillstone_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark._quillstone_scratch = at
    return at


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; `by` gives each value of that column a folder, so that a filter on it reads no other.

    Cuts the lineage: a lost executor costs only the tasks it was running, and row numbers or
    random choices made above the write stay fixed however often the result is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by materialize() that no later step reads."""
    for df in frames:
        path = getattr(df, "_quillstone_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
