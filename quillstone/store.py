"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is named, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark._quillstone_shared = getattr(spark, "_quillstone_shared", None) or tempfile.mkdtemp(prefix="spark-")
    return spark._quillstone_shared


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: work that several later steps need is done once, and no lineage is left."""
    path = f"{shared_dir(df.sparkSession)}/quillstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by materialize() that no later step reads."""
    for df in frames:
        path = getattr(df, "_quillstone_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
