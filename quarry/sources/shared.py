"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode only, a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path_for(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: later plans start at the files."""
    spark = df.sparkSession
    path = path_for(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of ``written`` that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
