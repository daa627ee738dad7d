"""Tables that outlive a run: each part is written aside and appears by one rename, or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def parts(spark: SparkSession, folder: str, column: str) -> list[str]:
    """The values of ``column`` whose parts are committed in a folder."""
    fs, path = _files(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def commit(rows: DataFrame, folder: str, column: str, value: str, by: list[str] = ()) -> bool:
    """Writes rows as the part ``column=value``; False if that part is there already.

    The files are written to a folder that readers skip and renamed when all are there; a run that fails leaves nothing that counts.
    """
    spark = rows.sparkSession
    aside, name = f"{folder}/_aside-{uuid.uuid4().hex}", f"{folder}/{column}={value}"
    fs, target = _files(spark, name)
    if fs.exists(target):
        return False
    writer = rows.write.partitionBy(*by) if by else rows.write
    writer.parquet(aside)
    source = _files(spark, aside)[1]
    # of two writers the second finds the name taken
    done = not fs.exists(target) and fs.rename(source, target)
    if not done:
        fs.delete(source, True)
    return bool(done)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All committed parts; no rows if there is none."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)
