"""Comparing two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def row_digest(columns: list[str]) -> Column:
    """128 bits of a row's columns, nulls told from empty values."""
    parts = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.md5(parts)


def diff(old: DataFrame, new: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """key and change ("added", "removed" or "changed") of the rows that differ between two versions with the same columns.

    Each version is summed by bucket of the key first: the rows, and the exclusive or of two halves of their digests.  Only rows of
    buckets whose sums differ are joined, ``buckets`` rows at most are broadcast to find them, so what moves follows the changes.
    Keys are unique in a version; a null key is a key.
    """
    columns = sorted(old.columns)
    if columns != sorted(new.columns):
        raise ValueError("the versions have other columns")

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("k"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), row_digest(columns).alias("digest"))

    def sums(rows: DataFrame) -> DataFrame:
        half = lambda at: F.bit_xor(F.conv(F.substring("digest", at, 15), 16, 10).cast("long"))
        return rows.groupBy("bucket").agg(F.count("*").alias("n"), half(1).alias("x"), half(17).alias("y"))

    a, b = hashed(old), hashed(new)
    both = sums(a).alias("a").join(sums(b).alias("b"), "bucket", "full")
    same = F.expr("a.n <=> b.n and a.x <=> b.x and a.y <=> b.y")
    differ = F.broadcast(both.where(~same).select("bucket"))
    a, b = (v.join(differ, "bucket", "left_semi").select("k", "bucket", F.col("digest").alias(d)) for v, d in ((a, "was"), (b, "is")))
    b = b.withColumnsRenamed({"k": "__k", "bucket": "__b"})
    joined = a.join(b, a["k"].eqNullSafe(b["__k"]) & (a["bucket"] == b["__b"]), "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return joined.select(F.coalesce("k", "__k").alias(key), change.alias("change")).where("change is not null")
