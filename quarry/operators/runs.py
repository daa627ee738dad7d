"""Work that goes on where an earlier run stopped: cached answers and sweeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import committed
from ..sources.shared import written

ANSWERS = "key string, answer string, batch string, prefix string"


def cache_key(model: str, system: str) -> F.Column:
    """Sixteen hex digits of a hash of all that an answer depends on: model, system prompt, prompt and seed."""
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(model), F.lit(system), "prompt", F.col("seed").cast("string")), 256), 1, 16)


def answers(prompts: DataFrame, folder: str, ask: Callable[[str, int], str], model: str = "model", system: str = "system", portions: int = 4) -> DataFrame:
    """prompts (prompt, seed, ...) with cache_key, hit and answer.

    The cache is a folder that outlives the run, parted by the key's first digit.  Misses are found by anti-join, asked once for
    each distinct key, and committed in ``portions`` of the digits: of a run that fails the portions that were done count,
    and the next run asks for the rest only.  Two runs that ask the same at once both append; the first batch's answer is read.
    Rows with a null prompt or seed are keyed without it, as they are.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("cache_key", cache_key(model, system)).withColumn("prefix", F.substring("cache_key", 1, 1))
    before = committed.parts(spark, folder, "batch")
    known = committed.read(spark, folder, ANSWERS).select("prefix", F.col("key").alias("cache_key"))
    missing = keyed.join(known, ["prefix", "cache_key"], "left_anti").groupBy("cache_key", "prefix").agg(F.first("prompt").alias("prompt"), F.first("seed").alias("seed"))
    missing = written(missing.withColumnRenamed("cache_key", "key"), "asked")

    def run(batches):
        for batch in batches:
            batch["answer"] = [ask(p, s) for p, s in zip(batch["prompt"], batch["seed"])]
            yield batch[["key", "answer", "prefix"]]

    for k in range(0, 16, 16 // portions):
        some = missing.where(F.col("prefix").isin([f"{d:x}" for d in range(k, k + 16 // portions)]))
        if not some.isEmpty():
            name = f"{len(before):08d}-{k:02d}-{uuid.uuid4().hex}"
            committed.commit(some.mapInPandas(run, "key string, answer string, prefix string"), folder, "batch", name, ["prefix"])
    found = committed.read(spark, folder, ANSWERS)
    old = F.col("batch") <= before[-1] if before else F.lit(False)
    found = found.groupBy("prefix", F.col("key").alias("cache_key")).agg(F.min_by("answer", "batch").alias("answer"), F.max(old).alias("hit"))
    return keyed.join(found, ["prefix", "cache_key"]).drop("prefix")


def sweep(spark: SparkSession, variants: list[dict], folder: str, schema: str, run: Callable[[dict], DataFrame]) -> DataFrame:
    """The results of ``run(variant)`` for all variants, each with its name in variant; ``schema`` is that of a result.

    A variant's result is committed to the folder by itself; variants that are there are not run again, so a sweep that was
    ended goes on with the others.  ``variants`` are dictionaries with a name.
    """
    done = set(committed.parts(spark, folder, "variant"))
    for v in variants:
        if v["name"] not in done:
            committed.commit(run(v), folder, "variant", v["name"])
    return committed.read(spark, folder, f"{schema}, variant string").where(F.col("variant").isin([v["name"] for v in variants]))
