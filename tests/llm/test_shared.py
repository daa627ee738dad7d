"""Joins with very frequent keys, hubs of graphs, caches, reserved names and the shared folder."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import components, lines, near_copies, shared, simhash, substrings, toxicity

from .test_operators import corpus, toxic_rows


def test_join_counted_is_the_join(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 0, 0, 1, r.randrange(400)]), i) for i in range(5000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k long, v long")
    counted = df.where("k is not null and k % 3 <> 2").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    expected = sorted(map(tuple, df.join(counted.drop("n"), "k").collect()))
    assert sorted(map(tuple, shared.join_counted(df, counted, "k", "n").collect())) == expected
    assert shared.join_counted(df.limit(0), counted.limit(0), "k", "n").count() == 0


def test_a_frequent_key_is_split(spark):
    df = spark.range(60_000).select(F.lit(7).alias("k"), F.col("id").alias("v"))
    counted = df.groupBy("k").agg(F.count("*").alias("n"), F.lit("x").alias("payload"))
    out = shared.join_counted(df, counted, "k", "n")
    assert out.count() == 60_000 and out.where("payload = 'x'").count() == 60_000
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = [r[0] for r in shared.join_counted(df, counted, "k", "n").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(held) > 8 and max(held) < 15_000


def test_components_of_a_hub(spark):
    edges = spark.range(100_000).select(F.lit(-5).cast("long").alias("a"), F.col("id").alias("b"))
    edges = edges.union(spark.createDataFrame([(200_000, 200_001)], "a long, b long"))
    found = components.connected_components(edges)
    assert {(r["root"], r["n"]) for r in found.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(-5, 100_001), (200_000, 2)}


def test_a_cache_is_bounded():
    cache = shared.Cache(10_000)
    for i in range(1000):
        cache.put(str(i), b"x" * (i % 50), 60)
    assert 0 < len(cache) * (shared.Cache.ENTRY + 10) <= 10_000
    cache.put("large", b"y" * 50_000, 50_000)
    assert list(cache) == ["large"]


def test_a_worker_keeps_one_thing():
    made = []
    make = lambda k: (lambda: made.append(k) or k)
    assert [shared.kept_in_worker((k,), make(k)) for k in "aabba"] == list("aabba")
    assert made == ["a", "b", "a"]


NAMES = "row x gone lines kept n_lines h id last at doc doc_id_ fp sig root digest __id __kept __d __x __part __parts __salt copies changed score".split()


@pytest.mark.parametrize("stage", ["toxicity", "lines", "simhash", "near_copies", "substrings"])
def test_stages_keep_columns_of_any_name(spark, stage):
    rows, labels = toxic_rows(60)
    texts = dict([*rows, *[(1000 + d, t) for d, t in corpus()[60:90] if d is not None]])
    docs = spark.createDataFrame([(d, t, *[f"{d}.{n}" for n in NAMES]) for d, t in texts.items()], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    run = {
        "toxicity": lambda: toxicity.clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int")),
        "lines": lambda: lines.clean(docs), "simhash": lambda: simhash.keep_one(docs), "near_copies": lambda: near_copies.keep_one(docs), "substrings": lambda: substrings.clean(docs),
    }
    out = run[stage]()
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all(r[n] == f"{r['doc_id']}.{n}" for r in kept for n in NAMES)


def test_a_cluster_needs_a_shared_folder():
    from quarry.sources.shared import root

    class Held:
        def isDefined(self):
            return False

    class Stub:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: Held()})())

    with pytest.raises(RuntimeError):
        root(Stub)
