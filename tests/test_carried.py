"""Ordered state of keys that span several ranges, nulls among keys and values, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import corpus

ROWS = [(random.Random(i).choice(["hot", "hot", "hot", "x", None]), i, random.Random(-i - 1).choice([None, 1, 2, 3, 5, 8, 40 - i // 5])) for i in range(200)]
RUNS = {k: [(i, v) for j, i, v in ROWS if j == k] for k in ("hot", "x", None)}


@pytest.fixture(params=[1, 5])
def rows(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark.createDataFrame(ROWS, "k string, i long, v long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_early_stop(rows):
    want = {}
    for k, run in RUNS.items():
        best, since = None, 0
        for step, (_, v) in enumerate(run, 1):
            if best is None or v is not None and v < best:
                best, since = v, step
            if step - since >= 8:
                want[k] = step
                break
    assert {r.k: r.stopped for r in corpus.early_stop(rows, "k", "i", "v", 8).collect()} == want
    assert not corpus.early_stop(rows.limit(0), "k", "i", "v", 8).collect()


def test_sessions(rows):
    want = {i: sum(v == 5 for j, v in run if j <= i) for run in RUNS.values() for i, _ in run}
    assert {r.i: r.session for r in corpus.sessions(rows, "k", ["i"], F.col("v") == 5).collect()} == want


def test_before(rows):
    want = {}
    for run in RUNS.values():
        run = sorted(run, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
        for last, (i, _) in zip([(None, None), *run], run):
            want[i] = last
    found = corpus.before(rows, "k", ["v", "i"], ["i", "v"]).collect()
    assert {r.i: (r.before_i, r.before_v) for r in found} == want


def test_last_known(rows):
    want = {}
    for run in RUNS.values():
        last = None
        for i, v in run:
            last = v if v is not None and v > 4 else last
            want[i] = last
    found = corpus.last_known(rows, "k", ["i"], {"kept": F.when(F.col("v") > 4, F.col("v"))}).collect()
    assert {r.i: r.kept for r in found} == want


def test_history_within(rows):
    want = set()
    for run in RUNS.values():
        used = 0
        for n, (i, v) in enumerate(reversed(run), 1):
            used += v or 0
            if used <= 60 and n <= 12:
                want.add(i)
    found = corpus.history_within(rows, "k", "i", F.coalesce("v", F.lit(0)), 60, 12)
    assert found.columns == ["k", "i", "v"]
    assert {r.i for r in found.collect()} == want
