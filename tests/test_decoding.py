"""Stop rules, draws, packed products and training against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import automata, packed, sampling
from quarry.operators import training
from quarry.operators.model import Draws, sample


def stop(classes, prompt, limit, context, most):
    n = acts = 0
    replied = inside = False
    if limit <= 0:
        return "limit", 0
    for c in classes:
        n += 1
        if c == automata.END:
            return "end", n
        if replied and not inside and c != automata.OPEN:
            return "malformed", n
        replied |= c == automata.CLOSE
        inside |= c == automata.OPEN
        if inside:
            acts += 1
            if acts > most:
                return "action", n
        inside &= c != automata.SHUT
        if prompt + n > context:
            return "context", n
        if n >= limit:
            return "limit", n
    return "open", n


def test_stop_rules_fold_as_the_loop_does(spark):
    r = random.Random(2)
    rows = [(i, [r.choices(range(5), [8, 0.2, 1, 1.5, 1])[0] for _ in range(r.randint(0, 40))], r.randint(0, 30)) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, classes array<int>, prompt int")
    for limit, context, most in ((30, 45, 24), (8, 1000, 3), (1000, 20, 2), (0, 9, 9)):
        got = {x.i: (x.reason, x.stopped_at) for x in automata.stops(df, "classes", "prompt", limit, context, most).collect()}
        assert got == {i: stop(c, p, limit, context, most) for i, c, p in rows}
    assert len(automata.transitions()) == 20 and {(s, c) for s, c, *_ in automata.transitions()} == {(s, c) for s in range(4) for c in range(5)}


def test_draws_equal_the_generator_row_by_row(spark):
    seeds = [1, 2, 7, 42, 2**31, 2**63 - 1, -1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(s,) for s in seeds], "seed long").withColumn("s", sampling.seeded(F.col("seed")))
    for _ in range(5):
        df = df.withColumn("s", sampling.next_state(F.col("s")))
    got = {x.seed: x.r for x in df.select("seed", sampling.uniform(F.col("s")).alias("r")).collect()}
    for s in seeds:
        draws = Draws(s)
        assert got[s] == [draws.next() for _ in range(5)][-1]
    zero = spark.range(1).select(sampling.seeded(F.col("id")).alias("s")).first().s
    assert zero == sampling.signed(sampling.STATE_OF_ZERO)


@pytest.mark.parametrize("temperature,k,penalty", [(0.0, 0, 1.0), (0.7, 0, 1.0), (0.7, 3, 1.0), (1.5, 2, 1.4), (0.0, 3, 2.0), (0.5, 50, 1.3)])
def test_samples_equal_the_row_at_a_time_sampler(spark, temperature, k, penalty):
    r = random.Random(4)
    rows = []
    for i in range(400):
        logits = [r.choice([-1.0, 0.0, 0.5, 2.0, r.uniform(-2, 2)]) for _ in range(r.randint(1, 9))]  # ties at the cut and at the top
        recent = [r.randrange(len(logits)) for _ in range(r.randint(0, 6))]
        rows.append((i, logits, recent, temperature, r.random()))
    df = spark.createDataFrame(rows, "i int, logits array<double>, recent array<int>, temperature double, r double")

    class Given:
        def __init__(self, r):
            self.next = lambda: r

    got = {x.i: x.id for x in sampling.sampled(df, k, penalty, 4).collect()}
    assert got == {i: sample(np.array(z), recent[-4:], Given(u), t, k, penalty) for i, z, recent, t, u in rows}
    outside = spark.createDataFrame([(1, [1.0, 2.0], [-1, 5, 1], 0.0, 0.0)], df.schema)
    assert sampling.sampled(outside, 0, 4.0, 3).first().id == 0


@pytest.mark.parametrize("width", [1, 31, 32, 33, 40, 64, 70])
def test_product_on_packed_values_equals_that_of_whole_rows(spark, width):
    r = np.random.default_rng(width)
    groups = -(-width // 32)
    q, scales, x = r.integers(-7, 8, (20, width)), r.random((20, groups)), r.normal(size=width)
    df = spark.createDataFrame([(i, a.tolist(), s.tolist(), x.tolist()) for i, (a, s) in enumerate(zip(q, scales))], "i int, q array<int>, scales array<double>, x array<double>")
    rows = df.withColumn("bytes", packed.pack("q")).withColumn("y", packed.dot("bytes", "scales", "x")).collect()
    for row in rows:
        assert len(row.bytes) == (width + 1) // 2 and all(0 <= b < 256 for b in row.bytes)
        assert row.y == pytest.approx(float(np.repeat(scales[row.i], 32)[:width] * q[row.i] @ x), abs=1e-6)


def test_training_equals_numpy_on_the_same_batches(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 6))
    y = (x @ [2.0, -1, 0.5, 0, 0, 1] + 0.3 * r.normal(size=500) > 0).astype(float)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(5)
    c = training.Config(steps=24, batches=3, warm_up=4, eval_every=6, clip=0.2)
    train, held = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    run = training.fit(train, held, "id", 6, c)

    epochs = {e: {row.id: row.b for row in train.select("id", training.batch_of("id", e, c).alias("b")).collect()} for e in range(8)}
    w, m, v, best, history = np.zeros(7), np.zeros(7), np.zeros(7), (math.inf, None, 0), []
    for step in range(24):
        epoch, part = divmod(step, 3)
        rows = [i for i, b in epochs[epoch].items() if b == part]
        a = np.column_stack([x[rows], np.ones(len(rows))])
        g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y[rows]) / len(rows)
        g *= min(1, 0.2 / (np.linalg.norm(g) + 1e-6))
        rate = 0.1 * (step + 1) / 4 if step < 4 else 0.01 + 0.045 * (1 + math.cos(math.pi * (step - 4) / 20))
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g * g
        w = w - rate * 0.01 * np.append(w[:-1], 0) - rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.95 ** (step + 1))) + 1e-8)
        if (step + 1) % 6 == 0:
            z = np.column_stack([x[::5], np.ones(100)]) @ w
            loss = float(np.mean(np.logaddexp(0, z) - y[::5] * z))
            history.append(loss)
            best = min(best, (loss, w.copy(), step + 1), key=lambda t: t[0])
    assert run.weights == pytest.approx(best[1], abs=1e-9) and run.best_step == best[2]
    assert [h[2] for h in run.history] == pytest.approx(history, abs=1e-9) and history[-1] < 0.5


def test_training_stops_early_and_keeps_the_best(spark):
    df = spark.createDataFrame([(i, [float(i % 2)], float(i % 2)) for i in range(40)], "id long, x array<double>, y double")
    wrong = df.withColumn("y", 1 - F.col("y"))  # validation only gets worse
    run = training.fit(df, wrong, "id", 1, training.Config(steps=50, batches=2, eval_every=2, patience=3, warm_up=1))
    assert run.best_step == 2 and len(run.history) == 4 and run.history[-1][0] == 8
    none = training.fit(df.limit(0), df.limit(0), "id", 1, training.Config(steps=2, eval_every=1))
    assert none.best_step == 0 and none.weights.tolist() == [0, 0]
