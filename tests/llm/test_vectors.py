"""The operators on embeddings against brute force: ties, copies, hot cells, small parts, nulls, empty tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import embedding_groups, negatives, vector_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def clustered(n, width, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    x = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, floors(v)) for i, v, label in rows if i is not None and label is not None and usable(v)]
    width = max([len(v) for _, _, v in rows], default=0)
    rows = [(i, label, v + [0] * (width - len(v))) for i, label, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in sorted(rows):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), i, its) for i, its, w in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(t, i) for t, i, its in scored if its != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, folder):
    return sorted(map(tuple, negatives.query(spark, folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_negatives_with_ties_copies_and_nulls(spark, tmp_path):
    x = clustered(900, 8, 3)
    rows = [(i, v.tolist(), int(i) % 3) for i, v in enumerate(x)]
    rows += [(900 + i, x[5].tolist(), 1 + i % 2) for i in range(150)]  # a third of a label is one vector, so scores tie
    rows += [(2000, None, 1), (2100, [0.5, None] * 4, 1), (2200, [NAN] * 8, 1), (2300, [INF] * 8, 2), (2400, x[1].tolist(), None), (None, x[2].tolist(), 1), (2500, [0.9, 0.1], 1), (2600, [], 0)]
    assert mined(spark, table(spark, tmp_path, rows)) == brute_negatives(rows)


def test_negatives_in_small_parts_of_groups(spark):
    x = clustered(700, 6, 4)
    rows = [(int(i), int(i) % 4, floors(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    small = negatives.mine(df, F.expr("vec_id % 10 = 0"), positives=3, negatives=4, size=7, block=50)
    large = negatives.mine(df, F.expr("vec_id % 10 = 0"), positives=3, negatives=4)
    got = sorted(map(tuple, small.collect()))
    assert got == sorted(map(tuple, large.collect())) and len(got) > 300


def test_negatives_send_candidates_to_few_groups(spark):
    """Well-separated clusters: bounds keep most candidates from most groups."""
    x = clustered(600, 8, 5, 0.01)
    rows = spark.createDataFrame([(int(i), int(i) % 2, floors(v)) for i, v in enumerate(x)], "vec_id long, label long, v array<int>")
    vectors = np.array([floors(v) for v in x], np.int64)
    pivots = negatives.Pivots(vectors[:40], float((vectors**2).sum(1).max()))
    anchors = negatives.placed(rows.where("vec_id % 10 = 0"), pivots, True)
    wished = anchors.select("*", F.lit(0).alias("space"), F.expr("array(58000L)").alias("lows"), F.expr("array(4611686018427387904L)").alias("highs"))
    bounds = wished.groupBy("space", "cell").agg(F.count("*").alias("n"), F.min("near").alias("nearest"), F.max("near").alias("farthest"), F.max(F.expr(f"sqrt(norm + {pivots.most!r}D - 2D * 58000)")).alias("useful"), F.lit(0.0).alias("least")).collect()
    of, parts = negatives.groups_of(bounds, pivots, 5)
    sent = negatives.routed(rows.withColumn("space", F.lit(0)), pivots, bounds, of).select(F.sum(F.size("groups"))).first()[0]
    assert len(parts) >= 6 and sent < 0.7 * 600 * len(parts)


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 0.0], 1)], [(100, None, 1)], [(100, [], 1), (200, [], 1), (3, [], 2)], [(100, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (3, [1.0, 0.1], 1), (3, [1.0, 0.1], 1), (4, [0.4, 0.2], 2), (4, [0.4, 0.2], 2)]])
def test_negatives_of_few_rows(spark, tmp_path, rows):
    assert mined(spark, table(spark, tmp_path, rows)) == brute_negatives(rows)


def test_great_components_are_exact_or_an_error(spark):
    big = [(0, 1, [2**30, 3]), (1, 1, [2**30 - 1, 2]), (2, 2, [2**29, 5])]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    (row,) = negatives.mine(df(big), F.expr("vec_id = 0")).collect()
    assert (row.positive_score, row.negative_score) == (2**30 * (2**30 - 1) + 6, 2**59 + 15)
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(df([(0, 1, [2**31 - 1] * 3)]), F.expr("vec_id = 0")).collect()


def brute_codes(rows, parts=16, entries=64):
    kept = [(i, floors(v), label) for i, v, label in rows if usable(v)]
    width = max(1, -(-max([len(v) for _, v, _ in kept], default=0) // parts))
    kept = [(i, np.array(v + [0] * (parts * width - len(v))).reshape(parts, width), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].ravel().tolist()))
    books = [[list(v[p]) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(p, v[p])[1], []).append(v[p])
            for k, vs in held.items():
                books[p][k] = [int(c) // len(vs) for c in np.sum(vs, 0)]
    found = [(i, [nearest(p, v[p]) for p in range(parts)], label) for i, v, label in kept]
    by = {}
    for _, near, label in found:
        by[label] = by.get(label, 0) + sum(d for d, _ in near)
    sha = hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), by[label], sha) for i, near, label in found)


def codes(spark, folder):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.query(spark, folder).collect())


def test_codes_with_ties_copies_and_nulls(spark, tmp_path):
    x = clustered(260, 32, 6, 0.3)
    rows = [(i, v.tolist(), int(i) % 5 if i % 9 else None) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist(), 1) for i in range(130)] + [(3, x[3].tolist(), 2), (-5, x[9].tolist(), 2), (-4, x[9].tolist(), 2)]
    rows += [(2000, None, 1), (2001, [0.5, None] * 16, 1), (2002, [NAN] * 32, 1), (2003, [-INF] * 32, 2), (None, x[1].tolist(), 1), (2004, [0.3] * 30, 1), (2005, [], 1)]
    assert codes(spark, table(spark, tmp_path, rows)) == brute_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.25] * 7, None)], [(1, [1.5, -2.0], 1), (1, [1.5, -2.0], 1), (2, [0.1, 0.2], None)]])
def test_codes_of_few_rows(spark, tmp_path, rows):
    assert codes(spark, table(spark, tmp_path, rows)) == brute_codes(rows)


def test_bounds_hold_and_refining_few_entries_is_exact():
    r = np.random.default_rng(8)
    entries, x = r.integers(-90, 90, (64, 4)), r.integers(-120, 120, (500, 4))
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    cells = vector_codes.CellFile(entries)
    lower, upper = cells.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.25  # most entries are never refined
    at, distance = cells.nearest(x)
    assert (at == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_codes_decode_to_their_error(spark):
    x = clustered(200, 16, 9, 0.4)
    rows = spark.createDataFrame([(int(i), "=1", floors(v)) for i, v in enumerate(x)], "vec_id long, label string, v array<int>")
    books = vector_codes.fit(rows, entries=20)
    told = vector_codes.coded(rows, books)
    near = {r.vec_id: r.v for r in vector_codes.decoded(told, books).collect()}
    assert all(r.error == sum((a - b) ** 2 for a, b in zip(floors(x[r.vec_id]), near[r.vec_id])) for r in told.collect())


def brute_groups(rows, cosine=0.9):
    good = [k for k, (_, v) in enumerate(rows) if usable(v) and any(v)]
    width = max([len(rows[k][1]) for k in good], default=1)
    x = np.array([list(rows[k][1]) + [0.0] * (width - len(rows[k][1])) for k in good]).reshape(-1, width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        root[find(good[a])] = find(good[b])
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    links = {k: int(n) for k, n in zip(good, near.sum(1))}
    return sorted((str(i), links.get(k, 0), str(least[find(k)]), i == least[find(k)]) for k, (i, _) in enumerate(rows))


def grouped(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_groups.groups(df, **how).collect())


def linked_rows(n, width, seed):
    """Random vectors, each fourth with a chain of near copies at all similarities about the bound."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = r.normal(size=width)
        x /= np.linalg.norm(x)
        out.append(x)
        for _ in range(3 * (r.random() < 0.25)):
            d = r.normal(size=width)
            d -= d @ x * x
            c = r.uniform(0.88, 0.999)
            x = c * x + math.sqrt(1 - c * c) * d / np.linalg.norm(d)
            out.append(x)
    return [(1000 - i, np.float32(v).tolist()) for i, v in enumerate(out)]


def test_groups_with_exact_reach_lose_no_link(spark):
    rows = linked_rows(260, 24, 11)
    rows += [(5000 + i, rows[3][1]) for i in range(90)] + [(5100, None), (5101, [None] * 24), (5102, [NAN] * 24), (5103, [0.0] * 24), (None, rows[3][1]), (None, None), (5104, []), (5105, [1.0]), (5106, [2.0, 0.0]), (5106, [2.0, 0.0])]
    rows = [(i, v) for i, v in rows]
    assert grouped(spark, rows, reach=None, rows_in_cell=40, left=16, right=24) == brute_groups(rows)


def test_hot_group_of_near_copies_in_cores_and_out_of_them(spark):
    r = np.random.default_rng(12)
    base = r.normal(size=16)
    near = [base + 0.05 * s * r.normal(size=16) for s in (1, 1, 1, 3, 5) for _ in range(60)]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(near + list(r.normal(size=(100, 16))))]
    assert grouped(spark, rows, reach=None, rows_in_cell=100, left=32, right=50) == brute_groups(rows)


def test_default_reach_finds_links_of_planted_copies(spark):
    rows = linked_rows(900, 64, 13)
    got, exact = grouped(spark, rows, rows_in_cell=60), brute_groups(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in exact)
    assert there > 800 and 0.97 * there <= found <= there
    assert sum(a != b for a, b in zip(got, exact)) < 0.02 * len(rows)


def test_groups_of_extreme_lengths_and_empty_tables(spark):
    rows = [(1, [1e30, 1e30]), (2, [1e-30, 1e-30]), (3, [-1e30, -1e30]), (4, [0.0, -0.0])]
    assert grouped(spark, rows) == brute_groups([(1, [1, 1]), (2, [1, 1]), (3, [-1, -1]), (4, [0, 0])])
    assert grouped(spark, []) == []
    assert grouped(spark, [(7, None), (7, None)]) == [("7", 0, "7", True)] * 2


def test_clashing_names_are_ignored(spark, tmp_path):
    x = clustered(120, 8, 14)
    plain = [(i, v.tolist(), int(i) % 2) for i, v in enumerate(x)]
    extra = ["score", "cell", "near", "node", "key", "v", "n", "grp", "error", "copies", "core"]
    df = spark.createDataFrame(plain, SCHEMA)
    df.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    df.select("*", *[F.lit("?").alias(c) for c in extra]).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    for q in (negatives.query, vector_codes.query, embedding_groups.query):
        a, b = q(spark, f"{tmp_path}/a"), q(spark, f"{tmp_path}/b")
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
