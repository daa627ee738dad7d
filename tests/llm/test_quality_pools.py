"""Documents of small groups are judged by larger ones."""

import numpy as np

from quarry.llm import quality

from .test_operators import mcd_brute


def test_small_groups_are_judged(spark):
    r = np.random.default_rng(4)
    n = 330
    x = np.round(r.normal(0, 0.5, (n, quality.P)) * quality.SCALE).astype(int)
    # a: one large source and 20 of five rows; b: ten rows in all
    place = [("a", "big") if i < 220 else ("a", f"s{i % 20}") if i < 320 else ("b", "s") for i in range(n)]
    outliers = [3, 250, 325]
    x[outliers] += 12 * quality.SCALE
    df = spark.createDataFrame([(i, "\n".join(p), p[0], *map(int, v)) for i, (p, v) in enumerate(zip(place, x))], "key long, g string, l string, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    found = {r["key"]: r["d2"] for r in quality.mcd_distances(quality.pooled(df), 1).where("key >= 0").collect()}
    assert set(found) == set(range(n))
    for judged, pool in ((range(220), range(220)), (range(220, 320), range(320)), (range(320, n), range(n))):
        whole = dict(zip(pool, mcd_brute(x[list(pool)])))
        assert np.allclose([found[i] for i in judged], [whole[i] for i in judged], rtol=1e-2, atol=0.05)
    assert [i for i in range(n) if found[i] > quality.CUTOFF] == outliers


def test_an_outlier_of_a_small_source_is_rejected(spark):
    r = np.random.default_rng(5)
    text = lambda m: " ".join("".join(r.choice(list("abdeghilmnorst"), r.integers(2, 9))) for _ in range(m))
    rows = [(i, text(r.integers(80, 160)), "en", f"s{i % 12}") for i in range(60)]
    rows.append((99, "\n".join(" ".join("#$%&" * 9 + str(i % 3) + str(i * k) for k in range(4)) for i in range(3000)), "en", "s1"))
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["distance"] is not None for r in out) and [r["doc_id"] for r in out if not r["kept"]] == [99]
