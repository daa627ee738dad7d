"""Near copies by shingle similarity against all pairs."""

import itertools
import random
import time

import pytest

from pyspark.sql import functions as F

from quarry.llm import near_copies, simhash, substrings


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def edited(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.random()}"
    return " ".join(w)


def rows():
    r = random.Random(11)
    out = []
    for k in range(40):
        base = " ".join(r.choice(["ba", "ce", "di", "fo", "gu"]) + str(r.randrange(900)) for _ in range(r.randint(120, 400)))
        # one to four edits a hundred words: similarity from about 0.95 down to under 0.8
        out += [base, *(edited(r, base, max(1, len(base.split()) * e // 200)) for e in (1, 2, 4, 8))]
    out += [out[0], out[7].upper(), "", " \n", "two words", "Two\twords", "other words"]
    return list(enumerate(out))


def brute(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(held, 2):
        if alike(a, b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in root if root[i] == i}


def test_one_of_each_class_of_near_copies_stays(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    expected = brute(rows())
    assert {r["doc_id"] for r in near_copies.keep_one(df).collect()} == expected
    # two bits of a fingerprint miss most of these
    assert len({r["doc_id"] for r in simhash.keep_one(df).collect()}) > len(expected) + 40


def test_the_stage_drops_near_copies(spark):
    import corpus_pipeline

    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == brute(rows())


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash.keep_one])
def test_repeated_and_missing_ids(spark, keep_one):
    text = " ".join(f"w{i}" for i in range(60))
    given = [(1, text), (2, text.upper()), (2, "quite another text of its own"), (3, "same row"), (3, "same row"), (None, "lost words here"), (None, "Lost words here"), (None, text), (None, None), (7, "")]
    kept = keep_one(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert [(r[0], r[1]) for r in sorted(kept, key=str) if r[1] not in ("lost words here", "Lost words here")] == sorted([(1, text), (2, "quite another text of its own"), (3, "same row"), (7, "")], key=lambda x: f"Row(doc_id={x[0]}, text={x[1]!r})")
    assert len(kept) == 5


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash.keep_one])
def test_columns_that_have_no_hash(spark, keep_one):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, {"a": 1}, "x"), (2, text, {"b": 2}, "y"), (3, "another text", None, "z"), (3, "another text", None, "z"), (4, None, {}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>, row string").withColumn("deep", F.struct(F.array("tags").alias("m")))
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_copies_among_many_unlike_texts_of_one_template(spark):
    """The hard case: 2,000 texts of one template, unlike pairs at about 0.75, and 200 planted pairs above 0.8."""
    r = random.Random(21)
    template = [f"t{i}" for i in range(800)]
    docs = []
    for k in range(1800):
        words = list(template)
        for i in r.sample(range(0, 800, 5), 14):  # each changed place takes five shingles: two such texts are some 0.72 alike
            words[i] = f"v{k}x{i}"
        docs.append(words)
    pairs = []
    for k in range(200):
        words = list(docs[k])
        for i in r.sample(range(2, 800, 5), 16):
            words[i] = f"p{k}x{i}"
        pairs.append((k, 1800 + k))
        docs.append(words)
    sets = [shingles(" ".join(w)) for w in docs]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(a, b) >= 0.8 for a, b in pairs)
    unlike = [like(a, b) for a, b in itertools.islice(itertools.combinations(range(1800), 2), 3000)]
    assert max(unlike) < 0.8 and sum(unlike) / len(unlike) > 0.69
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(8)
    root = {x.doc_id: x.root for x in near_copies.classes(df).collect()}
    assert sum(root[a] == root[b] for a, b in pairs) >= 195
    assert len(set(root.values())) >= 1800


def test_no_pair_of_a_cell_is_left_out(spark):
    """Cells of many unlike sets: 600 texts of one template and 60 planted pairs, none of which the first look at a cell may find."""
    r = random.Random(22)
    docs = []
    for k in range(600):
        words = [f"t{i}" for i in range(400)]
        for i in r.sample(range(0, 400, 5), 7):
            words[i] = f"v{k}x{i}"
        docs.append(words)
    for k in range(60):
        words = list(docs[k])
        for i in r.sample(range(2, 400, 5), 8):
            words[i] = f"p{k}x{i}"
        docs.append(words)
    texts = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = near_copies.written(near_copies.sketches(df), "sketches")
    roots = spark.createDataFrame([], "node long, root long")
    linked = near_copies.between_classes(df, found, near_copies.shared_cells(found), roots).collect()
    sig = {x.doc_id: x.sig for x in found.collect()}
    sets = {sig[i]: shingles(t) for i, t in texts}
    assert {(min(sig[k], sig[600 + k]), max(sig[k], sig[600 + k])) for k in range(60)} <= {tuple(x) for x in linked}
    assert all(alike(sets[a], sets[b]) for a, b in linked)


def rows_of_joins(spark, act):
    """What act() returns, and how many rows the joins of its queries made in all."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    ids = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    bus.waitUntilEmpty()
    before, out, total = max(ids(), default=-1), act(), 0
    bus.waitUntilEmpty()
    for k in (k for k in ids() if k > before):
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return out, total


def test_sets_that_are_alone_in_a_cell_pass_no_join(spark):
    """A large group of near copies among texts of their own: no join makes rows of all cells."""
    r = random.Random(23)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(2000)]
    texts += [" ".join([*(f"t{i}" for i in range(60)), f"own{k}"]) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = near_copies.written(near_copies.sketches(df), "sketches")
    named, made = rows_of_joins(spark, lambda: near_copies.shared_cells(found))
    cells = {}
    for x in found.collect():
        for c in x.bands:
            cells.setdefault(c, set()).add(x.sig)
    held, expected = named.collect(), {(c, s) for c, sets in cells.items() if len(sets) > 1 for s in sets}
    assert len(held) == len(expected) > 1000 and {(x.cell, x.sig) for x in held} == expected
    assert all(x.many == (len(cells[x.cell]) > 3) and {x.low.sig, x.high.sig} <= cells[x.cell] for x in held)
    assert len({(x.cell, x.part) for x in held}) > len({x.cell for x in held})
    assert made <= 2 * len(expected) < near_copies.BANDS * len(texts) / 4


def test_fingerprints_of_two_bits_are_candidates(spark):
    r = random.Random(41)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(600)) for _ in range(20)]
    texts = base + [t + " end" for t in base]
    found = near_copies.written(near_copies.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "sketches")
    held = {x.doc_id: x for x in found.collect()}
    near = {tuple(sorted((held[k].sig, held[20 + k].sig))) for k in range(20) if ((held[k].fp ^ held[20 + k].fp) & (2**64 - 1)).bit_count() <= 2}
    assert len(near) > 10 and {tuple(x) for x in near_copies.by_fingerprint(found).collect()} == near


def test_sifting_keeps_what_is_alike(spark):
    r, texts = random.Random(31), []
    for _ in range(150):
        base = " ".join(f"w{r.randrange(10**6)}" for _ in range(200))
        texts += [base, edited(r, base, 4), edited(r, base, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.sketches(docs).cache()
    sig = {x.doc_id: x.sig for x in found.collect()}
    pairs = [(sig[3 * k], sig[3 * k + j]) for k in range(150) for j in (1, 2)]
    kept = {tuple(x) for x in near_copies.sifted(found, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(p in kept for p in pairs[::2]) and sum(p in kept for p in pairs[1::2]) < 15


def test_passages_of_rows_without_ids_take_time_linear_in_the_rows(spark):
    passage = " ".join(f"p{i}" for i in range(50))

    def seconds(n):
        df = spark.createDataFrame([(None, f"own{i} text{i} {passage} end{i}") for i in range(n)], "doc_id long, text string").repartition(8)
        start = time.perf_counter()
        assert [tuple(r) for r in substrings.removed(df).select("n_words", "n_removed").distinct().collect()] == [(53, 50)]
        return time.perf_counter() - start

    seconds(50)
    short, long = seconds(2500), seconds(20000)
    assert long < 8 * short + 5


def test_windows_that_share_their_first_64_bits_are_told_apart(spark):
    schema = "doc_id long, at long, weight int, hashes array<bigint>, counts array<bigint>, further array<int>"
    rows = [(1, 1, 1, [7, 8, 9], [1, 1, 1], [1, 1, 1]), (2, 2, 1, [7, 8], [1, 1], [2, 1]), (3, 3, 1, [5, 5], [1, 1], [1, 2]), (4, 4, 1, [6], [2], [0]), (5, 5, 2, [4, 9], [1, 1], [0, 1])]
    found = {r.doc_id: sorted(r.survived) for r in substrings._survivors(spark.createDataFrame(rows, schema), True).collect()}
    assert found == {1: [8, 9], 2: [8], 4: [6]}
    found = {r.doc_id: sorted(r.survived) for r in substrings._survivors(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: [7, 8, 9], 2: [7, 8], 3: [5, 5], 4: [6], 5: [4, 9]}
    w = substrings.Windows([f"w{i}".encode() for i in range(40)], substrings.WordHash(1 << 20), 35)
    assert w.second().max() < 1 << 32 and len(set(w.second().tolist())) == w.n == 6
