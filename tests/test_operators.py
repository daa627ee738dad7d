"""Operators on literal cases."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import corpus, tokens
from quarry.plans import rules
from quarry.plans.dialect import to_duckdb, to_spark
from quarry.sources import model_blob
from quarry.streaming import sessions


def test_one_decimal_is_correct_rounding(spark):
    values = [31.25, -3.25, 0.05, 0.15, 0.25, 0.35, 0.45, 2.675, 1234.55, 0.95]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(F.expr(to_spark("@one_decimal(v)")).alias("s"))
    assert [r.s for r in df.collect()] == [f"{v:.1f}" for v in values]


def test_pretokens(spark):
    cases = {"a b": ["a", " b"], "a  b": ["a", " ", " b"], "a  ": ["a", "  "], "  a": [" ", " a"], "key=1": ["key=", "1"], "é": ["Ã", "©"], "a\n b": ["a", "\n", " b"], "": [], "12": ["1", "2"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokens.pretokens(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_action_cases(spark):
    bodies = ["fan=2", "fan=4", "", "fan=1 fan=2", "fan=1 heat=1 pump=1 light=10 win=1", "light=15", "ack=0", "zap=1", "fan", "diag=too_hot", "diag=nope", "fan=-1", "fan=²", "light=100 win=0", "ack=99"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", F.expr(to_spark(rules.OK)).alias("ok"))
    good = {"fan=2", "diag=too_hot", "light=100 win=0", "ack=99"}
    assert {r.body for r in df.collect() if r.ok} == good


def test_verdicts(spark):
    state = {"t": 22.0, "h": 55, "soil": 50, "fan": 0, "heat": 0, "pump": 0, "light": 0, "win": 0, "pa": 0.0, "vib": 0, "err": 0}
    act = dict.fromkeys(rules.KEYS)
    cases = [({"err": 3}, {"heat": 1}, "fault_heater"), ({"err": 5}, {"win": 1}, "fault_window"), ({"err": 5, "win": 1}, {"win": 1}, "ok"), ({"err": 7}, {"pump": 1}, "fault_pump"), ({"err": 3}, {"ack": 5}, "ack_mismatch"), ({"t": 35.0}, {"heat": 1}, "overheat"), ({"t": None}, {"heat": 1}, "ok"), ({"heat": 1}, {"win": 1}, "heater_window"), ({"win": 1}, {"heat": 1, "win": 0}, "ok"), ({}, {"fan": 3}, "ok")]
    rows = [(i, *{**state, **s}.values(), *{**act, **a}.values(), True) for i, (s, a, _) in enumerate(cases)]
    schema = "i int, t double, h int, soil int, fan int, heat int, pump int, light int, win int, pa double, vib int, err int, " + ", ".join(f"a_{k} int" for k in rules.KEYS) + ", ok boolean"
    found = spark.createDataFrame(rows, schema).select("i", F.expr(to_spark(rules.VERDICT)).alias("v")).collect()
    assert [r.v for r in sorted(found)] == [v for _, _, v in cases]


def test_holdout_cuts(spark):
    rows = [(n, i) for n in (1, 2, 3, 4, 5, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int")
    for least, expected in ((3, {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 10: 2}), (1, {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 2})):
        found = corpus.holdout_split(df, ["k"], corpus.draw(F.col("i").cast("string")), "i", least).groupBy("k").agg(F.count_if(F.col("part") == "test").alias("n")).collect()
        assert {r.k: r.n for r in found} == expected


def test_nearest_rank(spark):
    rows = [(n, i) for n in (1, 19, 20, 21, 100) for i in range(n)]
    found = corpus.nearest_rank(spark.createDataFrame(rows, "k int, v int"), "k", "v", "v").collect()
    assert {r.k: r.p95 for r in found} == {n: min(95 * n // 100, n - 1) for n in (1, 19, 20, 21, 100)}


def test_pack_drops_the_tail(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5])], "k int, ids array<int>")
    assert [r.ids for r in corpus.packed_rows(df, "k", "ids", 2).orderBy("row").collect()] == [[1, 2], [3, 4]]


def test_skyline_keeps_ties(spark):
    points = [("a", 9, 5.0), ("b", 9, 5.0), ("c", 9, 6.0), ("d", 8, 5.0), ("e", 7, 1.0)]
    found = corpus.skyline(spark.createDataFrame(points, "n string, q int, ms double"), "q", "ms").collect()
    assert {r.n for r in found} == {"a", "b", "e"}
    assert corpus.skyline(spark.createDataFrame(points[:1], "n string, q int, ms double"), "q", "ms").count() == 1


def test_leaks_and_samples(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, t string")
    assert {r.i for r in corpus.drop_leaks(rows, rows.where("i = 1"), "t").collect()} == {2, 3}
    assert corpus.reject_sample(rows, F.col("i") > 1, 1, F.col("i")).first().i == 2
    with pytest.raises(ValueError):
        corpus.reject_sample(rows, F.col("i") > 9, 1, F.col("i"))


def test_merges_and_round_trip(spark):
    pieces = spark.createDataFrame([("aaab", 3), ("ab", 2), ("c", 9)], "piece string, n long")
    assert tokens.train(pieces, 3) == [(97, 97, 6), (97, 98, 5), (256, 257, 3)]
    coder = tokens.RankedMerges([(116, 104), (256, 101), (32, 257)])
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("the é日x ") for _ in range(12))
        assert coder.decode(coder.encode(text.encode().decode("latin-1"))) == text
    assert coder.encode(" the") == [258]
    docs = spark.createDataFrame([(1, "the the"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in tokens.encode_documents(docs, [(116, 104), (256, 101)]).collect()} == {1: [257, 32, 257], 2: []}


def test_special_tokens_match_longest_first(spark):
    coder = tokens.RankedMerges([(97, 98)], ["<s>", "<s><end", "<end"])
    assert coder.encode_text("ab<s><end<s>é<end") == [259, 257, 256, 0xC3, 0xA9, 258]
    assert coder.plain("<s>") == [60, 115, 62] and coder.encode_text("") == []
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["ab", " ", "é", "<s>", "<end", "<", "s>"]) for _ in range(9))
        assert coder.decode(coder.encode_text(text)) == text and coder.decode(coder.plain(text)) == text
    docs = spark.createDataFrame([(1, "<s>ab<s><end"), (2, None)], "doc_id long, text string")
    assert {x.doc_id: x.ids for x in tokens.encode_documents(docs, [(97, 98)], ["<s>", "<s><end", "<end"]).collect()} == {1: [256, 259, 257], 2: []}


def test_history_evicts_the_oldest():
    history = ()
    for size in (90, 3, 3, 4):
        history = sessions.remembered(history, size)
    assert history == (3, 3, 4)
    for _ in range(30):
        history = sessions.remembered(history, 1)
    assert len(history) == sessions.TURNS
    assert sessions.remembered((1,), sessions.BYTES + 1) == ()


def test_transport_waits_for_a_predicate_or_a_deadline():
    from quarry.streaming import transport

    now = [0.0]
    time = {"clock": lambda: now[0], "pause": lambda s: now.__setitem__(0, now[0] + s)}
    events = list(transport.run_cases(transport.InProcess(), ["fan=2", "heat=1", "win=1", "/reset"], **time))
    assert [e["event"] for e in events] == ["ok", "ok", "heater_window", "reset"] and events[1]["fan"] == 2

    class Silent:
        def send(self, line):
            pass

        def poll(self):
            return None

    assert transport.read_until(Silent(), lambda e: True, 2, **time) == ([], False) and now[0] >= 2
    with pytest.raises(TimeoutError):
        list(transport.run_cases(Silent(), ["x"], **time))
    quick = transport.InProcess()
    quick.send("hi")
    assert transport.read_until(quick, lambda e: e["event"] == "chat", 1, **time)[1]


def test_places_come_from_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    found = {x.i: (x["__r"], x["__n"]) for x in corpus.numbered(df, ["k"], [F.col("v").desc(), F.col("i")]).collect()}
    for k in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[2], x[1]))
        assert all(found[x[1]] == (p, len(mine)) for p, x in enumerate(mine, 1))
    assert corpus.numbered(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_datasets_have_no_leaks(spark):
    docs = spark.createDataFrame([(i, f"  words of text {i // 2} and more" if i % 3 else f"WORDS of text {i // 2} and more") for i in range(600)] + [(900, None), (901, " ")], "doc_id long, text string")
    found = corpus.build_dataset(docs, F.lit(True), {"val": 200, "test": 300}, "s|").collect()
    text = {r.doc_id: r.text.strip().lower() for r in docs.collect() if r.text}
    train = {text[r.doc_id] for r in found if r.split == "train"}
    assert train and {r.split for r in found} == {"train", "val", "test"} and not any(text[r.doc_id] in train for r in found if r.split != "train")
    for split in ("train", "val", "test"):
        places = sorted(r.place for r in found if r.split == split)
        assert places == list(range(1, len(places) + 1))


@pytest.mark.parametrize("name", ["ord_frontier_first", "join_piece_id", "win_holdout_split", "win_head_split", "ord_seeded_shuffle", "agg_p95_nearest", "ext_rank_orders", "win_pack_rows", "win_budget_stop", "join_pareto", "gen_dataset_build"])
def test_plans_have_no_pairs_and_no_single_task(spark, name):
    """No nested loop; and only tables of one row a range go to one task."""
    from quarry import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange SinglePartition") <= 1 or name in ("join_pareto", "ord_frontier_first")


def test_scored_pieces():
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], (" ", -9.0), ("a", -9.0), ("b", -9.0), (" a", -2.0), ("ab", -1.0), (" ab", -3.0)]
    coder = tokens.ScoredPieces(pieces)
    assert [pieces[i][0] for i in coder.encode("ab")] == [" ab"]
    assert coder.decode(coder.encode("abé")) == "abé" and coder.encode("") == []


def test_model_file(spark, tmp_path):
    r = np.random.default_rng(0)
    x = r.normal(size=(4, 64)).astype(np.float32)
    blob = model_blob.dump({"f": (0, x), "q": (1, x), "n": (2, x), "odd": (2, x[:, :33])})
    loaded = model_blob.load(blob)
    assert np.array_equal(loaded["f"][1], x) and loaded["odd"][0] == 1
    assert np.abs(loaded["q"][1] - x).max() < 0.02 and np.abs(loaded["n"][1] - x).max() < 0.3
    (tmp_path / "m.qmod").write_bytes(blob)
    assert model_blob.scan(spark, str(tmp_path)).count() == 16
    assert model_blob.check(model_blob.dump({}, b"words"))[0] == b"words" and model_blob.load(model_blob.dump({"z": (1, np.zeros((2, 3)))}))["z"][1].tolist() == [[0] * 3] * 2
    # 4-bit: the even column in the low half of a byte, seven the largest
    part = model_blob.load(model_blob.dump({"n": (2, np.arange(-7, 25)[None] % 8 - 1.0)}))["n"][1]
    assert np.abs(part - (np.arange(-7, 25) % 8 - 1.0)).max() < 0.5
    fix = lambda b: b[:12] + struct.pack("<I", zlib.crc32(b[20:])) + b[16:]
    for bad, why in [(b"", "size"), (b"X" + blob[1:], "magic"), (blob[:4] + b"\3" + blob[5:], "version"), (blob[:-1] + b"!", "checksum"), (fix(blob[:24]), "table"), (fix(blob[:52] + b"\7" + blob[53:]), "tensor"), (fix(blob[:-40]), "tensor")]:
        with pytest.raises(ValueError, match=why):
            model_blob.load(bad)


def test_sessions_never_heat_with_an_open_window(spark):
    r = random.Random(4)
    lines = [(s, i, r.choice(["fan=2", "HEAT=1", " win=1 ", "heat=0", "win=0", "hi", "/reset", "/kv-reset", "", "x" * 300, "fan=9"])) for s in range(5) for i in range(60)]
    df = spark.createDataFrame(lines, "session long, seq long, line string")
    rows = sessions.batch(df).collect()
    assert len(rows) == 300 and not any(x.heat and x.win for x in rows) and max(x.kept for x in rows) <= 16
    assert {x.event for x in rows} >= {"ok", "chat", "reset", "forgotten", "rejected", "heater_window"}


def test_stream_is_the_batch(spark, tmp_path):
    lines = [(s, i, ["fan=2", "heat=1", "win=1", "/reset"][(s + i) % 4]) for s in range(4) for i in range(20)]
    df = spark.createDataFrame(lines, "session long, seq long, line string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = sessions.stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    assert sorted(sessions.run_available(stream, str(tmp_path)).collect()) == sorted(sessions.batch(df).collect())


def test_dialects():
    assert to_duckdb("transform(x, v -> v div 2)") == "list_transform(x, lambda v: v // 2)"
    assert to_spark(r"regexp_like(a, '\d')") == r"regexp_like(a, '\\d')"


def test_column_functions(spark):
    from quarry.functions import columns as C

    texts = ["the cat", "other", "The", "the3", "Kelvin", "  3) Hello 'x' ", "ninety-nine and one hundred and five of a hundred", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(C.has_word(t, "the").alias("w"), C.has_word(t, "the", True).alias("b"), C.lower_ascii(t).alias("l"), C.clean_line(t).alias("c"), C.number_words_to_digits()(t).alias("n")).collect()
    assert [r.w for r in rows] == [True, False, True, True, False, False, False, None] and rows[3].b is False
    assert rows[4].l == "Kelvin" and rows[5].c == "hello 'x" and rows[6].n == "99 and 105 of 100" and rows[7].n is None
    assert spark.range(1).select(C.numbers_grounded(F.lit("at 3"), F.lit("36")).alias("g")).first().g


def test_decoder_and_sampling(spark):
    from quarry.operators import model

    r = np.random.default_rng(1)
    d, v = 8, 11
    w = {"embed": r.normal(size=(v, d)), "norm": np.ones(d)}
    for i in range(2):
        w |= {f"{i}.norm1": np.ones(d), f"{i}.norm2": np.ones(d), f"{i}.q": r.normal(size=(d, d)), f"{i}.k": r.normal(size=(4, d)), f"{i}.v": r.normal(size=(4, d)), f"{i}.o": r.normal(size=(d, d)), f"{i}.gate": r.normal(size=(12, d)), f"{i}.up": r.normal(size=(12, d)), f"{i}.down": r.normal(size=(d, 12))}
    m = model.Decoder(w, 4, 2, 16)
    one = m.generate([1, 2, 3], set(), 5)
    assert one == m.generate([1, 2, 3], set(), 5) and len(one) == 5 and len(m.generate([1] * 14, set(), 9)) == 2 and m.generate([1, 2, 3], {one[0]}, 5) == one[:1]
    found = model.generated(spark.createDataFrame([(1, [1, 2, 3]), (2, None)], "id long, prompt_ids array<int>"), w, 4, 2, 16, set(), 5).collect()
    assert {x.id: x.ids for x in found} == {1: one, 2: []}
    assert model.sample(np.array([1.0, 3.0, 3.0]), [], model.Draws(1)) == 1 and model.sample(np.array([1.0, 3.0, 2.9]), [1, 1], model.Draws(1), penalty=1.5) == 2
    picks = {model.sample(np.array([5.0, 5.0, 5.0, -9.0]), [], draws, 1.0, 2) for draws in [model.Draws(7)] for _ in range(200)}
    assert picks == {0, 1, 2}


def test_tokenizer_blobs():
    from quarry.sources import tokenizer_blob as B

    assert B.load(B.dump_merges(["<a>", "é"], [(1, 2), (300, 4)])) == (1, ["<a>", "é"], [(1, 2), (300, 4)])
    assert B.load(B.dump_pieces([(b"ab", 1.5), (b"", -2.0)])) == (2, [], [(b"ab", 1.5), (b"", -2.0)])
    for bad, why in [(b"nope", "magic"), (B.dump_pieces([(b"a", 1.0)])[:10], "size"), (b"QTOK" + struct.pack("<I", 9), "version")]:
        with pytest.raises(ValueError, match=why):
            B.load(bad)
    flat = np.arange(3 * 4 + (4 + 16 + 8 + 8 + 16 + 4 + 24 + 24 + 24) + 4, dtype="<f4")
    size, x = B.load_checkpoint(struct.pack("<7i", 4, 6, 1, 2, 1, 3, 8) + flat.tobytes())
    assert size["vocab"] == 3 and x["norm"].tolist() == flat[-4:].tolist() and x["0.up"].shape == (6, 4)
    with pytest.raises(ValueError, match="shared"):
        B.load_checkpoint(struct.pack("<7i", 4, 6, 1, 2, 1, -3, 8))
