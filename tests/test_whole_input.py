"""Queries cover whole tables and whole texts: small folders of our own against brute force."""

from collections import Counter

import pytest

from quarry import registry


@pytest.fixture
def asked(spark, tmp_path):
    # a text with the macro of that name names the table, too
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")

    def run(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return registry.QUERIES[name](spark, str(tmp_path)).collect()

    return run


DOCS = "doc_id long, text string, lang string"


def test_pair_counts_cover_all_documents(asked):
    rows = [(i, "abc " * i + "zq", "en") for i in range(1, 8)]
    words = Counter(w for _, t, _ in rows for w in t.split(" ") if w)
    pairs = Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:]):
            pairs[a, b] += n
    assert {(r.a, r.b): r.n for r in asked("agg_pair_counts", "documents", rows, DOCS)} == pairs
    assert [(r.a, r.b, r.n) for r in asked("agg_argmax_tiebreak", "documents", rows, DOCS)] == sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda x: (-x[2], x[:2]))


LONG = [(1, "Alpha beta=2  gamma.\n" * 40 + "last|one é", "en"), (2, "l'été " * 90 + "fin  ", "fr"), (3, "x", "de"), (4, "", "en"), (5, None, "en")]


def brute_pieces(text):
    import re

    return re.findall(r" +\Z| +(?= [^ ])| ?[A-Za-z]+=?| ?[^ ]", (text or "").encode().decode("latin-1"), re.S)


def test_pretokens_of_whole_texts(asked):
    assert {r.doc_id: r.pieces for r in asked("fn_pretokenize", "documents", LONG, DOCS)} == {i: "|".join(brute_pieces(t)) for i, t, _ in LONG}
    found = sorted((r.doc_id, r.at, r.piece) for r in asked("udtf_tokens", "documents", LONG, DOCS))
    assert found == [(i, k, p) for i, t, _ in LONG for k, p in enumerate(brute_pieces(t))]
    assert {r.piece: r.n for r in asked("agg_pretoken_freq", "documents", LONG, DOCS)} == Counter(p for _, t, _ in LONG for p in brute_pieces(t))


def brute_scored(coder, text):
    ids = []
    for c in " " + text if text else "":
        ids += [coder.place[c]] if c in coder.place else [b + 3 for b in c.encode()]
    while True:
        joint = [(coder.place.get(coder.pieces[a][0] + coder.pieces[b][0]), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        joint = [(-coder.pieces[j][1], i, j) for j, i in joint if j is not None]
        if not joint:
            return ids
        _, i, j = min(joint)
        ids[i : i + 2] = [j]


def test_scored_encode_of_whole_turns(asked):
    from quarry.operators import tokens

    letters = " etaonihsrdlucmfwypvbgkjqxz"
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((c, -20.0) for c in letters), *((p, -float(i)) for i, p in enumerate(["th", "the", " the", "an", "er", " a", "on", "re"], 1))]
    rows = [(1, 0, "the other weather on the anthem " * 12), (1, 1, "É the"), (2, 0, ""), (2, 1, None)]
    found = {(r.conv_id, r.turn): r.ids for r in asked("fn_scored_encode", "conversations", rows, "conv_id long, turn int, text string")}
    assert found == {(c, t): brute_scored(tokens.ScoredPieces(pieces), x or "") for c, t, x in rows}


def test_scored_pieces_merge_as_before():
    import random

    from quarry.operators import tokens

    r = random.Random(2)
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((c, -9.0) for c in " ab"), *((p, float(r.randrange(3))) for p in ["aa", "ab", "ba", "aab", "aba", "aaaa", " a", "bb", "abab"])]
    coder = tokens.ScoredPieces(pieces)
    for _ in range(300):
        text = "".join(r.choice("aabb é") for _ in range(r.randrange(40)))
        assert coder.encode(text) == brute_scored(coder, text)


def test_stops_and_steps_of_all_events(asked):
    # of 6000 events in two runs, the first rises from step 2500, the second falls to the end
    rows = [(i, ("a", "b")[i % 2], float(-(i // 2) if i % 2 or i < 5000 else i)) for i in range(6000)]
    schema = "event_id long, event_type string, value double"
    assert [(r.run, r.stopped) for r in asked("win_early_stop", "events", rows, schema)] == [("a", 2508)]
    expected = {(x, s) for x in "ab" for s in range(1, 3001) if (s + 1) % 50 == 0 or s == 3000}
    assert {(r.run, r.step) for r in asked("win_every_n", "events", rows, schema)} == expected


def test_merge_ranks_of_whole_documents(asked):
    rows = [(1, "x" * 70 + "anth", "en"), (2, "th" * 100, "en"), (3, "t", "en"), (4, "", "en"), (5, None, "en"), (6, "xx", "en")]
    found = {r.doc_id: (r.best, r.pairs) for r in asked("join_merge_rank", "documents", rows, DOCS)}
    assert found == {1: (0, 2), 2: (0, 100)}


def test_prefixes_of_whole_documents(asked):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(0, text, "en"), (30, text, "en"), (59, text, "en")]
    cut = lambda d: text[: len(text) * (20 + d % 60) // 60].split(" ")
    expected = {d: 399 if cut(d) == text.split(" ") else sum(a == b for a, b in zip(cut(d), text.split(" "))) for d, _, _ in rows}
    assert {r.doc_id: r.reused for r in asked("fn_common_prefix", "documents", rows, DOCS)} == expected and expected[0] > 100


def test_lines_of_whole_documents(asked):
    rows = [(3, "- First " + "long " * 30 + "END\n* Second \n3", "en"), (7, "4) Autre", "fr")]
    found = sorted((r.doc_id, r.line) for r in asked("fn_clean_line", "documents", rows, DOCS))
    assert found == sorted([(3, "first " + "long " * 30 + "end"), (3, "second"), (3, "3"), (7, "autre")])


def test_prompts_and_lines_of_whole_turns(asked):
    rows = [(1, 0, "user", "word " * 20 + "last"), (1, 1, "bot", "<act>" + "x" * 50)]
    schema = "conv_id long, turn int, role string, text string"
    assert [r.prompt for r in asked("fn_prompt_layout", "conversations", rows, schema)] == [f"<bos><user> {rows[0][3]},<bot>{rows[1][3]}<bot>"]
    assert all(t in r.line for (_, _, _, t), r in zip(rows, sorted(asked("fn_decorate", "conversations", rows, schema), key=lambda r: r.turn)))


def vectors(n, seed=0):
    import random

    r = random.Random(seed)
    return [(i, i % 3, [r.randrange(-40, 41) / 8 for _ in range(64)]) for i in range(n)]


VECTORS = "vec_id long, label int, embedding array<float>"


def test_every_group_of_a_vector_is_packed(asked):
    rows = vectors(5)
    peak = {(i, g + 1): max(map(abs, x[32 * g : 32 * g + 32])) for i, _, x in rows for g in range(2)}
    assert {(r.vec_id, r.grp): r.absmax for r in asked("agg_group_absmax", "embeddings", rows, VECTORS)} == {k: round(v, 6) for k, v in peak.items()}
    found = {(r.vec_id, r.grp): (r.scale, r.packed) for r in asked("vec_q4_pack", "embeddings", rows, VECTORS)}
    expected = {}
    for i, _, x in rows:
        for g in range(2):
            scale = peak[i, g + 1] / 7
            n = [max(-7, min(7, round(v / scale))) + 8 for v in x[32 * g : 32 * g + 32]]
            expected[i, g + 1] = round(scale, 9), ",".join(str(a + 16 * b) for a, b in zip(n[::2], n[1::2]))
    assert found == expected


def test_attention_uses_all_dimensions(asked):
    import math

    rows = vectors(20)
    x = {i: v for i, _, v in rows}
    expected = {}
    for q in x:
        for h in range(8):
            # two query heads share a key head, whose values are four heads on
            head, shared = slice(8 * h, 8 * h + 8), slice(8 * (h // 2), 8 * (h // 2) + 8)
            keys = [k for k in x if k // 16 == q // 16 and k <= q]
            w = [math.exp(sum(a * b for a, b in zip(x[q][head], x[k][shared])) / math.sqrt(8)) for k in keys]
            for d in range(8):
                expected[q, h + 1, d + 1] = sum(a * x[k][8 * (h // 2 + 4) + d] for a, k in zip(w, keys)) / sum(w)
    found = {(r.q_id, r.head, r.dim): r.y for r in asked("vec_causal_attention", "embeddings", rows, VECTORS)}
    assert found == pytest.approx(expected, abs=2e-6)
