"""The ten operators against brute force on small tables with nulls, ties, repeated rows and very long texts."""

import hashlib
import itertools
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import bpe, components, lines, ogg, packing, quality, simhash, substrings, token_files, toxicity, warc
from quarry.llm.shared import ChunkEncoder, shared_path, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, line string, fp long, g string, weight int, digest string"
SF = "/root/testdata/sf0.001"


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 7)))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", ". ", "\n", "\t", "  "]) for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    notice = "This very line stands in many documents of this corpus."
    docs: list[tuple[int | None, str | None]] = [(i, text(r.randint(1, 200))) for i in range(60)]
    docs += [(100 + i, text(40) + passage + " " + text(40)) for i in range(4)]
    docs += [(200 + i, f"{text(20)}\n  {notice.upper() if i % 2 else notice}\t\n{text(5)}") for i in range(7)]
    docs += [(300 + i, docs[3][1]) for i in range(3)] + [(310, docs[60][1]), (311, docs[60][1] + " end")]
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, "x " * 90), (404, "a b c a b c a b c"), (405, text(30_000)), (406, "É ñ ß İ Σς 日本語 \x1c\x85 x <|endoftext|>it's 12%|##"), (None, docs[61][1]), (None, "lost"), (5, docs[5][1]), (6, text(50)), (407, "one\n\none\n\r\none")]
    docs += [(500 + i, (docs[7][1] or "").replace("a", "e", i)) for i in range(6)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def frame(spark, rows):
    filled = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", len(t or ""), "h", "l", 7, "g", 3, "d") for i, t in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def words_of(text):
    return (text or "").encode().split()


# 1


def base_of(text):
    text = text or ""
    words = [w.decode() for w in words_of(text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 3)}
    held = [x for x in text.split("\n") if x.encode().split()]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(held) - len(set(held)), len(covered), failed


def test_base_counts(docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(quality.judged(docs), *names) == sorted(((i, *base_of(t)) for i, t in corpus()), key=key)


def nearest(d):
    """The rows of the least buckets of 1/64 up to three quarters."""
    q = np.minimum(np.floor(d * 64), quality.TOP)
    below = np.array([(q < v).sum() for v in q])
    return 4 * below < 3 * len(q)


def estimate(x):
    c = np.cov(x.T, bias=True) + np.eye(quality.P) * quality.FLOOR**2
    return x.mean(0), c, np.linalg.det(c)


def distance(x, mean, c):
    return ((x - mean) @ np.linalg.inv(c) * (x - mean)).sum(1)


def concentrated(x, d, steps):
    for _ in range(steps):
        e = estimate(x[nearest(d)])
        d = distance(x, *e[:2])
    return e, d


def mcd_brute(x):
    """The scaled distances of one group as quality.py describes them, in numpy."""
    x = (x - np.floor(np.median(x, 0))) / quality.SCALE
    z = (x / (1.4826 * np.median(np.abs(x), 0) + quality.FLOOR)) ** 2
    found = [concentrated(x, d, quality.STEPS) for d in (z.sum(1), *z.T)]
    # the two that have the least determinant after two steps go on
    first = sorted(range(len(found)), key=lambda k: concentrated(x, (z.sum(1), *z.T)[k], quality.FIRST_STEPS)[0][2])[: quality.STARTS_KEPT]
    e, d = min((found[k] for k in first), key=lambda f: f[0][2])
    return d * quality.CHI2_THREE_QUARTERS / (np.floor(d[nearest(d)].max() * 64) / 64)


def drawn(seed, n=150):
    """Rows with a cluster of outliers and a heavy tail."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.5, (n, quality.P)) @ r.normal(0, 1, (quality.P, quality.P))
    x[: n // 5] = x[: n // 5] * 0.2 + r.normal(0, 4, quality.P)
    return np.round(x * quality.SCALE).astype(int)


def test_estimates_have_the_least_determinant(spark):
    """Against the best of many starts from random subsets, by group."""
    xs = {f"g{k}": drawn(k) for k in range(4)}
    rows = [(i, g, *map(int, v - np.floor(np.median(x, 0)))) for g, x in xs.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, g string, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    found = {r["g"]: r["det"] ** 2 for r in quality.mcd_estimates(df).collect()}
    r = np.random.default_rng(1)
    for g, x in xs.items():
        x = x / quality.SCALE
        best = min(concentrated(x, distance(x, *estimate(x[r.choice(len(x), quality.P + 1, False)])[:2]), 12)[0][2] for _ in range(60))
        assert found[g] <= 1.05 * best, g


def test_mcd_finds_outliers(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(0, 0.5, (300, quality.P)) * quality.SCALE).astype(int)
    x[:20] += 8 * quality.SCALE
    rows = [(i, f"g{i % 2}", *map(int, v)) for i, v in enumerate(x)] + [(1000 + i, "small", *[0] * quality.P) for i in range(5)]
    df = spark.createDataFrame(rows, "key long, g string, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    found = {r["key"]: r["d2"] for r in quality.mcd_distances(df).collect()}
    assert set(found) == set(range(300))
    for g in range(2):
        mine = np.arange(g, 300, 2)
        assert np.allclose([found[i] for i in mine], mcd_brute(x[mine]), rtol=1e-2, atol=0.05)
    assert all(found[i] > quality.CUTOFF for i in range(20)) and sum(d > quality.CUTOFF for d in found.values()) == 20


def test_quality_without_rows(empty):
    assert quality.judged(empty).count() == 0


# 2


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=key)


def test_near_duplicates(docs):
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == brute_components(corpus())


def test_links_of_planted_fingerprints(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for v in list(values):
        for k in range(1, 5):
            x = v
            for b in r.sample(range(64), k):
                x ^= 1 << b
            values.add(x)
    base = r.getrandbits(64)
    values |= {base ^ (1 << b) for b in range(64)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {r["node"]: r["root"] for r in components.connected_components(simhash.links(df)).collect()}
    root = {v: v for v in signed.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(signed.items(), 2):
        if (a[0] ^ b[0]).bit_count() <= 2:
            x, y = sorted((find(a[1]), find(b[1])))
            root[y] = x
    assert {v: found.get(v, v) for v in root} == {v: find(v) for v in root}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_simhash_without_rows(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs):
    least = {(d, c) for d, _, c in brute_components([x for x in corpus() if x[0] is not None])}
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {d for d, c in least if d == c} - {d for d, c in least if d != c} | {None}


# 3


def toxic_rows(n):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice("tin oak sun map rug fog hill barn".split()) for _ in range(8)) + "." for _ in range(r.randint(1, 9))]
        bad = i % 3 == 0
        if bad:
            sentences[r.randrange(len(sentences))] += f" you grob{r.choice(['a', 'en', 'ist'])} fool."
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_rows(400)
    docs = frame(spark, [*rows, (None, "x"), (900, None), (901, "")])
    label = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, label)
    found = toxicity.scored(docs, model).collect()
    assert len(found) == 403 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    at = next(i for i, y in labels if y)
    assert any("fool" in s for _, s, _ in model.locate(rows[at][1]))
    kept = toxicity.clean(docs, label)
    assert kept.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in kept.collect()}


def test_toxicity_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(empty, none)
    assert model.constant == 0.0 and toxicity.scored(empty, model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.scored(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in found}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03


# 4


def brute_removed(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [35, 12])
def test_repeated_windows(docs, window):
    assert rows_of(substrings.removed(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removed(corpus(), window)


def test_repeats_within_a_text(spark):
    rows = [(1, "a b " * 40), (2, " ".join(map(str, range(50))) + " . " + " ".join(map(str, range(50)))), (3, "z " * 35), (4, "z " * 34)]
    assert rows_of(substrings.removed(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removed(rows, 35)


def test_substrings_keep_columns(docs, empty):
    cut = substrings.clean(docs)
    assert cut.columns == docs.columns and cut.count() == len(corpus())
    kept = sorted((d, hashlib.sha256(b" ".join(words_of(t))).hexdigest()) for d, t in cut.select("doc_id", "text").collect() if d is not None)
    assert kept == sorted((d, s) for d, _, _, s in brute_removed(corpus(), 35) if d is not None)
    assert substrings.removed(empty).count() == 0


# 5


def test_codec_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    r = random.Random(2)
    texts = [t or "" for _, t in corpus()] + ["".join(r.choice("abcxyzABC éß'sñ1.!́ 日<|>") for _ in range(300)) for _ in range(200)]
    texts += ["<|startoftext|>A<|endoftext|> b<|endoftext", "é É", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 20_000, "don't WE'LL 's"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == ids, t[:80]
        assert codec.decode(codec.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)


def test_encoded_documents(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = sorted(((d, *(lambda ids: (len(ids), library.decode(ids, skip_special_tokens=False)))(library.encode(t or "", add_special_tokens=False).ids)) for d, t in corpus()), key=key)
    found = sorted(((r[0], len(r[1]), r[2]) for r in bpe.encoded(docs, tokenizer_path("word_bpe_49k.json")).collect()), key=key)
    assert found == expected and bpe.encoded(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize(("name", "style"), [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "leading")])
def test_chunks_are_the_library(name, style):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    library, encoder = Tokenizer.from_file(path), ChunkEncoder(path, style, 50)
    r = random.Random(4)
    texts = [t or "" for _, t in corpus()] + ["".join(r.choice("ab  \n\t\r1.'s \x1c\x85é<|endoftext|>") for _ in range(60)) for _ in range(500)]
    texts += ["", " ", "  ", "a ", " a", "a \n", "a\n b", "a\n  b", "a \n ", "<|endoftext|> a <|endoftext|>"]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_every_code_point_is_the_librarys():
    """Alone before a mark, and beside a letter."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(letters), 20_000):
        for texts in ([c + "!" for c in letters[i : i + 20_000]], ["a" + c for c in letters[i : i + 20_000]]):
            for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
                assert codec.encode(t).tolist() == e.ids, hex(max(map(ord, t)))
    r = random.Random(3)
    for _ in range(2000):  # characters that Python does not know among others
        t = "".join(r.choice(["a", "B", " ", "\u0301", "'s", "1", "<|endoftext|>", "\u1c89", "\ua7cb", "\u0c5c", chr(0x31350), "\u0378", "\u208f", "\u00e9", "\u3000"]) for _ in range(12))
        assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


# 6


def brute_lines(rows, least=40, most=5):
    norm = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(norm(x)) >= least:
                    held.setdefault(norm(x), set()).add(d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if d is None or len(norm(x)) < least or len(held[norm(x)]) < most or max(held[norm(x)]) == d]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


def test_common_lines(spark, docs, empty, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(lines.query(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(corpus())
    cut = lines.clean(docs)
    assert cut.columns == docs.columns and cut.where("n_chars <> char_length(text)").count() == 0
    assert lines.clean(empty).count() == 0


# 7


def test_ogg_round_trip():
    for n in (0, 1, 191, 192, 4096, 65_025, 300_001):
        data = random.Random(n).randbytes(n)
        payload, m, feature = ogg.read_payload(ogg.store(data))
        assert m == n and payload[:n] == data and set(payload[n:]) <= {32} and len(payload) % 192 == 0 and payload
        assert f"duration_us={len(payload) * 125}" in feature


def test_ogg_packets_across_pages():
    packets = [(b"head", 0), (b"a" * 255, 1), (b"", 1), (b"b" * 200_000, 5), (b"c" * 510, 9), (b"d", 10)]
    streams, errors = ogg.read(b"".join(ogg.pages(9, packets)))
    assert not errors and [p for p, _, _ in streams[9].packets] == [p for p, _ in packets]
    assert streams[9].granule == 10 and streams[9].ended


def test_ogg_damage():
    media = ogg.store(bytes(range(256)) * 900)
    at = len(media) // 2
    streams, errors = ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    assert errors and any("bad page" in e for e in errors)
    assert 0 < sum(len(p) for p, _, _ in streams[ogg.AUDIO].packets) < 230_400
    assert ogg.read(b"not ogg") == ({}, ["no page at 0"])
    assert ogg.read(b"") == ({}, [])
    # the check value of CRC-32 with this polynomial, not mirrored, from zero
    assert ogg.checksum(b"123456789") == 0x89A1897F


def test_ogg_times():
    # three packets on one page: its granule position is the last one's, the others are counted back
    packets = [(ogg.AUDIO_HEAD + struct.pack("<II", 8000, 1), 0), (b"a" * 10, 10), (b"b" * 20, 30), (b"c" * 5, 35)]
    note = [(ogg.NOTE_HEAD, 0), (b"12345678", 0)]
    streams, errors = ogg.read(b"".join([*ogg.pages(1, packets), *ogg.pages(2, note)]))
    assert not errors and ogg.timed(streams[1]) == [0, 10, 30, 35] and [g for _, g, _ in streams[1].packets] == [0, -1, -1, 35]
    assert ogg.timed(streams[2]) == [0, 0]
    # a page that should continue a packet but does not: the open packet goes, and that is said
    pages = list(ogg.pages(3, [(b"h", 0), (b"x" * 70_000, 1), (b"y", 2)]))
    flags = pages[2][:5] + bytes([pages[2][5] & ~ogg.CONTINUED]) + pages[2][6:22] + b"\0" * 4 + pages[2][26:]
    pages[2] = flags[:22] + struct.pack("<I", ogg.checksum(flags)) + flags[26:]
    streams, errors = ogg.read(b"".join(pages))
    assert errors == ["stream 3: page 2 does not continue a packet"] and [len(p) for p, _, _ in streams[3].packets] != [1, 70_000, 1]


def test_media_columns(docs, empty):
    media = ogg.media_column(docs)
    found = {(r["doc_id"], r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in ogg.media_features(media).collect()}

    def expected(t):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        return hashlib.sha256(payload).hexdigest(), len(data), zlib.crc32(payload[-16:])

    assert found == {(d, *expected(t)) for d, t in corpus()}
    times = ogg.media_packets(media)
    assert times.where("time_us < 0").count() == 0 and times.where(f"time_us is null and serial = {ogg.AUDIO}").count() == 0
    assert times.where(f"time_us is not null and serial = {ogg.NOTE}").count() == 0
    assert ogg.media_features(ogg.media_column(empty)).count() == 0


# 8


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    folder = shared_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), "space", 1, folder, length=64)
    expected, start = [], 0
    for d, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert rows_of(token_files.read_token_files(manifest, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=key)
    nothing = token_files.write_token_files(empty, tokenizer_path("word_bpe_49k.json"), "space", 1, folder)
    assert token_files.read_token_files(nothing, folder).count() == 0


def test_ids_that_do_not_fit_are_an_error(tmp_path):
    writer = token_files.ShardWriter(f"file://{tmp_path}", 16, "uint16")
    writer.add(1, np.array([0, 65535], np.uint32))
    with pytest.raises(ValueError, match="65536"):
        writer.add(2, np.array([65536], np.uint32))


def test_token_files_are_fixed_size_lists(spark, docs):
    import pyarrow as pa

    folder = shared_path(spark, "test-lists")
    manifest = token_files.write_token_files(docs.limit(20), tokenizer_path("word_bpe_49k.json"), "space", 1, folder, length=64)
    for _, base, total in manifest.collect():
        with pa.memory_map(f"{base}.ids") as source:
            file = pa.ipc.open_file(source)
            batches = [file.get_batch(i) for i in range(file.num_record_batches)]
            assert file.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            assert sum(sum(map(sum, b.column(1).to_pylist())) for b in batches) == total


def test_sequences_are_slices_of_the_file(spark, docs):
    folder = shared_path(spark, "test-sequences")
    manifest = token_files.write_token_files(docs, tokenizer_path("word_bpe_49k.json"), "space", 1, folder, length=64).collect()
    files = token_files.TokenFiles(manifest, folder, length=64)
    at = 0
    for _, base, total in sorted(map(tuple, manifest)):
        whole = np.concatenate([x for _, _, x in token_files.read_shard(folder, base)])
        assert len(whole) == total
        shard = token_files.Shard(folder, base)
        assert len(shard) == -(-total // 64)
        for k in range(0, len(shard), 7):
            ids, mask = shard.sequence(k)
            n = min(64, total - 64 * k)
            assert ids.to_numpy(zero_copy_only=True)[:n].tolist() == whole[64 * k : 64 * k + n].tolist() and mask.to_pylist() == [True] * n + [False] * (64 - n)
            again = files.sequence(at + k)
            assert again[0].equals(ids) and again[1].equals(mask)
        # both lie in the mapped file: reading it whole gives a buffer around theirs
        shard.source.seek(0)
        all_ = shard.source.read_buffer()
        for part in shard.sequence(len(shard) - 1):
            place = part.buffers()[1].address
            assert all_.address <= place < all_.address + all_.size
        at += len(shard)
    assert at == len(files)
    with pytest.raises(IndexError):
        files.sequence(at)
    assert len(token_files.TokenFiles([], folder)) == 0


# 9


def test_warc_derivatives(spark):
    page = '<html><head><title> A &amp; B </title><style>p{}</style></head><body><p>One<b>two</b></p><!-- x --><script>var t="</p>";</script><ul><li><a href="/q?a=1&amp;b=2">go</a><li><img src=pic.png></ul></body>'
    rows = [(1, "http://a.example/x/y", page, "clash"), (2, None, None, "x"), (3, "http://b.example/", "", "x"), (None, "u", "<p>z", "x"), (1, "http://a.example/x/y", page, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    records = warc.derivatives(warc.responses(pages))
    found = {(r["page_id"], r["kind"]): warc.parse(bytes(r["record"])) for r in records.collect()}
    assert records.count() == 10
    head, block = found[1, "metadata"]
    meta = json.loads(block)
    assert meta["title"] == "A & B" and [x["url"] for x in meta["links"]] == ["http://a.example/q?a=1&b=2", "http://a.example/x/pic.png"]
    conv, text = found[1, "conversion"]
    assert text.decode() == "A & B\nOnetwo\ngo"
    source, _ = warc.parse(warc.response(*rows[0][:3]))
    assert head["WARC-Refers-To"] == conv["WARC-Refers-To"] == source["WARC-Record-ID"] and conv["WARC-Concurrent-To"] == head["WARC-Record-ID"]
    assert conv["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] == warc.digest(page.encode())
    assert found[2, "conversion"][1] == b"" and found[2, "metadata"][0]["WARC-Target-URI"] == "urn:page:2"
    assert warc.listed(records).count() == 10 and warc.derive(b"junk") == [] and warc.derive(warc.response(*rows[0][:3])[:50]) == []
    assert warc.listed(warc.derivatives(warc.responses(pages.limit(0)))).count() == 0


def changed(record, *pairs):
    """A record with parts of its head replaced."""
    raw = zlib.decompress(record, 31)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    for old, new in pairs:
        assert old in head
        head = head.replace(old, new)
    return head + mark + rest


def test_warc_headers():
    whole = warc.response(1, "http://a.example/", "<p>x")
    head, _ = warc.parse(whole)
    for name in ("WARC-Block-Digest", "WARC-Payload-Digest"):
        (_, meta), (_, conv) = warc.derive(changed(whole, (f"{name}: {head[name]}\r\n".encode(), b"")))
        assert f"WARC-Source-{name[5:]}" not in warc.parse(conv)[0] and warc.parse(meta)[0]["WARC-Refers-To"] == head["WARC-Record-ID"]
    for name in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Type"):
        assert warc.derive(changed(whole, (f"{name}: {head[name]}\r\n".encode(), b""))) == []
    assert warc.derive(changed(whole, (b"Content-Length: ", b"Content-Length: x"))) == []
    lower = changed(whole, *((k.encode(), k.lower().encode()) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length")))
    assert warc.derive(lower) == warc.derive(whole)
    evil = warc.response(2, "http://a.example/\r\nWARC-Evil: 1\n x", "")
    head, _ = warc.parse(evil)
    assert "WARC-Evil" not in head and head["WARC-Target-URI"] == "http://a.example/%0D%0AWARC-Evil:%201%0A%20x"
    with pytest.raises(ValueError):
        warc.build([("WARC-Type", "response\r\nX: y")], b"")


def test_warc_codings():
    import gzip

    text = "<p>Gr\u00fc\u00dfe"

    def derived(fields, body):
        block = f"HTTP/1.1 200 OK\r\n{fields}\r\n\r\n".encode() + body
        head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", warc.DATE), ("WARC-Target-URI", "http://a.example/")]
        return warc.parse(warc.derive(warc.build(head, block))[1][1])[1].decode()

    zipped = gzip.compress(text.encode())
    chunks = b"".join(f"{len(c):x};q=1\r\n".encode() + c + b"\r\n" for c in (zipped[:7], zipped[7:])) + b"0\r\n\r\n"
    assert derived("content-type: text/html; charset=ISO-8859-1", text.encode("latin-1")) == text[3:]
    assert derived("Content-Encoding: gzip", zipped) == text[3:]
    assert derived("transfer-encoding: chunked\r\nContent-Encoding: gzip", chunks) == text[3:]
    assert derived("Content-Encoding: deflate", zlib.compress(text.encode())) == text[3:]
    assert derived("Content-Type: text/html; charset=none-such\r\nContent-Encoding: gzip", b"plain") == "plain"


@pytest.mark.parametrize("part", ["<a ", "<", "< ", "<script ", "<script>", "</script ", "<!--", "<a href='", '<a x="', "a=", "<p>", "&amp", "<title>", "<a b" + " " * 50, "<!"])
def test_hostile_pages_are_linear(part):
    import time

    began = time.process_time()
    for page in (part * (1_000_000 // len(part)), part * (1_000_000 // len(part)) + ">"):
        warc.page_of(page, "http://a.example/")
    assert time.process_time() - began < 4


def test_page_parts():
    page = "<!-- <a href=no> --><TITLE>A\n&lt;b</TITLE><script src='s.js'>'<a href=no>'</script >1 < 2<br>x<y z<p>t</p><a\nclass=c HREF = '?q=1&amp;r'>l</a><a name=n>m</a><img alt=\"a > b\" src=i><style>p{}"
    title, links, text = warc.page_of(page, "http://a.example/d/")
    assert title == "A <b" and [x["url"] for x in links] == ["http://a.example/d/s.js", "http://a.example/d/?q=1&r"]
    assert text == 'A <b\n1 < 2\nxt\nlm b" src=i>' and warc.page_of("", "") == (None, [], "")


# 10


def bins_of(patterns, counts, capacity):
    used = Counter()
    for n, f in patterns:
        assert n > 0 and sum(x * k for x, k in f.items()) <= capacity
        for x, k in f.items():
            used[x] += n * k
    assert used == +Counter(counts)
    return sum(n for n, _ in patterns)


def test_bin_completion_is_optimal_on_small_cases():
    def least(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= capacity:
                    go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    r = random.Random(9)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        assert bins_of(packing.bin_completion(dict(Counter(items)), 20), Counter(items), 20) == least(items, 20)


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 7: 2}  # sums to 50: five full bins of ten exist
    assert bins_of(packing.bin_completion(counts, 10), counts, 10) == packing.lower_bound(counts, 10) == 5


def test_packed_documents(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs).collect()
    expected = []
    for d, t in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            expected.append((d, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected, key=key)
    held = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(held) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack_documents(empty).count() == 0
