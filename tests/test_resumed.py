"""Work that goes on where a run stopped, differences of tables, phrases, links, repaired bytes: against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import markdown
from quarry.operators import phrases, runs, tables
from quarry.sources import committed


def counting(path, fail_on=None):
    """A hook that notes each call in a file, since it is called in other processes."""

    def ask(prompt, seed):
        with open(path, "a") as f:
            f.write(f"{prompt}|{seed}\n")
        if prompt == fail_on:
            raise ValueError("no answer")
        return f"{prompt}-{seed}"

    return ask


def calls(path):
    return sorted(path.read_text().split()) if path.exists() else []


def test_a_second_run_asks_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i % 30}", i % 2) for i in range(120)], "id long, prompt string, seed int")
    folder, log = str(tmp_path / "cache"), tmp_path / "log"
    first = runs.answers(rows, folder, counting(log)).collect()
    asked = calls(log)
    assert asked == sorted({f"p{i % 30}|{i % 2}" for i in range(120)}) and not any(r.hit for r in first)
    second = runs.answers(rows, folder, counting(log)).collect()
    assert calls(log) == asked and all(r.hit for r in second)
    assert {(r.id, r.answer) for r in first} == {(r.id, r.answer) for r in second} == {(i, f"p{i % 30}-{i % 2}") for i in range(120)}
    more = runs.answers(rows.union(spark.createDataFrame([(500, "new", 1), (501, "new", 1), (502, "new", 2)], rows.schema)), folder, counting(log)).collect()
    assert len(calls(log)) == len(asked) + 2 and {r.id for r in more if not r.hit} == {500, 501, 502}
    # another model or system prompt is another question
    assert not any(r.hit for r in runs.answers(rows, folder, counting(log), model="other").collect())


def test_a_failed_run_leaves_the_portions_that_were_done(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}", 1) for i in range(64)], "id long, prompt string, seed int")
    folder, log = str(tmp_path / "cache"), tmp_path / "log"
    keys = {r.prompt: r.key for r in rows.select("prompt", runs.cache_key("model", "system").alias("key")).collect()}
    last = max(keys, key=keys.get)  # in the last portion
    with pytest.raises(Exception, match="no answer"):
        runs.answers(rows, folder, counting(log, last)).collect()
    done = [p for p, k in keys.items() if k[0] < "c"]
    log.unlink()
    after = runs.answers(rows, folder, counting(log)).collect()
    assert calls(log) == sorted(f"{p}|1" for p in keys if p not in done) and len(done) > 20
    assert {r.prompt for r in after if r.hit} == set(done) and len(after) == 64
    assert runs.answers(rows.limit(0), folder, counting(log)).count() == 0


def test_an_ended_sweep_goes_on_with_the_rest(spark, tmp_path):
    variants, ran = [{"name": f"v{k}", "k": k} for k in range(6)], []

    def run(v, stop=None):
        if v["name"] == stop:
            raise KeyboardInterrupt
        ran.append(v["name"])
        return spark.range(10).agg(F.sum(F.col("id") * v["k"]).alias("total"))

    whole = sorted(map(tuple, runs.sweep(spark, variants, str(tmp_path / "a"), "total long", run).collect()))
    ran.clear()
    with pytest.raises(KeyboardInterrupt):
        runs.sweep(spark, variants, str(tmp_path / "b"), "total long", lambda v: run(v, "v3"))
    assert ran == ["v0", "v1", "v2"]
    again = runs.sweep(spark, variants, str(tmp_path / "b"), "total long", run)
    assert ran == [f"v{k}" for k in range(6)] and sorted(map(tuple, again.collect())) == whole == sorted((45 * k, f"v{k}") for k in range(6))


def test_a_part_is_committed_once_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert committed.read(spark, folder, "id long, part string").count() == 0 and committed.parts(spark, folder, "part") == []
    assert committed.commit(spark.range(3), folder, "part", "x") and not committed.commit(spark.range(9), folder, "part", "x")
    broken = spark.range(5).select(F.expr("raise_error('stop')").cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        committed.commit(broken, folder, "part", "y")
    assert committed.parts(spark, folder, "part") == ["x"] and committed.read(spark, folder, "id long, part string").count() == 3


def test_differences_of_two_versions(spark):
    r = random.Random(3)
    old = {i: (r.choice(["a", "b", None]), r.choice([1.5, None])) for i in [*range(300), None]}
    new = {i: v for i, v in old.items() if i is None or i % 11}
    new |= {i: ("c", None) for i in range(0, 300, 13) if i % 11} | {i: (None, None) for i in range(900, 905)}
    frame = lambda d: spark.createDataFrame([(i, *v) for i, v in d.items()], "id long, a string, b double")
    expected = {(i, "removed") for i in old if i not in new} | {(i, "added") for i in new if i not in old} | {(i, "changed") for i in old if i in new and old[i] != new[i]}
    for buckets in (4, 4096):
        assert {tuple(x) for x in tables.diff(frame(old), frame(new).select("b", "id", "a"), "id", buckets).collect()} == expected
    assert tables.diff(frame(old), frame(old), "id").count() == 0 and tables.diff(frame({}), frame(new), "id").count() == len(new)
    with pytest.raises(ValueError, match="columns"):
        tables.diff(frame(old), frame(new).drop("a"), "id")


def contains(text, phrase):
    word = lambda c: c.isascii() and c.isalnum()
    return any(text[i : i + len(phrase)] == phrase and not (i and word(text[i - 1])) and not (i + len(phrase) < len(text) and word(text[i + len(phrase)])) for i in range(len(text)))


def test_first_phrase_against_every_pair(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice(["ab", "c", "A", "7", " ", " ", "-", ".", "é", "\n", "(", "\\E"]) for _ in range(n))
    docs = [(i, text(40)) for i in range(150)] + [(900, None), (901, "")]
    table = [(k, text(r.randint(1, 5))) for k in range(80)] + [(99, ""), (98, "é"), (97, "\\E"), (96, "nowhere")]
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    expected = {}
    for i, t in docs:
        hits = [(k, low(p)) for k, p in sorted(table) if t and p and contains(low(t), low(p))]
        if hits:
            expected[i] = hits[0]
    found = phrases.first_phrase(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(table, "ord long, phrase string"))
    assert {x.doc_id: (x.ord, x.phrase) for x in found.collect()} == expected and len(expected) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def python_links(text):
    out, fenced = [], False
    for n, line in enumerate(text.splitlines(), 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        elif not fenced:
            bare = re.sub(r"`[^`]*`", "", line)
            out += [(n, m) for m in re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", bare)]
    return out


def test_links_outside_of_code(spark):
    r = random.Random(9)
    pieces = ["[a](x.md)", "![i](y.png)", "`[c](z.md)`", "[t](w.md \"a title\")", "```", "~~~", "\n", "\n", "\r\n", "\x0b", " ", " ", "word", "`", "[b](#in)", "[h](https://a.b)", "[](e.md#part)", "[x]()"]
    docs = [(i, "".join(r.choice(pieces) for _ in range(25))) for i in range(300)] + [(900, None), (901, ""), (902, "```\n[a](b.md)\n```\n[c](d.md)")]
    found = markdown.links(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, n, t) for i, text in docs if text for n, t in python_links(text))
    known = spark.createDataFrame([("x.md",), ("e.md",)], "path string")
    broken = {x.target for x in markdown.broken_links(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()}
    inner = {t.split("#")[0]: t for _, text in docs if text for _, t in python_links(text) if not t.startswith(("#", "https://"))}
    assert broken == {t for path, t in inner.items() if path not in ("x.md", "e.md")} and "d.md" in broken and "b.md" not in broken


def test_bytes_that_are_no_text_are_repaired_as_python_does(spark):
    r = random.Random(5)
    blobs = [bytes(r.choice([65, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x90, 0x8D, 0xF4, 0x8F, 0xF5, 0xFF]) for _ in range(r.randint(0, 9))) for _ in range(800)]
    found = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary").select("i", F.expr("make_valid_utf8(cast(b as string))").alias("t")).collect()
    assert {x.i: x.t for x in found} == {i: b.decode("utf-8", "replace") for i, b in enumerate(blobs)}
