"""The pipeline, stage by stage, against brute force, and the driver's entry with and without the text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from quarry.llm import toxicity

from .test_near_copies import brute as brute_kept
from .test_operators import corpus, frame, toxic_rows, words_of

ROOT = Path(__file__).resolve().parents[2]


def line_key(x):
    return "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))


def without_common_lines(rows):
    held = {}
    for d, t in rows:
        for x in t.split("\n"):
            if len(line_key(x)) >= 40:
                held.setdefault(line_key(x), set()).add(d)
    keep = lambda d, x: len(line_key(x)) < 40 or len(held[line_key(x)]) < 5 or max(held[line_key(x)]) == d
    return [(d, "\n".join(x for x in t.split("\n") if keep(d, x))) for d, t in rows]


def without_passages(rows, window=35):
    seen = {}
    for _, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((d, b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = toxic_rows(300)
    seen = set()
    rows = [(1000 + i, t) for i, t in rows] + [(d, t) for d, t in corpus() if d is not None and t is not None and not (d in seen or seen.add(d))]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("toxicity", "line dedup", "near-dedup by MinHash", "substring dedup", "best-fit packing")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    cache = toxicity.WordWeights(model.weights)
    expected = [(d, t) for d, t in pairs(docs) if model.score(model.sentences(t, cache)[1]) < 0.3]
    assert 0 < len(expected) < docs.count() and {d for d, _ in expected} >= {i for i in range(60)}
    steps = [
        lambda rows: rows,
        without_common_lines,
        lambda rows: [x for x in rows if x[0] in brute_kept(rows)],
        without_passages,
    ]
    for i, (stage, brute) in enumerate(zip(stages, steps)):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        expected = sorted(brute(expected))
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        assert pairs(docs) == expected
        assert docs.where("n_chars <> char_length(text)").count() == 0
    packed = stages[4](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in expected}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in whole) == sorted(tuple(r)[:5] for r in packed)


def test_stages_without_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_entry_without_the_text_operators(tmp_path):
    for name in ("quarry", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "quarry").mkdir()
    for p in (ROOT / "quarry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quarry" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    entry = (ROOT / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_with_them():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert set(e.oracle_sql()) <= set(names)
