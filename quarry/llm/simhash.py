"""SimHash near-duplicates by segment-popcount embedding (operator 2).

A fingerprint of 64 bits is mapped to the bit counts of its 16 segments of four bits.  The Manhattan distance of
two such vectors is at most the Hamming distance of the fingerprints, so fingerprints that differ in two bits or
fewer lie within Manhattan distance two.  The range join runs on the unit grid of vectors: each fingerprint goes
to the cells within distance one of its own, and two vectors within distance two always share a cell.  Cells
with one fingerprint are dropped.  In the others the exact check is made without forming pairs: two fingerprints
differ in at most two bits if and only if some value differs from each of them in at most one bit, so each
candidate names the values of that kind that lie in the shared cell, and fingerprints that name the same value are
linked to the smallest of them.  The work is linear in the candidates, whatever the size of a group.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and link like others;
a null doc_id keeps its row, and its component_id is the smallest id of its component that is not null; repeated
rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, documents, join_counted, small_batches, written

SEED, SHINGLE, SEGMENT = 42, 3, 4


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """A hash of each shingle of a text; a shorter text is one shingle, a text without a word has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    ends = starts[min(words_in_shingle, len(words)) :]
    return np.array([xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(starts, ends)], "<u8")


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer."""
    return majority(shingle_hashes(text, words_in_shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, repeats included."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; columns with maps, which have no hash, go by their JSON."""
    plain = lambda f: not any(k in f.dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(*[F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema])


def fingerprints(docs: DataFrame, by_row: bool = False) -> DataFrame:
    """doc_id and fp (a signed long of the same bits), and row, a hash of all columns, if asked for."""
    keys = ["doc_id", "row"] if by_row else ["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(len(keys))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found.view(np.int64))], [*keys, "fp"])

    columns = {"doc_id": F.col("doc_id").cast("long"), "row": row_hash(docs)}
    return small_batches(docs.select(*[columns[k].alias(k) for k in keys], F.col("text").cast("string").alias("text"))).mapInArrow(scan, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def links(values: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` just as all pairs at two or fewer differing bits would."""
    unit = "shiftleft(1L, 3 * i)"
    count = f"bit_count(shiftrightunsigned(fp, {SEGMENT} * i) & {(1 << SEGMENT) - 1})"
    segments = f"sequence(0, {64 // SEGMENT - 1})"
    vectors = values.select("fp", F.expr(f"aggregate({segments}, 0L, (v, i) -> v + shiftleft(cast({count} as bigint), 3 * i))").alias("vector"))
    up = f"transform(filter({segments}, i -> {count} < {SEGMENT}), i -> vector + {unit})"
    down = f"transform(filter({segments}, i -> {count} > 0), i -> vector - {unit})"
    cells = written(vectors.select("fp", "vector", F.explode(F.expr(f"concat(array(vector), {up}, {down})")).alias("cell")), "cells")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("cell")
    flipped = f"vector + (1 - 2 * (shiftrightunsigned(fp, b) & 1L)) * shiftleft(1L, 3 * cast(floor(b / {SEGMENT}) as int))"
    near = f"if(cell = vector, array(fp), transform(filter(sequence(0, 63), b -> {flipped} = cell), b -> fp ^ shiftleft(1L, b)))"
    named = cells.join(shared, "cell").select("fp", F.explode(F.expr(near)).alias("value"))
    named = written(named, "named")
    discard(cells)
    least = named.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("value", "b")
    return named.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")


def _classes(found: DataFrame) -> DataFrame:
    """fp, root, component_id and copies, how many rows have it, of each distinct fingerprint of found (doc_id, fp)."""
    values = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "values")
    roots = connected_components(links(values.select("fp")))
    placed = written(values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots")
    return written(join_counted(placed, least, "root", "members").select("fp", "root", "component_id", "copies"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    found = written(fingerprints(docs), "fingerprints")
    return join_counted(found, _classes(found), "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Of docs the first row of each ``root`` in ``placed`` (doc_id, row, a hash of all columns, and root), a row of docs each."""
    rows = written(placed.groupBy("root", "doc_id", "row").agg(F.count("*").alias("copies")), "class-rows")
    first = rows.groupBy("root").agg(F.count("*").alias("rows"), F.sum("copies").alias("all"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).where("all > 1")
    marked = join_counted(rows, written(first.drop("all"), "classes"), "root", "rows")
    marked = marked.select(F.col("doc_id").alias("id"), "row", "copies", F.expr("doc_id <=> first.doc_id and row = first.row").alias("stays"))
    marked = written(marked.where("not stays or copies > 1"), "marked")
    keyed = docs.select(F.struct("*").alias("doc"), row_hash(docs).alias("at"), F.col("doc_id").cast("long").alias("doc_id"))
    same = lambda m: (F.col("at") == m["row"]) & F.col("doc_id").eqNullSafe(m["id"])
    repeated = marked.where("stays")
    single = keyed.join(marked, same(marked), "left_anti").select("doc")
    # fully repeated rows: the first of each, taken as a whole, since maps cannot be compared
    first = keyed.join(repeated, same(repeated), "left_semi").groupBy("doc_id", "at").agg(F.first("doc").alias("doc"))
    return single.union(first.select("doc")).select("doc.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row; all columns of ``docs``.

    It is that with the smallest doc_id (null last), of fully repeated rows one.  Other rows of the same doc_id are judged by their own text.
    """
    found = written(fingerprints(docs, True), "fingerprints")
    return one_of_each(docs, join_counted(found, _classes(found), "fp", "copies").select("doc_id", "row", "root"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
