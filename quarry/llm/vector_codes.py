"""Vector code compression: product codes whose nearest entries are found by a vector-approximation file (operator 12).

A vector of integers is cut into PARTS equal parts, each part is coded by its nearest entry of that part's codebook.  The
entries' coordinates are quantised into 2^BITS cells a dimension; a query looks up in tables of its own how near and how far
each cell can be, and adds these up to a lower and an upper bound for each entry.  Only the entries whose lower bound is
not above the least upper bound are refined with the exact integer distance.  Rounds of assignment and means run over all
rows; what reaches the driver are the sums of the entries, ENTRIES times the dimensions whatever the number of rows.

Defined results: a row whose vector is null or has null or non-finite components is dropped; vectors that are shorter
than the longest, and a length that PARTS does not divide, end in zeros; a null vec_id sorts last and its row is
coded like any other, rows of one vec_id sort by their vectors; fewer rows than ENTRIES make as many entries; repeated
rows give repeated rows; null labels are one label; a component of 2^31 or more, or a squared distance of 2^63 or more, is
an error; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, small_batches, written
from .vectors import embeddings, integers, matrix, whole

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4


class CellFile:
    """The entries of one codebook with their coordinates in cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        self.cell = np.zeros((n, width), np.int64)
        # bounds of a cell are the least and greatest coordinate in it; cells without one are never looked up
        self.low, self.high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
        for d in range(width):
            values = np.sort(entries[:, d])
            edges = values[np.arange(1, cells) * n // cells]
            self.cell[:, d] = np.searchsorted(edges, entries[:, d], side="right")
            for c in np.unique(self.cell[:, d]):
                held = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = held.min(), held.max()

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A lower and an upper bound of the squared distance of each row to each entry."""
        under, over = x[:, :, None] - self.low, self.high - x[:, :, None]
        near, far = np.maximum(np.maximum(-under, -over), 0) ** 2, np.maximum(np.abs(under), np.abs(over)) ** 2
        lower, upper = (sum(t[:, d, self.cell[:, d]] for d in range(x.shape[1])) for t in (near, far))
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the first of equal ones, and its squared distance."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        exact = ((x[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(exact, starts) if len(x) else exact
        first = np.flatnonzero(exact == least[row])
        hit = first[np.searchsorted(row[first], np.arange(len(x)))]
        return entry[hit], least


class Codebooks:
    """The codebooks of all parts: entries of shape (parts, entries, width)."""

    def __init__(self, entries: np.ndarray, most: int):
        if entries.shape[2] * (2 * most + 1) ** 2 >= 1 << 63:
            raise ValueError("squared distances do not fit 64 bits")
        self.entries = entries
        self.files = [CellFile(e) for e in entries]

    def split(self, column) -> np.ndarray:
        """Rows of vectors as (parts, rows, width)."""
        parts, _, width = self.entries.shape
        return matrix(column, parts * width, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, place, total and n over all rows assigned to each entry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for p, x in enumerate(books.split(batch.column(0))):
                at, _ = books.files[p].nearest(x)
                np.add.at(total[p], at, x)
                n[p] += np.bincount(at, minlength=len(n[p]))
        part, entry, place = (np.int32(i) for i in np.indices(total.shape).reshape(3, -1))
        many = np.repeat(n.ravel(), total.shape[2])
        out = pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, place, total.ravel(), many)], ["part", "entry", "place", "total", "n"])
        yield out.filter(pa.array(many > 0))

    found = small_batches(rows.select("v")).mapInArrow(scan, "part int, entry int, place int, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of rows (vec_id, v: array<int>); None for no rows."""
    length, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if length is None:
        return None
    width = max(1, -(-length // parts))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for line, r in zip(start, first):
        line[: len(r.v)] = r.v
    most = max(abs(low or 0), abs(high or 0))
    books = Codebooks(start.reshape(-1, parts, width).transpose(1, 0, 2).copy(), most)
    for _ in range(rounds):
        moved = books.entries.copy()
        for r in sums(rows, books).collect():  # parts * entries * width rows at most
            moved[r.part, r.entry, r.place] = r.total // r.n
        books = Codebooks(moved, most)
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows (vec_id, label, v) with code, two hex digits a part, and error, the squared distances summed over parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.nearest(x) for f, x in zip(books.files, books.split(batch.column("v")))]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = np.sum([d for _, d in found], 0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return small_batches(rows.select("vec_id", "label", "v")).mapInArrow(scan, "vec_id long, label string, code string, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes (vec_id, code) with v, the vector of the entries that the code names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(len(books.entries))
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, len(parts))
            v = books.entries[parts, at].reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(v), pa.list_(pa.int32()))], ["vec_id", "v"])

    return codes.select("vec_id", "code").mapInArrow(scan, "vec_id long, v array<int>")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of rows (vec_id, label, v)."""
    books = fit(rows, parts, entries, rounds)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = written(coded(rows, books), "codes")
    by_label = written(found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return join_counted(found, by_label, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = embeddings(spark, sf_dir).where(whole()).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), integers().alias("v"))
    return compress(written(rows, "vectors"))


def _rounds() -> str:
    """Distances to each entry, the least of them, and floors of means, by part; for small tables of 64 dimensions."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
near{r} AS MATERIALIZED (
  SELECT id, part, min(d * 64 + entry) AS key FROM (
    SELECT p.id, p.part, b.entry, ((p.x1 - b.x1) * (p.x1 - b.x1) + (p.x2 - b.x2) * (p.x2 - b.x2) + (p.x3 - b.x3) * (p.x3 - b.x3) + (p.x4 - b.x4) * (p.x4 - b.x4))::BIGINT AS d
    FROM parts p JOIN book{r} b ON p.part = b.part) GROUP BY id, part)""")
        if r < ROUNDS:
            means = ", ".join(f"coalesce(m.x{i}, b.x{i}) AS x{i}" for i in range(1, 5))
            floors = ", ".join(f"floor(sum(p.x{i})::DOUBLE / count(*))::BIGINT AS x{i}" for i in range(1, 5))
            out.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, {means} FROM book{r} b LEFT JOIN (
    SELECT n.part, n.key % 64 AS entry, {floors} FROM near{r} n JOIN parts p ON n.id = p.id AND n.part = p.part GROUP BY 1, 2) m
  ON m.part = b.part AND m.entry = b.entry)""")
    return ",".join(out)


ORACLE = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, part, v[4 * part + 1] AS x1, v[4 * part + 2] AS x2, v[4 * part + 3] AS x3, v[4 * part + 4] AS x4
  FROM (SELECT id, v, unnest(range({PARTS})) AS part FROM whole)),
book0 AS MATERIALIZED (SELECT part, id AS entry, x1, x2, x3, x4 FROM parts WHERE id < {ENTRIES}),{_rounds()},
sha AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
codes AS (
  SELECT id, string_agg(lower(printf('%02x', key % 64)), '' ORDER BY part) AS code, sum(key // 64)::BIGINT AS error FROM near{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN whole USING (id), sha
"""
