"""Near-duplicate vectors by spherical k-means cells and blocked cosine products (operator 13).

Unit vectors are assigned to the nearest of K centroids, one for ROWS_IN_CELL distinct vectors and CELLS at most, that are
fitted to a bounded sample (SAMPLE vectors a centroid): leaders that are no near copies of each other start, and STEPS
rounds of spherical k-means follow.  Two linked vectors can lie on both sides of the plane between two cells.  The
distances of the two to that plane add up to at most their own distance, sqrt(2 - 2 * 0.9), so one of them is within
half of that of the plane; a vector goes to each further cell from whose plane it is not farther than ``reach``.  With
EXACT_REACH no link can be lost; the default REACH, some three standard deviations of a difference in no
particular direction of 64 dimensions, sends far fewer (recall in README).

Within a cell blocks of bounded size meet, and a product of blocks gives cosines.  No pairs are returned: a vector's links are
counted, weighted by exact copies, and links that connect the same vectors are returned as a star.  Vectors within half
the angle of a link around a centroid (its core) are all linked with each other, so they are counted by their sum and are
not compared: a cell of any number of near copies costs no square of it.  Exact copies are one vector with a weight.

Defined results: vectors that are null, zero or hold null or non-finite components have no links; vectors that are
shorter than the longest end in zeros; a null vec_id keeps its row, the smallest id of a component is that of its
rows which have one, and kept says whether vec_id and component_id are equal or both null; repeated rows are further vectors
and give rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import join_counted, lists, written
from .vectors import embeddings, matrix, whole

COSINE = 0.9
ROWS_IN_CELL, CELLS, SAMPLE, STEPS = 1024, 4096, 32, 5
REACH = 0.09
#: Rows of a cell that meet at once, and how many of the others at a time.
LEFT, RIGHT, SLICE = 2048, 8192, 1024


def exact_reach(cosine: float = COSINE) -> float:
    return math.sqrt(2 - 2 * cosine) / 2


def units(column, width: int) -> np.ndarray:
    """Rows of length one; greatest components first become one, so that no square is too large or too small."""
    x = matrix(column, width, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keyed(df: DataFrame, width: int) -> DataFrame:
    """vec_id, key (a 128-bit digest of the vector) and v of the vectors that can have links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width, np.float64) + 0.0  # no minus zero
            keys = pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), keys, batch.column("v")], ["vec_id", "key", "v"])

    return df.select("vec_id", "v").mapInArrow(scan, f"vec_id long, key binary, v {df.schema['v'].dataType.simpleString()}")


def centroids(distinct: DataFrame, width: int, n: int, cells: int) -> np.ndarray:
    """Spherical k-means on the SAMPLE * cells vectors whose digests come first."""
    sample = distinct.orderBy("key").limit(SAMPLE * cells).select("v").toArrow()
    x = units(sample["v"], width)
    centres = np.zeros((cells, width))
    k = 0
    for u in x:  # leaders: no near copy of another one starts a cell
        if k < cells and (not k or (centres[:k] @ u).max() < 0.8):
            centres[k], k = u, k + 1
    centres = centres[:k]
    for _ in range(STEPS):
        at = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        length = np.sqrt((total**2).sum(1, keepdims=True))
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    return centres


def routed(distinct: DataFrame, centres: np.ndarray, cosine: float, reach: float) -> DataFrame:
    """distinct (node, copies, v) with its cell, whether it is in the cell's core, and the further cells that it goes to."""
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 0)) if len(centres) <= 512 else None
    width, core = centres.shape[1], math.cos(math.acos(cosine) / 2) + 1e-9

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = units(batch.column("v"), width) @ centres.T
            cell = dots.argmax(1)
            best = dots[np.arange(len(cell)), cell]
            far = apart[cell] if apart is not None else np.sqrt(np.maximum(2 - 2 * centres[cell] @ centres.T, 0))
            near = best[:, None] - dots <= reach * far + 1e-9
            near[np.arange(len(cell)), cell] = False
            more = [np.flatnonzero(r) for r in near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(best >= core), lists(more, pa.int32(), np.int32)], [*batch.schema.names, "cell", "core", "more"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("node", "copies", "v").mapInArrow(scan, f"node long, copies long, v {kind}, cell int, core boolean, more array<int>")


def star(nodes: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect ``nodes`` as the hits do: each hit is rows, columns (places in nodes) and a matrix of who is linked."""
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        for r, c, m in hits:
            label[r] = np.minimum(label[r], np.where(m, label[c], len(nodes)).min(1))
            label[c] = np.minimum(label[c], np.where(m, label[r][:, None], len(nodes)).min(0))
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def compared(left: DataFrame, right: DataFrame, width: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): n links of a with b null, or a link of a and b, from each part (cell, a, b) of the cells."""

    def local(one: pa.Table, other: pa.Table) -> pa.Table:
        if not len(one) or not len(other):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        cell = one["cell"][0].as_py()
        x, ids, copies = units(one["v"], width), one["node"].to_numpy(), one["copies"].to_numpy()
        more = [set(m) for m in one["more"].to_pylist()]
        their_ids, their_copies, homes = other["node"].to_numpy(), other["copies"].to_numpy(), other["home"].to_numpy()
        nodes = np.unique(np.concatenate([ids, their_ids]))
        counts, hits = np.zeros(len(nodes), np.int64), []
        for i in range(0, len(other), SLICE):
            part = slice(i, i + SLICE)
            linked = x @ units(other["v"].slice(i, SLICE), width).T >= cosine
            linked &= ids[:, None] != their_ids[part]
            r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(r):
                continue
            m = linked[np.ix_(r, c)]
            rows, columns = np.searchsorted(nodes, ids[r]), np.searchsorted(nodes, their_ids[part][c])
            counts[rows] += m @ their_copies[part][c]
            # a guest counts here what its own cell does not see: those that do not go there
            guests = np.flatnonzero(homes[part][c] != cell)
            if len(guests):
                home = homes[part][c][guests]
                seen = np.array([[h in more[k] for h in home] for k in r], bool).reshape(len(r), len(home))
                counts[columns[guests]] += copies[r] @ (m[:, guests] & ~seen)
            hits.append((rows, columns, m))
        a, b = star(nodes, hits)
        some = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array(np.concatenate([nodes[some], a])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
            "n": pa.concat_arrays([pa.array(counts[some], pa.int64()), pa.nulls(len(a), pa.int64())]),
        })

    keys = ["cell", "l", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(local, "a long, b long, n long")


def linked(distinct: DataFrame, width: int, cosine: float = COSINE, reach: float | None = REACH, rows_in_cell: int = ROWS_IN_CELL, left: int = LEFT, right: int = RIGHT) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (node, copies, key, v): counts (node, n), how many other vectors are linked directly, and edges (a, b).

    ``reach`` None loses no link.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")
    centres = centroids(distinct, width, n, min(CELLS, -(-n // rows_in_cell)))
    rows = written(routed(distinct, centres, cosine, exact_reach(cosine) if reach is None else reach), "routed")

    # how many blocks of each kind a cell has: CELLS rows at most, here and in what is broadcast
    home = rows.groupBy("cell").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("rest"), F.min(F.when(F.col("core"), F.col("node"))).alias("first"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("weight"))
    guests = rows.select(F.explode("more").alias("cell")).groupBy("cell").agg(F.count("*").alias("guests"))
    held = home.join(guests, "cell", "left").na.fill(0, ["guests"]).collect()
    up = lambda k, size: -(-k // size)
    dealt = [(r.cell, up(r.cores, left), up(r.rest, left), up(r.cores, right), up(r.rest + r.guests, right), r.first, r.weight) for r in held]
    dealt = F.broadcast(spark.createDataFrame(dealt, "cell int, lc int, lo int, rc int, ro int, first long, weight long"))
    dealing = lambda salt, k: f"cast(pmod(xxhash64(node, {salt}), greatest({k}, 1)) as int)"
    upto = lambda a, b: f"if({a} < {b}, sequence({a}, {b} - 1), array())"

    # cores meet all but cores, the rest meets all
    ours = rows.join(dealt, "cell").withColumn("l", F.expr(f"if(core, {dealing(1, 'lc')}, lc + {dealing(1, 'lo')})"))
    ours = ours.select("cell", "l", F.explode(F.expr(f"if(core, {upto('rc', 'rc + ro')}, {upto('0', 'rc + ro')})")).alias("r"), "node", "copies", "v", "more")
    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    others = again.select("node", "copies", "v", "core", F.col("cell").alias("home"), F.explode(F.concat(F.array("cell"), "more")).alias("cell"))
    others = others.withColumn("core", F.expr("core and cell = home")).join(dealt, "cell").withColumn("r", F.expr(f"if(core, {dealing(2, 'rc')}, rc + {dealing(2, 'ro')})"))
    others = others.select("cell", "r", F.explode(F.expr(f"if(core, {upto('lc', 'lc + lo')}, {upto('0', 'lc + lo')})")).alias("l"), "node", "copies", "v", "home")
    found = written(compared(ours, others, width, cosine), "compared")
    inner = rows.where("core").join(dealt, "cell").select("node", F.expr("weight - copies").alias("n"), F.col("first"))
    counts = found.where("b is null").select(F.col("a").alias("node"), "n").union(inner.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    return counts, found.where("b is not null").select("a", "b").union(inner.where("node <> first").select("node", "first"))


def groups(df: DataFrame, cosine: float = COSINE, reach: float | None = REACH, rows_in_cell: int = ROWS_IN_CELL, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of df (vec_id, v); one row of each component is kept."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    usable = F.coalesce(whole("v") & F.expr("exists(v, x -> x <> 0)"), F.lit(False))
    width = df.where(usable).agg(F.max(F.size("v"))).first()[0] or 1
    rows = written(keyed(df.where(usable), width), "vectors")
    distinct = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    counts, edges = linked(distinct, width, cosine, reach, rows_in_cell, left, right)
    roots = connected_components(edges).withColumnRenamed("node", "at")
    nodes = distinct.select("node", "key", "copies", "least").join(counts, "node", "left").join(roots, F.col("node") == F.col("at"), "left")
    nodes = written(nodes.select("key", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root")), "nodes")
    least = written(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "components")
    nodes = written(join_counted(nodes, least, "root", "members").select("key", "copies", F.expr("n + copies - 1").alias("n_links"), "component_id"), "nodes")
    told = join_counted(rows.select("vec_id", "key"), nodes, "key", "copies").select("vec_id", "n_links", "component_id")
    alone = df.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("v")))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT * FROM e WHERE usable) a JOIN (SELECT * FROM e WHERE usable) b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
