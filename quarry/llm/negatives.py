"""Hard-negative mining by a Voronoi-partition distributed nearest-neighbour join (operator 11).

Inner products become distances by one more component: sqrt(M^2 - |x|^2) for a candidate x, M the greatest norm, and 0
for an anchor q.  Then |q - x|^2 = |q|^2 + M^2 - 2 qx, so the nearest candidates are those of the greatest inner product.
A sample of at most PIVOTS rows are the pivots; anchors and candidates belong to the cell of their nearest pivot.
An anchor meets a few candidates of its own cell first, whose scores bound what can still be of use to it.  For each cell
of anchors these bounds and the distances to the pivot say which candidates might serve it (triangle inequality, and
the distance to the plane between two pivots); cells of anchors are put together into groups, and a candidate is
sent to those groups only that it might serve.  Groups of anchors, and the candidates of a group, are split into parts of
bounded size; each part is joined exactly, and the best of the parts are ranked.

The same join runs twice: for the best rows of the anchor's own label (its positives), then for the best rows of
other labels whose score lies in the band that a positive allows.  Anchors of the first run are grouped by their label's
hash too, so that a candidate is compared with few other labels.

Defined results: a row with a null label, a null vector or a null or non-finite component takes no part, nor does one
without vec_id; vectors that are shorter than the longest end in zeros; rows that share an anchor's vec_id are no
candidates of it, and of several anchor rows of one vec_id the least (label, vector) is taken; candidates that repeat
each count; an anchor without a positive, and a pair without a negative, give no rows; a negative positive score has an
empty band; squared norms of 2^63 or more are an error; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lists, written
from .vectors import embeddings, integers, matrix, whole

#: Pivots; anchors in a part; candidates in a part; hashes of labels in the first run; candidates that an anchor meets first.
PIVOTS, ANCHORS, BLOCK, SPACES, SEEDS = 64, 1024, 8192, 16, 64
NONE, ALL = -(1 << 62), 1 << 62
SCORE = "aggregate(zip_with(q, v, (a, b) -> coalesce(cast(a as bigint) * b, 0L)), 0L, (s, x) -> s + x)"


class Pivots:
    """The pivots of a table, with the number type in which its inner products are exact."""

    def __init__(self, vectors: np.ndarray, most: float):
        if most >= 2.0**63:
            raise ValueError("inner products do not fit 64 bits")
        self.width, self.most = vectors.shape[1], most
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.at = np.unique(vectors, axis=0).astype(np.float64)
        self.more = np.sqrt(np.maximum(most - (self.at**2).sum(1), 0))
        whole = np.column_stack([self.at, self.more])
        self.apart = np.sqrt(np.maximum(((whole[:, None] - whole[None]) ** 2).sum(2), 0))
        self.slack = 1e-6 * np.sqrt(most) + 1e-9

    def order(self) -> dict[int, int]:
        """The place of each pivot on a path from one to the nearest that is left."""
        path, left = [0], set(range(1, len(self.at)))
        while left:
            path.append(min(left, key=lambda p: (self.apart[path[-1], p], p)))
            left.remove(path[-1])
        return {p: i for i, p in enumerate(path)}

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each row to each pivot."""
        norm = (x**2).sum(1)
        dot = x @ self.at.T
        if not anchors:
            dot += np.sqrt(np.maximum(self.most - norm, 0))[:, None] * self.more
            norm = np.full(len(x), self.most)
        return np.sqrt(np.maximum(norm[:, None] + self.most - 2 * dot, 0))


def placed(rows: DataFrame, pivots: Pivots, anchors: bool) -> DataFrame:
    """rows (vec_id, label, v) with the cell, the distance to its pivot (near) and the squared norm."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), pivots.width, np.float64)
            far = pivots.distances(x, anchors)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell]), pa.array((x**2).sum(1))], [*batch.schema.names, "cell", "near", "norm"])

    return rows.select("vec_id", "label", "v").mapInArrow(scan, "vec_id long, label long, v array<int>, cell int, near double, norm double")


def first_met(anchors: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of each anchor with the SEEDS candidates nearest to the pivot of its cell (and label): vec_id, label, met (label, score)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("near", "vec_id"))
    seeds = candidates.withColumn("place", place).where(F.col("place") <= SEEDS).select(*keys, F.col("vec_id").alias("other"), F.col("label").alias("its"), "v")
    met = anchors.select("vec_id", "label", *[k for k in keys if k != "label"], F.col("v").alias("q")).join(seeds, keys).where("other <> vec_id")
    return met.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("its").alias("label"), F.expr(SCORE).alias("score"))).alias("met"))


def groups_of(bounds: list, pivots: Pivots, size: int) -> tuple[np.ndarray, dict[int, int]]:
    """The group of each of the cells ``bounds``, and in how many parts a group is; cells are put together up to ``size`` anchors."""
    order, group, held, last = pivots.order(), -1, 0, None
    of, parts = np.zeros(len(bounds), np.int64), {}
    for i in sorted(range(len(bounds)), key=lambda i: (bounds[i].space, order[bounds[i].cell])):
        if bounds[i].space != last or held + bounds[i].n > size:
            group, held, last = group + 1, 0, bounds[i].space
        of[i], held = group, held + bounds[i].n
        parts[group] = -(-held // size)
    return of, parts


def routed(candidates: DataFrame, pivots: Pivots, bounds: list, of: np.ndarray) -> DataFrame:
    """candidates (vec_id, label, v, space) with the groups that each might serve; those that serve none are left out."""
    cells, spaces = np.array([b.cell for b in bounds]), np.array([b.space for b in bounds])
    near, far, useful, least = (np.array([getattr(b, k) for b in bounds], float) for k in ("nearest", "farthest", "useful", "least"))
    apart, slack = np.where(pivots.apart > 0, pivots.apart, np.inf), pivots.slack

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = pivots.distances(matrix(batch.column("v"), pivots.width, np.float64), False)
            own = to.argmin(1)
            beyond = (to**2 - (to.min(1) ** 2)[:, None]) / (2 * apart[own])
            d = to[:, cells]
            lower = np.maximum(np.maximum(d - far, near - d), beyond[:, cells])
            serves = (lower <= useful + slack) & (d + far >= least - slack)
            serves &= batch.column("space").to_numpy()[:, None] == spaces
            found = [np.unique(of[s]) for s in serves]
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), lists(found, pa.int32(), np.int32)], ["vec_id", "label", "v", "groups"])
            yield out.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    return candidates.select("vec_id", "label", "v", "space").mapInArrow(scan, "vec_id long, label long, v array<int>, groups array<int>")


def join_parts(anchors: DataFrame, candidates: DataFrame, pivots: Pivots, same: bool, best: int) -> DataFrame:
    """The ``best`` candidates of each wish within each part: vec_id, wish (its place), other, score.

    anchors: grp, part, salt, vec_id, label, v, lows and highs, the least and greatest score of each wish.
    """
    width, kind = pivots.width, pivots.kind

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        ids, labels, x = right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["v"], width, kind)
        q, q_ids, q_labels = matrix(left["v"], width, kind), left["vec_id"].to_numpy(), left["label"].to_numpy()
        lows, highs = left["lows"].to_pylist(), left["highs"].to_pylist()
        out: list[list] = [[], [], [], []]
        for start in range(0, len(q) if len(ids) else 0, 128):
            for i, scores in enumerate((q[start : start + 128] @ x.T), start):
                fits = ((labels == q_labels[i]) if same else (labels != q_labels[i])) & (ids != q_ids[i])
                for w, (low, high) in enumerate(zip(lows[i], highs[i])):
                    at = np.flatnonzero(fits & (scores >= low) & (scores <= high))
                    if len(at) > best:  # equal scores go by id, and so by place
                        s = scores[at]
                        cut = np.partition(s, len(s) - best)[len(s) - best]
                        above = at[s > cut]
                        at = np.concatenate([above, at[s == cut][: best - len(above)]])
                    for column, values in zip(out, (np.full(len(at), q_ids[i]), np.full(len(at), w), ids[at], scores[at].astype(np.int64))):
                        column.append(values)
        return pa.table({k: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for (k, t), c in zip((("vec_id", pa.int64()), ("wish", pa.int32()), ("other", pa.int64()), ("score", pa.int64())), out)})

    keys = ["grp", "part", "salt"]
    return anchors.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(local, "vec_id long, wish int, other long, score long")


def knn_join(anchors: DataFrame, candidates: DataFrame, pivots: Pivots, same: bool, best: int, size: int, block: int) -> DataFrame:
    """For each wish of an anchor its ``best`` candidates of the same label, or of other ones: vec_id, wish, other, score, rank.

    anchors: vec_id, label, v, cell, near, norm, space, lows and highs; candidates: vec_id, label, v and space.
    """
    spark = anchors.sparkSession
    schema = "vec_id long, wish int, other long, score long, rank int"
    away = lambda score: f"sqrt(greatest(0D, norm + {pivots.most!r}D - 2D * {score}))"
    bounds = anchors.groupBy("space", "cell").agg(
        F.count("*").alias("n"), F.min("near").alias("nearest"), F.max("near").alias("farthest"),
        F.max(F.expr(away("array_min(lows)"))).alias("useful"), F.min(F.expr(away("array_max(highs)"))).alias("least"),
    ).orderBy("space", "cell").collect()  # fmt: skip  # SPACES * PIVOTS rows at most
    if not bounds:
        return spark.createDataFrame([], schema)
    of, parts = groups_of(bounds, pivots, size)
    served = written(routed(candidates, pivots, bounds, of), "served")
    counts = {r.grp: r.n for r in served.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count("*").alias("n")).collect()}
    salts = {g: -(-counts.get(g, 0) // block) for g in parts}
    dealt = F.broadcast(spark.createDataFrame([(g, parts[g], salts[g]) for g in parts if salts[g]], "grp int, parts int, salts int"))
    cells = F.broadcast(spark.createDataFrame([(b.space, b.cell, int(g)) for b, g in zip(bounds, of)], "space int, cell int, grp int"))
    right = served.select("vec_id", "label", "v", F.explode("groups").alias("grp")).join(dealt, "grp")
    right = right.select("grp", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(vec_id), salts) as int)").alias("salt"), "vec_id", "label", "v")
    left = anchors.join(cells, ["space", "cell"]).join(dealt, "grp")
    left = left.select("grp", F.expr("cast(pmod(xxhash64(vec_id, 1), parts) as int)").alias("part"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "vec_id", "label", "v", "lows", "highs")
    found = join_parts(left, right, pivots, same, best)
    rank = F.row_number().over(Window.partitionBy("vec_id", "wish").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= best)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, size: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """Hard negatives of rows (vec_id, label: long; v: array<int>).

    For each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    width, most = rows.agg(F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))).first()
    if width is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).select("v").collect()
    vectors = np.zeros((len(chosen), max(1, width)), np.int64)
    for line, r in zip(vectors, chosen):
        line[: len(r.v)] = r.v
    pivots = Pivots(vectors, float(most))
    candidates = written(placed(rows, pivots, False), "candidates")
    taken = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    anchors = written(placed(taken, pivots, True), "anchors")
    space = F.expr(f"cast(pmod(xxhash64(label), {SPACES}) as int)").alias("space")

    # the first run: an anchor's only wish is a score as good as that of its k-th seed of the same label
    met = first_met(anchors, candidates, ["label", "cell"])
    kth = F.expr(f"coalesce(get(transform(sort_array(met, false), x -> x.score), {positives - 1}), {NONE}L)")
    wishing = anchors.join(met.select("vec_id", kth.alias("low")), "vec_id", "left")
    wishing = written(wishing.select("*", space, F.expr(f"array(coalesce(low, {NONE}L))").alias("lows"), F.expr(f"array({ALL}L)").alias("highs")), "wishes")
    near = written(knn_join(wishing, candidates.select("*", space), pivots, True, positives, size, block), "positives")

    # the second: a wish for each positive, from the band that it allows or the k-th seed within it
    exact = "cast(score as decimal(20,0))"
    pairs = near.select("vec_id", F.expr(f"({low} * {exact} + 99) div 100").alias("low"), F.expr(f"({high} * {exact}) div 100").alias("high"), F.col("other").alias("positive"), F.col("score").alias("its"), F.col("rank").alias("o"))
    listed = pairs.where("its >= 0 and low <= high").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("o", "positive", "its", "low", "high"))).alias("p"))
    met = first_met(anchors, candidates, ["cell"])
    held = anchors.join(listed, "vec_id").join(met, "vec_id", "left")
    fits = "filter(coalesce(met, array()), m -> m.label <> label and m.score between x.low and x.high)"
    kth = f"coalesce(get(sort_array(transform({fits}, m -> m.score), false), {negatives - 1}), x.low)"
    wishing = held.select(*anchors.columns, "p", F.lit(0).alias("space"), F.expr(f"transform(p, x -> {kth})").alias("lows"), F.expr("transform(p, x -> x.high)").alias("highs"))
    wishing = written(wishing, "wishes")
    far = knn_join(wishing, candidates.select("*", F.lit(0).alias("space")), pivots, False, negatives, size, block)
    named = far.join(wishing.select("vec_id", "p"), "vec_id").withColumn("x", F.expr("p[wish]"))
    return named.select(F.col("vec_id").alias("anchor_id"), F.col("x.positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("x.its").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end")
    rows = embeddings(spark, sf_dir).where(whole()).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), integers().alias("v"))
    return mine(rows, F.expr("vec_id % 100 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
