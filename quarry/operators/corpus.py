"""Corpus operators: leak removal, keyed splits, packing, budgets, skylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw  # noqa: F401
from ..sources.shared import written


def drop_leaks(test: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Rows of ``test`` whose ``column`` doesn't occur in ``train``; joined by a digest, so that whole texts aren't shuffled twice."""
    seen = train.select(F.sha2(column, 256).alias("__k")).distinct()
    return test.withColumn("__h", F.sha2(column, 256)).join(seen, F.col("__h") == F.col("__k"), "left_anti").drop("__h")


def reject_sample(candidates: DataFrame, accepted: Column, n: int, order: Column) -> DataFrame:
    """The first ``n`` accepted candidates; raises if there are fewer."""
    kept = candidates.where(accepted).orderBy(order).limit(n)
    found = kept.count()
    if found < n:
        raise ValueError(f"{found} of {n} samples accepted")
    return kept


def skyline(points: DataFrame, more: str, less: str) -> DataFrame:
    """Points that no other beats in both: ``more`` at least and ``less`` at most, one of them strictly.  Exact ties stay.

    First the least ``less`` for each value of ``more`` is found with a partial aggregation; only that table, one row
    a value, is ordered, and a running minimum from the top tells which values are beaten.
    """
    best = points.groupBy(F.col(more).alias("__m")).agg(F.min(less).alias("__l"))
    base = ranged(best, [F.col("__m").desc()])
    inside = Window.partitionBy("__p").orderBy(F.col("__m").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy("__p").agg(F.min("__l").alias("__t"))
    earlier = parts.select(F.col("__p"), F.min("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__e"))
    front = base.withColumn("__a", F.min("__l").over(inside)).join(F.broadcast(earlier), "__p").withColumn("__a", F.least("__a", "__e")).where("__a is null or __l < __a").select("__m", "__l")
    return points.join(front, (points[more] == front["__m"]) & (points[less] == front["__l"]), "left_semi")


def ranged(rows: DataFrame, order: list) -> DataFrame:
    """rows, written in ranges of ``order``, with __p, the range's number.  There are as many ranges as shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def carried(base: DataFrame, keys: list[str], found: dict[str, tuple]) -> DataFrame:
    """Adds to rows of ``ranged`` what the earlier ranges hold of their keys, null where they hold none.

    ``found`` gives each name the aggregate of a key within a range and the function that joins the earlier ranges'
    aggregates.  The window is over one row for each key in a range, so no key's rows meet in one task.
    """
    sizes = base.groupBy("__p", *keys).agg(*[inner.alias(name) for name, (inner, _) in found.items()])
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sizes = sizes.select(F.col("__p").alias("__q"), *names, *[outer(name).over(earlier).alias(name) for name, (_, outer) in found.items()])
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return base.join(sizes, same).select(*base.columns, *found)


def inside(keys: list[str], order: list):
    """The window over the rows of a key within their range."""
    return Window.partitionBy("__p", *keys).orderBy(*order)


def numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds __r, the row's place from 1 among those of its keys, and __n, how many they are; ``order`` should leave no ties.

    No key's rows meet in one task: rows are ranged by keys and order and numbered within their range, and the
    counts of earlier ranges, a row for each key in a range, are added.
    """
    base = ranged(rows, [*map(F.col, keys), *order])
    sizes = base.groupBy("__p", *keys).agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*keys)
    sizes = sizes.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.sum("__c").over(by).alias("__n"), F.coalesce(F.sum("__c").over(by.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = base.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order)))
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(sizes, same).select(*rows.columns, (F.col("__b") + F.col("__r")).alias("__r"), "__n")


def early_stop(rows: DataFrame, key: str, order: str, loss: str, patience: int) -> DataFrame:
    """key and stopped, the first step of each run that ``patience`` steps before it and itself did not improve on the best.

    A step improves if its loss is under the least before it, or none before it has a loss.  Runs that never stop give no row.
    """
    base = ranged(rows.select(key, order, loss), [F.col(key), F.col(order)])
    within = inside([key], [F.col(order)])
    steps = carried(base, [key], {"__b": (F.count("*"), F.sum), "__m": (F.min(loss), F.min)})
    best = F.least("__m", F.min(loss).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce("__b", F.lit(0)) + F.row_number().over(within)
    steps = steps.select("__p", key, place.alias("__r"), best.alias("__best"), loss).select("__p", key, "__r", F.when(F.col("__best").isNull() | (F.col(loss) < F.col("__best")), F.col("__r")).alias("__i"))
    steps = carried(written(steps, "steps"), [key], {"__c": (F.max("__i"), F.max)})
    since = F.greatest("__c", F.max("__i").over(inside([key], [F.col("__r")]).rowsBetween(Window.unboundedPreceding, 0)))
    return steps.withColumn("__since", since).where(F.col("__r") - F.col("__since") >= patience).groupBy(key).agg(F.min("__r").alias("stopped"))


def sessions(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Adds session, how many rows of the key up to this one start a session."""
    by = [*map(F.col, order)]
    base = ranged(rows.withColumn("__s", F.when(starts, 1).otherwise(0).cast("long")), [F.col(key), *by])
    summed = carried(base, [key], {"__b": (F.sum("__s"), F.sum)})
    here = F.sum("__s").over(inside([key], by).rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("session", F.coalesce("__b", F.lit(0)) + here).drop("__p", "__s", "__b")


def before(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds before_ and the name of each of ``columns``: its value in the key's row before; null for a key's first row."""
    by = [*map(F.col, order)]
    base = ranged(rows, [F.col(key), *by])
    within = inside([key], by)
    told = carried(base, [key], {"__b": (F.max(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("c"))), F.max)})
    first = F.row_number().over(within) == 1
    return told.select(*rows.columns, *[F.when(first, F.col("__b.c")[c]).otherwise(F.lag(c).over(within)).alias(f"before_{c}") for c in columns])


def last_known(rows: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """Adds to each row, for each field, its last value up to this row that is not null."""
    by = [*map(F.col, order)]
    base = ranged(rows.select(*rows.columns, *[c.alias(f) for f, c in fields.items()]), [F.col(key), *by])
    latest = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order)))
    told = carried(base, [key], {f"__b_{f}": (latest(f), lambda c: F.last(c, ignorenulls=True)) for f in fields})
    within = inside([key], by).rowsBetween(Window.unboundedPreceding, 0)
    return told.select(*rows.columns, *[F.coalesce(F.last(f, ignorenulls=True).over(within), f"__b_{f}").alias(f) for f in fields])


def holdout_split(rows: DataFrame, keys: list[str], order: Column, tie: str, least: int = 3) -> DataFrame:
    """Adds part: per key a fifth of the rows, one at least, is test; keys with fewer than ``least`` rows have none."""
    cut = F.when(F.col("__n") >= least, F.greatest(F.lit(1), F.floor(F.col("__n") / 5))).otherwise(0)
    return numbered(rows, keys, [order, F.col(tie)]).withColumn("part", F.when(F.col("__r") <= cut, "test").otherwise("train")).drop("__n", "__r")


def history_within(turns: DataFrame, key: str, order: str, tokens: Column, budget: int, most: int | None = None) -> DataFrame:
    """The most recent turns of each conversation that fit a token budget, and ``most`` of them at most."""
    recent = [F.col(order).desc()]
    base = ranged(turns.withColumn("__t", tokens), [F.col(key), *recent])
    told = carried(base, [key], {"__b": (F.sum("__t"), F.sum), "__c": (F.count("*"), F.sum)})
    within = inside([key], recent)
    used = F.coalesce("__b", F.lit(0)) + F.sum("__t").over(within.rowsBetween(Window.unboundedPreceding, 0))
    kept = told.select(*turns.columns, used.alias("__sum"), (F.coalesce("__c", F.lit(0)) + F.row_number().over(within)).alias("__r")).where(F.col("__sum") <= budget)
    return (kept.where(F.col("__r") <= most) if most else kept).drop("__sum", "__r")


def offsets(rows: DataFrame, key: str, length: str) -> DataFrame:
    """Adds start, the sum of ``length`` over all rows with a smaller ``key``, without a window over the whole table.

    Rows are written in ranges of the key, once, so that totals and rows agree; ranges are summed on their own, and a running sum over their totals, one
    row a range, is added.  Rows with the same key follow each other in the order of a hash of all columns.
    """
    tie = F.xxhash64(*rows.columns)
    base = ranged(rows, [F.col(key)])
    inside = Window.partitionBy("__p").orderBy(F.col(key), tie).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy("__p").agg(F.sum(length).alias("__t"))
    before = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    summed = base.withColumn("__s", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    return summed.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__b") + F.col("__s")).alias("start"))


def packed_rows(tokens: DataFrame, key: str, ids: str, width: int) -> DataFrame:
    """Token lists laid end to end in the order of ``key`` and cut into rows of ``width``; the last, partial row goes.

    A list is cut at the borders of the rows, and its slices move; nothing is as long as a token each.
    """
    placed = offsets(tokens.withColumn("__n", F.size(ids).cast("long")), key, "__n").where("__n > 0")
    cut = placed.select("start", "__n", F.col(ids).alias("ids"), F.explode(F.expr(f"sequence(start div {width}, (start + __n - 1) div {width})")).alias("row"))
    cut = cut.withColumn("first", F.expr(f"greatest(start, row * {width})"))
    parts = cut.select("row", F.expr(f"first - row * {width}").alias("at"), F.expr(f"slice(ids, cast(first - start + 1 as int), cast(least(start + __n, (row + 1) * {width}) - first as int))").alias("part"))
    return parts.groupBy("row").agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(at, part))), x -> x.part)")).alias("ids")).where(F.size("ids") == width)


def nearest_rank(rows: DataFrame, key: str, value: str, tie: str, percent: int = 95) -> DataFrame:
    """Per key the value at place floor(percent * n / 100), counted from 0 and at most n - 1."""
    placed = numbered(rows.select(*dict.fromkeys((key, value, tie))), [key], [F.col(value), F.col(tie)])
    return placed.where(F.expr(f"__r - 1 = least({percent} * __n div 100, __n - 1)")).select(key, F.col(value).alias(f"p{percent}"), F.col("__n").alias("n"))


def onpolicy(wrong: DataFrame, original: DataFrame, key: str, repeat: int, replay: int, seed: str) -> DataFrame:
    """A dataset for another round of training: place, kind, copy and ``key``.

    Each row that the model had wrong is there ``repeat`` times, with at most ``replay`` rows drawn from the original training rows, without
    replacement; all are shuffled by draws.  Rows are placed over ranges, so nothing is ordered in one task.
    """
    drawn = lambda *what: draw(F.concat(F.lit(seed), *[F.col(c).cast("string") for c in what]))
    corrections = wrong.select(F.lit("correction").alias("kind"), key, F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("copy"))
    picked = numbered(original.select(key), [], [drawn(key), F.col(key)]).where(F.col("__r") <= replay)
    rows = corrections.union(picked.select(F.lit("replay").alias("kind"), key, F.lit(0).alias("copy")))
    return numbered(rows, [], [drawn("kind", "copy", key), F.col(key)]).select(F.col("__r").alias("place"), "kind", "copy", key)


def grouped_median(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The median of each group's values that are there: the mean of the one or two in the middle, found by place, so that no group's values meet."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(key, value, tie), [key], [F.col(value), F.col(tie)])
    return placed.where("__r in ((__n + 1) div 2, (__n + 2) div 2)").groupBy(key).agg(F.round(F.avg(value), 6).alias("middle"))


def build_dataset(docs: DataFrame, accepted: Column, shares: dict[str, int], seed: str) -> DataFrame:
    """A dataset from documents (doc_id, text): split, place and doc_id of each row.

    Lines are cleaned, refused texts go, of equal texts that with the least id stays, splits are drawn by text, rows of a
    split that another split's training part holds in another case go, and each split is shuffled.  ``shares`` gives each split but train its share in 1/1000.
    """
    clean = docs.select("doc_id", F.trim(F.col("text")).alias("text")).where(F.col("text") != "")
    kept = clean.where(accepted).groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.min(F.sha2(F.lower("text"), 256)).alias("low"))
    part, at = F.lit("train"), draw(F.concat(F.lit(seed), F.col("k"))) % 1000
    bound = sum(shares.values())
    for name, share in reversed(shares.items()):
        part = F.when(at < bound, name).otherwise(part)
        bound -= share
    rows = written(kept.select("doc_id", "low", part.alias("split")), "dataset")
    train = rows.where("split = 'train'").select("low").distinct()
    rows = rows.where("split = 'train'").unionByName(rows.where("split <> 'train'").join(train, "low", "left_anti"))
    return numbered(rows.select("split", "doc_id"), ["split"], [draw(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), F.col("doc_id")]).select("split", F.col("__r").alias("place"), "doc_id")


def answered(prompts: DataFrame, ask) -> DataFrame:
    """Adds answer to (prompt, seed): what the hook ``ask(prompt, seed)`` says, asked once for each distinct pair."""
    keys = prompts.select("prompt", "seed").distinct()

    def run(batches):
        for batch in batches:
            batch["answer"] = [ask(p, s) for p, s in zip(batch["prompt"], batch["seed"])]
            yield batch

    found = written(keys.mapInPandas(run, "prompt string, seed long, answer string"), "answers")
    return prompts.join(found.withColumnsRenamed({"prompt": "__p", "seed": "__s"}), F.col("prompt").eqNullSafe(F.col("__p")) & F.col("seed").eqNullSafe(F.col("__s"))).drop("__p", "__s")
