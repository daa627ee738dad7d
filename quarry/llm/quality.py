"""Quality rules in DataFrame functions: fixed rules and robust multivariate outliers (operator 1).

Base counts come from one pass over the text with array functions.  Five statistics of each document that
passes the fixed rules are transformed by logarithms and held as whole numbers of 1/4096.  For every language
and source a minimum-covariance-determinant estimate is made from them by selective iteration (FAST-MCD, with starts that the data
fix): one start takes the three quarters of rows nearest to the medians by all statistics, one more each the three quarters nearest by a single
statistic.  A concentration step estimates mean and covariance from the subset and takes the three quarters with the least
Mahalanobis distance from them as the next one.  Every start makes two steps, the two with the least determinant go on until no
group changes (``STEPS`` at most), and the lesser determinant of the two is the group's estimate.  A document is
rejected if its squared distance, scaled so that the three-quarter point agrees with that of a chi-squared variable, exceeds ``cutoff``.

A step reads the statistics once: rows are summed by group, start and distance in 1/64 before they are shuffled, and the subset is found
from those sums.  Sums are of whole numbers, bigints in a bucket and decimals above it, and so exact in any order.  No group is
gathered, and a group's rows are spread over salted keys: a source with a third of all rows costs what other rows cost.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources are
groups of their own; a document in a group with fewer than ``least_rows`` documents is judged by the estimate of its
language, and in a language with fewer by that of all documents, so every document has a distance; columns that don't vary get the
variance ``FLOOR`` squared, which is added to all variances; distances of 1,024 or more count as one when a subset is chosen; rows at the subset's border with the same
distance in 1/64 are all in it; starts with the same determinant go by number; null and repeated doc_ids are rows like any others;
an empty table gives no rows; further columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, written

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SCALE = 4096
#: Points of the chi-squared distribution with five degrees of freedom.
CHI2_THREE_QUARTERS = 6.6257
CUTOFF, FLOOR, LEAST_ROWS = 100.0, 0.2, 50
#: Steps of every start, starts that go on, and steps in all at most.
FIRST_STEPS, STARTS_KEPT, STEPS = 2, 2, 20
TOP = 1 << 16
SALTS = 32
#: Up to so many repeated windows of a text are looked up one by one; it changes the way, not the result.
LOOKED_UP = 400


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    blank = r"[\\x20\\x09-\\x0D]"
    bare = "__t"
    for c in SYMBOLS:
        bare = f"replace({bare}, '{c}', '')"
    d = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    d = d.withColumn("__w", F.expr(f"array_remove(split(__t, '{blank}+'), '')"))
    d = d.withColumn("__l", F.expr("filter(split(__t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    d = d.withColumn("__n", F.size("__w"))
    d = d.withColumn("__h", F.expr("if(__n < 4, array(), transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"))
    d = d.withColumn("__s", F.expr("if(size(array_distinct(__h)) < size(__h), sort_array(__h), array())"))
    d = d.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 and x = __s[i - 1]))"))
    # few repeated windows are looked up; many are found side by side among the sorted pairs of hash and place
    d = d.withColumn("__p", F.expr(f"if(size(__d) <= {LOOKED_UP}, array(), array_sort(transform(__h, (x, i) -> struct(x as h, i as p))))"))
    beside = "array_sort(transform(filter(__p, (x, i) -> (i > 0 and x.h = __p[i - 1].h) or (i < __n - 3 and x.h = __p[i + 1].h)), x -> x.p))"
    lookup = "filter(transform(__h, (x, i) -> if(array_contains(__d, x), i, -1)), p -> p >= 0)"
    d = d.withColumn("__r", F.expr(f"case when size(__d) = 0 then array() when size(__d) <= {LOOKED_UP} then {lookup} else {beside} end"))
    covered = "aggregate(__r, named_struct('n', 0L, 'next', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.next), 'next', p + 3), a -> a.n)"
    d = d.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.expr("char_length(array_join(__w, ''))").cast("long"),
        "n_symbols": F.expr(f"char_length(__t) - char_length({bare})").cast("long"),
        "n_dup_lines": F.expr("size(__l) - size(array_distinct(__l))").cast("long"),
        "n_repeat_words": F.expr(covered).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("__t", "__w", "__l", "__n", "__h", "__s", "__d", "__p", "__r")


#: The transformed statistics of a document, as SQL that Spark and DuckDB share.
STATISTICS = [
    "ln(1 + n_words)",
    "ln(word_chars / cast(greatest(n_words, 1) as double))",
    "ln(1 + 100 * n_symbols / cast(greatest(word_chars, 1) as double))",
    "ln(1 + n_dup_lines)",
    "ln(1 + 10 * n_repeat_words / cast(greatest(n_words, 1) as double))",
]
P = len(STATISTICS)
LANGUAGE = "coalesce(concat('=', lang), '')"
GROUP = f"concat({LANGUAGE}, chr(10), coalesce(concat('=', source), ''))"


AT = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: The squared distance of each start, as SQL of the rows less their medians and of the median absolute deviations d0, d1 ...
SPREAD = [f"(x{i} / (1.4826 * d{i} + {FLOOR * SCALE}))" for i in range(P)]
STARTS = [" + ".join(f"{z} * {z}" for z in SPREAD), *[f"{z} * {z}" for z in SPREAD]]
MOMENTS = [("n", "count(*)"), *[(f"s{i}", f"sum(x{i})") for i in range(P)], *[(f"s{i}{j}", f"sum(x{i} * x{j})") for i, j in PAIRS]]
ESTIMATE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS] + ["det"]


def estimate_columns() -> list[tuple[str, str]]:
    """Columns (name, SQL), each naming earlier ones only: mean, covariance and Cholesky factor of the moments, and det, the root of the determinant."""
    out = [(f"m{i}", f"s{i} / n / {SCALE}") for i in range(P)]
    out += [(f"c{i}{j}", f"s{i}{j} / n / {SCALE * SCALE} - m{i} * m{j}" + (f" + {FLOOR * FLOOR}" if i == j else "")) for i, j in PAIRS]
    for i, j in PAIRS:
        part = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append((f"l{i}{j}", f"sqrt(greatest({part}, {FLOOR * FLOOR}))" if i == j else f"({part}) / l{j}{j}"))
    return [*out, ("det", " * ".join(f"l{i}{i}" for i in range(P)))]


def distance_columns() -> tuple[list[tuple[str, str]], str]:
    """Columns (name, SQL), each naming earlier ones only, and SQL for the squared Mahalanobis distance of a row from its group's estimate."""
    out = [(f"y{i}", f"(x{i} / cast({SCALE} as double) - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}") for i in range(P)]
    return out, " + ".join(f"y{i} * y{i}" for i in range(P))


def bucket(distance: str) -> str:
    return f"cast(least(floor(({distance}) * 64), {TOP}) as bigint)"


def of_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined to their group's row; a group's rows are spread over SALTS keys, so that a large one is no single task's."""
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("__salt", F.pmod(F.col("key"), F.lit(SALTS))).join(spread, ["g", "__salt"]).drop("__salt")


def _with(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    for name, sql in columns:
        df = df.withColumn(name, F.expr(sql))
    return df


def _summed(rows: DataFrame) -> DataFrame:
    """Of rows (g, s, q, x0 ...) the moments by group, start and bucket, with below, the rows in lesser buckets, and total."""
    sums = rows.groupBy("g", "s", "q").agg(*[F.expr(sql).alias(name) for name, sql in MOMENTS])
    one = W.partitionBy("g", "s")
    return sums.withColumn("below", F.sum("n").over(one.orderBy("q")) - F.col("n")).withColumn("total", F.sum("n").over(one))


def _estimates(rows: DataFrame) -> DataFrame:
    """g, s and the estimate from the three quarters of rows (g, s, q, x0 ...) in the least buckets."""
    best = _summed(rows).where("4 * below < 3 * total").groupBy("g", "s")
    moments = best.agg(*[F.sum(F.col(name).cast("decimal(38,0)")).cast("double").alias(name) for name, _ in MOMENTS])
    return _with(moments, estimate_columns()).select("g", "s", *ESTIMATE)


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows (g, x0 ...) for each estimate of their group, with d, the squared distance from it."""
    columns, distance = distance_columns()
    out = _with(of_group(rows, estimates), columns)
    return out.select(*rows.columns, "s", F.expr(distance).alias("d"))


def _least(estimates: DataFrame, kept: int) -> DataFrame:
    """Of each group the ``kept`` estimates with the least determinant."""
    return estimates.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy("det", "s"))).where(F.col("place") <= kept).drop("place")


def mcd_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """g, s and the estimate of each group of rows (g, x0 ..., whole numbers near zero)."""
    q = lambda d: F.expr(bucket(d))
    spread = rows.groupBy("g").agg(*[F.percentile(F.abs(x), F.lit(0.5)).alias(f"d{i}") for i, x in enumerate(AT)])
    begun = of_group(rows, spread).select("g", *AT, F.posexplode(F.array(*[F.expr(s) for s in STARTS])).alias("s", "d"))
    now = written(_estimates(begun.select("g", "s", *AT, q("d").alias("q"))), "estimates")
    settled = []
    for step in range(1, steps):
        if step == FIRST_STEPS:
            now = written(_least(now, STARTS_KEPT), "estimates")
        before = now.select("g", "s", F.xxhash64(*ESTIMATE).alias("was"))
        new = _estimates(_measured(rows, now).select("g", "s", *AT, q("d").alias("q"))).join(before, ["g", "s"])
        now = written(new.withColumn("same", F.xxhash64(*ESTIMATE) == F.col("was")).drop("was"), "estimates")
        if step >= FIRST_STEPS:  # an estimate that a step leaves as it is stays so: its group goes through no further step
            settled.append(now.where("same").drop("same"))
            now = now.where("not same")
            if now.isEmpty():
                break
        now = now.drop("same")
    now = now.select("g", "s", *ESTIMATE)
    for part in settled:
        now = now.union(part.select("g", "s", *ESTIMATE))
    return _least(now, 1)


def mcd_distances(rows: DataFrame, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> DataFrame:
    """Of rows (key, g, x0 ... whole numbers) those in groups of ``least_rows`` or more, with d2, the scaled squared distance."""
    centre = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(x, F.lit(0.5)).alias(f"m{x}") for x in AT]).where(F.col("n") >= least_rows).drop("n")
    rows = written(of_group(rows, centre).select("key", "g", *[F.expr(f"x{i} - cast(floor(mx{i}) as bigint)").alias(x) for i, x in enumerate(AT)]), "centred")
    estimates = written(mcd_estimates(rows, steps), "estimates")
    found = _measured(rows, estimates)
    scale = _summed(found.select("g", "s", *AT, F.expr(bucket("d")).alias("q"))).where("4 * below < 3 * total").groupBy("g").agg(F.max("q").alias("cut"))
    return of_group(found.select("key", "g", "d"), written(scale, "scale")).select("key", "g", F.expr(f"d * 64 * {CHI2_THREE_QUARTERS} / greatest(cut, 1)").alias("d2"))


def pooled(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """rows (key from 0, g, l, x0 ...) in the group they are judged by; a row that only counts in a larger group's estimate is there once more as -1 - key.

    Groups are '0' and g, '1' and the language l of groups that are too small, and '2' for languages that are.
    """
    groups = rows.groupBy("g", "l").agg(F.count("*").alias("n"))
    languages = groups.groupBy("l").agg(F.sum("n").alias("in_l"), F.min("n").alias("least"))
    whole = languages.agg(F.coalesce(F.max(F.expr(f"least < {least_rows} and in_l < {least_rows}")), F.lit(False)).alias("all"))
    level = f"case when n >= {least_rows} then 0 when in_l >= {least_rows} then 1 else 2 end"
    used = f"filter(array(if(n >= {least_rows}, 0, -1), if(least < {least_rows} and in_l >= {least_rows}, 1, -1), if(all, 2, -1)), v -> v >= 0)"
    groups = written(groups.join(languages, "l").crossJoin(whole).select("g", F.expr(level).alias("own"), F.expr(used).alias("used")), "groups")
    at = [f"x{i}" for i in range(P)]
    rows = of_group(rows, groups).select("key", "g", "l", "own", F.explode("used").alias("v"), *at)
    return rows.select(F.expr("if(v = own, key, -1 - key)").alias("key"), F.expr("case v when 0 then concat('0', g) when 1 then concat('1', l) else '2' end").alias("g"), *at)


def judged(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance (null where the base rule failed)."""
    base = base_counts(docs.select("doc_id", "text", F.expr(GROUP).alias("g"), F.expr(LANGUAGE).alias("l")))
    base = written(base.drop("text").withColumn("key", F.monotonically_increasing_id()), "counts")
    rows = base.where("not base_failed").select("key", "g", "l", *[F.expr(f"cast(round({SCALE} * ({s})) as bigint)").alias(f"x{i}") for i, s in enumerate(STATISTICS)])
    rows = written(pooled(rows, least_rows), "pooled")
    found = mcd_distances(rows, 1).where("key >= 0").select("key", F.col("d2").alias("distance"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return base.join(found, "key", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("distance")


def oracle() -> str:
    """The query in DuckDB's SQL: windows and estimates spelled out step by step."""
    xs = ", ".join(AT)
    columns, distance = distance_columns()
    moments = ", ".join(f"{sql}::HUGEINT AS {name}" for name, sql in MOMENTS)
    steps: list[str] = []

    def with_columns(source: str, named: list[tuple[str, str]]) -> str:
        """A subquery a column: names of the same SELECT would be replaced by their expressions, which then double and double again."""
        for name, sql in named:
            source = f"(SELECT *, {sql.replace(' / n / ', ' / n::DOUBLE / ')} AS {name} FROM {source})"
        return source

    def step(k: int, measured: str) -> None:
        """The estimates e{k} from rows (g, s, q, x0 ...)."""
        steps.extend([
            f"h{k} AS MATERIALIZED (SELECT g, s, q, {moments} FROM ({measured}) GROUP BY g, s, q)",
            f"b{k} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY g, s ORDER BY q) - n AS below, sum(n) OVER (PARTITION BY g, s) AS total FROM h{k})",
            f"e{k} AS MATERIALIZED (SELECT g, s, {', '.join(ESTIMATE)} FROM {with_columns('(SELECT g, s, ' + ', '.join(f'sum({name}) AS {name}' for name, _ in MOMENTS) + f' FROM b{k} WHERE 4 * below < 3 * total GROUP BY g, s)', estimate_columns())})",
        ])

    def least(name: str, source: str, kept: int) -> None:
        steps.append(f"{name} AS MATERIALIZED (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, s) <= {kept})")

    def measured(source: str) -> str:
        return f"SELECT key, g, s, {xs}, {distance} AS d FROM {with_columns(f'(SELECT * FROM centred JOIN {source} USING (g))', columns)}"

    step(0, " UNION ALL ".join(f"SELECT g, {s} AS s, {xs}, {bucket(sql)} AS q FROM centred JOIN spread USING (g)" for s, sql in enumerate(STARTS)))
    last = "e0"
    for k in range(1, STEPS):
        if k == FIRST_STEPS:
            least("better", last, STARTS_KEPT)
            last = "better"
        step(k, f"SELECT g, s, {xs}, {bucket('d')} AS q FROM ({measured(last)})")
        last = f"e{k}"
    least("chosen", last, 1)
    statistics = ", ".join(f"round({SCALE} * ({s}))::BIGINT AS x{i}" for i, s in enumerate(STATISTICS))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS key, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT key, i, array_to_string(words[i:i + 2], ' ') AS k
  FROM (SELECT key, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
repeated AS (SELECT key, k FROM windows GROUP BY key, k HAVING count(*) > 1),
covered AS (
  SELECT key, count(DISTINCT pos) AS n FROM (SELECT key, unnest([i, i + 1, i + 2]) AS pos FROM windows JOIN repeated USING (key, k)) GROUP BY key),
base AS MATERIALIZED (
  SELECT key, doc_id, {GROUP} AS g, {LANGUAGE} AS l, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(words) < {MIN_WORDS} OR 100 * coalesce(covered.n, 0) > {MAX_REPEATED_PERCENT} * len(words) AS base_failed
  FROM w LEFT JOIN covered USING (key)),
single AS (SELECT key, g, l, {statistics} FROM base WHERE NOT base_failed),
sized AS (SELECT *, count(*) OVER (PARTITION BY g) AS in_g, count(*) OVER (PARTITION BY l) AS in_l FROM single),
own AS MATERIALIZED (SELECT *, CASE WHEN in_g >= {LEAST_ROWS} THEN 0 WHEN in_l >= {LEAST_ROWS} THEN 1 ELSE 2 END AS v FROM sized),
pools AS MATERIALIZED (
  SELECT v = 0 AS judged, key, '0' || g AS g, {xs} FROM own WHERE in_g >= {LEAST_ROWS}
  UNION ALL SELECT v = 1, key, '1' || l, {xs} FROM own WHERE in_l >= {LEAST_ROWS}
  UNION ALL SELECT v = 2, key, '2', {xs} FROM own),
wanted AS (SELECT g FROM pools GROUP BY g HAVING bool_or(judged)),
centre AS MATERIALIZED (SELECT g, {', '.join(f'floor(quantile_cont({x}, 0.5))::BIGINT AS m{x}' for x in AT)} FROM pools JOIN wanted USING (g) GROUP BY g),
centred AS MATERIALIZED (SELECT judged, key, g, {', '.join(f'{x} - m{x} AS {x}' for x in AT)} FROM pools JOIN centre USING (g)),
spread AS MATERIALIZED (SELECT g, {', '.join(f'quantile_cont(abs({x}), 0.5) AS d{i}' for i, x in enumerate(AT))} FROM centred GROUP BY g),
{', '.join(steps)},
measured AS MATERIALIZED (SELECT *, {bucket('d')} AS q FROM ({measured('chosen').replace('SELECT key', 'SELECT judged, key')})),
counted AS (SELECT g, q, count(*) AS n FROM measured GROUP BY g, q),
placed AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY q) - n AS below, sum(n) OVER (PARTITION BY g) AS total FROM counted),
scale AS (SELECT g, max(q) AS cut FROM placed WHERE 4 * below < 3 * total GROUP BY g),
found AS (SELECT key, d * 64 * {CHI2_THREE_QUARTERS} / greatest(cut, 1) AS d2 FROM measured JOIN scale USING (g) WHERE judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept
FROM base LEFT JOIN found USING (key)
"""
