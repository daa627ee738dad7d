"""Queries in SQL that Spark runs and, after renaming functions, DuckDB runs too.

``add`` registers a query from one text; ``pair`` from two texts or a DataFrame function and a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Functions that have another name in DuckDB.
NAMES = {
    "split": "string_split", "size": "len", "transform": "list_transform", "filter": "list_filter", "array": "list_value",
    "array_sort": "list_sort", "array_distinct": "list_distinct", "array_contains": "list_contains", "array_join": "array_to_string",
    "array_max": "list_max", "array_min": "list_min", "array_position": "list_position", "array_intersect": "list_intersect",
    "sequence": "generate_series", "explode": "unnest", "collect_list": "list", "element_at": "list_extract", "regexp_like": "regexp_matches",
    "startswith": "starts_with", "flatten": "flatten", "arrays_overlap": "list_has_any", "get_json_object": "json_extract_string",
}


def _argument(text: str, start: int) -> int:
    """The place of the bracket that closes the one before ``start``."""
    depth, quoted = 1, False
    for i in range(start, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if not depth:
                return i
    raise ValueError(text[start:])


def _split(text: str) -> list[str]:
    """The arguments in a list of arguments."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append(text[last:i].strip())
                last = i + 1
    return [*out, text[last:].strip()]


#: Macros: what becomes of the arguments in Spark and in DuckDB.
MACROS: dict[str, tuple[Callable[..., str], Callable[..., str]]] = {
    # a reproducible draw from 0 to 2^32 - 1
    "draw": (lambda x: f"cast(conv(substr(md5({x}), 1, 8), 16, 10) as bigint)", lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"),
    "one_decimal": (lambda x: f"format_number({x}, '0.0')", lambda x: f"printf('%.1f', {x})"),
    "half_even": (lambda x: f"rint({x})", lambda x: f"round_even({x}, 0)"),
    "sha": (lambda x: f"sha2({x}, 256)", lambda x: f"sha256({x})"),
    "replace_all": (lambda a, b, c: f"regexp_replace({a}, {b}, {c})", lambda a, b, c: f"regexp_replace({a}, {b}, {c}, 'g')"),
    "fold": (lambda a, i, f: f"aggregate({a}, {i}, {f})", lambda a, i, f: f"list_reduce({a}, {f}, {i})"),
    "zero": (lambda i: i, lambda i: f"({i} - 1)"),
    "part": (lambda a, s, n: f"slice({a}, {s}, {n})", lambda a, s, n: f"list_slice({a}, {s}, ({s}) + ({n}) - 1)"),
    "json": (lambda *p: f"to_json(named_struct({', '.join(p)}), map('ignoreNullFields', 'false'))", lambda *p: "to_json({" + ", ".join(f"{k}: {v}" for k, v in zip(p[::2], p[1::2])) + "})::VARCHAR"),
    "words": (lambda x: f"array_remove(split({x}, ' '), '')", lambda x: f"list_filter(string_split({x}, ' '), lambda w_: w_ <> '')"),
    "without": (lambda a, b: f"array_except({a}, {b})", lambda a, b: f"list_filter({a}, lambda w_: NOT list_contains({b}, w_))"),
    "unescaped": (lambda x: x.replace("\\", "\\\\"), lambda x: x),
    "listed": (lambda x, o: f"array_join(transform(array_sort(collect_list(named_struct('o', {o}, 'x', {x}))), v_ -> v_.x), ',')", lambda x, o: f"string_agg({x}, ',' ORDER BY {o}, {x})"),
    "last_known": (lambda x: f"last_value({x}) ignore nulls", lambda x: f"last_value({x} ignore nulls)"),
    "repeat_list": (lambda x, n: f"array_repeat({x}, {n})", lambda x, n: f"list_transform(generate_series(1, {n}), lambda w_: {x})"),
    "epoch_us": (lambda x: f"unix_micros(cast({x} as timestamp))", lambda x: f"epoch_us({x})"),
}


def expand(text: str, duck: bool) -> str:
    """Macros ``@name(arguments)`` replaced, inner ones first."""
    while m := list(re.finditer(r"@(\w+)\(", text)):
        m = m[-1]
        end = _argument(text, m.end())
        text = text[: m.start()] + MACROS[m[1]][duck](*_split(text[m.end() : end])) + text[end + 1 :]
    return text


def to_duckdb(text: str) -> str:
    text = expand(text, True)
    text = re.sub(r"\((\w+), (\w+)\) ->", r"lambda \1, \2:", text)
    text = re.sub(r"\b(\w+) ->", r"lambda \1:", text)
    text = re.sub(r"(?<![\w.])(" + "|".join(NAMES) + r")\(", lambda m: NAMES[m[1]] + "(", text)
    return re.sub(r"\bdiv\b", "//", text)


def to_spark(text: str) -> str:
    """In Spark's string literals a backslash escapes."""
    return re.sub(r"'[^']*'", lambda m: m[0].replace("\\", "\\\\"), expand(text, False))


def view(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        view(spark, sf_dir, text)
        return spark.sql(to_spark(text))

    return query


def add(key: str, text: str) -> None:
    QUERIES[key], ORACLES[key] = run(text), to_duckdb(text)


def pair(key: str, query, oracle: str | None = None) -> None:
    QUERIES[key] = run(query) if isinstance(query, str) else query
    if oracle:
        ORACLES[key] = to_duckdb(oracle)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
