"""Line dedup in DataFrame functions (operator 6).

Long enough lines are exploded with a 128-bit hash of their key; documents are counted per hash after a partial
distinct; what a document loses comes back to it as an array of hashes, and its lines are reassembled in their
positions.  Texts are shuffled once, for that join, and nothing else of their size is.  The hashes are written once, and the
documents of a very frequent line are split over tasks (``shared.join_counted``).

Defined results: a null or empty text is one empty line; a null doc_id is not counted as a document and loses
nothing; rows that repeat a doc_id count once and lose the same lines; an empty table gives no rows; further
columns, whatever their names, are kept by ``clean`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE_CHARS, UPPER, documents, join_counted, written

MIN_CHARS, MIN_DOCS = 40, 5


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(key_of(line)))


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id and gone: the hashes of the lines that each document loses."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(SPACE_CHARS))) >= min_chars).select("id", _hash(F.col("line")).alias("h"))
    held = written(lines.distinct(), "lines")
    common = written(held.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs), "common-lines")
    return join_counted(held, common, "h", "n").where("id <> last").groupBy("id").agg(F.collect_list("h").alias("gone"))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (all columns of ``docs``), n_lines, the lines' number, and kept, the lines that stay."""
    common = common_lines(docs, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(common, F.col("row.doc_id") == common["id"], "left").select("row", "gone", F.split(F.coalesce("row.text", F.lit("")), "\n").alias("lines"))
    stay = F.filter("lines", lambda x: ~(F.coalesce(F.char_length(F.btrim(x, F.lit(SPACE_CHARS))) >= min_chars, F.lit(False)) & F.array_contains(F.col("gone"), _hash(x))))
    return joined.select("row", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; texts that lose a line are rejoined, and n_chars, if there, follows them."""
    cut = drop_common_lines(docs)
    changed = F.size("kept") < F.col("n_lines")
    cut = cut.select("row", changed.alias("changed"), F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("text"))
    follow = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.char_length("text")).otherwise(F.col("row")["n_chars"])}
    return cut.select(*[(follow[c].cast(docs.schema[c].dataType) if c in follow else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = drop_common_lines(docs)
    return cut.select("row.doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
flagged AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
