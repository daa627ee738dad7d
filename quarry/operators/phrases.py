"""Phrase retrieval: which of a table of phrases a text holds, by an inverted index on rare words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

WORD = "[A-Za-z0-9]+"


def lowered(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def holds(text: str, phrase: str) -> str:
    """SQL for whether a phrase stands in a text with no ASCII letter or digit beside it."""
    quoted = f"concat('\\\\Q', replace({phrase}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    # most candidates fall at the plain search, before a pattern is made
    return f"contains({text}, {phrase}) and {text} rlike concat('(?<![A-Za-z0-9])', {quoted}, '(?![A-Za-z0-9])')"


def signs_of(text: Column) -> Column:
    """Distinct characters that are no ASCII letters or digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)[^A-Za-z0-9]"), F.lit(0)))


def candidates(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, ord and phrase where the text (lowered) holds the phrase's rarest word.

    A phrase stands between characters that are no letters or digits, so each of its words is a word of the text.  How many
    texts hold a word is counted for the words of phrases only.  A phrase without a word goes by its rarest character.
    """
    bare = phrases.where(F.size(words_of(F.col("phrase"))) == 0)
    parts = phrases.select("ord", "phrase", F.explode(words_of(F.col("phrase"))).alias("word")).union(bare.select("ord", "phrase", F.explode(signs_of(F.col("phrase")))))
    units = words_of(F.col("text")) if bare.isEmpty() else F.concat(words_of(F.col("text")), signs_of(F.col("text")))
    words = docs.select("doc_id", F.explode(units).alias("word"))
    held = written(words.join(parts.select("word").distinct(), "word", "left_semi"), "phrase-words")
    spread = held.groupBy("word").agg(F.count("*").alias("n"))
    # a word that no text holds is the rarest of all
    known = parts.join(spread, "word", "left").groupBy("ord", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare"))
    index = known.where("rare.n > 0").select("ord", "phrase", F.col("rare.word").alias("word"))
    return held.join(index, "word").select("doc_id", "ord", "phrase")


def first_phrase(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, ord and phrase: of the phrases (ord, phrase) that a document's text holds, that of the least ord.

    A-Z count as a-z in texts and phrases.  Documents that hold none give no row; null texts and empty phrases hold nothing.
    """
    docs = docs.select("doc_id", lowered(F.col("text")).alias("text")).where("text is not null")
    phrases = phrases.select("ord", lowered(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    # the text goes once to the list of its candidates, which is at most the table of phrases
    listed = candidates(docs, phrases).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("ord", "phrase"))).alias("c"))
    held = docs.join(listed, "doc_id").select("doc_id", F.expr(f"get(filter(c, x -> {holds('text', 'x.phrase')}), 0)").alias("hit"))
    return held.where("hit is not null").select("doc_id", "hit.ord", "hit.phrase")
