"""Substring dedup by level-wise doubling (operator 4).

Windows of one length are hashed from the two windows of half the length that they consist of.  The first level
hashes windows of 9 words, and of each 35-word window it sends only the one with the least hash; equal windows
have equal least hashes, so none is missed and seven in a hundred are sent.  A window whose 9 words are repeated
is extended to 18 words around them, and if those are repeated too, to its whole length (twice 18, the halves
sharing a word).  Only the documents that still have a candidate go on to the next level, and the levels end
when no candidate survives or the length is reached.  Counts are taken over all documents.

Documents with the same words are counted once with weight two: all their windows are repeated, so they need no
further level themselves.

Windows are compared by hashes of the words' own 64-bit hashes: of 64 bits on the levels that only select, of 96 bits on
the last; within one document 64 bits say which of its windows were found repeated.  Texts are joined to their survivors by doc_id and a hash of the text, so that rows of one id, or of none, do not
meet all with all.

Defined results: a null text has no words; a null doc_id is a document like any other; rows that repeat a
doc_id are documents of their own; a text of fewer words than a window loses nothing; an empty table gives no
rows; further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, Cache, batched, discard, documents, join_counted, kept_in_worker, lists, small_batches, written

WINDOW = 35
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
K3, K4 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class WordHash(Cache):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(word)
        self.put(word, h, len(word))
        return h


def word_hashes() -> WordHash:
    """The cache of this Python process, kept from task to task."""
    return kept_in_worker(("words",), lambda: WordHash(64 << 20))


def mixed(left: np.ndarray, right: np.ndarray, k1: np.uint64 = K1, k2: np.uint64 = K2) -> np.ndarray:
    """The hash of a pair of hashes."""
    x = left * k1 + (right ^ (right >> np.uint64(29))) * k2
    x ^= x >> np.uint64(32)
    x *= k1
    x ^= x >> np.uint64(29)
    return x


class Windows:
    """The hashed windows of one document; ``window`` is the target length, at least 4 words."""

    def __init__(self, words: list[bytes], hashes: WordHash, window: int):
        self.window, self.half = window, -(-window // 2)
        self.quarter = -(-self.half // 2)
        level, length = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), 1
        self.words, made = level, {}
        for target in (self.quarter, self.half, window):
            while length < target:
                step = min(length, target - length)
                level = mixed(level[:-step], level[step:])
                length += step
            made[target] = level
        self.small, self.middle, self.whole = made[self.quarter], made[self.half], made[window]
        self.n = len(self.whole)

    def least(self) -> np.ndarray:
        """For each whole window the place of its leftmost least small window."""
        value, at, length = self.small, np.arange(len(self.small)), 1
        width = self.window - self.quarter + 1
        while length < width:
            step = min(length, width - length)
            first = value[:-step] <= value[step:]
            value, at = np.where(first, value[:-step], value[step:]), np.where(first, at[:-step], at[step:])
            length += step
        return at

    def second(self) -> np.ndarray:
        """Further 32 bits of each whole window's hash."""
        level, length = self.words, 1
        while length < self.window:
            step = min(length, self.window - length)
            level = mixed(level[:-step], level[step:], K3, K4)
            length += step
        return level >> np.uint64(32)

    def sent(self, level: int, survived: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes that this document sends at a level, distinct, how often each occurs, and on the last level the hashes' further bits."""
        if not self.n:
            return NONE
        at = self.least()
        if level == 0:
            places, source = np.unique(at), self.small
        else:
            start = self.extended(at)
            if level == 1:
                places, source = np.unique(start[np.isin(self.small[at], survived)]), self.middle
            else:
                places = np.flatnonzero(np.isin(self.middle[start], survived))
                both = np.unique(np.stack([self.whole[places], self.second()[places]]), axis=1, return_counts=True)
                return both[0][0], both[1], both[0][1]
        return *np.unique(source[places], return_counts=True), NONE[2]

    def extended(self, at: np.ndarray) -> np.ndarray:
        """Where the middle window around a small one starts: with it if there is room to the right, else so as to end with it."""
        right = at + self.half <= np.arange(self.n) + self.window
        return np.where(right, at, at + self.quarter - self.half)

    def kept(self, repeated: np.ndarray) -> np.ndarray:
        """A mask of the words that no repeated window covers."""
        change = np.zeros(self.n + self.window, np.int64)
        hit = np.flatnonzero(np.isin(self.whole, repeated)) if self.n else np.empty(0, np.int64)
        change[hit] += 1
        change[hit + self.window] -= 1
        return np.cumsum(change)[:-1] == 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


NONE = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
SENT = "hashes array<bigint>, counts array<bigint>, further array<int>"
SENT_NAMES = ["hashes", "counts", "further"]
TEXTS = ["doc_id", "at", "text", "weight"]
#: Window lengths: a quarter, a half and the whole of the target.
LEVELS = 3
CHARS = 1_000_000


def _sent_columns(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    longs = [lists([np.ascontiguousarray(r[k]).view(np.int64) for r in rows], pa.int64(), np.int64) for k in range(2)]
    return [*longs, lists([r[2].astype(np.uint32).view(np.int32) for r in rows], pa.int32(), np.int32)]


def _first(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batched(texts, CHARS):
                n, digests, rows = [], [], []
                for text in texts[a:b]:
                    words = words_of(text)
                    n.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).digest())
                    rows.append(Windows(words, cache, window).sent(0, None) if len(words) >= window else NONE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *_sent_columns(rows)], ["doc_id", "at", "n_words", "digest", *SENT_NAMES])

    return small_batches(docs.select("doc_id", "text", "at")).mapInArrow(scan, f"doc_id long, at long, n_words long, digest binary, {SENT}")


def _next(candidates: DataFrame, window: int, level: int) -> DataFrame:
    """What documents (doc_id, at, text, weight, survived) send at a level."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batched(texts, CHARS):
                rows = []
                for text, survived in zip(texts[a:b], batch.column("survived").slice(a, b - a)):
                    values = survived.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    rows.append(Windows(words_of(text), cache, window).sent(level, values))
                kept = [batch.column(c).slice(a, b - a) for c in TEXTS]
                yield pa.RecordBatch.from_arrays([*kept, *_sent_columns(rows)], [*TEXTS, *SENT_NAMES])

    return small_batches(candidates.select(*TEXTS, "survived")).mapInArrow(scan, f"doc_id long, at long, text string, weight int, {SENT}").where("size(hashes) > 0")


def _survivors(sent: DataFrame, last: bool = False) -> DataFrame:
    """Of rows (doc_id, at, weight, hashes, counts, further), survived: each document's hashes that occur twice or more over all rows.

    On the last level hashes are equal if their further bits are, too, and only documents of weight one are told, since copies lose all words.
    """
    keys = ["doc_id", "at", "weight"]
    rows = sent.select(*keys, F.explode(F.arrays_zip(*SENT_NAMES[: 3 if last else 2])).alias("x"))
    h = F.struct(F.col("x.hashes").alias("h"), F.col("x.further").alias("f")) if last else F.col("x.hashes")
    rows = rows.select(*keys, h.alias("h"), (F.col("x.counts") * F.col("weight")).alias("n"))
    repeated = written(rows.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n >= 2").select("h", "rows"), "repeated")
    told = rows.where("weight = 1") if last else rows
    found = join_counted(told.drop("n"), repeated, "h", "rows")
    return found.select(*keys, F.col("h.h").alias("h") if last else "h").groupBy(*keys).agg(F.collect_list("h").alias("survived"))


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Of rows (doc_id, text, survived) the digest of the words and the words that stay."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for a, b in batched(whole, CHARS):
                texts, removed, digests = [], [], []
                for text, survived in zip(whole[a:b], batch.column("survived").slice(a, b - a)):
                    words = words_of(text)
                    kept = Windows(words, cache, window).kept(survived.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    digests.append(hashlib.sha256(b" ".join(words)).digest())
                    texts.append(b" ".join(w for w, k in zip(words, kept) if k).decode("utf-8", "replace"))
                    removed.append(len(words) - int(kept.sum()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(digests, pa.binary()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "digest", "n_removed", "kept"])

    return small_batches(rows.select("doc_id", "text", "survived")).mapInArrow(scan, "doc_id long, digest binary, n_removed long, kept string")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(summary, cut): per row of ``docs`` doc_id, n_words, digest (of the joined words) and copied; per document that
    loses words, and is not a copy, doc_id, digest, n_removed and kept, the text of the words that stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("at", F.xxhash64("text"))
    first = written(_first(docs, window), "windows-0")
    copies = first.where(F.col("n_words") >= window).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("x")).where("n > 1")
    copies = written(copies.select("digest", F.col("x.doc_id").alias("least")), "copies")
    summary = first.select("doc_id", "n_words", "digest").join(copies.select("digest", F.lit(True).alias("copied")), "digest", "left").select("doc_id", "n_words", "digest", F.coalesce("copied", F.lit(False)).alias("copied"))
    marked = first.where("size(hashes) > 0").join(copies, "digest", "left").where("least is null or doc_id is null or doc_id = least")
    # a copy whose least row stands for all; rows that repeat that very id and text are taken once
    sent, same = marked.withColumn("weight", F.when(F.col("least").isNotNull(), 2).otherwise(1)).select("doc_id", "at", "weight", *SENT_NAMES), docs
    for level in range(1, LEVELS):
        # a document is known by its id and a hash of its text; its digest would be most of what the hashes' rows weigh
        right = _survivors(sent).withColumnsRenamed({"doc_id": "__id", "at": "__at", "weight": "__w"})
        candidates = same.drop("weight").join(right, same["doc_id"].eqNullSafe(right["__id"]) & (same["at"] == right["__at"])).withColumnRenamed("__w", "weight")
        last, sent = sent, written(_next(candidates, window, level), f"windows-{level}")
        if level > 1:
            discard(last)
        if sent.isEmpty():
            return summary, docs.sparkSession.createDataFrame([], "doc_id long, digest binary, n_removed long, kept string")
        same = sent.select(*TEXTS)
    right = _survivors(sent, True).select(F.col("doc_id").alias("__id"), F.col("at").alias("__at"), "survived")
    last = same.where("weight = 1").join(right, same["doc_id"].eqNullSafe(right["__id"]) & (same["at"] == right["__at"]))
    return summary, _cut(last, window)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    summary, cut = repeated_windows(docs, window)
    cut = cut.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), "n_removed", F.sha2("kept", 256).alias("sha"))
    joined = summary.join(cut, (summary["digest"] == cut["__d"]) & summary["doc_id"].eqNullSafe(cut["__id"]), "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs``; texts that lose words are the kept words joined by spaces, and n_chars, if there, follows them."""
    summary, cut = repeated_windows(docs, window)
    emptied = summary.where("copied").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), F.lit("").alias("__kept")).distinct()
    changed = cut.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), F.col("kept").alias("__kept")).distinct().union(emptied)
    words = F.array_remove(F.split(F.translate("row.text", SPACE_CHARS[1:], " " * 5), " "), "")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.unhex(F.sha2(F.coalesce(F.array_join(words, " "), F.lit("")), 256)).alias("digest"))
    joined = rows.join(changed, F.col("row.doc_id").eqNullSafe(changed["__id"]) & (rows["digest"] == changed["__d"]), "left")
    follow = {"text": F.coalesce("__kept", "row.text"), "n_chars": F.coalesce(F.char_length("__kept"), F.col("row")["n_chars"])}
    return joined.select(*[(follow[c].cast(docs.schema[c].dataType) if c in follow else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))


#: Exact windows in SQL, for small tables.
ORACLE = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM windows WHERE k IN (SELECT k FROM repeated)),
lists AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id),
placed AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM w),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS text FROM placed p
  ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
