"""What the text operators share: the shared folder, written tables, word splitting, cached encoding."""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import discard, written  # noqa: F401
from quarry.sources.shared import path_for as shared_path  # noqa: F401

#: The white space that separates words, as a Java class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A key with more than this share of the rows is split; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str, total: int | None = None, part: str | None = None) -> DataFrame:
    """rows joined by ``key`` to ``counted``, one row a key, with ``n``, how many of the rows hold it (n itself is left out).

    ``total`` is the sum of n or more; without it ``counted`` should be a written table, since it is read for the sum.
    No key's rows meet in one task: a key with more than HOT_SHARE of the total is split into parts of that size.
    Such keys are a thousand at most by their very definition, and only they and their numbers of parts are broadcast;
    the other side of a split key is there once for each part, at most a thousand rows more in all.  ``part`` names a
    column for the part that a row is in; rows of a key and part are together.
    """
    if total is None:
        total = counted.agg(F.sum(n)).first()[0] or 0
    size = max(1.0, HOT_SHARE * float(total))
    parts = F.ceil(F.col(n) / size).cast("int")
    few = counted.where(F.col(n) > size).select(key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(few), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "__parts"), F.lit(0)).cast("int"))
    every = F.explode(F.when(F.col(n) > size, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))
    more = [c for c in counted.columns if c not in (key, n)]
    return dealt.join(counted.withColumn("__part", every), [key, "__part"]).select(*rows.columns, *more, *([F.col("__part").alias(part)] if part else []))


#: Rows in an Arrow batch at most: whole texts are in a batch, in the JVM and in Python.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands at most BATCH_ROWS rows to Python at once; Spark reads the setting when the plan runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name))
    if not 0 < held <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


class Cache(dict):
    """A dictionary of byte strings or texts that is emptied when it would hold more than ``limit`` bytes, its own included."""

    #: What an entry takes besides the bytes of its key and value.
    ENTRY = 200

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0

    def put(self, key, value, size: int) -> None:
        self.held += self.ENTRY + size
        if self.held > self.limit:
            self.clear()
            self.held = self.ENTRY + size
        self[key] = value


_KEPT: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """What ``make`` gives, kept in this Python process from task to task.

    One thing is kept at a time: workers outlive their stage, and what a stage kept goes when the next one asks
    for its own.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def lists(parts: list[np.ndarray], kind: pa.DataType, dtype) -> pa.ListArray:
    """An Arrow column of lists from numpy arrays, without Python numbers."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(column):
    """A-Z only; every other letter stays as it is."""
    return F.translate(column, UPPER, LOWER)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


#: The pieces that the two tokenizers cut a text into (their pre-tokenizers' own patterns; fixed values).
SPACE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LEADING_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ChunkEncoder(Cache):
    """Ids of whole texts by the tokenizers library, each distinct chunk of text encoded once.

    A chunk ends where the tokenizer's own pre-tokenizer always ends a piece, so that the ids of a text are
    the ids of its chunks in order.  ``style`` says which rule holds:

    * ``"space"``: the tokenizer drops white space and case; chunks are the runs between ASCII white space.
    * ``"leading"``: a byte-level tokenizer whose pieces carry one leading space; a chunk starts at each
      space that stands beside no other white space.
    * ``"whole"``: no rule; each text is one chunk.

    As a dictionary it holds the ids of chunks as little-endian unsigned 32-bit integers.  A chunk of plain Latin
    letters is cut into its pieces and each distinct piece goes to the library's model; a chunk with any
    other character, or with what may be a special token, goes through the library's whole pipeline.  Chunks and pieces are held
    up to ``limit`` bytes.
    """

    def __init__(self, path: str, style: str, limit: int = 280 << 20):
        super().__init__(limit)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.split = {"space": self._space, "leading": self._leading, "whole": lambda t: [t]}[style]
        # below U+0180 letters have one form, and lower case letter by letter but for U+0130
        self.plain = {"space": regex.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u017F]+"), "leading": regex.compile(r"[\n\x20-\x7E\xA1-\u017F]+"), "whole": None}[style]
        self.pieces = regex.compile(SPACE_PIECES if style == "space" else LEADING_PIECES).findall
        self.lower = style == "space"
        self.letters = dict(enumerate(byte_letters()))

    @staticmethod
    def _space(text: str) -> list:
        return text.encode("utf-8", "replace").split()

    @staticmethod
    def _leading(text: str) -> list[str]:
        import re

        runs = re.split(r"(\s\s+)", text)
        first, *rest = runs[0].split(" ")
        out = [first, *[" " + p for p in rest]]
        for i in range(2, len(runs), 2):
            first, *rest = runs[i].split(" ")
            out[-1] += runs[i - 1] + first
            out += [" " + p for p in rest]
        return out

    def __missing__(self, chunk) -> bytes:
        text = chunk.decode("utf-8", "replace") if isinstance(chunk, bytes) else chunk
        if not self.plain or not self.plain.fullmatch(text) or "<|" in text:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            low = text.lower() if self.lower else text
            pieces = self.pieces(low)
            if pieces == [text]:
                letters = text.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                ids = b"".join([self[p.encode() if self.lower else p] for p in pieces])
        self.put(chunk, ids, len(chunk) + len(ids))
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        get = self.__getitem__
        return [b"".join(map(get, self.split(t))) for t in texts]


def encoder(path: str, style: str) -> ChunkEncoder:
    """The encoder of this Python process: tasks that follow each other in a worker find its cache filled."""
    return kept_in_worker(("encoder", path, style), lambda: ChunkEncoder(path, style))


def batched(texts: list[str | None], size: int = 2_000_000):
    """Slices of about ``size`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
