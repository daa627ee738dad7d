"""A binary model file: header, tensor table, aligned tensors, checksum; written, and read with every field checked.

Layout (little-endian): magic ``QMOD``, version, number of tensors, CRC-32 of everything after the header, bytes of the
tokenizer; the tokenizer's own file (see tokenizer_blob.py); then a record for each tensor (name of 32 bytes, dtype, rows, columns, place,
bytes); then the tensors, each at a multiple of 16.  A tensor is a list of records of one form, so that any row can be read on its own:

* 0: a row is its float32 values;
* 1: a row is a float32 scale and one signed byte a value;
* 2: 32 values are a float16 scale and 16 bytes, each with two values of four bits, the even column in the low half.  The
  number of columns is a multiple of 32; other tensors are written as type 1.

A value is its stored number times the scale.  Scales are the largest magnitude over 127 or 7, or one for zeros.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HEAD = struct.Struct("<4sIIII")
ENTRY = np.dtype([("name", "S32"), ("dtype", "<u4"), ("rows", "<u4"), ("columns", "<u4"), ("place", "<u4"), ("bytes", "<u4")])
SCHEMA = "name string, dtype int, row int, values array<float>"
BLOCK = 32


@dataclass(frozen=True)
class Form:
    """How a tensor's values are stored: a record of ``width`` values, and the largest stored number (0: as they are)."""

    width: int
    record: np.dtype
    limit: int

    @staticmethod
    def of(dtype: int, columns: int) -> Form:
        if dtype == 0:
            return Form(columns, np.dtype([("values", "<f4", (columns,))]), 0)
        if dtype == 1:
            return Form(columns, np.dtype([("scale", "<f4"), ("values", "i1", (columns,))]), 127)
        if dtype == 2 and columns % BLOCK == 0:
            return Form(BLOCK, np.dtype([("scale", "<f2"), ("values", "u1", (BLOCK // 2,))]), 7)
        raise ValueError("tensor")

    def pack(self, x: np.ndarray) -> bytes:
        """The records of a matrix."""
        parts = x.astype("<f4").reshape(-1, self.width)
        out = np.zeros(len(parts), self.record)
        if not self.limit:
            out["values"] = parts
            return out.tobytes()
        peak = np.abs(parts).max(axis=1, initial=0.0).astype(np.float64)
        out["scale"] = np.where(peak > 0, peak / self.limit, 1.0)
        step = out["scale"].astype("<f4").reshape(-1, 1)
        stored = np.round(np.divide(parts, step, out=np.zeros_like(parts), where=step != 0)).clip(-self.limit, self.limit)
        if self.limit == 127:
            out["values"] = stored
        else:
            nibbles = (stored + 8).astype("u1").reshape(len(parts), -1, 2)
            out["values"] = nibbles[:, :, 0] | nibbles[:, :, 1] << 4
        return out.tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        """The values of records, a record a row."""
        held = np.frombuffer(raw, self.record)
        if not self.limit:
            return held["values"]
        stored = held["values"].astype("<f4")
        if self.limit == 7:
            high, low = np.divmod(stored, 16)
            stored = np.dstack([low, high]).reshape(len(held), self.width) - 8
        return stored * held["scale"].astype("<f4").reshape(-1, 1)


def dump(tensors: dict[str, tuple[int, np.ndarray]], tokenizer: bytes = b"") -> bytes:
    table, at = np.zeros(len(tensors), ENTRY), HEAD.size + len(tokenizer) + ENTRY.itemsize * len(tensors)
    data = []
    for i, (name, (dtype, x)) in enumerate(tensors.items()):
        x = np.atleast_2d(x)
        dtype = 1 if dtype == 2 and x.shape[1] % BLOCK else dtype
        raw = Form.of(dtype, x.shape[1]).pack(x)
        gap = -at % 16
        table[i] = (name.encode(), dtype, *x.shape, at + gap, len(raw))
        data += [bytes(gap), raw]
        at += gap + len(raw)
    body = tokenizer + table.tobytes() + b"".join(data)
    return HEAD.pack(b"QMOD", 2, len(tensors), zlib.crc32(body), len(tokenizer)) + body


def check(blob: bytes) -> tuple[bytes, np.ndarray]:
    """The tokenizer and the tensor table; ValueError names what is wrong."""
    if len(blob) < HEAD.size:
        raise ValueError("size")
    magic, version, n, crc, held = HEAD.unpack_from(blob)
    if magic != b"QMOD":
        raise ValueError("magic")
    if version != 2:
        raise ValueError("version")
    if zlib.crc32(memoryview(blob)[HEAD.size :]) != crc:
        raise ValueError("checksum")
    first = HEAD.size + held
    if first + n * ENTRY.itemsize > len(blob):
        raise ValueError("table")
    table = np.frombuffer(blob, ENTRY, n, first)
    for entry in table:
        form = Form.of(int(entry["dtype"]), int(entry["columns"]))
        values = int(entry["rows"]) * int(entry["columns"])
        if not form.width or entry["bytes"] != values // form.width * form.record.itemsize or entry["place"] % 16 or int(entry["place"]) + int(entry["bytes"]) > len(blob):
            raise ValueError("tensor")
    return blob[HEAD.size : first], table


def load(blob: bytes) -> dict[str, tuple[int, np.ndarray]]:
    """The tensors as float32."""
    out = {}
    for entry in check(blob)[1]:
        at, n = int(entry["place"]), int(entry["bytes"])
        values = Form.of(int(entry["dtype"]), int(entry["columns"])).unpack(blob[at : at + n])
        out[entry["name"].decode()] = int(entry["dtype"]), np.array(values, np.float32).reshape(int(entry["rows"]), int(entry["columns"]))
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tensors in the model files of a folder; a file is read by one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                for name, (dtype, x) in load(bytes(blob)).items():
                    yield pd.DataFrame({"name": name, "dtype": dtype, "row": range(len(x)), "values": list(x)})

    return files(spark, path).select("content").mapInPandas(rows, SCHEMA)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.qmod").load(path)


def write(rows: DataFrame, path: str, tokenizer: bytes = b"") -> DataFrame:
    """Writes a model file for each ``model`` of rows (model, name, dtype, row, values) into a folder; returns (model, bytes, crc).

    A model is put together by one task, as its file is one.  The bytes of the files are a table first, so that a task that runs again does no harm.
    """
    from .shared import write_file, written

    def build(one: pd.DataFrame) -> pd.DataFrame:
        tensors = {}
        for name, part in one.sort_values(["name", "row"]).groupby("name", sort=True):
            tensors[name] = int(part["dtype"].iloc[0]), np.stack([np.asarray(v, np.float32) for v in part["values"]])
        blob = dump(tensors, tokenizer)
        return pd.DataFrame({"model": [one["model"].iloc[0]], "blob": [blob]})

    blobs = written(rows.groupBy("model").applyInPandas(build, "model string, blob binary"), "models")
    for row in blobs.toLocalIterator():  # one file at a time
        write_file(rows.sparkSession, f"{path}/{row['model']}.qmod", bytes(row["blob"]))
    return blobs.selectExpr("model", "length(blob) as bytes", "crc32(blob) as crc")
