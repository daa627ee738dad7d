"""Token ids in Arrow files of fixed-size lists (operator 8).

Each shard is an Arrow IPC file whose record batches hold two columns: ``ids``, fixed-size lists of
``length`` ids, and ``mask``, fixed-size lists of booleans that are false on the padding of the shard's last
sequence.  All batches but the last hold ``ROWS`` sequences, so sequence k of a shard is row k mod ROWS of batch k div ROWS: ``Shard``
memory-maps the file and returns it as a slice of the batch, without copying and without reading others; ``TokenFiles`` does
so across shards.  A second Arrow file per shard lists its documents with the place of their first id.

Defined results: a null text is an empty one (its only id is the end id); null ids of documents come first;
documents with the same id follow each other in the order of their texts; an empty table gives no rows and no
shards; further columns of the input are ignored.  A task that is run again writes files under new names, and
only the names in the manifest are read, so lost executors cannot mix two attempts.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, documents, encoder, partitions, shared_path, small_batches, tokenizer_path, written

LENGTH, ROWS = 2048, 64


def open_store(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; ids arrive document by document."""

    def __init__(self, folder: str, length: int, dtype: str):
        self.store, path = open_store(folder)
        self.store.create_dir(path, recursive=True)
        self.base = f"{path}/{uuid.uuid4().hex}"
        self.length, self.dtype = length, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.files = [self.store.open_output_stream(f"{self.base}.{k}.tmp") for k in ("ids", "docs")]
        self.out = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.index_schema)
        self.held, self.n_held, self.total, self.rows = [], 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {int(ids.max())} does not fit {self.dtype}")
        self.rows.append((doc_id, self.total, len(ids)))
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * ROWS:
            self._flush(False)
        if len(self.rows) >= 50_000:
            self._index()

    def _index(self) -> None:
        if self.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)]
            self.docs.write_batch(pa.record_batch(columns, schema=self.index_schema))
            self.rows = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        full = self.length * ROWS  # all batches but the last are full
        real = n = len(flat) if last else len(flat) // full * full
        keep, flat = flat[n:], flat[:n]
        if n % self.length:
            flat = np.concatenate([flat, np.zeros(-n % self.length, self.dtype)])
        for i in range(0, len(flat), self.length * ROWS):
            part = flat[i : i + self.length * ROWS]
            mask = np.arange(i, i + len(part)) < real
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.n_held = ([keep], len(keep)) if len(keep) else ([], 0)

    def close(self) -> tuple[str, int]:
        self._flush(True)
        self._index()
        for w, f in zip((self.out, self.docs), self.files):
            w.close()
            f.close()
        for k in ("ids", "docs"):
            self.store.move(f"{self.base}.{k}.tmp", f"{self.base}.{k}")
        return self.base, self.total


def _open(store, path: str):
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


class Shard:
    """Random access to the sequences of one shard; where the folder is local, ids and mask lie in the mapped file."""

    def __init__(self, folder: str, base: str):
        store, _ = open_store(folder)
        self.source = _open(store, f"{base}.ids")
        self.file = pa.ipc.open_file(self.source)
        n = self.file.num_record_batches
        self.n = (n - 1) * ROWS + len(self.file.get_batch(n - 1)) if n else 0

    def __len__(self) -> int:
        return self.n

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """The ids of sequence k and their mask, as slices; ``ids.to_numpy()`` is a view."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        batch = self.file.get_batch(k // ROWS)
        return tuple(batch.column(c).slice(k % ROWS, 1).flatten() for c in (0, 1))


class TokenFiles:
    """Random access to all sequences of a manifest, in the order of its shards."""

    def __init__(self, manifest: list[tuple[int, str, int]], folder: str, length: int = LENGTH):
        self.folder, self.shards = folder, {}
        held = sorted(tuple(r) for r in manifest)
        self.bases = [base for _, base, _ in held]
        self.ends = np.cumsum([-(-total // length) for _, _, total in held]).tolist()

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = bisect_right(self.ends, k)
        if i not in self.shards:
            self.shards[i] = Shard(self.folder, self.bases[i])
        return self.shards[i].sequence(k - (self.ends[i - 1] if i else 0))


def read_shard(folder: str, base: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, place of its first id in the shard, ids) of each document, from the shard's files."""
    store, _ = open_store(folder)
    with _open(store, f"{base}.ids") as source, _open(store, f"{base}.docs") as listing:
        file, docs = pa.ipc.open_file(source), pa.ipc.open_file(listing)
        held, first, end, at = [], 0, 0, 0  # held: the batches that cover [first, end)

        def load() -> None:
            nonlocal at, end
            batch = file.get_batch(at)
            ids = batch.column(0).flatten().to_numpy()
            real = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            held.append(ids[: int(real.sum())])
            end += len(held[-1])
            at += 1

        for k in range(docs.num_record_batches):
            for doc_id, start, n in zip(*(c.to_pylist() for c in docs.get_batch(k).columns)):
                while end < start + n:
                    load()
                while held and first + len(held[0]) <= start:
                    first += len(held.pop(0))
                flat = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, np.uint16)
                if len(held) > 1:
                    held[:] = [flat]
                yield doc_id, start, flat[start - first : start - first + n]


def write_token_files(docs: DataFrame, path: str, style: str, end_id: int, folder: str, length: int = LENGTH, dtype: str = "uint16") -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest (shard, base, total)."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, writer = encoder(path, style), None
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batched(texts):
                for doc_id, ids in zip(doc_ids[a:b], coder.encode(texts[a:b])):
                    writer = writer or ShardWriter(folder, length, dtype)
                    writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer:
            base, total = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "base": [base], "total": pa.array([total], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(small_batches(ordered).mapInArrow(write, "shard long, base string, total long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the shards.

    The manifest has a row per shard, as many as there were partitions; the driver adds up their totals.
    """
    spark = manifest.sparkSession
    start, rows = 0, []
    for shard, base, total in sorted(map(tuple, manifest.collect())):
        rows.append((base, start))
        start += total

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = [(d, before + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in read_shard(folder, base)]
                for i in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i : i + 50_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "base string, start long").repartition(max(1, len(rows)))
    return small_batches(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "space", 1, folder)
    return read_token_files(manifest, folder)
