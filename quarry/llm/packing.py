"""Best-fit packing by bin completion (operator 10).

Only the lengths of pieces matter to a packing, and there are at most ``capacity`` of them, so the plan is made
on the histogram of lengths: a few thousand numbers whatever the corpus.  Bin completion takes the largest
length left, enumerates the undominated fillings of the space beside it, and branches over them; a branch ends
when its waste exceeds what a better packing than the incumbent could have.  The incumbent is best-fit
decreasing at first.  A filling is applied as often as the histogram allows at once.  ``nodes`` bounds the
search, not the input: every piece is placed, whatever the search finds.

The plan is a list of patterns; a piece gets its place from its rank among all pieces ordered by (length,
doc_id, piece), found from the order and the partitions' counts without gathering any length in one task.

Defined results: a null text is an empty one and has just the end id; repeated documents are packed like any
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, documents, encoder, partitions, small_batches, tokenizer_path, written

CAPACITY = 2048
TAIL = 40
Pattern = tuple[int, dict[int, int]]  # how often, {length: how many}


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the sum of lengths, or lengths over a half that cannot share a bin with others (Martello and Toth's L2)."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in [0, *(x for x in lengths if x <= capacity // 2)]:
        large = sum(n for x, n in counts.items() if x > capacity - k)
        middle = sum(n for x, n in counts.items() if capacity // 2 < x <= capacity - k)
        room = sum((capacity - x) * n for x, n in counts.items() if capacity // 2 < x <= capacity - k)
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: bins with the same filling are one group."""
    from bisect import bisect_left, insort

    groups: dict[int, list[list]] = {}  # space left -> [[how many bins, filling]]
    spaces: list[int] = []

    def put(space: int, n: int, filling: dict[int, int]) -> None:
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append([n, filling])

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            i = bisect_left(spaces, x)
            if i == len(spaces):
                each = capacity // x
                if left >= each:
                    put(capacity - each * x, left // each, {x: each})
                    left %= each
                if left:
                    put(capacity - left * x, 1, {x: left})
                break
            space = spaces[i]
            n, filling = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(i)
            each = min(space // x, left)
            times = min(n, left // each)
            put(space - each * x, times, filling | {x: each})
            if n > times:
                put(space, n - times, filling)
            left -= each * times
    return [(n, filling) for g in groups.values() for n, filling in g]


def fillings(counts: dict[int, int], space: int, width: int, steps: int = 600) -> list[dict[int, int]]:
    """Undominated maximal fillings of ``space``, least waste first and then the larger lengths; ``width`` at most.

    A filling is dominated if a longer piece that is left over could replace one of its pieces, or two of them.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= space), reverse=True)
    if not lengths:
        return [{}]
    smallest, found, budget = lengths[-1], [], steps
    stack: list[tuple[int, int, dict[int, int]]] = [(0, space, {})]
    while stack and budget and len(found) < 4 * width:
        budget -= 1
        i, room, chosen = stack.pop()
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if i == len(lengths):
            if room < smallest or all(x > room or chosen.get(x, 0) >= counts[x] for x in lengths):
                found.append((room, chosen))
                if not room and len(found) >= width:
                    break
            continue
        x = lengths[i]
        stack.append((i + 1, room, chosen))
        most = min(counts[x], room // x)
        for k in range(1, most + 1) if most <= 3 else sorted({1, most // 2, most}):
            stack.append((i + 1, room - k * x, chosen | {x: k}))
    spare = lambda x, f: counts.get(x, 0) > f.get(x, 0)

    def dominated(room: int, f: dict[int, int]) -> bool:
        if not room:
            return False
        items = [x for x, k in f.items() for _ in range(min(k, 2))]
        for x in items:
            if any(spare(y, f) for y in lengths if x < y <= x + room):
                return True
        return any(spare(y, f) for i, a in enumerate(items) for b in items[i + 1 :] for y in lengths if a + b <= y <= a + b + room)

    found.sort(key=lambda r: (r[0], [-x for x in sorted(r[1], reverse=True)]))
    kept = [f for room, f in found if not dominated(room, f)][:width]
    return kept or [f for _, f in found[:1]] or [{}]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 3000, width: int = 6) -> list[Pattern]:
    """A packing of the histogram ``counts`` into as few bins of ``capacity`` as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    full = [(counts[capacity], {capacity: 1})] if capacity in counts else []
    counts.pop(capacity, None)
    incumbent = best_fit(counts, capacity)
    used = sum(n for n, _ in incumbent)
    least = lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    # (bins so far, waste so far, lengths left, patterns)
    stack = [(0, 0, counts, [])] if used > least else []
    while stack and nodes and used > least:
        nodes -= 1
        bins, waste, left, patterns = stack.pop()
        if waste > (used - 1) * capacity - total:
            continue
        if not left:
            used, incumbent = bins, patterns
            continue
        x = max(left)
        beside = left | {x: left[x] - 1}
        children = []
        for f in fillings(beside, capacity - x, width):
            f = dict(f)
            f[x] = f.get(x, 0) + 1
            times = min(left[y] // k for y, k in f.items())
            rest = {y: m for y, n in left.items() if (m := n - f.get(y, 0) * times)}
            room = capacity - sum(y * k for y, k in f.items())
            children.append((bins + times, waste + room * times, rest, [*patterns, (times, f)]))
        if nodes % TAIL == 0 or len(left) < TAIL:  # a full packing from here: what the first branch leaves, by best fit
            n, _, rest, head = children[0]
            tail = best_fit(rest, capacity)
            if (n := n + sum(k for k, _ in tail)) < used:
                used, incumbent = n, [*head, *tail]
        stack.extend(reversed(children))
    return full + incumbent


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (first rank, first sequence, pieces a sequence, offset in it, length), by rank among all pieces ordered by length."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, filling in patterns:
        offset = 0
        for x in sorted(filling, reverse=True):
            by_length.setdefault(x, []).append((times * filling[x], sequence, filling[x], offset))
            offset += x * filling[x]
        sequence += times
    rows, rank = [], 0
    for x in sorted(by_length):
        for n, first, each, offset in by_length[x]:
            rows.append((rank, first, each, offset, x))
            rank += n
    return np.array(rows, np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, style: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document; of a longer document the first piece is the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, style)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batched(texts):
                out = []
                for doc_id, ids in zip(doc_ids[a:b], coder.encode(texts[a:b])):
                    ids += end
                    n = len(ids) // 4
                    at = stop = 0
                    k = 0
                    while at < n:
                        stop = at + ((n % capacity or capacity) if k == 0 else capacity)
                        out.append((doc_id, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                        at, k = stop, k + 1
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(cut, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY, nodes: int = 3000) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens."""
    spark = found.sparkSession
    found = written(found, "pieces")
    ordered = found.repartitionByRange(partitions(spark), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "pieces-ordered")
    # at most ``capacity`` rows, and one row per partition
    counts = {r[0]: r[1] for r in ordered.groupBy("length").count().collect()}
    parts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("__at", 33)).count().collect())
    ids = np.array([p for p, _ in parts], np.int64)
    before = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(np.int64)
    table = slots(bin_completion(counts, capacity, nodes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("__at").to_numpy()
            rank = before[np.searchsorted(ids, at >> 33)] + (at & ((1 << 33) - 1))
            first, sequence, each, offset, length = table[np.searchsorted(table[:, 0], rank, "right") - 1].T
            q = rank - first
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence + q // each), pa.array(offset + q % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return small_batches(ordered).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, tokenizer_path("byte_bpe_50k.json"), "leading", 0))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
