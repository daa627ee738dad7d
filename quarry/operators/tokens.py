"""Tokenizer operators: byte-level pre-tokens, merge training, encoding of distinct pieces, scored pieces."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: A run of spaces at the end, spaces before the last one of a run, letters with a space before and an equals sign after, or any one byte.
PRETOKEN = r"(?s) +\z| +(?= [^ ])| ?[A-Za-z]+=?| ?[^ ]"

PIECE = re.compile(PRETOKEN.replace(r"\z", r"\Z"))


def pretokens(text: Column) -> Column:
    """Pre-tokens of the UTF-8 bytes of a text, each byte as the Latin-1 letter of its number."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(PRETOKEN), F.lit(0))


def piece_counts(docs: DataFrame) -> DataFrame:
    """piece and n over all texts."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def _byte_pairs(letters: bytes) -> set[int]:
    return {256 * x + y for x, y in zip(letters, letters[1:])}


def postings(pieces: DataFrame) -> DataFrame:
    """An inverted index of pieces (piece, n): pair (256 * byte + next byte), piece and n, written in the order of the pair.

    A pair of merged symbols stands only where the last byte of the one meets the first byte of the other, so the index of byte
    pairs finds the pieces of every later pair and is written once.  Files are ranged and sorted by pair: a look at a few
    pairs reads few of their row groups.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pair"] = [sorted(_byte_pairs(p.encode("latin-1"))) for p in batch["piece"]]
            yield batch.explode("pair").astype({"pair": "int32"})[["pair", "piece", "n"]]

    found = pieces.where(F.length("piece") > 1).mapInPandas(scan, "pair int, piece string, n long")
    return written(found.repartitionByRange(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair", "piece").sortWithinPartitions("pair"), "postings")


def _pair_sums(rows: DataFrame, count, looked: set[int] = frozenset()) -> DataFrame:
    """a, b and n: what ``count(piece, n, totals)`` adds to the totals of pairs, summed in each task first.

    Of postings, a piece counts once: under the least of its pairs that are ``looked`` for.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: Counter = Counter()
        for batch in batches:
            pairs = batch["pair"] if len(looked) > 1 else [None] * len(batch)
            for pair, piece, n in zip(pairs, batch["piece"], batch["n"]):
                letters = piece.encode("latin-1")
                if pair is None or pair == min(_byte_pairs(letters) & looked):
                    count(letters, n, totals)
        rows = [(a, b, n) for (a, b), n in totals.items() if n]
        yield pd.DataFrame(rows, columns=["a", "b", "n"])

    found = rows.mapInPandas(scan, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def independent(counts: dict[tuple[int, int], int], floor: int, most: int) -> list[tuple[tuple[int, int], int]]:
    """The merges that come next one after the other, whatever the earlier of them change: pairs and counts.

    A merge changes only counts of pairs that share a symbol with it, and the pairs that it makes stand no more often
    than such a pair did.  So the best pairs follow each other as long as they share no symbol and stand more often than
    every pair that shares one with those before.  Counts up to ``floor`` are not known in full.
    """
    best = heapq.nsmallest(8 * most, counts.items(), key=lambda x: (-x[1], x[0]))
    if not best:
        return []
    taken, symbols, least = [], set(), max(floor, best[-1][1] if len(best) < len(counts) else 0, 0)
    for k, (pair, n) in enumerate(best[:most]):
        rival = next((m for other, m in best[k:] if symbols & {*other}), least)
        if n <= (max(rival, floor) if taken else floor):
            break
        taken.append((pair, n))
        symbols |= {*pair}
    return taken


#: Pair counts that the driver holds at most, and merges that are made together at most.
HELD, TOGETHER = 500_000, 64


def train(pieces: DataFrame, n_merges: int, held: int = HELD) -> list[tuple[int, int, int]]:
    """The first merges (a, b, n) of distinct pieces (piece, n): the most frequent adjacent pair, ties to the smaller pair, never across pieces.

    Symbols are the 256 bytes and then the merges in order.  Counts are kept by differences: a round makes the merges that
    ``independent`` allows, looks up the pieces that can hold them in the index, and sums how their pairs change; nothing is
    counted anew and no table is written after the index.  The driver holds pair counts, which number as the
    vocabulary makes them, not the corpus: the ``held`` greatest, and counts again when those are used up.
    """
    pieces = written(pieces.select("piece", "n"), "pieces")
    index = postings(pieces)
    merges: list[tuple[int, int, int]] = []
    ends = [(i, i) for i in range(256)]  # first and last byte of each symbol

    def counted() -> tuple[dict, int]:
        coder = RankedMerges([m[:2] for m in merges])

        def count(piece: bytes, n: int, totals: Counter) -> None:
            s = coder.symbols(piece)
            for pair in zip(s, s[1:]):
                totals[pair] += n

        rows = _pair_sums(pieces, count).orderBy(F.desc("n"), "a", "b").limit(held + 1).collect()
        return {(r.a, r.b): r.n for r in rows[:held]}, rows[held].n if len(rows) > held else 0

    counts, floor = counted()
    fresh = True
    while len(merges) < n_merges:
        batch = independent(counts, floor, min(TOGETHER, n_merges - len(merges)))
        if not batch:
            if fresh or not floor:
                break
            (counts, floor), fresh = counted(), True
            if counts and not independent(counts, floor, 1):
                floor = max(counts.values()) - 1  # ties beyond what is held: the first of them is the least pair
            continue
        done, fresh = len(merges), False
        merges += [(a, b, n) for (a, b), n in batch]
        ends += [(ends[a][0], ends[b][1]) for (a, b), _ in batch]
        wanted = sorted({256 * ends[a][1] + ends[b][0] for (a, b), _ in batch})
        coder, looked = RankedMerges([m[:2] for m in merges]), set(wanted)

        def change(piece: bytes, n: int, totals: Counter) -> None:
            before = coder.symbols(piece, done)
            after = coder.symbols(piece)
            if len(before) != len(after):
                for pair in zip(before, before[1:]):
                    totals[pair] -= n
                for pair in zip(after, after[1:]):
                    totals[pair] += n

        for r in _pair_sums(index.where(F.col("pair").isin(wanted)), change, looked).collect():
            pair = (r.a, r.b)
            if pair in counts or max(pair) >= 256 + done:
                counts[pair] = counts.get(pair, 0) + r.n
                if counts[pair] <= 0:
                    del counts[pair]
        if len(counts) > 2 * held:
            cut = heapq.nlargest(held + 1, counts.values())[-1]
            counts, floor = {p: n for p, n in counts.items() if n > cut}, max(floor, cut)
    return merges


def texts_of(merges: list[tuple[int, int]]) -> list[str]:
    """The Latin-1 letters of each merge."""
    names = [chr(i) for i in range(256)]
    for a, b, *_ in merges:
        names.append(names[a] + names[b])
    return names[256:]


class RankedMerges:
    """Encodes pieces by repeatedly merging the adjacent pair of least rank, the leftmost first.

    Merges are pairs of symbols: the 256 bytes and the merges before, from 256 on.  Ids are the 256 bytes, the special tokens in
    their order, and then the merges.
    """

    def __init__(self, merges: list[tuple[int, int]], specials: list[str] = ()):
        self.rank = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
        self.specials = {s: 256 + i for i, s in enumerate(specials)}
        self.names = {i: bytes([i]) for i in range(256)} | {i: s.encode() for s, i in self.specials.items()}
        self.names |= {256 + len(specials) + i: t.encode("latin-1") for i, t in enumerate(texts_of(merges))}
        #: The longest special token that starts at a place wins.
        self.split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def symbols(self, piece: bytes, ranks: int | None = None) -> list[int]:
        """The symbols of a piece by the merges of the first ``ranks`` only.

        A heap holds the pairs that can be merged, by rank and place; one whose symbols have gone is stale.
        """
        s, n = [*piece], len(piece)
        rank, top = self.rank.get, 1 << 60
        ranks = top if ranks is None else ranks
        heap = [(k, i) for i in range(n - 1) if (k := rank((s[i], s[i + 1]), top)) < ranks]
        if not heap:
            return s
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j >= n or rank((s[i], s[j]), top) != k:
                continue
            s[i], s[j], after[i] = 256 + k, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := rank((s[i], s[after[i]]), top)) < ranks:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := rank((s[before[i]], s[i]), top)) < ranks:
                heapq.heappush(heap, (k, before[i]))
        return [x for x in s if x >= 0]

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece, whose letters stand for bytes."""
        more = len(self.specials)
        return [x if x < 256 else x + more for x in self.symbols(piece.encode("latin-1"))]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without regard to special tokens."""
        letters = text.encode("utf-8", "replace").decode("latin-1")
        return [i for piece in PIECE.findall(letters) for i in self.encode(piece)]

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text in which special tokens stand for themselves."""
        if not self.split:
            return self.plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """UTF-8 with replacement characters for bytes that are none."""
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, merges: list[tuple[int, int]], specials: list[str] = ()) -> DataFrame:
    """doc_id and ids.  Texts are parted at special tokens, the longest first; distinct pieces are encoded once in each task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, known = RankedMerges(merges, specials), {}
        coder.encode = lambda piece, fresh=coder.encode: known[piece] if piece in known else known.setdefault(piece, fresh(piece))
        for texts in batches:
            if len(known) > 200_000:
                known.clear()
            yield texts.map(coder.encode_text)

    return docs.select("doc_id", encode(F.coalesce("text", F.lit(""))).alias("ids"))


class ScoredPieces:
    """Pieces with scores: a space goes before the text, unknown characters fall back to bytes, and the pair whose joint piece scores best is merged first."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces, self.place = pieces, {}
        for i, (p, _) in enumerate(pieces):
            self.place.setdefault(p, i)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for c in " " + text if text else "":
            ids += [self.place[c]] if c in self.place else [b + 3 for b in c.encode()]
        # a heap of joint pieces by score and place, with the ids they join; a stale one no longer stands there
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                a, b = ids[i], ids[after[i]]
                j = self.place.get(self.pieces[a][0] + self.pieces[b][0])
                if j is not None:
                    heapq.heappush(heap, (-self.pieces[j][1], i, a, after[i], b, j))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, k, b, j = heapq.heappop(heap)
            if ids[i] != a or after[i] != k or ids[k] != b:
                continue
            ids[i], ids[k], after[i] = j, -1, after[k]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int], first: int = 1) -> str:
        """The space after the id ``first`` is dropped; ``<0xHH>`` pieces are bytes."""
        out, before = b"", first
        for i in ids:
            p = self.pieces[i][0]
            raw = bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.encode()
            out += raw[1:] if before == first and raw.startswith(b" ") else raw
            before = i
        return out.decode("utf-8", "replace")

