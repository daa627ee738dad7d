"""BPE encoding with backtracking, decoding with an offset table (operator 5).

Exact byte-pair merges without merging: an Aho-Corasick automaton over all tokens finds the longest token at every
place of a word in one pass.  The encoder takes the longest one, checks that it may stand beside the token
before it, and otherwise tries the token's next shorter prefix or steps back.  Two tokens may stand side by side
if no merge across their border would have come first; the checks are kept in a pair-compatibility table, and
places that led nowhere are marked, so each place is tried once.  Decoding concatenates slices of one byte
string, cut by a table of offsets, without a loop over ids.

The vocabulary is one whose words end in an end-of-word mark and whose white space is dropped; the tokenizer's
JSON names the normalisation (NFC, lower case character by character) and the pieces of a word.  Tables of characters differ between
Unicode's versions, but only in characters that one of them does not know: a run of text with a character that Python's
table does not assign is normalised and cut by the library's own tables.  Its pieces are encoded here like all others.

Defined results: a null or empty text has no ids and decodes to the empty text; null and repeated doc_ids are
rows like any others; an empty table gives no rows; further columns are ignored.  Special tokens that stand in a
text get their own ids, as the library gives them.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cache, batched, byte_letters, documents, kept_in_worker, small_batches, tokenizer_path

END = "\0"
TOP = 1 << 62


class Backtracking:
    """Encodes words of a vocabulary in which a merge's rank is its place in the list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        import ahocorasick

        named = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        # order: tokens by rank; those that no merge makes come first and split into themselves
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
        made = {}
        for rank, (a, b) in enumerate(pairs):
            made.setdefault(a + b, (rank, a, b))
        base = [t for t in vocab if t not in made]
        order = [*base, *sorted(made, key=lambda t: made[t][0])]
        place = {t: i for i, t in enumerate(order)}
        self.ids = [vocab[t] for t in order]
        self.text = [named(t) for t in order]
        self.length = [len(t) for t in self.text]
        self.split = [(place[made[t][1]], place[made[t][2]]) if t in made else (i, i) for i, t in enumerate(order)]
        self.merged = {(place[a], place[b]): place[a + b] for a, b in pairs}
        self.place = {t: i for i, t in enumerate(self.text)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging would leave a and b side by side."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 300_000:
                self.compatible.clear()
            known = self.compatible[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        merged, split, limit = self.merged, self.split, TOP
        while True:
            if merged.get((a, b), TOP) < limit:
                return False
            # undo the later of the two tokens; what lies at the border then must not have merged before it was made
            left, right = split[a][1], split[b][0]
            if (a > b and left != a) or right == b:
                if left == a:
                    return True
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def prefix(self, t: int) -> int:
        """The longest token that is a proper prefix of t, or -1."""
        known = self.shorter.get(t)
        if known is None:
            s = self.text[t]
            known = self.shorter[t] = next((p for k in range(len(s) - 1, 0, -1) if (p := self.place.get(s[:k])) is not None), -1)
        return known

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of text."""
        letters = self.letters
        return self.spelled("".join([letters[b] for b in piece.encode("utf-8", "replace")]))

    def spelled(self, letters: str) -> list[int]:
        """Ids of one piece of text, given by the letters that stand for its bytes."""
        s = letters + END
        n = len(s)
        if (whole := self.place.get(s)) is not None and self.split[whole] == (whole, whole):
            return [self.ids[whole]]
        longest = [-1] * n
        length = self.length
        for end, t in self.automaton.iter(s):
            longest[end - length[t] + 1] = t  # ends rise, so the last is the longest
        open_ = [True] * (n + 1)
        open_[n - 1] = False  # the mark alone is no token
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (last < 0 or self.fits(last, token))):
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                if last < 0:
                    raise ValueError(f"no encoding of {letters!r}")
                open_[at] = False
                out.pop()
                at -= length[last]
                token = last
        return [self.ids[t] for t in out]


class Codec:
    """Texts to ids and back, for the vocabulary in a tokenizer's JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.encoder = Backtracking(model["vocab"], model["merges"], model["end_of_word_suffix"])
        names = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.path, self.library = path, None
        self.chunks, self.words = Cache(180 << 20), Cache(110 << 20)
        # the offset table: token i, and the space after it, is blob[offsets[i]:offsets[i + 1]]
        parts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _foreign(self, text: str) -> list[int]:
        """Ids of a text with characters that Python's tables don't know, cut by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [i for piece, _ in pieces for i in self.encoder.spelled(piece)]

    def _plain(self, text: str) -> list[int]:
        if text.isascii():
            text = text.lower()
        elif "Cn" in map(unicodedata.category, text):
            return self._foreign(text)
        else:
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        out, words = [], self.words
        for piece in self.pieces.findall(text):
            ids = words.get(piece)
            if ids is None:
                ids = self.encoder.word(piece)
                words.put(piece, ids, len(piece) + 36 * len(ids))
            out += ids
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a run of text without ASCII white space."""
        text = chunk.decode("utf-8")
        if "<|" not in text:
            return array("I", self._plain(text)).tobytes()
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return array("I", [*out, *self._plain(text[at:])]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        cache, out = self.chunks, []
        for c in text.encode("utf-8", "replace").split():
            ids = cache.get(c)
            if ids is None:
                ids = self._chunk(c)
                cache.put(c, ids, len(c) + len(ids))
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts, joined by spaces: this tokenizer names no decoder."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        return self.blob[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)].tobytes()[:-1]


def codec_of(path: str) -> Codec:
    """The codec of this Python process: tasks that follow each other in a worker find its caches filled."""
    return kept_in_worker(("codec", path), lambda: Codec(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded, the text that the ids decode to."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batched(texts, 4_000_000):
                ids = [codec.encode(t) for t in texts[a:b]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = pa.array([codec.decode(x).decode("utf-8") for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, decoded], ["doc_id", "ids", "decoded"])

    return small_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(scan, "doc_id long, ids array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    found = encoded(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
