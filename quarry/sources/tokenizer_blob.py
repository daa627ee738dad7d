"""Binary tokenizers of two versions, and flat checkpoints of another program.

Version 1 holds merges as pairs of 16-bit ids by rank; version 2 holds pieces with float scores.  A flat checkpoint
is seven 32-bit numbers (width, hidden width, layers, heads, key heads, vocabulary, context) and then float32
tensors in a fixed order; a negative vocabulary says that the head is not shared, which is refused.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"QTOK"


def dump_merges(specials: list[str], merges: list[tuple[int, int]]) -> bytes:
    names = b"".join(struct.pack("<H", len(s.encode())) + s.encode() for s in specials)
    return MAGIC + struct.pack("<III", 1, len(specials), len(merges)) + names + b"".join(struct.pack("<HH", *m) for m in merges)


def dump_pieces(pieces: list[tuple[bytes, float]]) -> bytes:
    return MAGIC + struct.pack("<II", 2, len(pieces)) + b"".join(struct.pack("<fH", s, len(p)) + p for p, s in pieces)


def load(blob: bytes) -> tuple[int, list, list]:
    """(version, special tokens, merges) or (2, [], pieces)."""
    if blob[:4] != MAGIC:
        raise ValueError("magic")
    (version,) = struct.unpack_from("<I", blob, 4)
    try:
        if version == 1:
            n, m = struct.unpack_from("<II", blob, 8)
            at, specials = 16, []
            for _ in range(n):
                (k,) = struct.unpack_from("<H", blob, at)
                specials.append(blob[at + 2 : at + 2 + k].decode())
                at += 2 + k
            return 1, specials, [struct.unpack_from("<HH", blob, at + 4 * i) for i in range(m)]
        if version == 2:
            (n,) = struct.unpack_from("<I", blob, 8)
            at, pieces = 12, []
            for _ in range(n):
                score, k = struct.unpack_from("<fH", blob, at)
                pieces.append((blob[at + 6 : at + 6 + k], score))
                at += 6 + k
            return 2, [], pieces
    except struct.error as e:
        raise ValueError("size") from e
    raise ValueError("version")


def load_checkpoint(blob: bytes) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """Sizes, and tensors by the names that the decoder uses."""
    names = ["d", "hidden", "layers", "heads", "kv_heads", "vocab", "context"]
    size = dict(zip(names, struct.unpack_from("<7i", blob)))
    if size["vocab"] < 0:
        raise ValueError("the head is not shared")
    d, h, n, kv = size["d"], size["hidden"], size["layers"], size["d"] // size["heads"] * size["kv_heads"]
    flat, at = np.frombuffer(blob, "<f4", offset=28), 0
    out = {}

    def take(name: str, *shape: int) -> None:
        nonlocal at
        k = int(np.prod(shape))
        if at + k > len(flat):
            raise ValueError("size")
        out[name] = flat[at : at + k].reshape(shape)
        at += k

    take("embed", size["vocab"], d)
    for name, *shape in (("norm1", d), ("q", d, d), ("k", kv, d), ("v", kv, d), ("o", d, d), ("norm2", d), ("gate", h, d), ("down", d, h), ("up", h, d)):
        for i in range(n):
            take(f"{i}.{name}", *shape)
    take("norm", d)
    return size, out
