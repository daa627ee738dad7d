"""Ogg media columns (operator 7): write, and read with checksums, lacing, demultiplexing and timestamps.

``read`` walks the pages of a physical stream, verifies each page's checksum, reassembles packets from lacing
values across pages, and keeps the logical streams apart by serial number.  A page's granule position is that of the last packet that
ends on it; ``timed`` derives those of the other packets from it, by the samples that a codec says each packet has.  A page that
fails its checksum is dropped and reported; a packet that lost a page, or whose continuation does not follow, is dropped
and reported too.  After damage the reader looks for the next capture pattern.

``store`` writes a payload as 8-bit samples of one logical stream, beside a second stream with a packet that holds
its length without padding; both are interleaved in one physical stream.

Defined results: a null text is an empty one and has a payload of one padding block; null and repeated doc_ids
are rows like any others; bytes that are no Ogg give no streams and one error; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, small_batches

BLOCK, RATE, PACKET = 192, 8000, 4096
AUDIO, NOTE = 0x51A0, 0x51A1
AUDIO_HEAD, NOTE_HEAD = b"PCM8", b"NOTE"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, from 0.  It is the mirror image of zlib's."""
    return int(f"{zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """The pages of one logical stream; packets come with the granule position after them.  The first has a page of its own."""
    lacing, body, granule, number, flags = [], [], -1, 0, FIRST

    def page(last: bool) -> bytes:
        head = lambda crc: HEADER.pack(b"OggS", 0, flags | (LAST if last else 0), granule, serial, number, crc, len(lacing)) + bytes(lacing)
        data = b"".join(body)
        return head(checksum(head(0) + data)) + data

    for i, (packet, after) in enumerate(packets):
        at, done = 0, False
        while not done:
            if len(lacing) == 255:
                yield page(False)
                lacing, body, granule, number, flags = [], [], -1, number + 1, CONTINUED if at else 0
            n = min(255, len(packet) - at)
            lacing.append(n)
            body.append(packet[at : at + n])
            at += n
            done = n < 255
        granule = after
        if i == 0 and len(packets) > 1:
            yield page(False)
            lacing, body, granule, number, flags = [], [], -1, number + 1, 0
    yield page(True)


def store(data: bytes) -> bytes:
    """The physical stream of ``data``, padded with spaces to a positive multiple of the block."""
    payload = data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))
    audio = [(AUDIO_HEAD + struct.pack("<II", RATE, 1), 0)]
    audio += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    note = [(NOTE_HEAD, 0), (struct.pack("<Q", len(data)), 0)]
    a, n = list(pages(AUDIO, audio)), list(pages(NOTE, note))
    return b"".join([a[0], n[0], *(p for pair in zip(a[1:], n[1:]) for p in pair), *a[len(n) :]])


@dataclass
class Stream:
    """One logical stream: packets are (data, granule position after it or -1 if its page does not say, number of its page)."""

    serial: int
    packets: list[tuple[bytes, int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    granule: int = 0
    _open: list[bytes] | None = None
    _next: int = 0


def read(data: bytes) -> tuple[dict[int, Stream], list[str]]:
    """The logical streams by serial number, and what was wrong."""
    streams: dict[int, Stream] = {}
    errors: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            errors.append(f"no page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        if len(data) < at + 27:
            errors.append(f"cut page at {at}")
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version or len(lacing) < n or len(data) < end or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            errors.append(f"bad page at {at}")
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next or bool(flags & CONTINUED) != bool(s._open):
            if number != s._next:
                errors.append(f"stream {serial}: page {number} after {s._next - 1}")
            else:
                errors.append(f"stream {serial}: page {number} {'continues no packet' if flags & CONTINUED else 'does not continue a packet'}")
            s._open = None
        skip = bool(flags & CONTINUED) and s._open is None  # the rest of a packet whose beginning is lost
        place, done = start, []
        for k in lacing:
            if not skip:
                s._open = s._open or []
                s._open.append(data[place : place + k])
            place += k
            if k < 255:
                if not skip:
                    done.append(b"".join(s._open))
                s._open, skip = None, False
        s.packets += [(p, granule if i == len(done) - 1 else -1, number) for i, p in enumerate(done)]
        s.pages, s._next, s.ended = s.pages + 1, number + 1, s.ended or bool(flags & LAST)
        s.granule = max(s.granule, granule)
        at = end
    errors += [f"stream {s.serial}: no end" for s in streams.values() if not s.ended]
    return streams, errors


def pcm_samples(packet: bytes) -> int:
    """Samples in a packet of a stream of 8-bit samples; its header has none."""
    return 0 if packet.startswith(AUDIO_HEAD) else len(packet)


#: How many samples a packet of a stream has, by what its first packet starts with.
CODECS = {AUDIO_HEAD: pcm_samples}


def timed(stream: Stream) -> list[int | None]:
    """The granule position after each packet: its page's, and counted back from it by the codec's samples; None where that is unknown."""
    count = next((f for head, f in CODECS.items() if stream.packets and stream.packets[0][0].startswith(head)), None)
    out, after, page = [], None, None
    for packet, granule, number in reversed(stream.packets):
        if granule >= 0:
            after = granule
        elif number != page:  # no packet is known to end with this page's granule position
            after = None
        out.append(after)
        page = number
        after = max(0, after - count(packet)) if count and after is not None else None
    return out[::-1]


def read_payload(media: bytes) -> tuple[bytes, int, str]:
    """Payload, length without padding and feature text of what ``store`` wrote."""
    streams, errors = read(media)
    if errors:
        raise ValueError(errors[0])
    audio = next(s for s in streams.values() if s.packets[0][0].startswith(AUDIO_HEAD))
    note = next(s for s in streams.values() if s.packets[0][0] == NOTE_HEAD)
    rate = struct.unpack("<I", audio.packets[0][0][4:8])[0]
    payload = b"".join(p for p, _, _ in audio.packets[1:])
    n = struct.unpack("<Q", note.packets[1][0])[0]
    starts = [(g - len(p)) * 1_000_000 // rate for g, (p, _, _) in zip(timed(audio)[1:], audio.packets[1:])]
    feature = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};rate={rate};duration_us={audio.granule * 1_000_000 // rate};last_start_us={starts[-1]};adler={zlib.adler32(payload)}"
    return payload, n, feature


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media, the text's bytes as an Ogg stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [store((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return small_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(write, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """What reading the column ``media`` of (doc_id, media) gives."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = m.as_py()
                payload, n, feature = read_payload(m)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            types = [pa.string() if k in (3, 6, 7) else pa.int64() for k in range(8)]
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return small_batches(media.select("doc_id", "media")).mapInArrow(scan, FEATURES)


PACKETS = "doc_id long, serial long, packet long, page long, granule long, time_us long, data binary"


def media_packets(media: DataFrame, rate: int = RATE) -> DataFrame:
    """The packets of every logical stream in the column ``media``, with granule position and the time at which each ends (null where no
    granule position says, time also where the stream is no audio)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                streams, _ = read(m or b"")
                rows = [(doc_id, s.serial, i, page, g, None if g is None or not s.packets[0][0].startswith(AUDIO_HEAD) else g * 1_000_000 // rate, p) for s in streams.values() for i, (g, (p, _, page)) in enumerate(zip(timed(s), s.packets))]
                if rows:
                    types = [*[pa.int64()] * 6, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in PACKETS.split(", ")])

    return small_batches(media.select("doc_id", "media")).mapInArrow(scan, PACKETS)


def query(spark, sf_dir: str) -> DataFrame:
    return media_features(media_column(documents(spark, sf_dir)))
