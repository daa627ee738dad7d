"""Operators 3, 7 and 9 against independent plain programs over whole tables."""

import hashlib
import json
import math
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest

from quarry.llm import ogg, toxicity, warc

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # labels enough for weights


def sentences(text):
    """Sentences end at white space after a full stop, an exclamation or a question mark, and at line feeds."""
    out, now = [], ""
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\n" or c.isspace() and i and text[i - 1] in ".!?":
            out.append(now)
            now = ""
            while i < len(text) and (text[i].isspace() if c != "\n" else text[i] == "\n"):
                i += 1
            continue
        now += c
        i += 1
    return [s for s in [*out, now] if s.strip()]


def test_scores_are_the_noisy_or_of_sentences(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert model.weights
    for r in toxicity.scored(docs, model).collect():
        none = 1.0
        for s in sentences(texts[r.doc_id] or "") or [""]:
            z = model.bias
            for word in s.split():
                bare = word.strip(toxicity.EDGES).lower()
                for f in ["=" + bare, *(bare[:k] for k in toxicity.PREFIXES if len(bare) >= k)] if bare else []:
                    z += model.weights.get(f, 0.0)
            none *= 1 - 1 / (1 + math.exp(-z))
        assert r.score == pytest.approx(1 - none, abs=1e-9)
        assert r.predicted == (r.score >= 0.3)


def test_slopes_equal_differences_of_the_loss():
    r = np.random.default_rng(3)
    sentences_, docs, weights = 60, 20, 12
    doc_of = np.sort(r.integers(0, docs, sentences_))
    ids, sentence_of = r.integers(0, weights, 150), np.sort(r.integers(0, sentences_, 150))
    y, cost = r.random(docs) < 0.4, r.random(docs)
    y[~np.isin(np.arange(docs), doc_of)] = False
    w, b = r.normal(size=weights), -1.0

    def brute(w, b):
        out = 0.0
        for d in range(docs):
            none = 1.0
            for s in np.flatnonzero(doc_of == d):
                none *= 1 - 1 / (1 + math.exp(-(b + sum(w[i] for i, at in zip(ids, sentence_of) if at == s))))
            out += cost[d] * -math.log(1 - none if y[d] else none)
        return out

    loss, dw, db = toxicity.loss_and_slopes(w, b, ids, sentence_of, doc_of, y, cost)
    assert loss == pytest.approx(brute(w, b), abs=1e-9)
    e = 1e-5
    for k in range(weights):
        step = np.eye(weights)[k] * e
        assert dw[k] == pytest.approx((brute(w + step, b) - brute(w - step, b)) / (2 * e), abs=1e-6)
    assert db == pytest.approx((brute(w, b + e) - brute(w, b - e)) / (2 * e), abs=1e-6)


def crc(data):
    """Ogg's checksum bit by bit."""
    reg = 0
    for byte in data:
        reg ^= byte << 24
        for _ in range(8):
            reg = (reg << 1 ^ 0x04C11DB7 if reg & 0x80000000 else reg << 1) & 0xFFFFFFFF
    return reg


TABLE = [crc(bytes([b])) for b in range(256)]


def fast_crc(data):
    reg = 0
    for byte in data:
        reg = (reg << 8 & 0xFFFFFFFF) ^ TABLE[(reg >> 24) ^ byte]
    return reg


def page(flags, granule, serial, number, segments, data):
    head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    tail = bytes([len(segments)]) + bytes(segments) + data
    return head + fast_crc(head + b"\0\0\0\0" + tail).to_bytes(4, "little") + tail


def logical(serial, head, packets):
    """Pages of a stream: its head alone, then packets of (data, granule), cut after each 255 segments."""
    out = [page(2, 0, serial, 0, [len(head)], head)]
    segments = []  # (bytes, whether a packet ends, granule, whether it goes on from the segment before)
    for data, granule in packets:
        cuts = [data[i : i + 255] for i in range(0, len(data), 255)]
        if len(data) % 255 == 0:
            cuts.append(b"")
        segments += [(c, k == len(cuts) - 1, granule, k > 0) for k, c in enumerate(cuts)]
    for i in range(0, len(segments), 255):
        part = segments[i : i + 255]
        ends = [g for _, end, g, _ in part if end]
        last = i + 255 >= len(segments)
        out.append(page((1 if part[0][3] else 0) | (4 if last else 0), ends[-1] if ends else -1, serial, len(out), [len(c) for c, *_ in part], b"".join(c for c, *_ in part)))
    return out


def media_of(data):
    payload = data + b" " * ((-len(data)) % 192 if data else 192)
    audio = logical(0x51A0, b"PCM8" + (8000).to_bytes(4, "little") + (1).to_bytes(4, "little"), [(payload[i : i + 4096], min(i + 4096, len(payload))) for i in range(0, len(payload), 4096)])
    note = logical(0x51A1, b"NOTE", [(len(data).to_bytes(8, "little"), 0)])
    return payload, b"".join([audio[0], note[0], audio[1], note[1], *audio[2:]]), len(audio) + len(note), -(-len(payload) // 4096) + 3


def test_media_equal_those_of_another_writer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert fast_crc(b"123456789abc") == crc(b"123456789abc")
    for r in ogg.query(spark, SF).collect():
        payload, media, pages, packets = media_of(texts[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        said = dict(x.split("=") for x in r.feature.split(";"))
        start = (len(payload) - 1) // 4096 * 4096
        assert said == {"streams": "2", "pages": str(pages), "packets": str(packets), "rate": "8000", "duration_us": str(len(payload) * 125), "last_start_us": str(start * 125), "adler": str(zlib.adler32(payload))}


class Page(HTMLParser):
    """Title, links and text by the standard library's parser."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.out, self.title, self.now, self.hidden = base, [], [], None, None, None

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in warc.BLOCKS:
            self.out.append("\n")
        if tag == "title" and self.title is None:
            self.now = []
        if tag in ("a", "area", "link", "img", "iframe", "script", "form"):
            for k, v in attrs:
                if k in ("href", "src", "action") and v is not None:
                    self.links.append({"path": f"{tag}@{k}", "url": urljoin(self.base, v.strip())})
                    break
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = tag
            self.out.append(" ")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag in warc.BLOCKS:
            self.out.append("\n")
        if tag == "title" and self.now is not None:
            self.title, self.now = " ".join("".join(self.now).split()), None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))
            if self.now is not None:
                self.now.append(data)

    def handle_comment(self, data):
        self.out.append(" ")


def test_links_and_text_equal_those_of_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    given = {r.page_id: r for r in pages.collect()}
    found = warc.derivatives(warc.responses(pages)).collect()
    assert len(found) == 2 * len(given)
    for r in found:
        headers, block = warc.parse(bytes(r.record))
        source = given[r.page_id]
        other = Page(source.url)
        other.feed(source.html)
        other.close()
        if r.kind == "metadata":
            said = json.loads(block)
            assert said["title"] == other.title and said["links"] == other.links, source.page_id
        else:
            lines = (" ".join(x.split()) for x in "".join(other.out).split("\n"))
            assert block.decode() == "\n".join(x for x in lines if x), source.page_id
        assert headers["WARC-Refers-To"] and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["WARC-Record-ID"])
