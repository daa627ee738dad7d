"""WARC derivative builder (operator 9): metadata and plain-text conversion records from responses.

Each response gives two records: a metadata record (JSON with status, headers, title and links) and a conversion
record (the page's text).  Both name the response in WARC-Refers-To, repeat its target, date and digests, and the
conversion names the metadata record as concurrent.  Record ids are UUIDs made from the content, so that a task
that runs again builds the same records.  Records are gzip members of their own, as WARC files hold them.

Header names are read without case.  A body is freed of chunks and of gzip or deflate, and read in the charset that the response names.
Pages are scanned once, from left to right: the work is linear in their length, whatever their markup.

Defined results: a null html is an empty body; a null url makes the target ``urn:page:<id>`` and has no links
resolved; white space and control characters in a url are percent-encoded; bytes that are no whole response record, or have no record id, date or
target, give no derivatives; a digest that the response does not have is left out of them; null and repeated page_ids are rows like any others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

DATE = "2020-01-01T00:00:00Z"
VERSION = "WARC/1.1"
#: Tags that end a line of text.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no text.
HIDDEN = frozenset("script style noscript template".split())
#: Elements with a link, and the attributes that hold one.
LINKED, HOLDERS = frozenset("a area link img iframe script form".split()), frozenset("href src action".split())
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?![a-zA-Z0-9])")
CLOSE = {name: re.compile(rf"</{name}(?![a-zA-Z0-9])", re.I) for name in HIDDEN}
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")


class Headers(dict):
    """Header fields by name, without case; of repeated ones the first."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)

    def __contains__(self, name) -> bool:
        return super().__contains__(name.lower())


def fields(lines: list[str]) -> Headers:
    """Header fields from their lines; a line that starts with white space continues the one before."""
    out, name = Headers(), None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            dict.__setitem__(out, name, f"{out[name]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, value.strip().replace("\r", " ").replace("\n", " "))
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'\0'.join(parts)).digest()[:16], version=4)}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; ValueError if a field would break its line."""
    if bad := next((k for k, v in headers if "\r" in k + v or "\n" in k + v), None):
        raise ValueError(f"a line break in {bad}")
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[Headers, bytes]:
    """Headers and block of a record; raises ValueError if it is not whole."""
    try:
        raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    except zlib.error as e:
        raise ValueError(str(e)) from e
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = fields(lines[1:])
    n = headers.get("Content-Length", "")
    n = int(n) if n.isascii() and n.isdigit() else -1
    if n < 0 or len(rest) < n:
        raise ValueError("a cut record")
    return headers, rest[:n]


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """The response record of a page."""
    body = (html or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    target = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"
    own = record_id(b"response", str(page_id).encode(), target.encode("utf-8", "replace"), body)
    return build([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))], block)


def unchunked(body: bytes) -> bytes:
    """The data of a body in HTTP chunks, as far as they are whole."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n <= 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def html_of(headers: Headers, body: bytes) -> str:
    """The page in an HTTP body, without its codings."""
    if "chunked" in headers.get("Transfer-Encoding", "").lower():
        body = unchunked(body)
    coding = headers.get("Content-Encoding", "").strip().lower()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            body = zlib.decompressobj(bits).decompress(body)
            break
        except zlib.error:
            continue
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", headers.get("Content-Type", ""), re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) from left to right: ``text``, ``open`` and ``close`` with the tag's name and inside, ``gap`` for what is dropped."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            yield "gap", "", ""
            at = end + 3 if end >= 0 else n
            continue
        m = NAME.match(html, lt)
        if not m and html[lt + 1 : lt + 2] not in ("!", "/", "?"):
            yield "text", "", "<"
            at = lt + 1
            continue
        gt = html.find(">", lt)
        if gt < 0:  # no tag ends from here on
            yield "text", "", html[lt:]
            return
        at = gt + 1
        if m:
            name = m[2].lower()
            yield "close" if m[1] else "open", name, html[m.end() : gt]
            if not m[1] and name in HIDDEN:
                yield "gap", "", ""
                close = CLOSE[name].search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n


def page_of(html: str, base: str) -> tuple[str | None, list[dict[str, str]], str]:
    """Title, links and text of a page.

    Text has a line for each block, white space collapsed, entities decoded, blank lines dropped.
    """
    title, open_title, links, out = None, None, [], []
    for kind, name, inside in scan(html):
        if kind == "text":
            out.append(inside.replace("\n", " "))
            if open_title is not None:
                open_title.append(inside)
            continue
        if kind == "gap":
            out.append(" ")
            continue
        if name in BLOCKS:
            out.append("\n")
        if name == "title" and title is None:
            if kind == "open":
                open_title = []
            elif open_title is not None:
                title, open_title = " ".join(entities.unescape("".join(open_title)).split()), None
        if kind == "open" and name in LINKED:
            for m in ATTRIBUTE.finditer(inside):
                key = m[1].lower()
                if key in HOLDERS and m[0] != m[1]:
                    value = entities.unescape(m[2] or m[3] or m[4] or "").strip()
                    try:
                        url = urljoin(base, value)
                    except ValueError:
                        url = value
                    links.append({"path": f"{name}@{key}", "url": url})
                    break
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    return title, links, "\n".join(x for x in lines if x)


def derive(member: bytes) -> list[tuple[str, bytes]]:
    """(kind, record) of the derivatives of a response record; none if it is no response."""
    try:
        source, block = parse(member)
    except ValueError:
        return []
    own, date, target = (source.get(f"WARC-{k}") for k in ("Record-ID", "Date", "Target-URI"))
    if source.get("WARC-Type", "").lower() != "response" or not own or not date or not target:
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    headers = fields(lines)
    title, links, text = page_of(html_of(headers, body), "" if target.startswith("urn:") else target)
    found = {"status": status, "headers": headers, "title": title, "links": links}
    data = json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "replace")
    text = text.encode("utf-8", "replace")
    meta_id, text_id = record_id(b"metadata", own.encode()), record_id(b"conversion", own.encode())
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", own)]
    common += [(f"WARC-Source-{k}", source[f"WARC-{k}"]) for k in ("Block-Digest", "Payload-Digest") if source.get(f"WARC-{k}")]
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, ("WARC-Block-Digest", digest(data)), ("Content-Type", "application/json")]
    conv = [("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *common, ("WARC-Concurrent-To", meta_id), ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain")]
    return [("metadata", build(meta, data)), ("conversion", build(conv, text))]


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record, the response record of each page."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response(*(x.as_py() for x in r)) for r in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["page_id", "record"])

    return small_batches(pages.select("page_id", "url", "html")).mapInArrow(write, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, kind and record of the derivatives of the responses in ``record``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, kind, r) for p, m in zip(batch.column(0).to_pylist(), batch.column(1)) for kind, r in derive(m.as_py() or b"")]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))], ["page_id", "kind", "record"])

    return small_batches(records.select("page_id", "record")).mapInArrow(write, "page_id long, kind string, record binary")


LISTED = "page_id long, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, n_links long, block_sha256 string"


def listed(records: DataFrame) -> DataFrame:
    """What the records (page_id, kind, record) say when they are read; their digests are verified."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, kind, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h, block = parse(r.as_py())
                if digest(block) != h["WARC-Block-Digest"]:
                    raise ValueError(f"digest of {h['WARC-Record-ID']}")
                n = len(json.loads(block)["links"]) if kind == "metadata" else None
                rows.append((p, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h.get("WARC-Source-Payload-Digest"), h["WARC-Block-Digest"], len(block), n, hashlib.sha256(block).hexdigest()))
            names = [x.split()[0] for x in LISTED.split(", ")]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 7, 8) else pa.string()) for i, c in enumerate(columns)], names)

    return small_batches(records.select("page_id", "kind", "record")).mapInArrow(scan, LISTED)


def query(spark, sf_dir: str) -> DataFrame:
    return listed(derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


