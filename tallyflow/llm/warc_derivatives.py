"""Derived WARC records: metadata and plain text from response records.

Each response becomes two records that point back to it by WARC-Refers-To and to
each other by WARC-Concurrent-To. Both keep the target and date of the source;
the metadata record also lists its digests, HTTP status and headers, title and
links. Record ids are made from the source's id and the derived type, so a rerun
gives the same records. Every record is read, derived and digested in one pass
over its partition; nothing is shuffled.

Defined results: a null html is an empty page, a null url leaves out the target.
A record that is not a readable response gives one row of type ``rejected`` with
the reason as its body. Repeated rows give repeated records with the same ids.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
HIDDEN = {"script", "style", "noscript", "template", "head"}
IN_HEAD = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
BREAKS = set(
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
LONG_NUMBER = re.compile(r"&#([0-9]{1000,})")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
FIELDS = ("record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "source_date", "source_payload_digest", "block_digest")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", content_length long, body string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(map(str, parts)))}>"


def serialised(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, plain or gzipped."""
    if record[:2] == b"\x1f\x8b":
        record = gzip.decompress(record)
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        last = name.strip().lower()
        headers[last] = value.strip()
    size = int(headers.get("content-length", "-1"))
    if size < 0 or size > len(rest):
        raise ValueError("content length does not fit")
    return headers, rest[:size]


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and decoded payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        raise ValueError("no HTTP response")
    headers = [(n.strip(), v.strip()) for n, c, v in (line.partition(":") for line in lines[1:]) if c]
    named = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = unchunked(payload)
    if named.get("content-encoding") in ("gzip", "x-gzip"):
        payload = gzip.decompress(payload)
    elif named.get("content-encoding") == "deflate":
        payload = zlib.decompress(payload)
    return lines[0], headers, payload


class Page(HTMLParser):
    """Visible text with a line for each block, the title, and links in order.

    A head ends where something comes that may not stand in one, a noscript or
    template that is never closed hides nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.hidden: list[str] = []
        self.since: list[int] = []  # for each of hidden, how long held was
        self.held: list[int] = []  # parts inside a noscript or template, which count if it is not closed
        self.in_title = False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As in HTML, only CDATA is a section; any other, which would raise an error, is a comment up to ``>``."""
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden == ["head"] and tag not in IN_HEAD:
            self.reveal(0)
        if tag in HIDDEN and not (tag == "head" and self.hidden):
            self.hidden.append(tag)
            self.since.append(len(self.held))
        elif tag == "body":
            self.reveal(0)
        self.in_title = tag == "title"
        if tag in BREAKS:
            self.parts.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN and self.hidden and self.hidden[-1] == tag:
            self.reveal(len(self.hidden) - 1)

    def reveal(self, depth: int) -> None:
        """Closes what is hidden from ``depth`` on; what it held stays hidden."""
        if self.hidden[depth:]:
            for place in self.held[self.since[depth] :]:
                self.parts[place] = ""
            del self.held[self.since[depth] :], self.hidden[depth:], self.since[depth:]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.reveal(self.hidden.index(tag))
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
            return
        if self.hidden == ["head"] and data.strip(" \t\n\f\r"):
            self.reveal(0)
        if self.hidden and self.hidden[-1] in ("noscript", "template"):
            self.held.append(len(self.parts))
        elif self.hidden:
            return
        self.parts.append(data)

    def text(self) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def decoded(payload: bytes, content_type: str) -> str:
    found = CHARSET.search(content_type.encode()) or CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no such encoding, or one that is not for text
        return payload.decode("utf-8", "replace")


def shortened(found: re.Match) -> str:
    """A character number of more digits than Python converts: past all characters, or zeros first."""
    return "&#" + (found[1].lstrip("0")[:10] or "0")


def response_record(key: object, url: str | None, html: str | None, date: str) -> bytes:
    """A response record as a crawler would have written it for a page."""
    payload = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", named_id("response", key, url, digest(payload))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    headers += [
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return serialised(headers, block)


def derivatives(record: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response, as rows of SCHEMA."""
    try:
        source, block = parsed(record)
        if source.get("warc-type") != "response":
            raise ValueError(f"a record of type {source.get('warc-type')}")
        status, http, payload = http_parts(block)
    except (ValueError, OSError, EOFError, zlib.error) as error:
        return [(None, "rejected", None, None, None, None, None, None, None, str(error), None)]
    page = Page()
    named = {n.lower(): v for n, v in http}
    page.feed(LONG_NUMBER.sub(shortened, decoded(payload, named.get("content-type", ""))))
    page.close()
    text, source_id = page.text(), source.get("warc-record-id", "")
    payload_digest = source.get("warc-payload-digest") or digest(payload)
    ids = {kind: named_id(kind, source_id) for kind in ("metadata", "conversion")}
    fields = [("source-record-id", source_id), ("source-payload-digest", payload_digest)]
    fields += [("source-block-digest", source["warc-block-digest"])] if "warc-block-digest" in source else []
    fields += [("http-status", status)] + [(f"http-header-{n.lower()}", v) for n, v in http]
    fields += [("title", " ".join("".join(page.title).split())), ("text-characters", str(len(text)))]
    fields += [("outlink", " ".join(link.split())) for link in page.links]
    rows = []
    for kind, other, media, body in (
        ("metadata", "conversion", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "metadata", "text/plain; charset=utf-8", text),
    ):
        data = body.encode("utf-8", "replace")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source_id), ("WARC-Concurrent-To", ids[other])]
        for name, key in (("WARC-Target-URI", "warc-target-uri"), ("WARC-Date", "warc-date"), ("WARC-Refers-To-Date", "warc-date")):
            if key in source:
                headers.append((name, source[key]))
        headers += [("WARC-Block-Digest", digest(data)), ("Content-Type", media), ("Content-Length", str(len(data)))]
        rows.append(
            (ids[kind], kind, source_id, ids[other], source.get("warc-target-uri"), source.get("warc-date"), payload_digest, digest(data), len(data), body, serialised(headers, data))
        )
    return rows


def key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def responses(pages: DataFrame, key: str = "page_id", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """key and ``record``: a response record for each row of ``pages`` (key, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns = [batch[c].to_pylist() for c in (key, "url", "html")]
                records = [response_record(k, u, h, date) for k, u, h in zip(*columns)]
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(records, pa.binary())], [key, "record"])

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {key_type(pages, key)}, record binary")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The derived records of every row of ``records`` (key, record), with the key of their source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [derivatives(r or b"") for r in batch["record"].to_pylist()]
                source = [i for i, rows in enumerate(made) for _ in rows]
                rows = [row for rows in made for row in rows]
                columns = list(zip(*rows))
                kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(pa.array(source)), *arrays], [key, *FIELDS, "content_length", "body", "record"]
                )

    return records.select(key, "record").mapInArrow(run, f"{key} {key_type(records, key)}, {SCHEMA}")
