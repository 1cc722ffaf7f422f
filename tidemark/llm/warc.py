"""Operator 10 - derivatives of web archives.

``responses`` makes WARC 1.1 response records of page rows; ``derive`` turns each response into two
linked records: a ``metadata`` record (JSON: HTTP status and headers, title, links, digests, sizes)
and a ``conversion`` record (plain text of the body). Both point to their source by
``WARC-Refers-To`` with its target URI and date, keep the source's headers, and carry a block digest;
the metadata record also keeps the source's payload digest, and the two refer to each other by
``WARC-Concurrent-To``. Record ids are UUIDs named by the source id and the kind, so a task that runs
again after a lost executor writes the same records. Records travel as rows (``record`` binary), in
batches bounded in bytes; ``write_files`` lays them out in gzipped archive files, a member a record,
and ``read_files`` streams such files, or plain ones, record by record.

Header names count whatever their case. Bodies are read through chunked transfer and gzip or deflate
encoding, and decoded by the charset of the header, else of the page, else as UTF-8.

A null url becomes an empty target; a null body gives an empty block; a record that can't be parsed
gives a metadata record with an ``error`` and an empty conversion. Records of other types than
``response`` are passed over by ``derive``. Pages of any length are read whole. Repeated rows of one
page give equal records, each row its own two; pages that share an id but differ in url or body have
ids of their own. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import slices
from ._frames import modest_batches, staged

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
DATE = "2024-01-01T00:00:00Z"
HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Concurrent-To", "Content-Type", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-Source-Headers")
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer main nav aside blockquote pre dd dt hr form title".split())
#: Bytes read from a file at a time, and of records made before they go on.
READ_BYTES, OUT_BYTES = 1 << 20, 8 << 20
SKIP = frozenset(("script", "style", "noscript", "template"))


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{source}')}>"


def one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def build(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; headers in the order of ``HEADERS``, length last."""
    lines = ["WARC/1.1", *(f"{k}: {one_line(headers[k])}" for k in HEADERS if headers.get(k) is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def look(headers: dict[str, str], name: str, default: str = "") -> str:
    """A header's value, whatever the case of its name."""
    return next((v for k, v in headers.items() if k.lower() == name.lower()), default)


def _cut(data: bytes) -> tuple[bytes, bytes, bool]:
    """Head and rest around the first empty line, and whether there is one."""
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end() :], True) if m else (data, b"", False)


def _lines(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers: names as first written, folded lines joined, later values joined by commas."""
    lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")))
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = next((k for k in headers if k.lower() == name.strip().lower()), name.strip())
            headers[name] = ", ".join(filter(None, (headers.get(name), value.strip())))
    return lines[0], headers


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, rest, found = _cut(record)
    first, headers = _lines(head)
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    if not look(headers, "Content-Length").isdigit():
        raise ValueError("the record has no length")
    size = int(look(headers, "Content-Length"))
    if len(rest) < size:
        raise ValueError("the block is shorter than its length")
    return headers, rest[:size]


def parse_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and payload, as it was sent, of a response's block."""
    head, body, _ = _cut(block)
    status, headers = _lines(head)
    if not status.startswith("HTTP/"):
        raise ValueError("no HTTP response")
    return status, headers, body


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what isn't chunked, though its header says so, stays as it is."""
    out, at = [], 0
    while m := re.compile(rb"\s*([0-9A-Fa-f]{1,8})[^\n]*\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
    return b"".join(out) or body


def content(headers: dict[str, str], body: bytes) -> bytes:
    """The payload without its transfer and content encodings."""
    if "chunked" in look(headers, "Transfer-Encoding").lower():
        body = unchunked(body)
    for name in reversed([x.strip().lower() for x in look(headers, "Content-Encoding").split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif name != "identity":
                raise ValueError(f"unknown content encoding {name}")
        except zlib.error as e:
            if body[:2] == b"\x1f\x8b" or name == "deflate":
                raise ValueError(f"broken {name}: {e}") from None
    return body


META = re.compile(rb"""<meta[^>]{0,200}charset\s*=\s*["']?\s*([\w-]+)""", re.I)


def decoded(headers: dict[str, str], body: bytes) -> str:
    """The page's text by the header's charset, the page's own, or UTF-8."""
    named = re.search(r"charset\s*=\s*[\"']?\s*([\w-]+)", look(headers, "Content-Type"), re.I)
    inside = META.search(body[:2048])
    for charset in (named and named[1], inside and inside[1].decode(), "utf-8"):
        try:
            return body.decode(charset, "replace") if charset else body.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


class _Text(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.title, self.links, self.skip, self.in_title = base, [], [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        if tag in BLOCKS:
            self.out.append("\n")
        for name, value in attrs:
            if value and (tag, name) in (("a", "href"), ("link", "href"), ("img", "src"), ("script", "src")):
                try:
                    self.links.append({"path": f"{tag}@/{name}", "url": urljoin(self.base, value.strip())})
                except ValueError:
                    self.links.append({"path": f"{tag}@/{name}", "url": value.strip()})

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.out.append(data)


def extract(body: str, url: str) -> tuple[str, str, list[dict]]:
    """Plain text, title and links of a page."""
    parser = _Text(url)
    try:
        parser.feed(body)
        parser.close()
        raw = "".join(parser.out)
    except (AssertionError, ValueError):  # markup that the parser gives up on: strip tags
        raw = html.unescape(re.sub(r"<[^>]*>", " ", body))
    lines = (" ".join(line.split()) for line in raw.split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(parser.title).split()), parser.links


def derive_record(record: bytes) -> tuple[dict, dict] | None:
    """Metadata and conversion of a response, as dicts of their columns; None for other types."""
    error, headers, block, status, http, body, plain = None, {}, b"", "", {}, b"", b""
    try:
        headers, block = parse(record)
        if look(headers, "WARC-Type").lower() != "response":
            return None
        status, http, body = parse_http(block)
        plain = content(http, body)
    except (ValueError, KeyError) as e:
        error = str(e) or "unreadable"
    source = look(headers, "WARC-Record-ID") or f"<{sha1(record)}>"
    url, date = look(headers, "WARC-Target-URI"), look(headers, "WARC-Date", DATE)
    text, title, links = extract(decoded(http, plain), url)
    payload = look(headers, "WARC-Payload-Digest") or sha1(body)
    meta = {
        "envelope": {"warc": headers, "block-digest-ok": look(headers, "WARC-Block-Digest", sha1(block)) == sha1(block), "payload-digest-ok": payload in (sha1(body), sha1(plain))},
        "http": {"status": status, "headers": http, "length": len(body)},
        "html": {"title": title, "links": links},
    }
    if error:
        meta["error"] = error
    ids = {k: record_id(source, k) for k in ("metadata", "conversion")}
    out = []
    for kind, other, mime, made in (("metadata", "conversion", "application/json", json.dumps(meta, sort_keys=True, ensure_ascii=False).encode()), ("conversion", "metadata", "text/plain", text.encode("utf-8", "replace"))):
        h = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Target-URI": url, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date, "WARC-Concurrent-To": ids[other], "Content-Type": mime, "WARC-Block-Digest": sha1(made), "WARC-Payload-Digest": payload if kind == "metadata" else None, "WARC-Source-Headers": json.dumps(headers, sort_keys=True, ensure_ascii=False)}
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": source, "concurrent_to": ids[other], "target_uri": url, "block_digest": h["WARC-Block-Digest"], "payload_digest": payload, "content_length": len(made), "record": build(h, made)})
    return out[0], out[1]


RECORD = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("record", pa.binary())])
COLUMNS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, block_digest string, payload_digest string, content_length long, record binary"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id, record``: a response record of every page."""
    modest_batches(pages.sparkSession)
    kind = pages.select(F.col(page_id).alias("page_id")).schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, u, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, u = (b or "").encode("utf-8", "replace"), u or ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                out.append(build({"WARC-Type": "response", "WARC-Record-ID": record_id(f"{i}:{u}:{sha1(payload)}", "response"), "WARC-Date": DATE, "WARC-Target-URI": u, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": sha1(block), "WARC-Payload-Digest": sha1(payload)}, block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col(page_id).alias("page_id"), url, body).mapInArrow(run, f"page_id {kind}, record binary")


def derive(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """``key`` and the columns of the derived records, two rows a response."""
    modest_batches(records.sparkSession)
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([range(n or 0) for n in pc.binary_length(batch.column(1)).to_pylist()], OUT_BYTES):
                owner, rows = [], []
                for k in range(a, b):
                    for row in derive_record(batch.column(1)[k].as_py() or b"") or ():
                        owner.append(k), rows.append(row)
                made = pa.RecordBatch.from_pylist(rows, RECORD)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *made.columns], names=[key, *RECORD.names])

    return records.select(key, record).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")


def write_files(records: DataFrame, path: str, record: str = "record") -> DataFrame:
    """Gzipped archive files under ``path``, a member a record and a file a partition; ``file, records, bytes`` of each.

    A file gets its name when it is whole; a task that runs again replaces it by the same records.
    """
    modest_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        here = TaskContext.get()
        name = f"{folder}/part-{here.partitionId():06d}.warc.gz"
        draft = f"{folder}/_{here.taskAttemptId()}-{here.partitionId():06d}"
        n = size = 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.column(0):
                    if raw := row.as_py():
                        member = gzip.compress(raw, mtime=0)
                        out.write(member)
                        n, size = n + 1, size + len(member)
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return staged(records.select(record).mapInArrow(run, "file string, records long, bytes long"))


def split(stream) -> Iterator[bytes]:
    """The records of an archive, gzipped or not, from a binary stream; one record at a time is in memory."""
    held, gz, at_end = b"", None, False

    def more() -> bool:
        nonlocal held, gz, at_end
        raw = stream.read(READ_BYTES)
        if not raw:
            at_end = True
            return False
        if gz is None:
            gz = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else False
        if gz is False:
            held += raw
            return True
        while raw:
            held += gz.decompress(raw)
            raw = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(31)
            else:
                break
        return True

    while True:
        start = held.find(b"WARC/")
        while start < 0 and not at_end:
            more()
            start = held.find(b"WARC/")
        if start < 0:
            return
        held = held[start:]
        while not (head := re.search(rb"\r?\n\r?\n", held)) and more():
            pass
        size = re.search(rb"\nContent-Length:[ \t]*(\d+)", held[: head.start()] if head else b"", re.I)
        if not size:  # not a record: on to the next
            if not head:
                return
            held = held[head.end() :]
            continue
        end = head.end() + int(size[1])
        while len(held) < end and more():
            pass
        yield held[:end]
        held = held[end:]


def read_files(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """``source, record`` of the archives under ``path``, plain or gzipped, a task a file, read as streams."""
    modest_batches(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")  # contents aren't read
    files = listed.repartition(max(1, min(listed.count(), 4096)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                store, name = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", source))
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in split(stream):
                        held.append(raw)
                        size += len(raw)
                        if size >= OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([source] * len(held), pa.string()), pa.array(held, pa.binary())], names=["source", "record"])
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(held), pa.string()), pa.array(held, pa.binary())], names=["source", "record"])

    return files.select("path").mapInArrow(run, "source string, record binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id")
    return made.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "block_digest", "payload_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
