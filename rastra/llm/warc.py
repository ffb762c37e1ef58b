"""WARC derivatives: a metadata and a conversion record for each response.

The metadata record holds the source's headers, title and digest; the conversion record is the page's plain
text.  Both refer to the response by WARC-Refers-To and to each other by WARC-Concurrent-To.  Record ids are
name-based UUIDs of the response, so a repeated task writes the same records.

Defined results: two rows for each input row; a null page is an empty payload, a null url leaves
target_uri out; repeated rows give equal records; an empty table gives none.  Columns named headers
(raw HTTP header lines), record_id and date are taken from the source if they are strings, and source_headers is null
where none came; others are ignored.  Line breaks in a header's value are written as %0D and %0A, so that no value
makes a header.  Pages are read in time proportional to their length, whatever tags stay open in them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage
from .repair import put

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre|title|head|body|html|dt|dd|dl|form|td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?/][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_SPACES, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
EPOCH = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def plain_text(page: str) -> str:
    """Text of a page: no scripts, styles, comments or tags; a line for each block; entities decoded."""
    # Behind the last > no tag is complete: there the patterns would look for its end again and again.
    cut = page.rfind(">") + 1
    tail = page[cut:]
    text = _DROP.sub(" ", page[:cut])
    if "<!--" in tail:
        tail = tail[: tail.index("<!--")]
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text)) + tail)
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def title_of(page: str) -> str | None:
    """The first title's text; None if there is none or it stays open."""
    begin = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return " ".join(html.unescape(page[begin.end() : end.start()]).split()) if end else None


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def derive(page_id, url, page, headers=None, record_id=None, date=None) -> list[dict]:
    payload = (page or "").encode("utf-8", "surrogatepass")
    source_digest = digest(payload)
    source = record_id or f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'response|{page_id}|{url}|{source_digest}')}>"
    title = title_of(page or "")
    fields = [("source-record-id", source), ("source-payload-digest", source_digest), ("source-payload-length", str(len(payload)))]
    fields += [("title", title)] if title is not None else []
    fields += [("source-header", line) for line in (headers or "").splitlines() if line.strip()]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", plain_text(page or ""))}
    ids = {kind: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}|{source}')}>" for kind in blocks}
    out = []
    for kind, (media, block) in blocks.items():
        raw = block.encode("utf-8", "surrogatepass")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append({"page_id": page_id, "record_type": kind, "record_id": ids[kind], "refers_to": source, "concurrent_to": other, "target_uri": url, "record_date": date or EPOCH,
                    "content_type": media, "content_length": len(raw), "block_digest": digest(raw), "source_digest": source_digest, "source_headers": headers, "block": block})
    return out


_SCHEMA = pa.schema([(n, pa.int64() if n in ("page_id", "content_length") else pa.string()) for n in derive(1, "", "")[0]])
_DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _SCHEMA)


def _run(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))
            yield pa.RecordBatch.from_pylist([x for r in rows for x in derive(*r)], _SCHEMA)


def derivatives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Two records for each page; see ``derive`` for the columns."""
    storage.small_batches(pages.sparkSession, 500)
    kinds = dict(pages.dtypes)
    more = [F.col(c) if kinds.get(c) == "string" else F.lit(None).cast("string").alias(c) for c in ("headers", "record_id", "date")]
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"), *more).mapInArrow(_run, _DDL)


#: Columns that are headers of a record, in their order.
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "record_date": "WARC-Date", "target_uri": "WARC-Target-URI",
            "block_digest": "WARC-Block-Digest", "source_digest": "Source-Payload-Digest", "page_id": "Source-Page-ID", "content_type": "Content-Type"}


def record_bytes(r: dict) -> bytes:
    block = r["block"].encode("utf-8", "surrogatepass")
    lines = [f"{name}: {_one_line(str(r[c]))}\r\n" for c, name in _HEADERS.items() if r[c] is not None]
    head = "WARC/1.1\r\n" + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _members(data: bytes):
    """The decompressed members of a gzip file, one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + (1 << 16)]
            if not piece:
                raise ValueError("the file ends within a member")
            out.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        yield b"".join(out)


def parse(data: bytes):
    """Headers and block of every record of a (gzip) WARC file, one after the other; a member holds whole records."""
    for raw in _members(data):
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            at = end + 4 + int(headers["Content-Length"])
            if raw[at : at + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end as it should")
            yield headers, raw[end + 4 : at]
            at += 4


def write_warc(records: DataFrame, uri: str, file_bytes: int = 16 << 20) -> DataFrame:
    """Write records to part files of gzip members; returns file, records, bytes."""

    def run(batches):
        part, seq, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            name = f"derived-{part:06d}-{seq:06d}.warc.gz"
            put(uri, name, b"".join(held))
            return pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": size}])

        for batch in batches:
            for r in batch.to_pylist():
                held.append(gzip.compress(record_bytes(r), 1, mtime=0))
                size, n = size + len(held[-1]), n + 1
                if size >= file_bytes:
                    yield close()
                    seq, held, size, n = seq + 1, [], 0, 0
        if n:
            yield close()

    return storage.written(records.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


_READ = pa.schema([(n, _SCHEMA.field(n).type) for n in _SCHEMA.names if n not in ("source_headers",)])


def _parsed(batches):
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for head, block in parse(data.as_py()):
                row = {c: head.get(name) for c, name in _HEADERS.items()}
                if digest(block) != row["block_digest"]:
                    raise ValueError(f"record {row['record_id']} differs from its digest")
                row["page_id"] = None if row["page_id"] is None else int(row["page_id"])
                rows.append(row | {"content_length": len(block), "block": block.decode("utf-8", "surrogatepass")})
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _READ)


def read_warc(spark, uri: str) -> DataFrame:
    """The records of the files below ``uri``, each checked against its digest; columns as of ``derivatives``, but for
    source_headers, which the metadata block holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri).select("content")
    return files.mapInArrow(_parsed, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _READ))
