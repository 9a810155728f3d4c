"""WARC archives with the index first.

Writing: equal payloads are found by digest, the one with the smallest page id becomes a ``response``, others ``revisit`` it. Tasks
stream records (one gzip member each) into archive files of their own in the shared folder and return an index row per record: archive,
offset, length, URL, digest, page. The index is stored as a table before anything reads it, so it only names files of attempts that
succeeded; what a lost attempt leaves is never looked at.

Reading: the selected index rows are sorted by place, neighbouring ranges are joined to reads of bounded size, and the records are parsed
from the archives alone and checked against their digests.

Null payloads are empty. Pages with a null id never become the response others refer to, unless all copies have none. Rows that repeat
the response's id are responses too. Control characters and spaces of URLs are percent-encoded; a null URL is ``urn:none``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.shared import shared_folder, stored

READ_BYTES, TASK_BYTES = 8 << 20, 16 << 20
GAP_BYTES = 64 << 10
INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page_of(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _record(page: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, str, str]:
    """A record's bytes, payload digest and type."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "urn:none" if url is None else "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1").decode()
    revisit = first is not None and first != page
    kind = "revisit" if revisit else "response"
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest, kind


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages below ``folder`` and return the stored index."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    copies = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(stored(copies).hint("shuffle_hash"), "key", "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                if out is None and len(batch):
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0])
                    out = store.open_output_stream(path, compression=None)
                found = []
                for page, url, payload, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                    page, url = page.as_py(), url.as_py()
                    record, digest, kind = _record(page, url, payload.as_py(), first.as_py())
                    packed = gzip.compress(record, 1, mtime=0)
                    out.write(packed)
                    found.append((page, url, digest, kind, name, place, len(packed)))
                    place += len(packed)
                columns = list(zip(*found, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, INDEX))


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]


def _parsed(record: bytes) -> tuple:
    """A record's columns, from its own bytes."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    uri = fields["WARC-Target-URI"]
    return _page_of(fields["WARC-Record-ID"]), None if uri == "urn:none" else uri, size, digest, kind, refers, payload if kind == "response" else None


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` (any selection of its rows) names, read as few, sorted byte ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            i = 0
            while i < len(at):
                archive, begin, length = at[i]
                j, stop = i + 1, begin + length
                while j < len(at) and at[j][0] == archive and at[j][1] - stop <= GAP_BYTES and at[j][1] + at[j][2] - begin <= READ_BYTES:
                    stop = at[j][1] + at[j][2]
                    j += 1
                if archive != name:
                    store, path = fs.FileSystem.from_uri(archive)
                    name, source = archive, store.open_input_file(path)
                raw = source.read_at(stop - begin, begin)
                found = [_parsed(gzip.decompress(raw[o - begin : o - begin + n])) for _, o, n in at[i:j]]
                columns = [list(c) for c in zip(*found, strict=True)]
                if not payloads:
                    columns[6] = [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD_TYPES, strict=True)], _RECORD_NAMES)
                i = j

    size = index.agg(F.sum("length")).first()[0] or 0
    place = index.select("archive", "offset", "length").repartitionByRange(max(1, -(-size // TASK_BYTES)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return place.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives, read every record back: one row per page, from the archives."""
    index = write_archives(pages, folder or shared_folder(pages.sparkSession))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
