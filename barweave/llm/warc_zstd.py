"""Web archives: WARC/1.1 records, one Zstandard frame each, with the dictionary in a leading skippable frame.

An archive is a row (archive string, content binary), as Spark's ``binaryFile`` reader gives for files; tables of
such rows can lie in any store that Spark writes to. Records with equal payloads are written once as ``response``,
the rest as ``revisit`` without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barweave.llm.shared import written

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
_NULL = 1 << 64
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")
_KEEP = 64  # the bits of an id


def _urn(page_id: int | None) -> str:
    x = f"{_NULL if page_id is None else page_id % _NULL:032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _page_id(urn: str) -> int | None:
    x = int(urn.removeprefix("<urn:uuid:").rstrip(">").replace("-", ""), 16)
    return None if x == _NULL else x - _NULL if x >> (_KEEP - 1) else x


def _target(url: str | None) -> list[str]:
    """Header lines of the url; a null one has none. One with white space or control characters is escaped and told so."""
    if url is None:
        return []
    if not _UNSAFE.search(url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url)}", "X-Target-URI-Escaped: 1"]


def pack_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        *_target(url), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if not is_response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """One record's fields; a wrong length, header or digest raises ValueError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} - fields.keys():
        raise ValueError(f"a record lacks {sorted(missing)}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has {len(rest) - 4} bytes and should have {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("a record's block is no HTTP response")
    lengths = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (lengths != [len(payload)] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload doesn't match its length or digest")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError(f"a record of type {kind} isn't sound")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]), "url": unquote(url) if (url := fields.get("WARC-Target-URI")) and "X-Target-URI-Escaped" in fields else url, "payload": payload, "payload_bytes": lengths[0], "payload_digest": digest, "record_type": kind,
        "refers_to": _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def pack_archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 16_384) -> bytes:
    """The dictionary, learned from the records' first parts, then a frame for each record."""
    import zstandard

    sample = [x[:4096] for x in records[:128]]
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, sample).as_bytes()
    except zstandard.ZstdError:  # too few records to learn from
        trained = b"".join(sample)[-dictionary_bytes:].ljust(8, b"\0")
    shared = zstandard.ZstdCompressionDict(trained)
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
    return struct.pack("<II", SKIPPABLE, len(trained)) + trained + b"".join(map(packer.compress, records))


def unpack_archive(content: bytes, step: int = 65_536) -> Iterator[bytes]:
    """The records of an archive, one per frame; a frame that is cut short raises ValueError."""
    import zstandard

    view, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(view) >= 8 and (head := struct.unpack("<II", view[:8]))[0] == SKIPPABLE:
        at = 8 + head[1]
        trained = bytes(view[8:at])
        if trained[:4] == struct.pack("<I", FRAME):
            trained = zstandard.ZstdDecompressor().decompress(trained)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    while at < len(view):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut short")
            piece = view[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Pages (page_id, url, html) to archives (archive, content) of about ``archive_bytes`` of records each.

    The payload is the html in UTF-8; null is empty. Of pages with equal payloads those with the largest page_id are
    responses, the others revisit that id. A null url stays null, and every other url comes back as it is. Repeated rows each get a record. A null page_id ranks below all others. An
    empty table gives no archive. Other columns are not read.
    """
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "coalesce(cast(html as string), '') html").withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # only payloads that occur twice or more are looked up, in a table of their digests: Spark broadcasts it if it is small,
    # and otherwise can split a digest that many pages have
    best = rows.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("of", "best")
    joined = rows.join(written(best, "repeated"), F.col("digest") == F.col("of"), "left")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("of").isNull(), F.col("page_id")).otherwise(F.col("best")).alias("refers_to"))

    def run(batches):
        import uuid

        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"], pa.string()), pa.array([pack_archive(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(2).cast("binary").to_pylist()
                for page_id, url, payload, digest, refers in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    record = pack_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, page_id == refers)
                    held.append(record)
                    size += len(record)
                    if size >= archive_bytes:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return joined.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, content_col: str = "content", payload: bool = False) -> DataFrame:
    """A row per record of archives in ``content_col``, such as ``spark.read.format("binaryFile")`` gives.

    Frames, headers, lengths and digests are checked; what doesn't hold raises an error. A null archive has no
    records. With ``payload`` the payload's bytes come along (null for a revisit).
    """
    schema = RECORDS + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and x["record_type"] == "revisit" else x[n] for x in rows], t) for n, t in zip(names, fields, strict=True)], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                content, rows = batch.column(0)[row].as_py(), []
                for record in unpack_archive(content or b""):
                    fresh = parse_record(record)
                    if not payload:
                        del fresh["payload"]
                    rows.append(fresh)
                    if len(rows) >= (64 if payload else 2048):
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return archives.select(F.col(content_col).cast("binary").alias("content")).mapInArrow(run, schema)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as ``.warc.zst`` files to a folder that every executor mounts; a row (path, bytes) per file."""

    def run(batches):
        import os

        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                with open(f"{path}.part", "wb") as file:
                    sizes.append(file.write(content))
                os.replace(f"{path}.part", path)  # a task that runs twice leaves whole files only
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "path string, bytes long")
