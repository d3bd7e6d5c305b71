"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary, then has one frame a record. The reader loads the
dictionary from there, decodes frame by frame in bounded memory, and checks headers, lengths and payload digests.
Archives lie in any folder that pyarrow's file systems reach; a table of the archives written is what counts, so
files of attempts that failed are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize, scratch_dir
from .common import slices

SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
# Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 32 << 20
# The dictionary is trained on this many pages at most, of so many characters each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 4096, 16 << 10
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 8 << 10


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; raw sample text if there is too little to train on."""
    rows = pages.filter("length(html) > 0").select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()
    samples = [r[0].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def number(value: int | None) -> str:
    return "none" if value is None else str(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (without the payload) if `refers_to` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{number(page_id)}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block)))]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of one record.

    Raises ValueError for anything that is not a complete, consistent record.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    wanted = {"warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "content-length"}
    if missing := wanted - headers.keys():
        raise ValueError(f"headers missing: {sorted(missing)}")
    if rest[-4:] != b"\r\n\r\n" or headers["content-length"] != str(len(rest) - 4):
        raise ValueError("Content-Length does not fit the record")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    page = re.fullmatch(r"<urn:x-page:(none|-?\d+)>", headers["warc-record-id"])
    digest = re.fullmatch(r"sha256:([0-9a-f]{64})", headers["warc-payload-digest"])
    kind = headers["warc-type"]
    if not (found and length and page and digest and kind in ("response", "revisit")):
        raise ValueError("header missing or malformed")
    refers = None
    if kind == "revisit":
        target = re.fullmatch(r"<urn:x-page:(-?\d+)>", headers.get("warc-refers-to", ""))
        if not target or headers.get("warc-profile") != PROFILE:
            raise ValueError("revisit record without profile or the record that it refers to")
        refers = int(target[1])
        if payload:
            raise ValueError("revisit record with a payload")
    elif len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest() != digest[1]:
        raise ValueError("payload does not fit its length or digest")
    return {
        "page_id": None if page[1] == "none" else int(page[1]), "url": headers["warc-target-uri"], "payload_bytes": int(length[1]),
        "payload_digest": digest[1], "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write every row of `pages` (page_id, url, html) to archives under `path`; returns their table (archive, records).

    Of rows with equal payloads of REVISIT_BYTES or more, those with the smallest page_id are responses, the others
    revisits of it. A null html is an empty payload, a null url an empty one. A row without page_id refers to others
    but is never referred to. Other columns are not read; an empty table gives no archive.
    """
    dictionary = train(pages)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha2("html", 256))
    shared = materialize(rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"))
    rows = rows.join(shared, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(dict_data=held, write_content_size=True)
        lead = DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        frames, size = [], 0

        def closed() -> pa.RecordBatch:
            system, folder = fs.FileSystem.from_uri(path)
            system.create_dir(folder)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(lead + b"".join(frames))
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(frames)]})

        for part in slices(batches, "html"):
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                frames.append(packer.compress(record(page_id, url, html.encode(), digest, refers_to)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    frames, size = [], 0
        if frames:
            yield closed()

    return materialize(rows.mapInArrow(run, "archive string, records long"))


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one; raises ValueError if it is cut short."""
    buffer, at, dictionary = b"", 0, None

    def need(n: int) -> bytes:
        nonlocal buffer, at
        while len(buffer) - at < n and (more := stream.read(max(READ, n - len(buffer) + at))):
            buffer, at = buffer[at:] + more, 0
        return buffer[at:at + n]

    first = True
    while head := need(4):
        magic = int.from_bytes(head, "little")
        if magic in SKIPPABLE:
            length = int.from_bytes(need(8)[4:], "little")
            body = need(8 + length)[8:]
            if len(body) != length:
                raise ValueError("skippable frame is cut short")
            at += 8 + length
            if first and magic == DICTIONARY_FRAME and body:
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
            first = False
            continue
        if head != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        first, out = False, []
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        while not decoder.eof:
            piece = need(1) and buffer[at:at + READ]
            if not piece:
                raise ValueError("frame is cut short")
            out.append(decoder.decompress(piece))
            at += len(piece) - len(decoder.unused_data)
        yield b"".join(out)


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
          "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
SQL_TYPES = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string",
             "record_type": "string", "refers_to": "long", "payload": "binary"}


def read_archives(archives: DataFrame, path: str, columns: list[str] = list(FIELDS)) -> DataFrame:
    """`columns` of every record in the archives of the table; a task reads one archive at a time, as a stream.

    Raises an error if an archive has another number of records than its table says.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with system.open_input_stream(f"{folder}/{name}") as stream:
                    for frame in frames(stream):
                        rows.append(parse(frame))
                        size, seen = size + len(frame), seen + 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], FIELDS[c]) for c in columns})
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name}: {seen} records instead of {records}")
                if rows:
                    yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], FIELDS[c]) for c in columns})

    spread = archives.repartition(max(1, archives.count()))
    return spread.mapInArrow(run, ", ".join(f"{c} {SQL_TYPES[c]}" for c in columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives in the shared folder and return what the reader finds there, without payloads."""
    path = scratch_dir(pages.sparkSession)
    archives = write_archives(pages, path)
    return read_archives(archives, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
 f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
 CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
