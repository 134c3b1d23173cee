"""WARC archives: a writer with revisit records and a reader that splits gzip files by byte ranges.

Writer: digests are grouped with a partial maximum. A page's role is found on its keys alone, so of a payload
that a third of all pages has only ids meet; payloads are then dealt by page, and only those of responses. Each task writes
records, one gzip member each, to a file of its own name, and only files of finished tasks are in the
returned table, so a lost task leaves nothing that is read.

Reader: a task gets a byte range, looks for the gzip magic, and takes a candidate as a member if it
decodes to a WARC header and ends at the end of the file or at another magic. It owns the records that
start in its range and reads the last of them to its end. Damaged members are skipped to the next valid one.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are always responses;
rows that repeat the largest page_id of a payload are responses; a null page_id revisits like any other
and is a response where no page_id is known; ids of any characters come back as they were; a revisit whose
response is not in the archive ends the round trip with an error; an empty table gives no files and no records.
A member is decoded in memory: a task needs room for its largest record.
"""

from __future__ import annotations

import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from partflow.llm.shared import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
LEAST = 1000
SPLIT = 8 << 20
FILE_BYTES = 1 << 30
RECORDS = "page_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary, path string, offset long"


def _urn(page_id: str | None) -> str:
    return "<urn:nil>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _record(page_id: str | None, uri: str, size: int, payload: bytes | None, digest: str, refers_to: str | None, date: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; returns (path, bytes, records) of each file."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    roles = rows.select("page_id", "url", "size", "digest").join(first, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("keeper")))
    key = F.struct("page_id", "digest").alias("key")  # a struct is never null
    again = roles.where("refers_to IS NOT NULL")
    kept = rows.withColumn("key", key).join(again.select(key).distinct(), "key", "left_anti").select("page_id", "url", "size", "payload", "digest", F.lit(None).cast(again.schema["refers_to"].dataType).alias("refers_to"))
    again = again.select("page_id", "url", "size", F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    text = lambda c: F.col(c).cast("string")
    roles = kept.union(again).select(text("page_id"), "url", "size", "payload", "digest", text("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        name = out = None
        size = count = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            for page_id, uri, length, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                member = _record(page_id, (uri or "").replace("\r", "").replace("\n", ""), length, data, digest, refers_to, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(roles.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def _member(handle: pa.NativeFile, at: int, size: int) -> tuple[bytes, int] | None:
    """The decoded member at a byte and the byte after it; null if there is no WARC member."""
    handle.seek(at)
    inflate, parts, read = zlib.decompressobj(31), [], 0
    try:
        while not inflate.eof:
            block = handle.read(1 << 16)
            if not block:
                return None
            read += len(block)
            parts.append(inflate.decompress(block))
            if len(parts) == 1 and len(parts[0]) >= 7 and not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    data, after = b"".join(parts), at + read - len(inflate.unused_data)
    if not data.startswith(b"WARC/1."):
        return None
    if after < size:
        handle.seek(after)
        if handle.read(len(MAGIC)) != MAGIC:
            return None
    return data, after


def _next_magic(handle: pa.NativeFile, at: int, end: int) -> int:
    """The first byte from ``at`` before ``end`` where the gzip magic stands, or -1."""
    while at < end:
        handle.seek(at)
        block = handle.read(min(1 << 20, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        if found >= 0:
            return at + found
        at += max(1, len(block) - len(MAGIC) + 1)
    return -1


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", "0"))]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of the files (path, bytes), read in byte ranges of ``split``."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    spread = ranges.repartition(max(1, min(100_000, int(files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1))), "path", "start")

    def page(value: str | None) -> str | None:
        inner = (value or "").strip("<>")
        return unquote(inner.removeprefix("urn:page:")) if inner.startswith("urn:page:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as handle:
                    at, end, rows, held = start, min(size, start + split), [], 0
                    while at < end and (at := _next_magic(handle, at, end)) >= 0:
                        if (found := _member(handle, at, size)) is None:
                            at += 1
                            continue
                        fields, payload = _parsed(found[0])
                        rows.append((page(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), page(fields.get("warc-refers-to")), fields.get("warc-payload-digest"), payload, path, at))
                        at, held = found[1], held + len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread.select("path", "bytes", "start").mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and give size, digest and kind of each page's record."""
    kind = pages.schema["page_id"].dataType
    files = write_warc(pages, shared_dir(pages.sparkSession, "warc"))
    records = read_warc(files).select(
        F.col("page_id").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("payload_digest").alias("stated"),
    )
    records = stored(records, "warc-records")
    whole = records.where("record_type = 'response'")
    sources = whole.where(F.col("payload_bytes") >= LEAST).select(F.col("page_id").alias("source"), F.col("stated").alias("of"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")).distinct()
    same = (F.col("refers_to") == F.col("source")) & (F.col("stated") == F.col("of"))
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(sources, same, "left")
    found = F.coalesce(F.col("n"), F.raise_error(F.concat(F.lit("no response for page "), F.col("refers_to").cast("string"))).cast("long"))
    again = again.select("page_id", found.alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return whole.drop("stated").unionByName(again)
