"""WARC: archives written as one gzip stream, normalised to a member per record.

``write_archives`` writes monolithic ``.warc.gz`` files (one gzip stream each),
``normalise`` inflates each once, front to back, rewrites every record as a gzip
member of its own and puts an offset index beside it, and ``read_archives``
reads records back through that index. Files lie in the session's shared
folder; names are fresh for each attempt, so that a repeated task never
disturbs what another has read. Any other gzip file is read alike, be it one
member or many; one that is cut short is an error. A record with an equal payload elsewhere is a
``revisit`` that carries no payload; its digest and length are in its header.

Null payloads count as empty. Of equal payloads of 100 bytes or more the smallest
page_id is the response; rows that repeat this page_id are responses too. A null
page_id is a revisit if another row has the payload, else a response. Of a very
large page one task holds the record; an empty table gives no archives; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, file_system, scratch_path, slices, table, written

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def deduplicated(pages: DataFrame, id_col: str, payload_col: str, *keep: str) -> DataFrame:
    """id, payload, payload_bytes, payload_digest, record_type, refers_to and the columns of ``keep``."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload"), *[F.col(k) for k in keep])
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("d"))
    first = written(first.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1").drop("n"), "warc-first")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, rows.payload_digest == F.col("d"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return rows.select("id", "payload", "payload_bytes", "payload_digest", *keep, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One WARC/1.1 record. The header carries what a reader needs of a revisit."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['id']) + row['payload_digest'])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.get("url") is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe=':/?&=#%+,;@!$()*~[]')}")
    if row["id"] is not None:
        head.append(f"X-Page-Id: {row['id']}")
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records to monolithic archives; one row (path, records) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out = path = None
        held = count = 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

        for big in batches:
            for batch in slices(big, "payload"):
                for row in batch.to_pylist():
                    if out is None:
                        path, held, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out, packer = fs.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(row)
                    out.write(packer.compress(raw))
                    held, count = held + len(raw), count + 1
                    if held >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return rows.mapInArrow(run, "path string, records long")


def records(stream) -> Iterator[bytes]:
    """The records of a gzip file that is read once, whatever its members; holds one record at a time.

    A file cut inside a member, a header or a record is an error.
    """
    inflate, held, begun = zlib.decompressobj(31), bytearray(), False
    more = True

    def fill() -> bool:
        nonlocal inflate, begun
        while True:
            ahead = b""
            if inflate.eof:
                ahead, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
            data = ahead or inflate.unconsumed_tail or stream.read(READ_BYTES)
            new = inflate.decompress(data, READ_BYTES) if data or begun else b""
            begun = begun or bool(data)
            if new:
                held.extend(new)
                return True
            if not data:
                if begun and not inflate.eof:
                    raise ValueError("the archive ends inside a gzip member")
                return False

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more:
            more = fill()
        if at < 0:
            if held:
                raise ValueError("the archive ends inside a record's header")
            return
        size = next(int(x[15:]) for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
        end = at + 4 + size + 4
        while len(held) < end and more:
            more = fill()
        if len(held) < end:
            raise ValueError("the archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a gzip member per record and a sidecar offset index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path, at, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(path, compression=None) as out, fs.open_output_stream(f"{path}.idx", compression=None) as index:
                    for raw in records(stream):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return paths.mapInArrow(run, "path string, records long")


def parsed(raw: bytes) -> dict:
    at = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:at].decode().split("\r\n")[1:])
    body = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
        raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
    return {"id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(head["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in head else None, "payload": body}


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each member found by the offset index alone."""
    kind = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, own = file_system(path)
                with fs.open_input_stream(f"{own}.idx", compression=None) as index:
                    entries = [json.loads(x) for x in index.read().splitlines()]
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(own) as file:
                    for entry in entries:
                        file.seek(entry["offset"])
                        rows.append(parsed(zlib.decompress(file.read(entry["length"]), 31)))
                        held += rows[-1]["payload_bytes"] if with_payload else 100
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return paths.mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", with_payload: bool = False) -> DataFrame:
    """Writes the pages, normalises the archives and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = deduplicated(pages.withColumnRenamed(url_col, "url"), id_col, payload_col, "url")
    raw = written(write_archives(rows, f"{folder}/raw"), "warc-raw")
    own = written(normalise(raw.repartition(max(1, min(10_000, raw.count())), "path"), f"{folder}/members"), "warc-members")
    return read_archives(own.repartition(max(1, min(10_000, own.count())), "path"), with_payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record reads in the normalised archives."""
    read = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d
"""
