"""WARC archives: an index with every record's place first, then coalesced byte-range reads of selected records.

Writing: each task streams its pages into gzip members, one a record, in files of its own in the target folder, and
yields an index row a record: file, offset, length, URL, digest. The index is stored as a table; a task that runs
again writes new files, and only those that the stored index names count, so lost executors do no harm.

Reading: the index rows selected are range-partitioned and sorted by file and offset; each task joins neighbouring
ranges with small gaps to reads of a few MB, and unpacks the members inside. No file is scanned from its start.

The target folder may be in any store that pyarrow's filesystems open by URI; executors and driver must share it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, new_path
from .url_filter import with_possible

FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(uri: str):
    """(filesystem, path) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _target(url: str | None) -> str:
    """A header's value: control characters and blanks become percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A response record, or with refers_to a revisit record, and the payload's digest."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> dict:
    """page_id, url, type, refers_to, payload_bytes, payload_digest and payload (null in a revisit) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a WARC payload of another digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_INDEX_SQL = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _writer(folder: str, file_bytes: int, level: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        out, name, at, index = None, "", 0, []
        for batch in rows:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                record, digest = make_record(page_id, url, html.encode() if html else b"", refers_to)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                index.append({"file": name, "offset": at, "length": len(member), "page_id": page_id, "url": url, "digest": digest, "record_type": "response" if refers_to is None else "revisit"})
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            if out is not None:
                out.flush()
            yield pa.RecordBatch.from_pylist(index, _INDEX)
            index = []
        if out is not None:
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC files in folder and gives the stored index.

    Of records whose payloads (html in UTF-8, null as empty) are equal and have at least min_bytes bytes, that with
    the largest page_id is a response, the others revisit it. Rows with a null page_id revisit it too, but are
    responses where no equal row has an id; rows that repeat the largest id are responses all. Null URLs are left
    out of the record. Other columns are ignored; an empty table gives an empty index.
    """
    batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("key"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    keeper = rows.where(F.col("size") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # payloads that surely occur once stay where they are; only the others are shuffled by key
    found = with_possible(rows.withColumn("canonical", F.col("key")), keeper.select(F.col("key").alias("canonical")))
    alone = found.where("not possible").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    some = found.where("possible").join(keeper, "key", "left")
    told = alone.unionByName(some.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")))
    return materialise(told.mapInArrow(_writer(folder, file_bytes, level), _INDEX_SQL), "warc-index")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_SQL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, offset, length, ranges inside) of the reads that cover sorted (file, offset, length) ranges."""
    file, start, end, inside = None, 0, 0, []
    for f, o, n in ranges:
        if inside and (f != file or o - end > gap or o + n - start > most):
            yield file, start, end - start, inside
            inside = []
        if not inside:
            file, start, end = f, o, o
        inside.append((o, n))
        end = max(end, o + n)
    if inside:
        yield file, start, end - start, inside


def _reader(folder: str, gap: int, most: int, with_payload: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        name, source = None, None
        for batch in rows:
            for file, start, length, inside in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), gap, most):
                if file != name:
                    name, source = file, store.open_input_file(f"{top}/{file}")
                data = source.read_at(length, start)
                out = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside]
                if not with_payload:
                    for x in out:
                        x["payload"] = None
                yield pa.RecordBatch.from_pylist(out, _RECORD)

    return run


def read_records(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES, with_payload: bool = True) -> DataFrame:
    """Reads the records that rows of index name (all of them or any selection), checking every payload's digest."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, gap, most, with_payload), _RECORD_SQL)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with raw as (select page_id, encode(coalesce(html, '')) as payload from pages),
     hashed as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex from raw),
     kept as (select *, max(page_id) over (partition by hex) as keeper from hashed)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
       case when page_id = keeper then 'response' else 'revisit' end as record_type,
       case when page_id <> keeper then keeper end as refers_to
from kept"""
