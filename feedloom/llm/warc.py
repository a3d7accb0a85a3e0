"""WARC archives: a writer with revisit records and a reader that splits files by byte ranges.

Defined results: a null payload is empty; pages with equal payload of at least ``min_revisit_bytes`` bytes are
one group whose largest id is the response (rows that repeat this id are responses as well); ids that are null
never become the response of a group with other ids; other columns of the input are ignored; an empty table
gives no archive, and no archive gives no record. A record of any length is decoded whole in one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import new_folder, small_batches, written

MAGIC = b"\x1f\x8b\x08"
RECORD_START = b"WARC/1."
SPLIT_BYTES = 16_000_000
READ_BYTES = 1_000_000
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 of the SHA-1: five hexadecimal digits are four of base32."""
    hexed = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    # The digits of base 32 as numbers are written, and those of RFC 4648.
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, url, payload) with payload_digest, payload_bytes, record_type and refers_to.

    One narrow row per digest is found first (combined before the shuffle) and written, so that the
    join that follows has plain exchanges on both sides and a payload of a third of all pages is split.
    """
    payload = F.coalesce("payload", F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    groups = (
        rows.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    )
    groups = written(groups.where("n > 1").drop("n"), "warc-groups")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return rows.join(groups, "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _header(fields: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _record(page_id, url, payload, digest, size, kind, refers_to) -> bytes:
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "").split()) or "about:blank",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    else:
        block += payload
    fields["Content-Length"] = len(block)
    return gzip.compress(_header(fields) + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, payload) as WARC files in a folder that all executors share.

    Returns the files (path, bytes, records). Each attempt of a task has a file of its own and only those
    of the attempts that Spark took are returned, so a lost executor leaves no half file among them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        path = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(path, compression=None)
                info = _header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{context.partitionId()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Length": 0})
                size += out.write(gzip.compress(info + b"\r\n\r\n", 6, mtime=0))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                size += out.write(_record(*row))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "bytes": [size], "records": [records]})

    small_batches(pages.sparkSession)
    rows = with_record_types(pages, min_revisit_bytes)
    return written(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-files")


def _fields(head: bytes) -> dict[str, str] | None:
    """The header of a record; None if these bytes are none."""
    if not head.startswith(RECORD_START):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    found = dict(x.split(": ", 1) for x in lines if ": " in x)
    return found if found.get("Content-Length", "").isdigit() and "WARC-Type" in found else None


def _member(file, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header, block, end) of the gzip member at a place; None if there is no record."""
    inflate, data, fields, place, searched = zlib.decompressobj(31), bytearray(), None, at, 0
    while not inflate.eof:
        if place >= size:
            return None
        chunk = file.read_at(min(READ_BYTES if fields else 65_536, size - place), place)
        place += len(chunk)
        try:
            data += inflate.decompress(chunk)
        except zlib.error:
            return None
        if fields is None:
            # A header of any length is read to its end; what does not begin like a record is given up at once.
            if not data.startswith(RECORD_START[: len(data)]):
                return None
            stop = data.find(b"\r\n\r\n", max(0, searched - 3))
            searched = len(data)
            if stop < 0 and not inflate.eof:
                continue
            fields = _fields(bytes(data[:stop])) if stop >= 0 else None
            if fields is None:
                return None
    start = data.find(b"\r\n\r\n") + 4
    return fields, bytes(data[start : start + int(fields["Content-Length"])]), place - len(inflate.unused_data)


def records_from(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records whose first byte is in [start, end)."""
    at = start
    while at < end:
        window = file.read_at(min(READ_BYTES, end - at) + len(MAGIC) - 1, at)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        if at + found >= end:
            return
        member = _member(file, at + found, size)
        if member is None:
            at += found + 1
            continue
        yield at + found, member[0], member[1]
        at = member[2]


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    name = fields.get("WARC-Record-ID", "")
    refers = fields.get("WARC-Refers-To")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("WARC-Payload-Digest", "sha1:").removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if actual != digest or length != len(payload):
            raise ValueError(f"record {name} is damaged")
    else:
        payload = None
    return name.removeprefix("<urn:page:").rstrip(">"), fields["WARC-Type"], fields.get("WARC-Target-URI"), (
        refers and refers.removeprefix("<urn:page:").rstrip(">")
    ), digest or None, length, payload


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of WARC files (path, bytes), see ``RECORD_SCHEMA``.

    A task takes a byte range, looks for gzip magic, checks each candidate by decoding a header, and owns
    the records that start in its range. Digests and lengths of responses are those of the bytes read.
    """
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for _, fields, block in records_from(file, start, min(start + split_bytes, size), size):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        row = _parsed(fields, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(row[-1] or b"") if with_payload else 1_000
                        if held > READ_BYTES * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small_batches(spark)
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(max(1, int(n))).mapInArrow(read, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read their records."""
    return read_archives(write_archives(pages, new_folder(spark, "warc"), min_revisit_bytes), with_payload=False)
