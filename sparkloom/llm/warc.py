"""WARC archives of pages, written and read as chunk rows.

A payload is a number of rows (record, chunk number) of CHUNK bytes at most, in the order of its bytes, so neither the
writing nor the reading task holds a record whole: a writer appends chunk after chunk to the record's gzip member, a
reader hands on what it has read and the SHA-1 of the record so far.

Of equal payloads one is a response record; the others are revisit records that refer to it and have no payload. Which
is which is decided on digests alone. Payloads are written by the task that reads them: a bitmap rules out that a row is
a revisit, and only rows that it can't tell, but for sure revisits, move to an exact join. Archives of lost tasks stay
behind in the folder; the table of archives has those of committed tasks only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import file_system, fresh_path, split_by_bitmap, table, written

CHUNK = 64 * 1024
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 * 1024 * 1024
#: Payloads of fewer bytes are response records even if equal ones exist.
LEAST_BYTES = 0
#: Formats' fixed values.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

ARCHIVES = StructType([StructField("archive", StringType()), StructField("records", LongType()), StructField("bytes", LongType())])
_CHUNK_ROW = ["record_id", "record_type", "url", "sha1", "n_bytes", "refers_to", "refers_url", "chunk", "last", "data"]


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(text: str | None, record: str) -> str:
    """A header's URI: whatever can't stand in a line is percent-encoded; the record's own name where there is none."""
    return quote(text, safe="%:/?#[]@!$&'()*+,;=~") if text else f"urn:{record}"


def record_head(row: dict, date: str) -> bytes:
    """The lines of a record before its payload: its own, and those of the HTTP response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    lines = [
        f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:{row['record_id']}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(row['url'], row['record_id'])}", f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['n_bytes'])}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:{row['refers_to']}>", f"WARC-Refers-To-Target-URI: {_uri(row['refers_url'], row['refers_to'])}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class ArchiveWriter:
    """One archive: a gzip member for each record, written chunk by chunk."""

    def __init__(self, folder: str, date: str):
        self.fs, path = file_system(folder)
        self.name, self.date, self.records, self.bytes = f"pages-{uuid.uuid4().hex}.warc.gz", date, 0, 0
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)  # else it compresses by the name, again
        info = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
        self._begin(VERSION + f"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info)
        self._end()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.member.compress(head))

    def _end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def add(self, row: dict) -> None:
        """The next chunk; ``row["chunk"]`` 0 begins a record, ``row["last"]`` ends it."""
        if row["chunk"] == 0:
            self._begin(record_head(row, self.date))
            self.sha1, self.n = hashlib.sha1(), 0
        if row["data"]:
            self.sha1.update(row["data"])
            self.n += len(row["data"])
            self._put(self.member.compress(row["data"]))
        if row["last"]:
            if row["record_type"] == "response" and (self.sha1.digest(), self.n) != (row["sha1"], row["n_bytes"]):
                raise ValueError(f"chunks of {row['record_id']} aren't its payload")
            self._end()
            self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.name, self.records, self.bytes


def write(chunks: DataFrame, folder: str, date: str) -> DataFrame:
    """Writes rows of _CHUNK_ROW, a record's together and in order, to archives in ``folder``; a written table of ARCHIVES."""
    file_system(folder)  # a folder that can't be opened is an error here, before any task

    def run(batches):
        archive, done = None, []
        for b in batches:
            for row in b.to_pylist():
                if archive and row["chunk"] == 0 and archive.bytes > ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
                archive = archive or ArchiveWriter(folder, date)
                archive.add(row)
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=ARCHIVES.names)

    return written(chunks.select(*_CHUNK_ROW).mapInArrow(run, ARCHIVES), "warc-archives")


def _same(a: DataFrame, b: DataFrame):
    return (a["sha1"] == b["sha1"]) & a["page_id"].eqNullSafe(b["page_id"])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Rows of _CHUNK_ROW for the pages' records: a response for each payload, a revisit for each further page that has it.

    The response is that of the smallest id (a null comes last, then the smaller address, then either of equal rows).
    Payloads under ``least_bytes`` are all responses. A null payload is empty; a null address is the record's own name.
    Repeated rows are records of their own. Other columns aren't read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    size = F.octet_length(payload).cast("long")
    whole = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), size.alias("n_bytes"), F.unhex(F.sha1(payload)).alias("sha1"))
    whole = whole.withColumn("pair", F.xxhash64("sha1", "page_id"))
    keys = written(whole.drop("payload").withColumn("at", F.monotonically_increasing_id()), "warc-keys")
    large = F.col("n_bytes") >= least_bytes
    firsts = keys.where(large).groupBy("sha1").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "at")).alias("first")).where("n > 1")
    copies = keys.where(large).join(firsts.select("sha1", "first"), "sha1").where(F.col("at") != F.col("first.at"))
    revisits = written(copies.select("page_id", "url", "sha1", "n_bytes", "pair", "at", "first"), "warc-revisits")

    # Pairs of digest and id that have a revisit; only those of another id than the response's are revisits throughout.
    special = revisits.select(F.col("pair").alias("id"))
    never = revisits.where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("sha1", "page_id").distinct()
    perhaps = split_by_bitmap(keys.where(large), "pair", special)[0].select("sha1", "page_id", "pair").distinct()
    open_ = written(perhaps.join(never, _same(perhaps, never), "left_anti"), "warc-open")
    unsure, clear = split_by_bitmap(whole.where(large), "pair", special)
    unsure, _ = split_by_bitmap(unsure, "pair", open_.select(F.col("pair").alias("id")))
    exact = unsure.join(open_, _same(unsure, open_), "left_semi").groupBy("sha1", "page_id").agg(F.min(F.struct("url", "n_bytes", "payload")).alias("p"))
    name = F.concat_ws(":", F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lower(F.hex("sha1")))
    serial = F.monotonically_increasing_id().cast("string")
    response = clear.select(name.alias("record_id"), "url", "sha1", "n_bytes", "payload")
    response = response.unionByName(exact.select(name.alias("record_id"), "p.url", "sha1", "p.n_bytes", "p.payload"))
    response = response.unionByName(whole.where(~large).select(F.concat_ws(":", name, serial).alias("record_id"), "url", "sha1", "n_bytes", "payload"))
    chunks = F.greatest(F.ceil(F.col("n_bytes") / chunk), F.lit(1)).cast("int")
    none = F.lit(None).cast("string")
    response = response.select("record_id", F.lit("response").alias("record_type"), "url", "sha1", "n_bytes", none.alias("refers_to"), none.alias("refers_url"), "payload", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    response = response.select(*_CHUNK_ROW[:8], (F.col("chunk") == F.col("chunks") - 1).alias("last"), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))
    to = F.concat_ws(":", F.lit("page"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("-")), F.lower(F.hex("sha1")))
    revisit = revisits.select(
        F.concat_ws(":", name, F.col("at").cast("string")).alias("record_id"), F.lit("revisit").alias("record_type"), "url", "sha1", "n_bytes", to.alias("refers_to"),
        F.col("first.url").alias("refers_url"), F.lit(0).alias("chunk"), F.lit(True).alias("last"), F.lit(None).cast("binary").alias("data"),
    )
    return response.unionByName(revisit)


def _fields(lines) -> dict[str, str]:
    """Header lines up to the empty one, by lower-case name."""
    found = {}
    for line in iter(lines.readline, b""):
        if not line.strip():
            break
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return found


class _Counted:
    """A record's block: not more than ``left`` bytes of a stream."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, most: int) -> bytes:
        data = self.stream.read(min(most, self.left))
        self.left -= len(data)
        if not data and most and self.left:
            raise ValueError("archive ends within a record")
        return data

    def readline(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line


def read_archive(stream, chunk: int = CHUNK):
    """Dicts of the chunk rows of an archive's response and revisit records, front to back, from an open file.

    A record's rows have sha1 and n_bytes so far, that is, in its last row, of the whole payload; a revisit is one row,
    which has what its record says of the payload. Responses that their own digest or length contradicts are an error.
    """
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while True:
        line = lines.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not re.match(rb"WARC/\d", line):
            raise ValueError("not a WARC record")
        head = _fields(lines)
        block = _Counted(lines, int(head["content-length"]))
        kind = head.get("warc-type")
        if kind in ("response", "revisit"):
            said = head.get("warc-payload-digest", "").removeprefix("sha1:")
            http = {}
            if head.get("content-type", "").startswith("application/http"):
                block.readline()
                http = _fields(block)
            row = {"record_id": head["warc-record-id"].strip("<>").removeprefix("urn:"), "record_type": kind, "url": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>").removeprefix("urn:") or None}
            if kind == "revisit":
                yield row | {"chunk": 0, "last": True, "n_bytes": int(http.get("content-length", 0)), "digest": said, "data": b""}
            else:
                sha1, n, at = hashlib.sha1(), 0, 0
                while True:
                    data = block.read(chunk)
                    sha1.update(data)
                    n += len(data)
                    last = not block.left
                    if last and (said and base32(sha1.digest()) != said or int(http.get("content-length", n)) != n):
                        raise ValueError(f"damaged record {row['record_id']}")
                    yield row | {"chunk": at, "last": last, "n_bytes": n, "digest": base32(sha1.digest()), "data": data}
                    at += 1
                    if last:
                        break
        while block.read(chunk):
            pass


CHUNKS = StructType(
    [
        StructField("archive", StringType()), StructField("record_id", StringType()), StructField("record_type", StringType()), StructField("url", StringType()),
        StructField("refers_to", StringType()), StructField("chunk", IntegerType()), StructField("last", BooleanType()), StructField("n_bytes", LongType()),
        StructField("digest", StringType()), StructField("data", BinaryType()),
    ]
)
_ARROW = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])
#: Rows, and bytes of data, after which a reader hands on a batch.
BATCH_ROWS, BATCH_BYTES = 500, 8 * 1024 * 1024


def read(archives: DataFrame, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (CHUNKS) of the archives in ``folder`` that ``archives(archive)`` names; an archive is a task's work.

    Without data, the rows have all but the payload's bytes, which are read and digested all the same.
    """
    file_system(folder)

    def run(batches):
        fs, path = file_system(folder)
        rows, held = [], 0
        for b in batches:
            for name in b.column("archive").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for row in read_archive(stream, chunk):
                        held += len(row["data"])
                        rows.append(row | {"archive": name, "data": row["data"] if with_data else None})
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    each = archives.select("archive").repartition(max(1, archives.count()))
    return each.mapInArrow(run, CHUNKS)


def page_of(record):
    """The page_id in a record's name; null for a page without one."""
    return F.nullif(F.split_part(record, F.lit(":"), F.lit(2)), F.lit("-")).cast("long")


def op13(spark, sf_dir) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write(records(table(spark, sf_dir, "pages")), folder, "2000-01-01T00:00:00Z")
    ends = read(archives, folder, with_data=False).where("last")
    refers = F.when(F.col("record_type") == "revisit", page_of(F.col("refers_to")))
    return ends.select(page_of(F.col("record_id")).alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", refers.alias("refers_to"))


ORACLE = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS first_id FROM payloads)
SELECT page_id, strlen(payload) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM placed
"""
