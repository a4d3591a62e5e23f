"""Media columns: content-addressed payloads in tar shards.

A payload (a text's UTF-8 bytes and zero bytes up to a positive multiple of 64) is stored as an 8-bit grey
PNG image, 64 samples wide. Each task writes one tar shard, in which a payload is stored once and its member is
named by the digest of its content; rows carry digest, shard, offset and length and no payload. Metadata columns
are filled by range reads of the image's header alone; the payload is read back only where it is asked for.

Rows keep the copy in their own shard, so neither writing nor reading moves a payload between machines: a payload
that occurs in several shards is stored once in each. A lost or repeated task writes a shard of a new name, and
only shards of committed tasks are referred to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import file_system, fresh_path, table, written

WIDTH = 64
#: Bytes of a stored image that hold signature, size and sample format.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Features of payloads that a reading task remembers; payloads themselves are never kept.
REMEMBERED = 20_000


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def store_image(payload: bytes) -> bytes:
    """The payload's bytes as samples of a grey PNG; rows are not filtered, the samples are deflated."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from an image's first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIBB", head[16:26])


def read_samples(image: bytes) -> bytes:
    """The samples of a stored image; every chunk's checksum is held against its content."""
    width, height, depth, colour = read_header(image[:HEADER])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, packed = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size in rows, mean and variance of the samples, and a 16-step histogram in parts of 10,000."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples >> 4, minlength=16)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    square = int(np.square(samples, dtype=np.int64).sum()) * 1000 // len(samples)
    parts = ",".join(str(int(c) * 10_000 // len(samples)) for c in counts)
    return f"rows={len(samples) // WIDTH};mean={mean};square={square};hist={parts}"


class ShardWriter:
    """One tar shard, written front to back."""

    def __init__(self, folder: str):
        self.fs, path = file_system(folder)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.at = 0
        self.stored: dict[bytes, tuple[int, int]] = {}

    def add(self, digest: bytes, payload: bytes) -> tuple[int, int]:
        """Offset and length of the payload's image, which is written unless the shard has it."""
        if digest not in self.stored:
            image = store_image(payload)
            entry = tarfile.TarInfo(f"{digest.hex()}.png")
            entry.size = len(image)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
            self.stored[digest] = (self.at + len(head), len(image))
            self.at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
        return self.stored[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


ADDRESS = StructType(
    [
        StructField("n_bytes", LongType()), StructField("digest", StringType()), StructField("shard", StringType()),
        StructField("offset", LongType()), StructField("length", LongType()),
    ]
)


def _with(docs: DataFrame, kept: list[str], fields: StructType) -> StructType:
    return StructType([*[docs.schema[c] for c in kept], *fields.fields])


def store(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Writes the payloads of ``docs`` to tar shards in ``folder``, a URI that all executors share.

    Returns a written table: the columns of ``docs`` but ``text_col`` and any that clash, and n_bytes (of the
    unpadded text), digest (SHA-256 of the payload), shard, offset, length. A null text is an empty one: 64 zero
    bytes. Equal texts have equal digests and, within a shard, one member. No rows write no shard. A folder that
    file_system() can't open is an error before any task.
    """
    file_system(folder)
    kept = [c for c in docs.columns if c != text_col and c not in ADDRESS.names]
    schema = _with(docs, kept, ADDRESS)

    def run(batches):
        shard = None
        for batch in batches:
            rows = []
            for text in batch.column(text_col):
                shard = shard or ShardWriter(folder)
                text = text.as_py() or ""
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                offset, length = shard.add(digest, payload)
                rows.append((len(text.encode("utf-8")), digest.hex(), shard.name, offset, length))
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ADDRESS_ARROW, strict=True)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *ADDRESS.names])
        if shard:
            shard.close()

    rows = docs.select(*[F.col(f"`{c}`") for c in [*kept, text_col]]).mapInArrow(run, schema)
    return written(rows, "media-rows")


_ADDRESS_ARROW = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


class ShardReader:
    """Range reads of the shards of a folder; one file is open at a time."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.file, self.name = self.fs.open_input_file(f"{self.path}/{shard}"), shard
        return self.file.read_at(length, offset)


def _read_columns(rows: DataFrame, folder: str, fields: StructType, length: int | None, read) -> DataFrame:
    """``rows`` with ``fields`` = read(the first ``length`` bytes, or all, of the row's member)."""
    kept = [c for c in rows.columns if c not in fields.names]
    types = [pa.int64() if f.dataType == LongType() else pa.string() for f in fields.fields]

    def run(batches):
        reader, known = ShardReader(folder), OrderedDict()
        for b in batches:
            out = []
            for shard, offset, size in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if (shard, offset) not in known:
                    known[shard, offset] = read(reader.read(shard, offset, min(size, length or size)))
                    if len(known) > REMEMBERED:
                        known.popitem(last=False)
                out.append(known[shard, offset])
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], names=[*kept, *fields.names])

    return rows.mapInArrow(run, _with(rows, kept, fields))


def media_columns(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` of store() with width, height, depth and colour, read from HEADER bytes of each member."""
    fields = StructType([StructField(n, LongType()) for n in ("width", "height", "depth", "colour")])
    return _read_columns(rows, folder, fields, HEADER, read_header)


def payload_columns(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` of store() with what the stored bytes give: payload_bytes, payload_sha256, tail_crc32 (of the last 64
    samples), media_bytes, media_sha256, feature."""
    fields = StructType(
        [
            StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
            StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()),
        ]
    )

    def read(image: bytes):
        payload = read_samples(image)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
            len(image), hashlib.sha256(image).hexdigest(), feature_of(payload),
        )

    return _read_columns(rows, folder, fields, None, read)


def op1(spark, sf_dir) -> DataFrame:
    folder = fresh_path(spark, "media")
    rows = media_columns(store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder), folder)
    return payload_columns(rows, folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "depth",
    )
