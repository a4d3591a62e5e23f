"""Shared helpers of the training-data operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local: dict[str, str] = {}


#: Rows of an Arrow batch, at most: batches hold whole texts, in the JVM and in Python, so 10,000 of them are too many.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most; fewer if it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting (one machine, one disk); it then gets a
    folder of its own that goes at exit. A cluster without the setting is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-mode")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "path" not in _local:
        _local["path"] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _local["path"], ignore_errors=True)
    return "file://" + _local["path"]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """A file system for a folder's URI, and the folder's path in it: file, s3 (s3a and s3n are the same), gs, abfs(s), hdfs, viewfs.

    The last two need libhdfs where tasks run. Any other scheme is a ValueError.
    """
    from pyarrow import fs

    scheme, _, rest = uri.partition("://") if "://" in uri else ("file", "", uri.removeprefix("file:"))
    known = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}
    if scheme not in known:
        raise ValueError(f"files of their own can't be written to {scheme}://; spark.checkpoint.dir may be {', '.join(known)}")
    return fs.FileSystem.from_uri(f"{known[scheme]}://{rest}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(StructType(df.schema.fields)).parquet(path)


#: Bits of a bitmap of ids: BITS_EACH for each id, so that one row in BITS_EACH is let through for nothing, but no more than
#: MOST_BITS (32 MB). Beyond some 16 M ids more rows go to the exact join behind it.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def bitmap_bits(n: int) -> int:
    """A power of two, by the number of ids."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length() if n else 0))


def split_by_bitmap(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among ``ids(id)``, rows whose ``column`` can't be), by a broadcast bitmap of hashes.

    So only the first ones have to move to an exact join; a null is in the second. ``ids`` may be of any number; they are
    counted, so they should be a written table.
    """
    bits = bitmap_bits(ids.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = place(F.col("id")) + 1
    pieces = ids.where("id is not null").select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    at = place(F.col(column))
    joined = rows.join(F.broadcast(pieces), F.floor(at / 32768) + 1 == F.col("__piece"), "left")  # MOST_BITS / 32768 rows of 4 KB at most
    octet = F.conv(F.hex(F.substring("__bits", (F.floor(at % 32768 / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    may = F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    return tuple(joined.where(side).drop("__piece", "__bits") for side in (may, ~may))


def lean(run):
    """A task's function over batches that gives back what the worker's allocators keep once it has ended.

    Workers live on after a task, two and more on an executor; what they hold idle would count against the next task's memory.
    """

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return whole


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """id (as text), label, text of labelled documents: for labels 0 and 1 each, at most ``most`` texts of ``most_bytes``
    bytes together, each whole. Those first by a hash of the id are taken; one that doesn't fit is left out.

    Equal rows of ``docs`` are one text; a null id has no label, a null text is empty, an id may be of any type.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    order = [F.xxhash64("id"), F.col("id")]
    ids = [known.where(F.col("label") == k).orderBy(*order).limit(most) for k in (0, 1)]
    ids = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * most rows of an id and a label at most
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    slim = texts.select("id", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).join(ids, "id").distinct()
    slim = slim.where(F.col("bytes") <= most_bytes)
    chosen = []
    for k in (0, 1):
        left = most_bytes
        for r in slim.where(F.col("label") == k).orderBy(*order, "h").limit(most).collect():  # numbers, not texts
            if r["bytes"] <= left:
                left -= r["bytes"]
                chosen.append((r["id"], r["h"], k))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id string, h long, label int"))
    found = texts.withColumn("h", F.xxhash64("text")).join(wanted, ["id", "h"])
    return found.groupBy("id", "h", "label").agg(F.first("text").alias("text")).select("id", "label", "text")
