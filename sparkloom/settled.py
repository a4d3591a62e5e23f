"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without that setting gets a folder that goes at exit, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a written table: what is read from it is the same however often and by whatever plan."""
    path = f"{shared_path(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(path)
