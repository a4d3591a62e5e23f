"""Streams: sessions by inactivity, messages once per key, and tables that are frozen once written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """key, start, last, n for each session: events of a key with steps of ``gap`` at most; the same for a table and a stream.

    A stream emits a session once its watermark, ``delay`` behind the newest event, has passed the session's end.
    """
    timed = events.withColumn("__at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("__at", delay) if events.isStreaming else timed
    # session_window ends a session at the gap itself; one microsecond more keeps steps of exactly ``gap`` together.
    window = F.session_window("__at", f"{gap} 1 microsecond")
    out = timed.groupBy(key, window).agg(F.min("__at").alias("start"), F.max("__at").alias("last"), F.count("*").alias("n"))
    return out.drop("session_window")


def first_messages(messages: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """One message for each key; a stream forgets a key once it is ``delay`` old."""
    if not messages.isStreaming:
        return messages.dropDuplicates([key])
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def add_absent(spark: SparkSession, rows: DataFrame, path: str, key: str | list[str]) -> int:
    """Appends the rows whose key (one column or several) the table at ``path`` doesn't have, one for each key; returns how many.

    What is written stays as it is. A row with a null in its key is never written. Rows are worked out once: they are
    counted while they are written.
    """
    from pyspark.errors import AnalysisException

    keys = [key] if isinstance(key, str) else list(key)
    new = rows.dropna(subset=keys).dropDuplicates(keys)
    try:
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
    seen = Observation()
    new.select(*rows.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def freeze_stream(stream: DataFrame, path: str, key: str | list[str], checkpoint: str):
    """A streaming query that adds each batch's unseen keys to the table at ``path``."""
    return stream.writeStream.foreachBatch(lambda batch, _: add_absent(batch.sparkSession, batch, path, key)).option("checkpointLocation", checkpoint)


def late_joined(sessions: DataFrame, late: DataFrame, key: str, at: str, gap_s: float) -> DataFrame:
    """Late events, each with ``session_start``: the session (key, start, last) that it re-opens, or null.

    A watermark has dropped these, so a batch corrects the sessions that they belong to. A late event extends its
    session, so that the next one may be near the first one only: sessions and late events of a key are chained by
    steps of ``gap_s`` at most. In a chain an event belongs to the last session that begins by its time, else to the
    first one after it. Equal late rows stay; a null key or time belongs to none.
    """
    gap = int(gap_s * 1e6)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    whole = F.struct(*[F.col(f"`{c}`") for c in late.columns]).alias("row")
    events = late.select(F.col(key).alias("__key"), us(at).alias("us"), us(at).alias("until"), F.lit(None).cast("timestamp").alias("start"), whole)
    spans = sessions.select(F.col(key).alias("__key"), us("start").alias("us"), us("last").alias("until"), F.col("start").cast("timestamp").alias("start"), F.lit(None).cast(events.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("__key").orderBy("us", F.col("start").isNull())
    reach = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = spans.unionByName(events).withColumn("chain", F.sum((reach.isNull() | (F.col("us") - reach > gap)).cast("int")).over(order))
    inside = Window.partitionBy("__key", "chain").orderBy("us", F.col("start").isNull())
    before = F.last("start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("start", ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    known = F.col("__key").isNotNull() & F.col("us").isNotNull()
    found = both.withColumn("session_start", F.when(known, F.coalesce(before, after))).where("row is not null")
    return found.select("row.*", "session_start")
