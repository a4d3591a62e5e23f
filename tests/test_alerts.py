"""Alerts: a plain loop, the stream, and quiet hours across clock changes."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import alerts as A

MESSAGES = "kind string, s int, id long, text string"


def messages(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", "c"]), r.randrange(20_000), i, r.choice([f"m{i}", None])) for i in range(n)]


def plain(rows, tick, pause):
    ticks = collections.defaultdict(list)
    for kind, s, i, text in rows:
        ticks[kind, (s // tick + 1) * tick].append((s, i, text))
    sent, out = {}, set()
    for kind, t in sorted(ticks):
        if kind not in sent or t - sent[kind] > pause:
            sent[kind] = t
            last = max(ticks[kind, t], key=lambda x: x[:2])
            out.add((kind, t * 1_000_000, last[2], len(ticks[kind, t]) - 1))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, MESSAGES).withColumn("at", F.timestamp_seconds("s"))


@pytest.mark.parametrize(("tick", "pause"), [(60, 0), (60, 120), (300, 1000)])
def test_alerts_equal_the_loop(spark, tick, pause):
    rows = messages(400, tick + pause)
    df = table(spark, rows).unionByName(spark.createDataFrame([(None, 5, 1, "x", None), ("a", 5, 1, "x", None)], MESSAGES + ", at timestamp")).withColumns({c: F.lit("own") for c in ("more", "kept", "chain")})
    got = {tuple(r[c] for c in ("kind", "tick_us", "text", "more")) for r in A.coalesced(df, "kind", "at", "id", "text", tick, pause).collect()}
    assert got == plain(rows, tick, pause)
    assert A.coalesced(df.limit(0), "kind", "at", "id", "text", tick, pause).count() == 0


def test_stream_gives_the_same_rows(spark, tmp_path):
    from sparkloom.streaming.alerts import coalesced_stream

    rows = sorted(messages(200, 3), key=lambda x: x[1])
    parts = [rows[i : i + 70] for i in range(0, len(rows), 70)] + [[("z", 1_000_000 + 100_000 * i, 9_000 + i, "end")] for i in range(2)]
    for i, part in enumerate(parts):
        table(spark, part[::-1]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(table(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = coalesced_stream(stream, "kind", "at", "id", "text", 300, 1000, "1 seconds")
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(180)
        assert not query.isActive and query.exception() is None
    finally:
        spark.conf.unset(name)
    got = {tuple(r[c] for c in ("kind", "tick_us", "text", "more")) for r in spark.read.parquet(f"{tmp_path}/out").where("kind <> 'z'").collect()}
    assert got == plain(rows, 300, 1000)


def test_quiet_hours(spark):
    utc = lambda *t: dt.datetime(*t)
    cases = [
        (utc(2026, 6, 1, 20, 59), utc(2026, 6, 1, 20, 59)), (utc(2026, 6, 1, 21, 0), utc(2026, 6, 2, 6, 0)), (utc(2026, 6, 2, 5, 59), utc(2026, 6, 2, 6, 0)), (utc(2026, 6, 2, 6, 0), utc(2026, 6, 2, 6, 0)),
        (utc(2026, 3, 28, 23, 0), utc(2026, 3, 29, 6, 0)), (utc(2026, 10, 24, 23, 0), utc(2026, 10, 25, 7, 0)),  # the clock goes forward, and back
    ]
    df = spark.createDataFrame([(i, at) for i, (at, _) in enumerate(cases)], "i int, at timestamp")
    rows = df.select("i", "at", A.due(F.col("at"), F.lit(True), "Europe/Berlin", "23:00", "08:00").alias("due"), A.due(F.col("at"), F.lit(None).cast("boolean"), "Europe/Berlin", "23:00", "08:00").alias("loud"), A.due(F.col("at"), F.lit(True), "Europe/Berlin", "", "").alias("never")).collect()
    for r in rows:
        assert r["due"] == cases[r["i"]][1] and r["loud"] == r["never"] == r["at"]
