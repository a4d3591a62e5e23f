"""Rows that were lost or wrong: numbering at size, odd keys, other session zones, keys without hits, values that are null."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import cohort, evidence, selection, series, timeline
from sparkloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_have_no_gaps_at_size(spark, small_parts):
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = selection.numbered(rows, "x", "i").agg(F.count("*").alias("n"), F.sum((F.col("i") == F.col("x")).cast("int")).alias("right"), F.max(F.length("payload")).alias("l")).first()
    assert (got["n"], got["right"], got["l"]) == (n, n, 64)


def test_ages_of_last_shown_at_size(spark, small_parts):
    n = 300_000
    shown = spark.range(n).select(F.col("id").alias("family"), (F.col("id") % 100_000).alias("item"), F.timestamp_seconds(F.col("id")).alias("at"))
    got = evidence.last_shown(shown, "family", "item", "at").agg(F.count("*").alias("n"), F.sum((F.col("age") == 99_999 - F.col("item")).cast("int")).alias("right")).first()
    assert (got["n"], got["right"]) == (100_000, 100_000)


def test_numbers_of_odd_json(spark):
    cases = {
        '{"a(b": 1}': {"a(b": 1.0}, '{"a": 1, "n": {"a": "x"}}': {"a": 1.0}, '{"a.c": 1, "abc": "5"}': {"a.c": 1.0},
        '{"x": true, "y": null, "z": [1], "w": -2.5e3, "v": "7"}': {"w": -2500.0}, "{}": {}, "[1]": None, "no": None, None: None,
    }
    for text, want in cases.items():
        assert one(spark, S.numbers_only(F.lit(text).cast("string"))) == want, text


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_local_times_don_t_follow_the_session(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        noon = F.timestamp_micros(F.lit(int(dt.datetime(2026, 7, 1, 10, 30, tzinfo=dt.UTC).timestamp() * 1e6)))  # 12:30 in Berlin
        assert one(spark, S.in_day_window(noon, "Europe/Berlin", "12:00", "13:00")) and not one(spark, S.in_day_window(noon, "Europe/Berlin", "13:00", "14:00"))
        bare = F.lit("2026-07-01 10:30:00").cast("timestamp_ntz")
        assert one(spark, S.in_day_window(bare, "Europe/Berlin", "12:00", "13:00"))
        late = F.timestamp_micros(F.lit(int(dt.datetime(2026, 7, 1, 3, 59, tzinfo=dt.UTC).timestamp() * 1e6)))  # 05:59 in Berlin
        assert one(spark, timeline.evening(late, "Europe/Berlin", 6)) == dt.date(2026, 6, 30)
        first, last = (F.timestamp_micros(F.lit(int(dt.datetime(2026, m, d, tzinfo=dt.UTC).timestamp() * 1e6))) for m, d in ((3, 20), (4, 6)))
        cuts = one(spark, F.transform(timeline.weekly_cutoffs(first, last, "Europe/Berlin", 7, 18), lambda t: F.unix_micros(t)))
        assert [dt.datetime.fromtimestamp(c / 1e6, dt.UTC).isoformat()[:16] for c in cuts] == ["2026-03-22T17:00", "2026-03-29T16:00", "2026-04-05T16:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_key_that_meets_no_point_is_idle(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:30:00"), ("c", "2025-01-01 00:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    begin, end = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-01 03:00:00"))
    got = {r["k"]: r["idle"] for r in series.idle_share(df, "k", "t", begin, end, 3600, 60).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": 1.0}


def test_rows_without_a_value_take_no_place(spark):
    values = [1.0, None, 2.0, None, None, 3.0, 4.0, None, 5.0]
    df = spark.createDataFrame([("k", i // 2, i, v) for i, v in enumerate(values)], "k string, t int, id int, v double")
    got = {r["id"]: list(r["cohort"]) for r in cohort.trailing(df, "k", "t", "id", "v", 2).collect()}
    want = {i: [v for j, v in enumerate(values) if j // 2 < i // 2 and v is not None][-2:] for i in range(len(values))}
    assert got == want


def test_no_key_without_an_id(spark):
    assert one(spark, S.composite_key(F.lit("clip"), F.lit(None).cast("long"))) is None
    assert one(spark, S.composite_key(F.lit("clip"), F.lit(3))) == "clip:3"


def _at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_late_events_extend_their_session(spark):
    sessions = spark.createDataFrame([("a", _at(0), _at(10)), ("a", _at(100), _at(110)), ("b", _at(0), _at(1))], "k string, start timestamp, last timestamp")
    rows = [("a", _at(40)), ("a", _at(65)), ("a", _at(65)), ("a", _at(95)), ("a", _at(500)), ("b", _at(40)), ("c", _at(1)), (None, _at(1)), ("a", None)]
    got = ingest.late_joined(sessions, spark.createDataFrame(rows, "k string, at timestamp"), "k", "at", 30 * 60).collect()
    found = sorted(((r["k"] or "", r["at"] or _at(-1), r["session_start"]) for r in got), key=str)
    want = [("a", _at(40), _at(0)), ("a", _at(65), _at(0)), ("a", _at(65), _at(0)), ("a", _at(95), _at(0)), ("a", _at(500), None), ("b", _at(40), None), ("c", _at(1), None), ("", _at(1), None), ("a", _at(-1), None)]
    assert found == sorted(want, key=str)


def test_keys_of_several_columns_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("x", 1, "r"), (None, 1, "s")], "a string, b int, v string")
    path = f"{tmp_path}/t"
    assert ingest.add_absent(spark, rows, path, ["a", "b"]) == 2 and ingest.add_absent(spark, rows, path, ["a", "b"]) == 0
    assert spark.read.parquet(path).count() == 2


def test_interval_joins_on_a_hot_key(spark):
    """One key has everything: covers and touches equal brute force, and no join is by key alone."""
    import random

    r = random.Random(4)
    recs = [("hot", i, a := r.randrange(0, 20_000), a + r.randrange(1, 600)) for i in range(300)]
    wins = [("hot", i, a := r.randrange(0, 20_000), a + r.randrange(1, 200)) for i in range(300)]
    t = lambda c: F.timestamp_seconds(F.col(c) * 60)
    recordings = spark.createDataFrame(recs, "k string, r_id int, s int, e int").select("k", "r_id", t("s").alias("r_start"), t("e").alias("r_end"))
    windows = spark.createDataFrame(wins, "k string, w_id int, s int, e int").select("k", "w_id", t("s").alias("w_start"), t("e").alias("w_end"), t("s").alias("first"), t("e").alias("last"))
    out = timeline.best_cover(windows, recordings, "k", 60, [F.col("r_id")])
    for row in out.collect():
        holding = [i for _, i, s, e in recs if s * 60 <= wins[row["w_id"]][2] * 60 + 60 and e * 60 >= wins[row["w_id"]][3] * 60 - 60]
        assert (row["r_id"] is None) == (not holding) and (row["r_id"] in holding or not holding)
    assert "__bucket" in out._jdf.queryExecution().optimizedPlan().toString()
    spans = windows.select("k", "w_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    shields = recordings.limit(20).select("k", "r_id", F.col("r_start").alias("p_start"), F.col("r_end").alias("p_end"))
    some = shields.collect()
    want = {w for _, w, s, e in wins if any(s * 60 <= int(x["p_end"].replace(tzinfo=dt.UTC).timestamp()) and e * 60 >= int(x["p_start"].replace(tzinfo=dt.UTC).timestamp()) for x in some)}
    fixed = spark.createDataFrame(some, shields.schema)
    assert {x["w_id"] for x in timeline.overlaps(spans, fixed, "k").collect()} == want
    assert {x["w_id"] for x in timeline.overlaps(spans, fixed, "k", keep=False).collect()} == {w[1] for w in wins} - want
