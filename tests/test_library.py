"""Operators, functions, parsers and streams of the library; every registered query with SQL against DuckDB."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import scalars as S
from sparkloom.operators import cohort, learning, selection, series, timeline
from sparkloom.sources import parsers
from sparkloom.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None).isoformat()
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def times(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s"))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gap_chains_keep_steps_of_the_gap(spark):
    df = times(spark, [("k", s) for s in (100, 106, 116, 140)], "k string, s int")
    got = {r["s"]: r["chain"] for r in timeline.gap_chains(df, "k", "at", 10).collect()}
    assert got == {100: 1, 106: 1, 116: 1, 140: 2}


def test_windows_merge_where_they_touch(spark):
    rows = [("k", 92, 105), ("k", 105, 117), ("k", 118, 120), ("j", 0, 9)]
    df = spark.createDataFrame(rows, "k string, start int, end int")
    got = sorted((r["k"], r["start"], r["end"], r["n"]) for r in timeline.merge_windows(df, "k", "start", "end").collect())
    assert got == [("j", 0, 9, 1), ("k", 92, 117, 2), ("k", 118, 120, 1)]


@pytest.mark.parametrize("recordings, best", [([(1, 85, 106), (2, 0, 99), (3, 0, 120)], 3), ([(1, 85, 106)], 1), ([(2, 0, 99)], None)])
def test_best_cover(spark, recordings, best):
    sec = lambda c: F.timestamp_seconds(c)
    w = spark.createDataFrame([("k", 1, 92, 109, 100, 104)], "k string, w_id int, a int, b int, c int, d int")
    w = w.select("k", "w_id", sec("a").alias("w_start"), sec("b").alias("w_end"), sec("c").alias("first"), sec("d").alias("last"))
    r = spark.createDataFrame([("k", *x) for x in recordings], "k string, r_id int, a int, b int").select("k", "r_id", sec("a").alias("r_start"), sec("b").alias("r_end"))
    assert timeline.best_cover(w, r, "k", 0.5, [F.col("r_start")]).first()["r_id"] == best


def test_credit_goes_once_and_in_time(spark):
    rows = [("k", 100, 1, "m"), ("k", 104, 2, "c"), ("k", 105, 3, "c"), ("k", 200, 4, "m"), ("k", 300, 5, "c"), ("j", 1, 6, "c"), ("j", 2, 7, "m"), ("j", 92, 8, "c")]
    df = times(spark, rows, "k string, s int, id int, kind string")
    got = {r["id"]: r["credit"] for r in timeline.credited(df, "k", "at", F.col("kind") == "m", F.col("kind") == "c", 90, "id", "id").collect()}
    assert got == {2: 1, 3: None, 5: None, 6: None, 8: 7}


def test_overlap_pairs_equal_nested_loops(spark):
    r = np.random.default_rng(3)
    rows = [("k" if i % 3 else "j", i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(r.integers(0, 500, 120), r.integers(1, 40, 120), strict=True))]
    df = spark.createDataFrame(rows, "k string, id int, a int, b int").select("k", "id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    got = {(x["a"], x["b"]) for x in timeline.overlap_pairs(df, "k", 30, 3, 0.4).collect()}
    want = set()
    for k, i, a, b in rows:
        for k2, j, c, d in rows:
            if k == k2 and (a, i) < (c, j) and c < b and (min(b, d) - c >= 3 or min(b, d) - c >= 0.4 * min(b - a, d - c)):
                want.add((i, j))
    assert got == want


def test_thin_measures_from_the_last_kept(spark):
    df = times(spark, [("k", s) for s in (0, 4, 8, 12, 13, 25)], "k string, s int")
    assert sorted(r["kept"] // 1_000_000 for r in timeline.thin(df, "k", "at", 10).collect()) == [0, 12, 25]


def test_trailing_cohort_is_strictly_earlier(spark):
    df = spark.createDataFrame([("k", t, i, float(i)) for i, t in enumerate([1, 1, 2, 2, 2, 3])], "k string, t int, id int, v double")
    got = {r["id"]: sorted(r["cohort"]) for r in cohort.trailing(df, "k", "t", "id", "v", 3).collect()}
    assert got == {0: [], 1: [], 2: [0, 1], 3: [0, 1], 4: [0, 1], 5: [2, 3, 4]}


def test_robust_scores(spark):
    values = F.array(*[F.lit(float(i)) for i in range(1, 6)])
    assert one(spark, cohort.robust_score(F.lit(5.0), values, 0.1)) == pytest.approx(2 / 1.4826)
    rates = F.array(*[F.lit(x) for x in (0.05, 0.06, 0.07, 0.08, 0.09)])
    assert one(spark, cohort.robust_score(F.lit(0.09), rates, 0.005)) == pytest.approx(0.02 / (1.4826 * 0.01))
    assert one(spark, cohort.middle(F.array(F.lit(4.0), F.lit(1.0)))) == 2.5 and one(spark, cohort.middle(F.array().cast("array<double>"))) is None


def test_components_and_renormalised(spark):
    r, e, v = cohort.components(F.lit(6.0), F.lit(20.0), F.lit(1000.0), F.lit(50.0), F.lit(5.0))
    assert [round(one(spark, x), 3) for x in (r, e, v)] == [0.3, 0.06, 6.909]
    assert one(spark, cohort.renormalised([(1.0, F.lit(None).cast("double"))], 50.0)) == 50.0
    assert one(spark, cohort.renormalised([(2.0, F.lit(1.0)), (1.0, F.lit(None).cast("double"))])) == 1.0


def test_run_times_use_the_nearest_rank(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (1, 2, 10)], "k string, v double")
    assert tuple(cohort.run_times(df, "k", "v").first())[1:] == (3, 2.0, 10.0, 10.0)


def test_t_quantile(spark):
    assert one(spark, cohort.t_quantile(0.975, F.lit(30.0))) == pytest.approx(2.0423, abs=1e-3)


def test_scalars(spark):
    assert [one(spark, S.points(F.lit(n))) for n in (0, 1, 3, 4, 9)] == [0, 1, 6, 10, 10]
    a, b = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in ({"kills": 3.0, "laughs": 2.0, "win": 0.0}, {"kills": 1.0, "length": 1.5, "win": 0.0}))
    assert one(spark, S.feature_difference(a, b)) == {"kills": 2.0, "win": 0.0}
    assert one(spark, S.merged_maps(a, b, 1.2)) == {"kills": 1.0, "laughs": 1.2, "win": 0.0, "length": 1.2}
    assert one(spark, S.feature_sum(a, {"kills": 1.0, "length": 5.0})) == 3.0
    assert one(spark, S.numbers_only(F.lit('{"a": 1, "b": true, "c": "2", "d": 2.5, "e": null, "f": [1]}'))) == {"a": 1.0, "d": 2.5}
    assert one(spark, S.logistic(F.lit(-800.0))) == 0.0 and one(spark, S.logistic(F.lit(800.0))) == 1.0
    assert [one(spark, S.trapezoid(F.lit(float(x)), 1, 3, 5, 9)) for x in (0, 2, 4, 7, 9)] == [0, 0.5, 1, 0.5, 0]
    assert [one(spark, S.hard_rejected(F.lit("rejected"), F.lit(s).cast("string"))) for s in (None, "auto", "user")] == [True, False, True]
    assert one(spark, S.hamming(F.lit(0b1011), F.lit(0b0010))) == 2
    at = F.lit("2026-07-01 23:30:00").cast("timestamp")
    assert one(spark, S.in_day_window(at, "UTC", "22:00", "06:00")) and not one(spark, S.in_day_window(at, "UTC", "06:00", "06:00"))
    assert one(spark, S.canonical_hash(b=F.lit(1), a=F.lit(None).cast("string"))) == one(spark, F.sha2(F.lit('{"a":null,"b":1}'), 256))
    wrong = S.implausible({"views": F.lit(5)}, {"views": F.lit(7)}, F.lit(40.0), F.lit(20.0), F.lit(None).cast("double"))
    assert one(spark, wrong) == ["views", "watch"]


def test_local_times(spark):
    at = F.lit("2026-03-29 03:30:00").cast("timestamp")
    assert str(one(spark, timeline.evening(at, "Europe/Berlin", 6))) == "2026-03-28"
    cuts = timeline.weekly_cutoffs(F.lit("2026-03-20").cast("timestamp"), F.lit("2026-04-06").cast("timestamp"), "Europe/Berlin", 7, 18)
    assert [c.isoformat() for c in one(spark, F.transform(cuts, lambda c: c.cast("timestamp_ntz")))] == ["2026-03-22T17:00:00", "2026-03-29T16:00:00", "2026-04-05T16:00:00"]


def test_elo(spark):
    assert learning.elo_step((1500, 350, 0), (1500, 350, 0), "a") == ((1524.0, 329.0, 1), (1476.0, 329.0, 1))
    assert learning.elo_step((1600, 100, 3), (1400, 76, 3), "s") == ((1600, 94.0, 4), (1400, 75.0, 4))
    assert [one(spark, learning.k_factor(F.lit(n))) for n in (0, 9, 10, 24, 25)] == [48, 48, 32, 32, 24]
    duels = spark.createDataFrame([("p", 1, 1, "x", "y", "a"), ("p", 2, 2, "x", "z", "b"), ("q", 1, 3, "x", "y", "s")], "pool string, at int, id int, a string, b string, result string")
    got = {(r["pool"], r["item"]): r["rating"] for r in learning.elo(duels, "pool", "at", "id").collect()}
    x, y = learning.elo_step((1500.0, 350.0, 0), (1500.0, 350.0, 0), "a")
    x, z = learning.elo_step(x, (1500.0, 350.0, 0), "b")
    assert got == {("p", "x"): x[0], ("p", "y"): y[0], ("p", "z"): z[0], ("q", "x"): 1500.0, ("q", "y"): 1500.0}


def test_ridge_and_calibration(spark):
    r = np.random.default_rng(1)
    x, w = r.normal(size=(80, 2)), r.uniform(0.5, 1.5, 80)
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.1
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "p double, q double, y double, w double")
    m = learning.ridge(df, ["p", "q"], F.col("y"), F.col("w"))
    full = np.c_[np.ones(80), x - x.mean(axis=0)]
    want = np.linalg.solve(full.T @ (w[:, None] * full) + np.diag([1, 1.2, 1.2]), full.T @ (w * y))
    assert [m["bias"], *m["weights"].values()] == pytest.approx(want)
    assert df.select(learning.predict(m).alias("v")).first()["v"] == pytest.approx(float(full[0] @ want))
    slope, offset = learning.calibrate(spark.createDataFrame([(1.0, 1), (-1.0, 0), (0.5, 1), (None, 1)], "z double, good int"), "z", "good", steps=5)
    assert slope > 1 and offset > 0


def test_selection(spark):
    good, bad = (spark.createDataFrame([(x,) for x in xs], "i string") for xs in (("g0", "g1", "g2"), ("s0", "s1")))
    assert {tuple(r) for r in selection.round_robin(good, bad, "i", 3).collect()} == {("g0", "s0"), ("g1", "s1"), ("g2", "s0")}
    assert selection.round_robin(good, bad, "i", 99).count() == 6 and selection.round_robin(good, bad.limit(0), "i", 9).count() == 0
    df = spark.createDataFrame([("k", i, float(v), float(n)) for i, v, n in ((1, 9, 50), (2, 8, 60), (3, 7, 40), (4, 1, 10))], "k string, id int, v double, n double")
    assert [r["id"] for r in selection.knapsack(df, "k", "id", F.col("v"), F.col("n"), 100, 12).collect()] == [1, 3, 4]


def test_one_per_scene_equals_one_by_one(spark):
    r = np.random.default_rng(8)
    worth = {i: float(w) for i, w in enumerate(r.integers(0, 6, 60))}
    links = {(int(a), int(b)) for a, b in r.integers(0, 60, (90, 2)) if a != b}
    taken = []
    for i in sorted(worth, key=lambda i: (-worth[i], i)):
        if not any((i, t) in links or (t, i) in links for t in taken):
            taken.append(i)
    items = spark.createDataFrame(list(worth.items()), "id int, w double")
    got = selection.one_per_scene(items, spark.createDataFrame(list(links), "a int, b int"), "id", "w")
    assert sorted(x["id"] for x in got.collect()) == sorted(taken)
    assert selection.one_per_scene(items.limit(0), spark.createDataFrame([], "a int, b int"), "id", "w").count() == 0


def test_parsers(spark):
    named = parsers.stamped_name(F.lit("Some Game 2026.09.01 - 21.42.22.617.mp4"), "Europe/Berlin")
    got = one(spark, F.struct(named["game"].alias("g"), named["at"].cast("timestamp_ntz").alias("t")))
    assert (got["g"], got["t"].isoformat()) == ("Some Game", "2026-09-01T19:42:22") and one(spark, parsers.stamped_name(F.lit("x.mp4"), "UTC")) is None
    tags = F.create_map(*[F.lit(x) for x in ("META2", "c}", "META10", "!", "META1", "{ab", "OTHER", "z")])
    assert one(spark, parsers.joined_tags(tags, "META")) == "{abc}!"
    assert one(spark, parsers.hand_metrics(F.lit(" 1000 50 - 6,5 "))) == [1000.0, 50.0, None, 6.5] and one(spark, parsers.hand_metrics(F.lit("1 2 3"))) is None
    hosts = {"example.org": r"/watch\?(?:.*&)?v=([\w-]+)", "short.example": r"^[a-z]+://[^/]+/([\w-]+)"}
    assert [one(spark, parsers.video_id(F.lit(u), hosts)) for u in ("https://www.example.org/watch?a=1&v=abc", "https://short.example/xyz", "https://evil.example/watch?v=abc")] == ["abc", "xyz", None]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["frame:0 pts:0 pts_time:0.5", "lavfi.r128.M=-20.5", "frame:1 pts_time:1.0", "lavfi.r128.M=-inf", "silence_start: 2.0", "silence_end: 3.5", "silence_start: 8"])], "f string, n int, t string")
    assert [(r["t"], r["name"]) for r in parsers.frame_series(lines, "f", "n", "t").orderBy("t").collect()] == [(0.5, "r128.M"), (1.0, "r128.M")]
    found = parsers.intervals(lines, "f", "n", "t", r"silence_start: ([0-9.]+)", r"silence_end: ([0-9.]+)", F.lit(9.0))
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(2.0, 3.5), (8.0, 9.0)]
    record = parsers.platform_metrics(F.lit('{"stats": {"views": 12, "likes": -3}, "shares": "x"}'), {"views": "$.stats.views", "likes": "$.stats.likes", "shares": "$.shares"})
    assert tuple(one(spark, record)) == (12, None, None)
    near = parsers.reference_time(F.lit("2026-01-01 00:01:00").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    assert one(spark, near.cast("timestamp_ntz")).minute == 1


def test_sessions_of_a_stream_equal_the_table(spark, tmp_path):
    rows = [(k, s) for k in "ab" for s in (0, 3600, 7200, 20_000, 30_000, 400_000)]
    df = times(spark, rows, "k string, s int").select("k", "at")
    df.write.parquet(f"{tmp_path}/in")
    batch = {(r["k"], r["start"], r["last"], r["n"]) for r in ingest.sessions(df, "k", "at", "1 hour", "45 minutes").collect()}
    assert {n for *_, n in batch} == {1, 3}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ingest.sessions(stream, "k", "at", "1 hour", "45 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r["k"], r["start"], r["last"], r["n"]) for r in spark.table("sessions").collect()}
    assert closed == {x for x in batch if x[1].timestamp() < 400_000}  # the newest stays open until the watermark passes it


def test_frozen_tables_keep_what_they_have(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert ingest.add_absent(spark, first, path, "k") == 2
    assert ingest.add_absent(spark, spark.createDataFrame([("a", 9), ("c", 4)], "k string, v int"), path, "k") == 1
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2), ("c", 4)}


def test_late_events_find_their_session(spark):
    s = spark.createDataFrame([("k", 0, 100), ("k", 9_000, 9_100)], "k string, a int, b int").select("k", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("last"))
    late = times(spark, [("k", 150), ("k", 5_000), ("j", 0)], "k string, s int")
    got = {(r["k"], r["s"]): r["session_start"] is not None for r in ingest.late_joined(s, late, "k", "at", 60).collect()}
    assert got == {("k", 150): True, ("k", 5_000): False, ("j", 0): False}


def test_greedy_folds_take_linear_time_in_a_dense_stretch(spark):
    """A key without a pause: as one array it took the square."""
    import time

    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id")).alias("at"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"), (F.col("id") % 2).alias("w"), "id")
    began = time.perf_counter()
    assert timeline.thin(df, "k", "at", 3).count() == n // 3
    best = series.strongest_first(df, "k", "at", "v", 3).orderBy("kept").collect()
    assert all(b["kept"] - a["kept"] >= 3_000_000 for a, b in zip(best, best[1:], strict=False)) and n / 6 < len(best) < n / 3 + 1
    assert series.unlike_last_kept(df, "k", "at", "w", 3, "id").count() == n
    assert time.perf_counter() - began < 90


def test_greedy_folds_take_any_names_and_nulls(spark):
    rows = [(None, 5, 1.0, None), (None, 6, 2.0, None), ("a", 1, None, "x"), ("a", 9, 3.0, "x"), ("a", None, 9.0, "y"), ("a", 2, 3.0, "x")]
    df = spark.createDataFrame(rows, "k string, s int, us double, chain string").withColumn("at", F.timestamp_seconds("s")).withColumns({c: F.lit("own") for c in ("begins", "kept", "v", "h")}).withColumn("id", F.col("s"))
    assert sorted((r["k"] or "", r["kept"] // 1_000_000) for r in timeline.thin(df, "k", "at", 4).collect()) == [("", 5), ("a", 1), ("a", 9)]
    got = {(r["k"] or "", r["kept"] // 1_000_000, r["strength"]) for r in series.strongest_first(df, "k", "at", "us", 4).collect()}
    assert got == {("", 6, 2.0), ("a", 2, 3.0), ("a", 9, 3.0)}
    assert sorted((r["k"] or "", r["kept"]) for r in series.unlike_last_kept(df, "k", "at", "chain", 4, "id").collect()) == [("", 5), ("a", 1), ("a", 9)]


def test_greedy_folds_take_many_short_stretches(spark):
    """A group for each stretch took a minute and more."""
    import time

    n = 100_000
    df = spark.range(n).select((F.col("id") % 1000).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("at"), F.lit(1.0).alias("v"), F.lit("w").alias("w"), "id").cache()
    df.count()
    began = time.perf_counter()
    assert timeline.thin(df, "k", "at", 3).count() == series.strongest_first(df, "k", "at", "v", 3).count() == series.unlike_last_kept(df, "k", "at", "w", 3, "id").count() == n
    assert time.perf_counter() - began < 40


def test_greedy_folds_go_on_over_batches(spark):
    r = np.random.default_rng(8)
    rows = sorted((int(k), int(s), float(v), "xy"[int(v) % 2]) for k, s, v in zip(r.integers(0, 4, 300), r.integers(0, 900, 300), r.integers(0, 9, 300), strict=True))
    rows = [(k, s, v, w, i) for i, (k, s, v, w) in enumerate(rows)]
    df = times(spark, rows, "k int, s int, v double, w string, id int")
    thinned, best, unlike = set(), set(), set()
    for key in range(4):
        mine, last = [x for x in rows if x[0] == key], None
        for _, s, *_ in mine:
            if last is None or s - last >= 5:
                thinned.add((key, s))
                last = s
        kept: list = []
        for x in sorted(mine, key=lambda x: (-x[2], x[1])):
            if all(abs(x[1] - y[1]) >= 5 for y in kept):
                kept.append(x)
        best |= {(key, x[1], x[2]) for x in kept}
        before = None
        for x in mine:
            if before is None or x[1] - before[1] >= 5 or x[3] != before[3]:
                unlike.add((key, x[4]))
                before = x
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for size in (1, 3, 10_000):
            spark.conf.set(name, size)
            assert {(r["k"], r["kept"] // 1_000_000) for r in timeline.thin(df, "k", "at", 5).collect()} == thinned
            assert {(r["k"], r["kept"] // 1_000_000, r["strength"]) for r in series.strongest_first(df, "k", "at", "v", 5).collect()} == best
            assert {(r["k"], r["kept"]) for r in series.unlike_last_kept(df, "k", "at", "w", 5, "id").collect()} == unlike
    finally:
        spark.conf.set(name, old)
