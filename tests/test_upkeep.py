"""Cases that the registered queries' tables don't have: nulls, empty tables, ties and worked values."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ending, teaching, upkeep


def timed(spark, rows, schema, *names):
    return spark.createDataFrame(rows, schema).withColumns({n: F.timestamp_seconds(n) for n in names})


def test_equal_samples_count_again_only_unscored_and_after_a_while(spark):
    schema = "k string, id int, at long, a int, b int, scored boolean"
    old = timed(spark, [("x", 1, 0, 1, None, None), ("x", 2, 0, 5, None, None), ("z", 3, 0, 5, 5, None)], schema, "at")
    new = timed(spark, [("x", 10, 72_000, 5, None, None), ("x", 11, 71_999, 5, None, False), ("x", 12, 90_000, 5, None, True), ("x", 13, 1, 5, 0, True), ("x", 14, 1, None, None, None), ("y", 15, 1, 5, None, True)], schema, "at")
    got = upkeep.accepted_samples(new, old, "k", "at", "id", ["a", "b"], F.col("scored"), 72_000)
    assert sorted(r["id"] for r in got.collect()) == [10, 13, 15]
    assert got.columns == new.columns
    assert upkeep.accepted_samples(new, old.limit(0), "k", "at", "id", ["a", "b"], F.col("scored"), 1).count() == 5


def test_clips_keep_clear_of_earlier_kills(spark):
    schema = "k int, id int, first long, end long, lo long, hi long"
    clips = timed(spark, [(1, 1, 100, 120, None, None), (1, 2, 100, 120, 95, None), (1, 3, 100, 200, None, 98), (2, 4, 100, 120, None, None), (None, 5, 100, 120, None, None)], schema, "first", "end", "lo", "hi")
    kills = timed(spark, [(1, 93), (1, 93), (1, 50), (1, 100), (2, 99)], "k int, at long", "at")
    got = upkeep.clip_starts(clips, kills, "k", "first", "end", "lo", "hi", "at", 10, 0.5, 1.0, 60)
    assert sorted((r["id"], r["start_us"] / 1e6, r["uncapped_us"] / 1e6, r["foreign"]) for r in got.collect()) == [
        (1, 93.5, 93.5, True), (2, 95, 95, False), (3, 98, 93.5, True), (4, 99, 99, True), (5, 90, 90, False),
    ]
    assert upkeep.clip_starts(clips.limit(0), kills, "k", "first", "end", "lo", "hi", "at", 10, 0.5, 1.0, 60).count() == 0


def test_due_and_polls(spark):
    p = timed(spark, [(1, 0, None), (2, 5, None), (3, 5, 1), (4, 6, 1), (5, 7, 1)], "id int, posted long, scored int", "posted")
    now = F.timestamp_seconds(F.lit(7 * 86_400 + 4))
    assert [r["id"] for r in p.where(upkeep.due(F.col("posted"), F.col("scored"), now, 7)).collect()] == [1]
    s = timed(spark, [(3, 9), (4, 8), (5, 50)], "id int, at long", "at")
    got = upkeep.poll_order(p, s, "id", "posted", "scored", "at", F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(20)), 3)
    assert [r["id"] for r in got.collect()] == [2, 1, 4]


def test_renders_of_old_drafts_come_from_files(spark):
    rows = [("a", "draft", 10.0, 5.0, 5.0, None, None), ("a", "draft", None, None, 4.0, 8.0, None), ("a", "draft", None, None, 4.0, 0.0, None), ("a", "up", None, None, 4.0, 8.0, None), (None, "up", 9.0, 3.0, None, None, True), ("a", "draft", 1.0, 0.0, 4.0, 9000.0, True)]
    r = spark.createDataFrame(rows, "e string, v string, m double, l double, p double, f double, fell boolean")
    got = upkeep.render_report(r, *[F.col(c) for c in "ev"], "draft", *[F.col(c) for c in ("m", "l", "p", "f", "fell")], 7200.0).orderBy("encoder").collect()
    assert [tuple(x) for x in got] == [("a", "draft", 2, 2.0, 2.0, 2.0, 1, 0), ("unknown (fell back)", "up", 1, 3.0, 3.0, 3.0, 0, 1)]


def test_teachers_without_anything_and_with_few_pairs(spark):
    none = spark.createDataFrame([], "g double, b double")
    t = teaching.teacher_weights(none, none, F.col("g"), F.col("b"), none, 10.0, 5.0, 2).first()
    assert t.asDict() == {"share": 0.0, "checked": 0, "hit": None, "trust": 1.0, "weight": 0.0}
    some = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (None, 1.0)], "g double, b double")
    t = teaching.teacher_weights(some, some, F.col("g"), F.col("b"), some.union(some).union(some).union(some), 3.0, 6.0, 2).first()
    assert t.asDict() == pytest.approx({"share": 0.5, "checked": 2, "hit": 0.75, "trust": 1.0, "weight": 0.125})


def test_arms_count_only_what_was_judged(spark):
    choices = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (2, "x", "b"), (2, "y", "a")], "draft int, knob string, choice string")
    verdicts = spark.createDataFrame([(1, 1, None), (2, -1, ["x"]), (2, 0, None), (2, -1, [])], "draft int, thumb int, knobs array<string>")
    audience = spark.createDataFrame([(1, 3.0), (2, None)], "draft int, y double")
    machine = spark.createDataFrame([(2, 50.0)], "draft int, note double")
    duels = spark.createDataFrame([(1, 2, 0.5)], "winner int, loser int, weight double")
    got = {(r["knob"], r["choice"]): tuple(r)[2:] for r in teaching.arm_statistics(choices, verdicts, audience, machine, duels).collect()}
    assert got[("x", "a")] == pytest.approx((3.5, 3.5, 1, 0, 1, 1.0))
    assert got[("x", "b")] == pytest.approx((1.84, 0.17, 0, 1, 0, 0.0))
    assert got[("y", "a")] == pytest.approx((3.34, 3.17, 1, 0, 1, 1.0))


def test_gate_keeps_start_without_pairs(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": -1.0}, 1.0)], "d map<string,double>, w double")
    start = {"a": 1.0, "b": 1.5}
    assert tuple(teaching.never_worse(rows, F.col("d"), F.col("w"), {"a": 1.0}, start, 1.0).first()) == (1.0, 0.0, True)
    assert tuple(teaching.never_worse(rows, F.col("d"), F.col("w"), {"a": 1.0}, {"a": 1.0, "b": 0.5}, -1.0).first()) == (0.0, 1.0, False)
    assert tuple(teaching.never_worse(rows.limit(0), F.col("d"), F.col("w"), {}, start, 1.0).first()) == (None, None, True)


def test_ends(spark):
    beats = timed(spark, [("a", 0), ("a", 8), ("a", 16), ("b", 0), ("c", 0), ("c", 0)], "k string, at long", "at")
    ends = timed(spark, [("a", 17), ("b", 0), ("c", 1), ("d", 1)], "k string, end long", "end")
    got = {r["k"]: r["beat"] for r in ending.on_beat(beats, ends, "k", "at", "end").collect()}
    assert got == {"a": 1.0, "b": None, "c": 0.2}
    sound = timed(spark, [("a", 1, -14.0), ("a", 2, -20.0), ("a", 4, -40.0), ("b", 0, -50.0)], "k string, at long, v double", "at")
    fades = ending.fade_out(sound, ends.withColumn("level", F.lit(-12.0)), "k", "at", "v", "end", "level")
    assert {r["k"]: r["fade_s"] for r in fades.collect()} == {"a": 3.0, "b": None}


def test_texts_outside_the_zone_are_unreadable(spark):
    rows = spark.createDataFrame([(100.0, 10), (960.0, 10), (960.0, 40)], "mid double, n int")
    safe = ending.inside_zone(F.col("mid"), F.lit(80.0), F.col("n"), 0.75, 1080.0, 1920.0, (0.1, 0.2, 0.05, 0.1))
    got = [r[0] for r in rows.select(ending.reading(F.lit(2.0), F.col("n"), F.lit(80.0), 1920.0, safe)).collect()]
    assert got == [0.0, 1.0, 0.0]
