"""Match and recorder documents and kill attribution: worked cases, a plain state machine, and the stream."""

import collections
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import attribution as A
from sparkloom.sources import replays as R

ME = "abc123"
DOCUMENT = {
    "replay_start": "2026-09-21T21:42:22.6170000", "replay_start_kind": "Unspecified", "laenge_ms": 1032994, "build": {"branch": "main", "changelist": 58011042},
    "ich": {"epic_id": ME, "player_id": ME, "platzierung": 3}, "stats_eliminierungen": 2, "team_platzierung": 4, "spieler_gesamt": 100,
}


def elimination(t, doer, victim, knock=False, own=False, **more):
    return {"t_ms": round(t * 1000), "eliminator": doer, "eliminiert": victim, "knock": knock, "selbst": own, **more}


def document(eliminations, **more):
    return json.dumps(DOCUMENT | {"eliminierungen": eliminations} | more)


def parsed(spark, docs, **more):
    rows = spark.createDataFrame(list(enumerate(docs)), "m int, json string")
    found = R.matches(rows, "m", "json", "Europe/Berlin", **more)
    return found, A.own_events(R.eliminations(found, "m"), found, "m")


def kills(own):
    return [(r["at_ms"] / 1000, r["action_ms"] and r["action_ms"] / 1000, r["weapon"], r["remaining"]) for r in own.where("kind = 'kill'").orderBy("at_ms", "seq").collect()]


def test_a_kill_belongs_to_who_knocked_down(spark):
    found, own = parsed(spark, [document([
        elimination(100, ME, "A", knock=True, waffe=7), elimination(104, "TEAM", "a", waffe=1),
        elimination(200, "TEAM", "B", knock=True), elimination(203, ME, "B"),
        elimination(300, ME.upper(), "C", knock=True), elimination(302, ME, "C"),
        elimination(400, ME, "D", waffe=5),
        elimination(500, ME, "E", knock=True), elimination(510, "E", "E", own=True),
        elimination(600, "X", "F", own=True), elimination(610, ME, "", waffe=2), elimination(620, ME, None),
        elimination(700, ME, "G", knock=True), elimination(900, "Y", "G"),
    ], stats_eliminierungen=4)])
    assert kills(own) == [(100, 100, 7, 99), (302, 300, None, 97), (400, None, 5, 96), (500, 500, None, 95)]
    (told,) = R.match_problems(found, own, "m").collect()
    assert (told["kills"], told["problems"], told["place"], told["build"]) == (4, [], 3, "main CL58011042")


def test_a_team_that_falls_at_once_and_old_knocks(spark):
    _, own = parsed(spark, [document([
        elimination(185.0, ME, "1", knock=True), elimination(195.4, ME, "2", knock=True), elimination(200.0, ME, "3", knock=True),
        elimination(200.0, ME, "1"), elimination(200.0, ME, "2"), elimination(200.1, ME, "3"),
        elimination(400, ME, "4", knock=True), elimination(495, ME, "4"), elimination(500, ME, "5", knock=True), elimination(590, "T", "5"),
    ])])
    assert [x[:2] for x in kills(own)] == [(200.0, 185.0), (200.0, 195.4), (200.1, 200.0), (495, None), (500, 500)]


def test_what_the_player_suffers(spark):
    _, own = parsed(spark, [document([
        elimination(5, "B", ME, knock=True, eliminator_bot=True), elimination(9, ME, ME, own=True, waffe=True), elimination(9, "X", "Z", eliminiert_bot=None),
    ])])
    rows = [(r["kind"], r["at_ms"], r["remaining"], r["doer_bot"], r["self"], r["action_ms"]) for r in own.orderBy("seq").collect()]
    assert rows == [("knock_suffered", 5000, 100, True, False, None), ("death", 9000, 98, None, True, None)]


def test_times_ids_and_what_is_no_match(spark):
    docs = [
        document([]), document([], replay_start_kind="Utc"), document([], replay_start="2026-12-01T21:42:22Z"), document([], replay_start="2026-12-01T21:42:22"),
        document([], ich=None), document(None, ich={"epic_id": "", "player_id": "Q"}, stats_eliminierungen=None, laenge_ms=None, build=None, spieler_gesamt=None),
        document([], replay_start=None), "{", "[1]", None, document([{"t_ms": None, "knock": True}, 5, elimination(1, "q", "v")], ich={"player_id": "q"}, stats_eliminierungen=5),
    ]
    found, own = parsed(spark, docs)
    rows = {r["m"]: r for r in R.match_problems(found, own, "m").collect()}
    us = lambda *t: int(dt.datetime(*t, tzinfo=dt.UTC).timestamp()) * 1_000_000
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 10]
    assert rows[0]["start_us"] == us(2026, 9, 21, 19, 42, 22) + 617_000 and rows[1]["start_us"] - rows[0]["start_us"] == 2 * 3_600_000_000
    assert rows[0]["end_us"] - rows[0]["start_us"] == 1_032_994_000
    assert rows[2]["start_us"] == us(2026, 12, 1, 21, 42, 22) and rows[3]["start_us"] == us(2026, 12, 1, 20, 42, 22)
    assert rows[4]["mine"] == [] and rows[4]["problems"] == ["own player not found"] and rows[0]["problems"] == ["counted 2, found 0"]
    assert (rows[5]["mine"], rows[5]["place"], rows[5]["build"], rows[5]["end_us"], rows[5]["problems"]) == (["Q"], 4, "? CL?", rows[5]["start_us"], [])
    assert rows[10]["problems"] == ["counted 5, found 1"]
    early, _ = parsed(spark, docs[:1], local_start=False)
    assert early.first()["start_us"] == rows[1]["start_us"]


def plain(events, most):
    """The owner of each finish of (match, seq, at_ms, doer, victim, knock, own, weapon), as a state machine."""
    marks, out = {}, []
    for m, seq, at, doer, victim, knock, own, weapon in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if knock:
            marks[m, victim] = at, doer, weapon
            continue
        mark = marks.pop((m, victim), None)
        mark = mark if mark and at - mark[0] <= most else None
        owner = (mark[1] if mark else doer) if victim and (mark or not own) else None
        known = bool(mark and owner)
        out.append((m, seq, at, doer, victim, owner or None, mark[0] if known else None, mark[2] if known else weapon))
    return collections.Counter(out)


EVENTS = "m int, seq long, at_ms long, doer string, victim string, knock boolean, self boolean, weapon int"
COLUMNS = ["m", "seq", "at_ms", "doer", "victim", "owner", "action_ms", "owner_weapon"]


def random_events(n, seed, hot=0.3):
    r = random.Random(seed)
    return [(0 if r.random() < hot else r.randrange(5), i, 1_700_000_000_000 + r.randrange(n * 40), r.choice("ABC"), r.choice(["A", "B", "C", "D", ""]), r.random() < 0.5, r.random() < 0.2, r.choice([None, 1, 2])) for i in range(n)]


def test_table_against_a_state_machine(spark):
    events = random_events(1500, 8)
    df = spark.createDataFrame(events, EVENTS).withColumns({"mark": F.lit(1), "stretch": F.lit(1), "place": F.lit(1)}).repartition(5)
    got = A.owned(df, "m", 900).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == plain(events, 900)
    assert got[0]["mark"] == got[0]["place"] == 1
    assert A.owned(df.limit(0), "m").count() == 0


def test_stream_gives_the_same_rows(spark, tmp_path):
    from sparkloom.streaming.attribution import owned_stream

    events = sorted(random_events(300, 9), key=lambda e: e[2])
    r = random.Random(1)
    shuffled = sorted(events, key=lambda e: e[2] + r.randrange(3000))  # out of order, within the delay
    far = [(9, 10_000 + i, events[-1][2] + 10**9 * (i + 1), "A", "Z", True, False, None) for i in range(2)]
    for k in range(4):
        part = shuffled[k * 75 : (k + 1) * 75] + ([far[0]] if k == 3 else [])
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame(far[1:], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/5")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = owned_stream(stream, "m", "4 seconds", 900).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(180)
        assert not query.isActive and query.exception() is None
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert collections.Counter(tuple(x[c] for c in COLUMNS) for x in got) == plain(events, 900)


def test_recordings_and_marks(spark):
    marks = [
        {"type": "kill", "unlocalized_display_name": "x", "clip_timestamp": 1.5}, {"type": "Award", "unlocalized_display_name": "Triple Elimination", "clip_timestamp": "2"},
        {"unlocalized_display_name": "Victory Royale"}, {"type": "died", "clip_timestamp": 4}, {"unlocalized_display_name": "eliminated", "clip_timestamp": 5},
        {"type": "QUEST", "unlocalized_display_name": "done", "clip_timestamp": 1}, {"type": "kill", "clip_timestamp": "soon"}, {"type": "kill", "clip_timestamp": None},
    ]
    rows = [
        ("a", json.dumps({"recording_timestamp": "2026-03-01T10:00:20Z", "full_length": 20, "gamesense_events": marks}), 5_000_000, 8.0),
        ("b", json.dumps({"recording_timestamp": "nonsense", "gamesense_events": "none"}), 5_000_000, 3.0), ("c", "{", 5_000_000, 2.0), ("d", None, None, 2.0),
    ]
    files = spark.createDataFrame(rows, "f string, json string, named long, measured double")
    found = R.recordings(files, "json", "named", "measured", "Europe/Berlin", 0.5)
    got = {r["f"]: r for r in found.collect()}
    end = int(dt.datetime(2026, 3, 1, 10, 0, 20, 500_000, tzinfo=dt.UTC).timestamp() * 1e6)
    assert (got["a"]["end_us"], got["a"]["start_us"], got["a"]["length_s"]) == (end, end - 20_000_000, 20.0)
    assert (got["b"]["start_us"], got["b"]["end_us"]) == (2_500_000, 5_500_000) and got["c"]["marks"] is None and got["d"]["end_us"] is None
    told = sorted(((r["at_us"] - (end - 20_000_000)) / 1e6, r["kind"], r["n"]) for r in R.marks(found, "f").collect())
    assert told == [(0.0, "win", 1), (1.5, "kill", 1), (2.0, "kill", 3), (4.0, "death", 1), (5.0, "death", 1)]


@pytest.mark.parametrize(("event", "want"), [("Doppeleliminierung ", ("kill", 2, 6_000_000)), ("Am Boden", ("knock", 1, 6_000_000)), ("other", None), (None, None)])
def test_names_tell_of_events(spark, event, want):
    files = spark.createDataFrame([("a", 10_000_000, 4.0, True, event)], "f string, named long, length double, is_end boolean, event string")
    found = R.named_recordings(files, "named", "length", "is_end")
    assert found.first()["start_us"] == 6_000_000
    rows = [(r["kind"], r["n"], r["at_us"]) for r in R.named_marks(found, "f", "event", "length").collect()]
    assert rows == ([want] if want else [])
    began = R.named_recordings(files.withColumn("is_end", F.lit(False)), "named", "length", "is_end").first()
    assert (began["start_us"], began["end_us"]) == (10_000_000, 14_000_000)


def test_a_document_is_parsed_once(spark):
    """Each field, and each filter, parsed the whole document again."""
    from sparkloom.sources import replays

    rows = spark.createDataFrame([("a", "{}", 1, 1.0)], "k string, j string, named long, s double").repartition(2)
    for df in (replays.matches(rows, "k", "j", "Europe/Berlin"), replays.marks(replays.recordings(rows, "j", "named", "s", "Europe/Berlin"), "k")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parsejson") + plan.count("parse_json") == 1
