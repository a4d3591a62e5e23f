"""Guarded changes and flashes against plain loops, in small pieces too."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import flashes as L
from sparkloom.operators import transitions as T

STATES = ["a", "b", "c", "d"]
REQUESTS = "item int, at int, id int, guard array<string>, target string"


def requests(n, seed, hot=0.4):
    r = random.Random(seed)
    return [(0 if r.random() < hot else r.choice([1, 2, 3, 4, None]), r.choice([None, *range(n)]) if r.random() < 0.05 else r.randrange(n), i, r.choice([None, [], ["zz"], ["a"], ["b", "c"], ["d", "a"], ["c"]]), r.choice([*STATES, "zz", None])) for i in range(n)]


def plain(rows, begin):
    now, out = {}, {}
    for item, at, i, guard, target in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: (x[0], x[1], x[2])):
        before = now.get(item, begin.get(item, "a"))
        done = bool(guard) and before in guard and target in STATES
        now[item] = target if done else before
        out[i] = (before, now[item], done)
    return out | {x[2]: (None, None, False) for x in rows if x[0] is None or x[1] is None}


@pytest.mark.parametrize("piece", [512, 3])
def test_changes_equal_the_loop(spark, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)  # 3: pieces of pieces, several levels
    rows = requests(160 if piece == 3 else 500, piece)
    begin = {1: "c", 2: "b", 3: "zz"}
    df = spark.createDataFrame(rows, REQUESTS).withColumns({c: F.lit("own") for c in ("state", "part", "place")}).repartition(3)
    got = T.guarded(df, spark.createDataFrame(list(begin.items()), "item int, state string"), "item", "at", "id", "guard", "target", STATES).collect()
    begin.pop(3)
    assert {r["id"]: (r["before"], r["after"], r["done"]) for r in got} == plain(rows, begin) and got[0]["state"] == "own"


def test_no_requests(spark):
    begin = spark.createDataFrame([], "item int, state string")
    assert T.guarded(spark.createDataFrame([], REQUESTS), begin, "item", "at", "id", "guard", "target", STATES).count() == 0


def plain_turns(values):
    out, extreme, way = [], None, 0
    for at, v in values:
        if extreme is None or (way > 0 and v > extreme) or (way < 0 and v < extreme):
            extreme = v
        elif abs(v - extreme) >= 0.1 and min(v, extreme) < 0.8:
            out.append(at)
            way = 1 if v > extreme else -1
            extreme = v
    return out


@pytest.mark.parametrize("piece_s", [600.0, 0.7])
def test_turns_and_flashes(spark, piece_s):
    r = random.Random(9)
    series = {k: sorted((r.randrange(20_000_000), min(1.0, max(0.0, r.gauss(0.5, s)))) for _ in range(n)) for k, s, n in (("calm", 0.02, 300), ("wild", 0.3, 400), ("bright", 0.05, 200))}
    series["bright"] = [(t, 0.9 + v / 20) for t, v in series["bright"]]
    series["slow"] = [(i * 400_000, 0.5) for i in range(40)] + [(17_000_000, 0.7)]  # a state that pieces hand on
    rows = [(k, t, v) for k, s in series.items() for t, v in s] + [("wild", 5, None), (None, 5, 0.1), ("none", 3, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(4)
    found = L.turning_points(df, "k", "t", "v", piece_s=piece_s)
    got = {k: sorted(x["t"] for x in found.where(F.col("k") == k).collect()) for k in series}
    want = {k: plain_turns(s) for k, s in series.items()}
    assert got == want and want["wild"] and want["slow"] and not want["calm"]
    most = {r["k"]: r["flashes"] for r in L.most_flashes(found, "k", "t", df.where("k is not null")).collect()}
    for k, at in want.items():
        assert most[k] == max((sum(t - 1_000_000 < u <= t for u in at) // 2 for t in at), default=0)
    assert most["none"] == 0 and L.turning_points(df.limit(0), "k", "t", "v").count() == 0
