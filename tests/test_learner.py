"""Pairs and learned weights against plain computations."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import learner as L
from sparkloom.operators.evidence import LEAD, leash


def test_votes_and_their_pairs(spark):
    votes = [(1, 1, None), (2, -1, []), (3, -1, ["dull"]), (4, 1, ["fine"]), (5, 0, None), (None, 1, None)]
    shown = [(1, "a"), (1, "b"), (1, "a"), (2, "c"), (2, "b"), (3, "d"), (4, "a"), (5, "e"), (5, "f"), (4, None), (9, "z")]
    sums = L.vote_sums(spark.createDataFrame(votes, "d int, thumb int, reasons array<string>"), spark.createDataFrame(shown, "d int, m string"), "d", "m")
    assert {r["m"]: r["votes"] for r in sums.collect()} == {"a": 2.0, "c": -1.0, "e": -1.0, "f": -1.0}
    more = spark.createDataFrame([("a", 2.0), ("g", 1.0), ("h", 5.0), ("c", -1.0), ("e", -3.0)], "m string, votes double")
    got = [(r["good"], r["bad"]) for r in L.voted_pairs(more, "m", 5).orderBy("place").collect()]
    assert got == [("h", "e"), ("a", "c"), ("g", "e"), ("h", "c"), ("a", "e")]
    assert L.voted_pairs(more, "m", 100).count() == 6 and L.voted_pairs(more.where("votes > 0"), "m", 9).count() == 0


def test_audience_pairs_are_the_newest(spark):
    r = random.Random(4)
    rows = [(i, r.choice("xy"), r.randrange(12), r.choice([None, *range(30)]) if i % 9 == 0 else r.randrange(30), r.choice([None, 0.0, 0.5, 1.2, 1.7, -0.3])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, m int, s int, y double").withColumn("at", F.timestamp_seconds("s")).repartition(3)
    plain = []
    for a, b in itertools.combinations([x for x in rows if x[3] is not None and x[4] is not None], 2):
        if a[1] == b[1] and a[2] != b[2] and abs(a[4] - b[4]) + 1e-9 >= 0.5:
            up, down = (a, b) if a[4] > b[4] else (b, a)
            plain.append(((max(a[3], b[3]), max(a[0], b[0]), min(a[0], b[0])), up[0], down[0]))
    plain.sort(reverse=True)
    for most, first in ((15, 2), (40, 8), (10_000, 4)):
        got = [(x["good"], x["bad"]) for x in L.audience_pairs(df, ["k"], "id", "m", "at", "y", 0.5, most, first).orderBy("place").collect()]
        assert got == [x[1:] for x in plain[:most]]


NAMES = ["f", "g", "h"]
START = {"f": 2.0, "g": 0.0, "h": -1.0}


def learn(rows, trust, epochs=4, step=0.05):
    first = np.array([START[n] for n in NAMES])
    width = np.array([leash(s, 0.5, 0.5) for s in first])
    w = first.copy()
    for _ in range(epochs):
        for _, _, much, *x in rows:
            d = np.array([0.0 if v is None else v for v in x])
            if d @ w < LEAD:
                w = np.where(d != 0, np.clip(w + step * much * d, first - width, first + width), w)
    return {n: round(START[n] + trust * (round(float(v), 4) - START[n]), 4) for n, v in zip(NAMES, w, strict=True)}


def rate(rows, w):
    if not rows:
        return None
    lead = [sum((v or 0.0) * w[n] for n, v in zip(NAMES, x[3:], strict=True)) for x in rows]
    return sum(x[2] * (1.0 if d > 0 else 0.5 if d == 0 else 0.0) for x, d in zip(rows, lead, strict=True)) / sum(x[2] for x in rows)


def pairs(seed, n, audience, good=0.5, user=None):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = "viewers" if i < audience else r.choice(["battles", "votes"])
        rows.append((source, i * 3, r.choice([0.5, 1.0]), round(r.gauss(0.1, 1), 3), r.choice([None, round(r.gauss(good if source == "viewers" or user is None else user, 1), 3)]), round(r.gauss(0, 1), 3)))
    return rows


def test_weights_and_gates_equal_the_plain_ones(spark):
    reasons = set()
    for seed, n, audience, basis, good, own in ((1, 60, 20, 40, 0.9, None), (2, 30, 0, 80, 0.4, None), (3, 40, 12, 5, 0.9, None), (4, 50, 25, 60, -0.9, None), (7, 70, 50, 60, 3.0, -3.0)):
        rows = pairs(seed, n, audience, good, own)
        df = spark.createDataFrame(rows, "source string, place int, weight double, f double, g double, h double").repartition(3)
        got, report = L.learned_weights(df, START, "viewers", basis, 10, 60, 10, epochs=4)
        trust = min(1.0, basis / 60)
        user = sorted((x for x in rows if x[0] != "viewers"), key=lambda x: (x[0], x[1]))
        seen = sorted((x for x in rows if x[0] == "viewers"), key=lambda x: x[1])
        cut = lambda side: len(side) - max(1, round(len(side) * 0.2)) if len(side) >= 10 else len(side)
        old = seen[::-1]
        held = user[cut(user) :] + old[cut(old) :]
        train = user[: cut(user)] + old[: cut(old)][::-1]
        want = rate(held, learn(train, trust)) if held else None
        assert report["rate_holdout"] is None if want is None else abs(report["rate_holdout"] - want) < 1e-4
        new = learn(user + seen, trust)
        worse = lambda side, new=new: side and round(rate(side, new), 4) < round(rate(side, START), 4)
        active = basis >= 10 and not worse(user) and not (len(seen) >= 10 and worse(seen))
        assert (report["active"], got) == (active, new if active else START)
        chosen = new if active else START
        assert abs(report["rate"] - rate(user, chosen)) < 1e-4 and abs(report["rate_start"] - rate(user, START)) < 1e-4
        reasons.add(report["reason"])
    assert {"active", "5 verdicts to go"} <= reasons and len(reasons) >= 3
