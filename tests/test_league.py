"""Weekly crowning against a plain replay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkloom.operators import cohort, league

CHOICES = ["montage", "story", "plain"]
T0 = dt.datetime(2026, 1, 4, 18)


def posts(seed, n, lift):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        posted = T0 + dt.timedelta(days=i * 2.3 + r.random())
        choice = r.choice([*CHOICES, None])
        score = r.gauss(lift if choice == "story" else 0.0, 0.3)
        rows.append((i, i - i % 7 if i % 7 == 1 else i, posted, posted + dt.timedelta(days=r.choice([7, 8, 15])), choice, score, 30.0 + r.random()))
    return rows


def verdict(spark, one, other):
    rows = [(True, *x) for x in one] + [(False, *x) for x in other]
    if not one or not other:
        return "few", None
    w = cohort.welch(spark.createDataFrame(rows, "side boolean, score double, length double"), F.col("side"), "score", "length").first()
    return w["verdict"], w["difference"]


def plain(spark, rows, cutoffs):
    entries, best, since, lead, sides, seen = [], None, None, None, None, None
    for c in cutoffs:
        active = {}
        for u in rows:
            if u[3] <= c and (u[1] not in active or (u[2], u[0]) < (active[u[1]][2], active[u[1]][0])):
                active[u[1]] = u
        mark = frozenset(u[0] for u in active.values())
        if mark == seen or not mark:
            continue
        seen = mark
        fresh = [u for u in active.values() if best is None or u[2] > since]
        found = []
        for k in CHOICES:
            if k == best:
                continue
            a = [u for u in fresh if u[4] == k]
            b = [u for u in fresh if u[4] not in (None, k)] if best is None else [u for u in fresh if u[4] == best]
            v, d = verdict(spark, [u[5:7] for u in a], [u[5:7] for u in b])
            if v == "more":
                found.append((d, k, (frozenset(u[0] for u in a), frozenset(u[0] for u in b))))
        now = max(found, default=None, key=lambda x: x[0])
        if now and lead == now[1]:
            if sides != now[2]:
                entries.append((c, "best", lead, best))
                best, since, lead, sides = lead, c, None, None
            continue
        if now:
            entries.append((c, "lead", now[1], best))
        lead, sides = (now[1], now[2]) if now else (None, None)
    return entries


def test_crowning_equals_a_plain_replay(spark):
    rows = posts(1, 60, 1.2)
    cutoffs = [T0 + dt.timedelta(days=7 * i) for i in range(1, 22)]
    units = spark.createDataFrame(rows, "post long, family long, posted timestamp_ntz, done timestamp_ntz, choice string, score double, length double")
    got = league.crown(units, spark.createDataFrame([(c,) for c in cutoffs], "cutoff timestamp_ntz"), CHOICES)
    want = plain(spark, rows, cutoffs)
    assert [(e["cutoff"], e["kind"], e["choice"], e["against"]) for e in got] == want and any(k == "best" for _, k, *_ in want)


def test_nothing_to_crown(spark):
    units = spark.createDataFrame([], "post long, family long, posted timestamp_ntz, done timestamp_ntz, choice string, score double, length double")
    assert league.crown(units, spark.createDataFrame([(T0,)], "cutoff timestamp_ntz"), CHOICES) == []
