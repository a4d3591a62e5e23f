"""Snapped timelines against a plain loop."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import cutting as C

SEGMENTS = "k int, n int, core_begin double, core_end double, must_begin double, must_end double, source_s double, most_s double, wanted double"


def segments(keys, r):
    rows = []
    for k in range(keys):
        for n in range(r.randrange(1, 12)):
            core = r.random() * 6
            length = r.random() * 5
            must = core + r.random() * length / 2
            rows.append((k, n * 3, core, core + length, must, must + r.random() * 3, core + length + r.random() * 6, r.choice([2.0, 4.0, 8.0]), r.choice([0.0, 0.3, 0.8])))
    return rows


def plain(rows, grid, least, fps):
    out, t, before = {}, {}, {}
    for k, n, cb, ce, mb, me, source, most, wanted in sorted(rows):
        now = t.get(k, 0.0)
        usable, must = max(0.5, source - 0.25), max(0.5, me - mb)
        wish = min(most, max(least, ce - cb, must), usable)
        low, high = max(least, must), min(usable, max(wish, must) + 2)
        fits = sorted(b for j, b in grid if j == k and low - 1e-6 <= b - now <= high + 1e-6)
        end = min(fits, key=lambda b: abs(b - (now + wish))) if fits else now + max(min(wish, usable), min(low, usable))
        length = end - now
        start = max(min(cb - 0.6 * (length - (ce - cb)), mb), me - length)
        start = max(0.0, min(start, usable - length))
        room = 2 * max(0.0, min(before[k], start)) if k in before else 0.0
        d = min(wanted, room)
        out[k, n] = (now, end, bool(fits), start, start + length, 0.0 if k not in before or d < 2 / fps else d)
        t[k], before[k] = end, source - (start + length)
    return out


def test_timelines_equal_the_loop(spark):
    r = random.Random(7)
    rows = segments(60, r)
    grid = [(k, round(b * r.choice([0.4, 0.5, 1.3]), 3)) for k in range(0, 60) if k % 6 for b in range(r.randrange(60))]
    s = spark.createDataFrame(rows, SEGMENTS).withColumns({c: F.lit("own") for c in ("length", "beats")}).repartition(4)
    g = spark.createDataFrame([*grid, (3, None)], "k int, at double").repartition(3)
    got = C.with_handles(C.timeline(s, g, "k", "n", "at", 1.5), "k", "n", "wanted", 30.0).collect()
    want = plain(rows, grid, 1.5, 30.0)
    assert len(got) == len(want) and 0 < sum(x["on_beat"] for x in got) < len(got)
    for x in got:
        mine = (x["time_begin"], x["time_end"], x["source_begin"], x["source_end"], x["transition_s"])
        w = want[x["k"], x["n"]]
        assert x["on_beat"] == w[2] and np.allclose(mine, (w[0], w[1], w[3], w[4], w[5]), atol=1e-9)
    assert C.timeline(s.limit(0), g, "k", "n", "at", 1.5).count() == 0


def test_the_earlier_of_two_beats_as_near():
    ends = C.snapped(*(np.array([x]) for x in (1.0, 4.0, 2.0, 2.0)), np.array([1.5, 2.5]))[1]
    assert ends[0] == 1.5


def test_a_long_timeline_takes_linear_time():
    n = 100_000
    one = np.ones(n)
    begins, ends, on = C.snapped(one, 3 * one, 2 * one, 2 * one, np.arange(0, 2.2 * n, 0.7))
    assert on.all() and (begins[1:] == ends[:-1]).all()
