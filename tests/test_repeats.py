"""Repeated pictures against comparing all frames with all."""

import random

from sparkloom.operators import repeats as R


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_runs_equal_those_of_all_pairs(spark):
    r = random.Random(8)
    rows = []
    for k in range(4):
        hashes = [r.getrandbits(64) for _ in range(60)]
        for _ in range(4):  # passages that come again, with a few bits changed
            a, n, d = r.randrange(30), r.randrange(2, 9), r.randrange(5, 25)
            for i in range(a, a + n):
                h = hashes[i]
                for bit in r.sample(range(64), r.randrange(8)):
                    h ^= 1 << bit
                hashes[min(59, i + d)] = h
        hashes[5:9] = [0] * 4  # black
        hashes[40:44] = [0] * 4
        rows += [(k, i, None if r.random() < 0.02 else signed(h)) for i, h in enumerate(hashes)]
    got = {tuple(x) for x in R.repeated_runs(spark.createDataFrame(rows, "k int, i int, h long").repartition(3), "k", "i", "h", 2.0).collect()}
    want = set()
    by = {(k, i): h for k, i, h in rows}
    for k in range(4):
        for offset in range(6, 60):
            run = []
            for i in range(61 - offset):
                a, b = by.get((k, i)), by.get((k, i + offset))
                if a is not None and b is not None and 4 <= (a & (2**64 - 1)).bit_count() <= 60 and ((a ^ b) & (2**64 - 1)).bit_count() <= 6:
                    run.append(i)
                    continue
                if len(run) >= 3:
                    want.add((k, run[0], offset, len(run)))
                run = []
            if len(run) >= 3:
                want.add((k, run[0], offset, len(run)))
    assert got == want and len(want) >= 3


def test_doubled_sources(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", None]), n, s := round(r.random() * 40, 2), round(s + r.random() * 9, 2)) for k in range(3) for n in range(40)] + [(0, "a", 99, None, 3.0), (0, "a", 98, 5.0, 5.0)]
    got = {(x["k"], x["f"], x["a"], x["b"], round(x["twice_s"], 6)) for x in R.doubled_sources(spark.createDataFrame(rows, "k int, f string, n int, s double, e double"), "k", "f", "n", "s", "e").collect()}
    want = set()
    good = [x for x in rows if None not in x]
    for a in good:
        for b in good:
            if a[:2] == b[:2] and (a[3], a[2]) < (b[3], b[2]) and min(a[4], b[4]) - b[3] > 1.5 + 1e-6:
                want.add((a[0], a[1], a[2], b[2], round(min(a[4], b[4]) - b[3], 6)))
    assert got == want and len(want) > 20
    assert R.doubled_sources(spark.createDataFrame([], "k int, f string, n int, s double, e double"), "k", "f", "n", "s", "e").count() == 0
