"""Draws: moments, repeatability, and choices against a plain loop over the same draws."""

import collections
import math

from pyspark.sql import functions as F

from sparkloom.operators import draws as D

N = 20_000


def test_beta_moments(spark):
    shapes = [(1.0, 1.0), (2.5, 7.0), (0.4, 0.6), (60.0, 3.0)]
    names = spark.range(N).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("n"))
    for a, b in shapes:
        m, v, low, high = names.select(D.beta_draw(F.col("n"), F.lit(a), F.lit(b)).alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(m - mean) < 5 * math.sqrt(var / N) and abs(v / var - 1) < 0.08 and 0 <= low < high <= 1


def test_uniforms_fill_the_range_evenly(spark):
    parts = collections.Counter(r["p"] for r in spark.range(N).select(F.floor(D.uniform(F.col("id").cast("string")) * 10).alias("p")).collect())
    assert set(parts) == set(range(10)) and all(abs(n - N / 10) < 5 * math.sqrt(N / 10) for n in parts.values())


def test_draws_stop_at_the_first_try_taken(spark):
    """All tries of a name, taken or not, took a minute and more."""
    import time

    names = spark.range(200_000).repartition(4).select(F.col("id").cast("string").alias("n"))
    began = time.perf_counter()
    assert abs(names.select(D.beta_draw(F.col("n"), F.lit(2.0), F.lit(2.0)).alias("x")).agg(F.avg("x")).first()[0] - 0.5) < 0.01
    assert time.perf_counter() - began < 15


ARMS = "step int, knob string, arm string, hits double, tries double, last array<string>"


def arms(n=120):
    rows = []
    for s in range(n):
        last = [[], ["b"], ["b", "b"], ["a", "c", "c"], None][s % 5]
        rows += [(s, "x", a, h, t, last) for a, h, t in (("a", 1.0, 4.0), ("b", 9.5, 12.0), ("c", 0.0, 0.0))]
        rows += [(s, "y", a, h, t, last) for a, h, t in (("p", 3.0, 30.0), ("q", None, None))]
        rows += [(s, "z", "only", 1.0, 1.0, last)]
    return rows


def drawn(spark, rows, parts):
    return D.drawn(spark.createDataFrame(rows, ARMS).repartition(parts), ["step", "knob"], "arm", F.col("hits"), F.col("tries"), "seed")


def test_same_on_any_partitioning_and_better_arms_win_more(spark):
    rows = arms()
    one, two = ({(r["step"], r["knob"], r["arm"]): (r["draw"], r["place"]) for r in drawn(spark, x, p).collect()} for x, p in ((rows, 1), (rows[::-1], 7)))
    assert one == two and all(0 < d < 1 for d, _ in one.values())
    wins = collections.Counter(k[2] for k, (_, place) in one.items() if k[1] == "x" and place == 1)
    assert wins["b"] > wins["c"] > wins["a"] and sum(wins.values()) == 120


def test_no_arm_three_times(spark):
    rows = arms()
    found = drawn(spark, rows, 3)
    draws = collections.defaultdict(list)
    for r in found.collect():
        draws[r["step"], r["knob"]].append((r["place"], r["arm"], r["last"]))
    for r in D.never_thrice(found, ["step", "knob"], "arm", "last").collect():
        ranked = [a for _, a, _ in sorted(draws[r["step"], r["knob"]], key=lambda x: x[0])]
        last = draws[r["step"], r["knob"]][0][2] or []
        want = next((a for a in ranked if not (len(last) >= 2 and last[-1] == last[-2] == a)), ranked[0])
        assert r["arm"] == want


def test_daring(spark):
    rows = arms(300)
    found = drawn(spark, rows, 3).withColumns({"hits": F.coalesce("hits", F.lit(0.0)), "tries": F.coalesce("tries", F.lit(0.0))})
    best = {(r["step"], r["knob"]): r["arm"] for r in found.where("place = 1").collect()}
    got = {(r["step"], r["knob"]): r for r in D.daring(found, ["step"], "knob", "arm", "tries", "hits", "s", 0.4, "x", "last").collect()}
    assert set(got) == set(best)
    dared = [k for k, r in got.items() if r["experiment"]]
    assert len({k[0] for k in dared}) == len(dared) and 0.15 < len(dared) / 300 < 0.4 and not [k for k in dared if k[1] == "z"]
    last = {s: rows_last or [] for s, _, _, _, _, rows_last in rows}
    rate = {"a": 2 / 6, "b": 10.5 / 14, "c": 0.5}
    for (step, knob), r in got.items():
        want = best[step, knob]
        if r["experiment"]:
            assert r["arm"] != want or knob == "x"
            others = [a for a, t in ({"a": 4.0, "b": 12.0, "c": 0.0} if knob == "x" else {"p": 30.0, "q": 0.0}).items() if a != want]
            want = min(others, key=lambda a: {"a": 4.0, "b": 12.0, "c": 0.0, "p": 30.0, "q": 0.0}[a])
        if knob == "x" and len(last[step]) >= 2 and last[step][-1] == last[step][-2] == want:
            want = max((a for a in "abc" if a != want), key=rate.get)
        assert r["arm"] == want


def test_no_rows(spark):
    assert drawn(spark, arms(), 2).limit(0).count() == 0 and D.drawn(spark.createDataFrame([], ARMS), ["step"], "arm", F.col("hits"), F.col("tries"), "s").count() == 0
