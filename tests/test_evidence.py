"""Learners and picture criteria against plain loops and worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.operators import evidence, picture


def test_leash_never_crosses_zero():
    assert [evidence.leash(s, 0.5, 0.5) for s in (4.0, -4.0, 0.25, 0.0)] == [2.0, 2.0, 0.25, 0.5]


@pytest.mark.parametrize("step, epochs, want", [(0.1, 1, 0.05), (0.05, 5, 0.125)])
def test_perceptron_worked_case(spark, step, epochs, want):
    pairs = spark.createDataFrame([("p", 1, 0.5, 1.0, None)], "pool string, i int, w double, loud double, laugh double")
    got = {r["name"]: r["weight"] for r in evidence.perceptron(pairs, "pool", "i", ["loud", "laugh"], "w", {"loud": 0.0, "laugh": 1.0}, step, epochs, 0.5, 0.5).collect()}
    assert got == {"loud": want, "laugh": 1.0}


def test_perceptron_leads_are_summed_in_order(spark):
    """A lead of LEAD but for the last bit: products that are summed fused or in another order don't move what SQL moves."""
    rnd, names, start = random.Random(11), ["a", "b", "c"], {"a": 2.0, "b": 1.0, "c": 1.0}
    rows = [(p, i, 1.0, rnd.randrange(-49, 50) / 50, rnd.randrange(-10, 11) / 10, rnd.randrange(-8, 9) / 10) for p in range(60) for i in range(120)]
    df = spark.createDataFrame(rows, "pool int, i int, w double, a double, b double, c double")
    got = {(r["pool"], r["name"]): r["weight"] for r in evidence.perceptron(df, "pool", "i", names, "w", start, 0.05, 2, 0.5, 0.5).collect()}
    for p in range(60):
        w = [2.0, 1.0, 1.0]
        for _ in range(2):
            for _, _, _, *x in rows[p * 120 : p * 120 + 120]:
                if x[0] * w[0] + x[1] * w[1] + x[2] * w[2] < 1.0:
                    w = [max(s - h, min(s + h, v + 0.05 * d)) if d else v for v, d, s, h in zip(w, x, (2.0, 1.0, 1.0), (1.0, 0.5, 0.5), strict=True)]
        assert [got[p, n] for n in names] == [round(v, 4) for v in w], p


def test_pair_factors_equal_a_plain_loop(spark):
    rnd, weights = random.Random(5), {"x": 2.0, "y": 1.0}
    rows = [(1.0 + i % 2, rnd.random(), rnd.random(), rnd.random(), None if i % 5 == 0 else rnd.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "g double, a_x double, b_x double, a_y double, b_y double")
    got = evidence.pair_factors(df, weights, "g", 0.5, 2.0, 4.0, 0.05, 0.5, 6)
    u, eta = {"x": 0.0, "y": 0.0}, 0.5 / (sum(r[0] for r in rows) / 20)
    for _ in range(6):
        grad = {k: 0.1 * v for k, v in u.items()}
        for g, ax, bx, ay, by in rows:
            parts = {k: (weights[k] * math.exp(u[k]), a - b) for k, a, b in (("x", ax, bx), ("y", ay, by)) if b is not None}
            whole = sum(w for w, _ in parts.values())
            lead = sum(w * d for w, d in parts.values()) / whole
            for k, (w, d) in parts.items():
                grad[k] += g * -4.0 / (1 + math.exp(4.0 * lead)) / whole * w * (d - lead)
        u = {k: min(math.log(2), max(math.log(0.5), u[k] - eta * grad[k])) for k in u}
    assert got == pytest.approx(u, abs=1e-9)


def test_pair_factors_make_the_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1.0, 0.5 + i / 40, 0.5) for i in range(20)], "g double, a_x double, b_x double")
    evidence.pair_factors(df.mapInArrow(counted, df.schema), {"x": 1.0}, "g", 0.5, 2.0, 4.0, 0.05, 0.5, 3)
    assert made.value == 20


def test_pair_factors_without_pairs(spark):
    assert evidence.pair_factors(spark.createDataFrame([], "g double, a_x double, b_x double"), {"x": 1.0}, "g", 0.5, 2.0, 4.0, 0.05, 0.5, 3) == {"x": 0.0}


def test_half_of_the_cuts_must_match(spark):
    def at(rows):
        return spark.createDataFrame(rows, "k string, s double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("at"))

    got = picture.matched_cuts(at([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]), at([("a", 1.05), ("a", 5.0), ("b", 1.05)]), "k", "at", 0.1)
    assert sorted((r["k"], r["at_us"] / 1e6, r["from_plan"]) for r in got.collect()) == [
        ("a", 1.05, True), ("a", 2.0, True), ("a", 5.0, False), ("b", 1.0, True), ("b", 2.0, True), ("b", 3.0, True)]


def test_iterative_queries_have_rows(spark):
    for name in ("line_weights", "line_factors"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_folds_by_pieces_equal_the_plain_one(spark):
    import random

    from pyspark.sql import functions as F

    from sparkloom.operators import evidence, series

    r = random.Random(3)
    rows = [(k, r.choice([None, *range(5000)]) if i % 50 == 0 else r.randrange(5000), i, r.choice([1.3, 0.7, 1.0, None, 2.5])) for k in "ab" for i in range(200)] + [("c", 1, 1, None)]
    df = spark.createDataFrame(rows, "k string, s int, i int, step double").withColumn("at", F.timestamp_seconds("s")).repartition(3)
    want = {}
    for k, _, _, step in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
        want[k] = min(2.0, max(0.5, want.get(k, 1.0) * (1.0 if step is None else step)))
    for piece in (60.0, 1e6):
        got = {x["k"]: x["factor"] for x in evidence.folded(df, "k", "at", "i", F.col("step"), 1.0, 0.5, 2.0, piece).collect()}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    levels = {x["k"]: x["p"] for x in series.floor_level(df, "k", "i", 0.9, "p").collect()}
    assert levels == {"a": 180, "b": 180, "c": 1}
