"""Hard negatives against scores of all pairs, and the bounds of the approximation file."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dims=6, labels=4, seed=1, wide=1.0):
    r = random.Random(seed)
    near = [0.5] * dims
    return [(i * 20, [float(np.float32(x + r.gauss(0, 0.05))) for x in near] if i % 3 == 0 else [float(np.float32(r.gauss(0, wide))) for _ in range(dims)], 1 if i % 3 == 0 else r.randrange(labels)) for i in range(n)]


def plain(rows, window=(30, 90)):
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))
    for k, a in enumerate(good):
        if a[0] % 100 == 0:
            scored = sorted((-score(a, b), b[0], b[2] == a[2]) for m, b in enumerate(good) if m != k)
            for s, i, _ in [x for x in scored if x[2]][:5]:
                inside = [(t, j) for t, j, same in scored if not same and window[0] * -s <= 100 * -t <= window[1] * -s][:10]
                for rank, (t, j) in enumerate(inside, 1):
                    out[a[0], i, rank, j, -s, -t] += 1
    return out


def mined(spark, rows, clashes=False, parts=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clashes:
        df = df.withColumns({c: F.lit("own") for c in ("at", "vector", "anchor", "codes", "id", "score", "place", "a b")})
    found = negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect()
    return collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)


def test_all_pairs_ties_and_a_hot_label(spark):
    rows = vectors(900)
    rows += [(i + 1, v, (c + 1) % 4) for i, v, c in rows[:200]]  # equal vectors of other labels
    assert mined(spark, rows, clashes=True) == plain(rows)


def test_groups_of_anchors_and_small_blocks(spark):
    """Several groups of anchors, and a window whose ends are other ones."""
    rows = vectors(400, seed=2)
    want = plain(rows, (50, 100))
    assert len({k[0] for k in want}) > 20
    assert mined(spark, rows, group_bytes=1024, window=(50, 100)) == want


def test_odd_rows(spark):
    rows = [
        (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (None, [9.0, 9.0], 2), (7, None, 2), (8, [1.0, None], 2), (9, [float("nan"), 1.0], 2), (10, [float("inf"), 1.0], 2),
        (11, [], 2), (12, [0.9, 1.5], None), (13, [0.5], 2), (14, [0.5, 1.0], 2), (14, [0.5, 1.0], 2), (200, [-1.0, -1.0], 3), (201, [1.0, 1.0], 3), (0, [0.0, 0.0], 4), (1, [0.0, 0.0], 4),
    ]
    assert mined(spark, rows) == plain(rows)
    assert any(k[0] == 0 and k[4] == 0 for k in plain(rows))  # a positive of score 0 has those of score 0
    assert mined(spark, []) == collections.Counter()
    assert mined(spark, [(100, [], 1), (101, [], 1), (5, [], 2)]) == plain([(100, [], 1), (101, [], 1), (5, [], 2)])


def test_large_components_saturate(spark):
    limit = negatives.component_limit(2)
    rows = [(0, [3e38, 1.0], 1), (1, [1.0, 1.0], 1), (2, [-3e38, 1.0], 2), (3, [0.5, 1.0], 2)]
    (row,) = mined(spark, rows)
    assert row == (0, 1, 1, 3, limit * 256 + 256 * 256, limit * 128 + 256 * 256)


@pytest.mark.parametrize("wide", [0.2, 5.0])
def test_bounds_hold_every_score_and_rule_most_out(wide):
    r = np.random.default_rng(4)
    v = negatives.integers(r.normal(0, wide, (3000, 16)))
    v[:5] *= 50  # in the outermost cells
    described = np.stack([v.min(axis=0), v.max(axis=0), v.mean(axis=0), v.std(axis=0)])
    cells = negatives.Cells(described)
    codes = cells.of(v.astype(np.int64))
    low, high = (negatives.bounds(codes.T.astype(np.intp), t).astype(np.int64) for t in cells.tables(v[:40]))
    exact = v.astype(np.int64) @ v[:40].T.astype(np.int64)
    assert (low <= exact).all() and (exact <= high).all()
    tenth = negatives._largest(low, 10)
    assert ((high >= tenth).sum(axis=0) < 200).all()


def test_best_keeps_smaller_ids_of_equal_scores():
    best = negatives.Best(2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 3, 4]))
    assert best.least(np.full(2, -100)).tolist() == [5, -100]
    best.add(np.array([0]), np.array([5]), np.array([1]))
    assert best.rows.tolist() == [[0, -5, 1], [0, -5, 3], [1, -1, 4]]
