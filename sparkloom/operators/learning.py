"""Ratings from pairwise votes and small models fitted from distributed sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where ratings start, how fast deviations shrink, and K by duels before.
START, DEVIATION, SHRINK, LEAST_DEVIATION = 1500.0, 350.0, 0.94, 75.0
K_STEPS = ((10, 48.0), (25, 32.0))
K_LAST = 24.0
# Bounds of ridge coefficients and predictions, and the priors' strength.
COEFFICIENT_BOUND, SCORE_BOUND, PRIOR_BIAS, PRIOR = 0.65, 1.0, 1.0, 1.2


def k_factor(duels: Column) -> Column:
    out = F.lit(K_LAST)
    for below, k in reversed(K_STEPS):
        out = F.when(duels < below, k).otherwise(out)
    return out


def elo_step(a: tuple, b: tuple, result: str) -> tuple[tuple, tuple]:
    """(rating, deviation, duels) of both after a duel; ``result`` is a, b or s (skipped: only deviations shrink)."""
    if result not in ("a", "b", "s"):
        raise ValueError(f"unknown result {result!r}")
    out = []
    for (rating, deviation, duels), (other, _, _), won in ((a, b, "a"), (b, a, "b")):
        if result != "s":
            k = next((k for below, k in K_STEPS if duels < below), K_LAST)
            rating = round(rating + k * ((result == won) - 1.0 / (1.0 + 10 ** ((other - rating) / 400.0))), 2)
        out.append((rating, max(LEAST_DEVIATION, round(deviation * SHRINK, 2)), duels + 1))
    return out[0], out[1]


def elo(duels: DataFrame, pool: str, at: str, tie: str) -> DataFrame:
    """pool, item, rating, deviation, duels from ``duels(pool, at, tie, a, b, result)``, applied in the order of time.

    A duel changes two items and depends on all duels of both before, so a pool (items that only meet each other) is
    folded by one task; pools run in parallel.
    """
    kind = duels.schema["a"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        for r in rows.sort_values([at, tie]).itertuples(index=False):
            a, b = r.a, r.b
            state[a], state[b] = elo_step(state.get(a, (START, DEVIATION, 0)), state.get(b, (START, DEVIATION, 0)), r.result)
        items = sorted(state)
        return pd.DataFrame({pool: [rows[pool].iloc[0]] * len(items), "item": items, "rating": [state[i][0] for i in items], "deviation": [state[i][1] for i in items], "duels": [state[i][2] for i in items]})

    schema = f"`{pool}` {duels.schema[pool].dataType.simpleString()}, item {kind}, rating double, deviation double, duels long"
    return duels.select(pool, at, tie, "a", "b", "result").groupBy(pool).applyInPandas(fold, schema)


def leaderboard(ratings: DataFrame) -> DataFrame:
    """Adds ``standing``: rating less half the deviation."""
    return ratings.withColumn("standing", F.round(F.col("rating") - 0.5 * F.col("deviation"), 2))


def ridge(rows: DataFrame, names: list[str], y: Column, weight: Column) -> dict:
    """Weighted ridge regression with clipped coefficients: means, bias, weights by name.

    Missing features count as their mean. All sums come from two aggregations; len(names) + 1 squared numbers reach
    the driver.
    """
    first = rows.agg(*[F.avg(n).alias(n) for n in names]).first()
    means = {n: float(first[n] or 0.0) for n in names}
    terms = [F.lit(1.0), *[F.coalesce(F.col(n), F.lit(means[n])) - means[n] for n in names]]
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*[F.sum(weight * terms[i] * terms[j]) for i, j in pairs], *[F.sum(weight * y * t) for t in terms]).first()
    a = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums, strict=False):
        a[i, j] = a[j, i] = s or 0.0
    b = np.array([s or 0.0 for s in sums[len(pairs) :]])
    beta = np.clip(np.linalg.solve(a + np.diag([PRIOR_BIAS] + [PRIOR] * len(names)), b), -COEFFICIENT_BOUND, COEFFICIENT_BOUND)
    return {"means": means, "bias": float(beta[0]), "weights": dict(zip(names, map(float, beta[1:]), strict=True))}


def predict(model: dict) -> Column:
    """The model's bounded prediction as a column expression; missing features count as their mean."""
    out = F.lit(model["bias"])
    for n, w in model["weights"].items():
        out = out + w * (F.coalesce(F.col(n), F.lit(model["means"][n])) - model["means"][n])
    return F.greatest(F.lit(-SCORE_BOUND), F.least(F.lit(SCORE_BOUND), out))


def calibrate(rows: DataFrame, z: str, good: str, steps: int = 50, rate: float = 0.5, l2: float = 0.01) -> tuple[float, float]:
    """Slope and offset of sigmoid(slope * z + offset) for 0/1 verdicts, by gradient steps on the mean log loss.

    Each step is one aggregation over all rows; the slope alone is penalised.
    """
    from ..functions.scalars import logistic

    slope, offset = 1.0, 0.0
    rows = rows.select(z, good).where(F.col(z).isNotNull() & F.col(good).isNotNull())
    for _ in range(steps):
        error = logistic(F.lit(slope) * F.col(z) + offset) - F.col(good)
        g = rows.agg(F.avg(error * F.col(z)), F.avg(error)).first()
        if g[0] is None:
            return slope, offset
        slope, offset = slope - rate * (g[0] + l2 * slope), offset - rate * g[1]
    return slope, offset


def hit_rate(pairs: DataFrame, difference: Column, weight: Column) -> Column:
    """Weighted share of pairs whose better side scores higher; ties count half."""
    right = F.when(difference > 0, 1.0).when(difference == 0, 0.5).otherwise(0.0)
    return F.round(F.sum(weight * right) / F.sum(weight), 4)
