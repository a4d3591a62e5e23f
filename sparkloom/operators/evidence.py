"""Evidence from what was shown and judged: hit rates, repetition, supply, folds of votes, learners and promotion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logistic
from ..settled import settled
from .selection import numbered
from .timeline import micros, seconds

# From which probability an expectation is positive, the margin by which a challenger must be better, and
# the lead that a perceptron asks of the better item.
POSITIVE, PROMOTION_MARGIN, LEAD = 0.5, 0.002, 1.0


def hits_of_newest(judged: DataFrame, at: str, item: str, p: str, good: Column, last: int | None = None, where: Column | None = None) -> DataFrame:
    """hits, n: how many of the ``last`` newest judged expectations (then largest item first) were right; all without ``last``.

    An expectation is right if it is at least POSITIVE just when the verdict is good. ``where`` narrows to a band.
    """
    rows = judged.where(good.isNotNull() & F.col(p).isNotNull())
    rows = (rows if where is None else rows.where(where)).select(at, item, ((F.col(p) >= POSITIVE) == good).alias("hit"))
    newest = rows if last is None else rows.orderBy(F.desc(at), F.desc(item)).limit(last)
    return newest.agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def repetition(shown: DataFrame, family: str, item: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(families, places, different), and the ``most`` commonest items; an item counts once in a family."""
    places = shown.where(F.col(item).isNotNull()).select(family, item).distinct()
    top = places.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(most)
    return places.agg(F.countDistinct(family).alias("families"), F.count("*").alias("places"), F.countDistinct(item).alias("different")), top


def last_shown(shown: DataFrame, family: str, item: str, at: str) -> DataFrame:
    """item, age: how many families are newer than the newest one that shows the item (0: the newest of all).

    Families are numbered by parts, so no task sees all of them.
    """
    families = shown.groupBy(family).agg(F.max(micros(at)).alias("us")).select(family, F.struct((-F.col("us")).alias("us"), F.col(family).alias("f")).alias("by"))
    ages = numbered(families, "by", "age").select(family, "age")
    return shown.select(family, item).distinct().join(ages, family).groupBy(item).agg(F.min("age").alias("age"))


def supply(rows: DataFrame, key: str, item: str, length: str, fresh: Column) -> DataFrame:
    """key, supply: all fresh lengths, and the longest of the others, as many as there are fresh ones."""
    both = rows.select(key, item, length, fresh.alias("fresh"))
    n = both.groupBy(key).agg(F.count_if("fresh").alias("n"), F.sum(F.when(F.col("fresh"), F.col(length)).otherwise(0)).alias("own"))
    late = both.where("not fresh").withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(length), item)))
    extra = late.join(n, key).where("i <= n").groupBy(key).agg(F.sum(length).alias("extra"))
    return n.join(extra, key, "left").select(key, (F.col("own") + F.coalesce("extra", F.lit(0))).alias("supply"))


#: Seconds of votes that are folded as one array.
FOLD_S = 30 * 86_400.0


def folded(votes: DataFrame, key: str, at: str, tie: str, step: Column, start: float, low: float, high: float, piece_s: float = FOLD_S) -> DataFrame:
    """key, factor: ``start`` multiplied by each vote's step in the order of time, held inside [low, high] after each.

    A held multiplication is a map x -> min(top, max(bottom, times * x)), and such maps make one together. So the votes of each
    ``piece_s`` are folded to one map on their own, and a key's maps, one for each piece, to its factor. Steps are positive; a null
    step changes nothing, votes without a time come first.
    """
    bounds = F.lit(float(low)), F.lit(float(high))
    us = F.coalesce(micros(at), F.lit(-(1 << 62)))
    one = F.struct(us.alias("at"), F.col(tie).alias("tie"), F.coalesce(step.cast("double"), F.lit(1.0)).alias("step"))
    pieces = votes.select(key, F.floor(us / seconds(piece_s)).alias("__piece"), one.alias("__one")).groupBy(key, "__piece").agg(F.array_sort(F.collect_list("__one")).alias("all"))
    held = lambda x, bottom, top: F.greatest(bottom, F.least(top, x))

    def then(f: Column, times: Column, bottom: Column, top: Column) -> Column:
        return F.struct((f["times"] * times).alias("times"), held(f["bottom"] * times, bottom, top).alias("bottom"), held(f["top"] * times, bottom, top).alias("top"))

    nothing = F.struct(F.lit(1.0).alias("times"), F.lit(float("-inf")).alias("bottom"), F.lit(float("inf")).alias("top"))
    maps = pieces.select(key, "__piece", F.aggregate("all", nothing, lambda f, x: then(f, x["step"], *bounds)).alias("f"))
    ordered = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__piece", "f"))).alias("maps"))  # a map for each piece
    value = F.aggregate("maps", F.lit(float(start)), lambda x, m: held(x * m["f"]["times"], m["f"]["bottom"], m["f"]["top"]))
    return ordered.select(key, value.alias("factor"))


def leash(start: float, share: float, least: float) -> float:
    """How far a weight may move from ``start``: a share of it, ``least`` at least, and never across 0."""
    width = max(least, abs(start) * share)
    return min(width, abs(start)) if start else width


def perceptron(pairs: DataFrame, pool: str, order: str, names: list[str], weight: str, start: dict[str, float], step: float, epochs: int, share: float, least: float) -> DataFrame:
    """pool, name, weight: for each pool, weights moved by every pair whose better item does not lead by LEAD.

    ``names`` are columns with the difference (better less worse); null is not comparable and moves nothing. Each move
    depends on all before it, so a pool is folded by one task; pools run in parallel.
    """
    first = [start.get(n, 0.0) for n in names]
    bounds = [(s - leash(s, share, least), s + leash(s, share, least)) for s in first]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        d, g = np.nan_to_num(rows[names].to_numpy(float)).tolist(), rows[weight].tolist()
        w = list(first)
        for _ in range(epochs):
            for x, much in zip(d, g, strict=True):
                # In the order of the names, each product rounded: leads that are LEAD but for the last bit are many.
                lead = 0.0
                for a, b in zip(x, w, strict=True):
                    lead += a * b
                if lead < LEAD:
                    w = [max(low, min(high, b + step * much * a)) if a else b for a, b, (low, high) in zip(x, w, bounds, strict=True)]
        return pd.DataFrame({pool: [rows[pool].iloc[0]] * len(names), "name": names, "weight": np.round(w, 4)})

    return pairs.select(pool, order, weight, *names).groupBy(pool).applyInPandas(fold, f"`{pool}` {pairs.schema[pool].dataType.simpleString()}, name string, weight double")


def pair_factors(pairs: DataFrame, weights: dict[str, float], worth: str, low: float, high: float, beta: float, l2: float, rate: float, steps: int) -> dict[str, float]:
    """ln factors of the parts' weights, by gradient steps on the pairwise logistic loss, held in [ln low, ln high].

    Columns a_<part> and b_<part> have the better and the worse side's part scores; a part counts in a pair if both
    have it. Each step is one aggregation over all pairs; one number for each part reaches the driver.
    """
    names = list(weights)
    # Written once: each step reads the pairs, and would else make them from their sources again.
    rows = settled(pairs.select(worth, *[f"{s}_{n}" for n in names for s in "ab"]).where(F.col(worth) > 0))
    mass = rows.agg(F.sum(worth)).first()[0]
    u = dict.fromkeys(names, 0.0)
    if not mass:
        return u
    eta = rate / max(1.0, mass / 20.0)
    for _ in range(steps):
        force = {n: F.when(F.col(f"a_{n}").isNotNull() & F.col(f"b_{n}").isNotNull(), weights[n] * float(np.exp(u[n]))).otherwise(0.0) for n in names}
        gap = {n: F.coalesce(F.col(f"a_{n}") - F.col(f"b_{n}"), F.lit(0.0)) for n in names}
        whole = sum(force.values(), F.lit(0.0))
        base = rows.withColumn("whole", whole).where("whole > 0").withColumn("lead", sum((force[n] * gap[n] for n in names), F.lit(0.0)) / F.col("whole"))
        push = F.col(worth) * -beta * logistic(-beta * F.col("lead")) / F.col("whole")
        g = base.agg(*[F.sum(push * force[n] * (gap[n] - F.col("lead"))) for n in names]).first()
        u = {n: float(np.clip(u[n] - eta * (2 * l2 * u[n] + (g[i] or 0.0)), np.log(low), np.log(high))) for i, n in enumerate(names)}
    return u


def promotion(holdout: DataFrame, seen: DataFrame, group: str, y: Column, weight: Column, challenger: Column, champion: Column) -> DataFrame:
    """challenger_mse, champion_mse, n, promote: weighted errors over groups that the champion never saw; a challenger
    must be better by more than PROMOTION_MARGIN."""
    fresh = holdout.join(seen.select(group).distinct(), group, "left_anti")
    errors = [(F.sum(weight * (y - p) * (y - p)) / F.sum(weight)) for p in (challenger, champion)]
    out = fresh.agg(errors[0].alias("challenger_mse"), errors[1].alias("champion_mse"), F.count("*").alias("n"))
    return out.withColumn("promote", F.coalesce(F.col("challenger_mse") + PROMOTION_MARGIN < F.col("champion_mse"), F.lit(False)))
