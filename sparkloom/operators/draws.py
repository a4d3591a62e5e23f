"""Seeded draws and choices by Thompson sampling.

A draw is a function of a name alone (seed, step, arm), by a hash as a counter, so it is the same on any partitioning, in any
order and on every rerun, and needs no generator that is handed on from row to row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tries of the rejection method, each of which fails in one of 20 cases at most.
ATTEMPTS = 16


def _digits(name: Column) -> Column:
    return F.sha2(name.cast("binary"), 256)


def _number(digits: Column, k: int) -> Column:
    """The k-th number in (0, 1) of a hash, 52 bits."""
    return (F.conv(F.substring(digits, 1 + 13 * k, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform(name: Column) -> Column:
    return _number(_digits(name), 0)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _standard_gamma(name: Column, shape: Column) -> Column:
    """A draw of the gamma distribution of a shape of 1 or more: a cubed normal, taken or left (Marsaglia and Tsang)."""
    d = shape - 1.0 / 3.0

    def tried(k: Column) -> Column:
        """The k-th try: a value, or null if it is not taken."""

        def of(h: Column) -> Column:
            x = F.sqrt(-2 * F.log(_number(h, 0))) * F.cos(2 * math.pi * _number(h, 1))
            return F.struct(x.alias("x"), F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0)).alias("v"), _number(h, 2).alias("u"))

        def taken(t: Column) -> Column:
            good = (t["v"] > 0) & (F.log(t["u"]) < t["x"] * t["x"] / 2 + d - d * t["v"] + d * F.log(F.when(t["v"] > 0, t["v"]).otherwise(1.0)))
            return F.when(good, t["v"])

        return _let(_let(_digits(F.concat(name, F.lit("#"), k.cast("string"))), of), taken)

    # One try in 20 at most is followed by another, so none is made before the one before has failed.
    found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), lambda v, k: F.when(v.isNotNull(), v).otherwise(tried(k)))
    return d * F.coalesce(found, F.lit(1.0))


def gamma_draw(name: Column, shape: Column) -> Column:
    """A draw of the gamma distribution of any positive shape, for a name; null for another shape."""
    small = shape < 1
    drawn = _standard_gamma(name, F.when(small, shape + 1).otherwise(shape))
    low = F.pow(uniform(F.concat(name, F.lit("#small"))), 1 / shape)
    return F.when(shape > 0, F.when(small, drawn * low).otherwise(drawn))


def beta_draw(name: Column, a: Column, b: Column) -> Column:
    """A draw of the beta distribution for a name."""
    x, y = gamma_draw(F.concat(name, F.lit("/a")), a), gamma_draw(F.concat(name, F.lit("/b")), b)
    return x / (x + y)


def drawn(arms: DataFrame, keys: list[str], arm: str, hits: Column, tries: Column, seed: str, prior: tuple[Column, Column] | None = None) -> DataFrame:
    """``arms`` with draw and place (1 is best): a beta draw for each arm of the ``keys``, by hits of tries and a prior (1, 1).

    Fractions of hits count. Keys and arm make the name, so a step that is among the keys has draws of its own. Of equal draws
    the later arm by name is first. Hits beyond the tries count as tries; null hits or tries as none.
    """
    a, b = prior or (F.lit(1.0), F.lit(1.0))
    n = F.greatest(F.coalesce(tries.cast("double"), F.lit(0.0)), F.lit(0.0))
    s = F.least(F.greatest(F.coalesce(hits.cast("double"), F.lit(0.0)), F.lit(0.0)), n)
    name = F.concat(F.lit(seed), *[F.concat(F.lit(":"), F.coalesce(F.col(k).cast("string"), F.lit("-"))) for k in (*keys, arm)])
    # Dealt by the keys first, as the places need it: draws cost more than rows, and a small file of steps is a single task.
    found = arms.repartition(*keys).withColumn("draw", beta_draw(name, a + s, b + n - s))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("draw").desc(), F.col(arm).desc())))


def never_thrice(found: DataFrame, keys: list[str], arm: str, last: str) -> DataFrame:
    """The best of ``drawn()`` for each of the ``keys`` that wouldn't be the same as both of the ``last`` two (an array), if there is another."""
    both = (F.size(last) >= 2) & (F.try_element_at(last, F.lit(-1)) == F.try_element_at(last, F.lit(-2))) & (F.try_element_at(last, F.lit(-1)) == F.col(arm))
    third = F.coalesce(both, F.lit(False))
    order = Window.partitionBy(*keys).orderBy(third.cast("int"), "place")
    return found.withColumn("__first", F.row_number().over(order)).where("__first = 1").drop("__first")


def daring(found: DataFrame, keys: list[str], knob: str, arm: str, tries: str, hits: str, seed: str, courage: float, steady: str | None = None, last: str | None = None) -> DataFrame:
    """keys, knob, arm, experiment: the best arm of each knob; in a share ``courage`` of the cases one knob gets its least tried other arm.

    ``found`` is drawn() over (keys, knob). Which knob, and which of equally little tried arms, is drawn too. The knob ``steady``
    never has an arm for a third time: it then takes the other arm with the best (hits + 1) / (tries + 2).
    """
    name = lambda what, *more: F.concat(F.lit(f"{seed}:{what}"), *[F.concat(F.lit(":"), F.coalesce(F.col(k).cast("string"), F.lit("-"))) for k in (*keys, *more)])
    case = Window.partitionBy(*keys)
    knobs = F.array_sort(F.collect_set(knob).over(case))
    pick = F.element_at("__knobs", (F.floor(uniform(name("knob")) * F.size("__knobs")) + 1).cast("int"))
    rows = found.withColumn("__knobs", knobs).withColumn("__dared", (uniform(name("dare")) < courage) & (F.col(knob) == pick))
    inside = Window.partitionBy(*keys, knob)
    more = F.max("place").over(inside) > 1
    rows = rows.withColumn("__try", F.row_number().over(inside.orderBy((F.col("place") == 1).cast("int"), tries, uniform(name("other", knob, arm)))))
    dared = F.col("__dared") & more
    rows = rows.withColumn("__won", F.when(dared, F.col("__try") == 1).otherwise(F.col("place") == 1)).withColumn("experiment", dared)
    if steady:
        third = (F.col(knob) == steady) & (F.size(last) >= 2) & (F.try_element_at(last, F.lit(-1)) == F.try_element_at(last, F.lit(-2))) & (F.try_element_at(last, F.lit(-1)) == F.col(arm))
        rows = rows.withColumn("__third", F.max(F.coalesce(third & F.col("__won"), F.lit(False)).cast("int")).over(inside) == 1)
        rate = (F.col(hits) + 1) / (F.col(tries) + 2)
        rows = rows.withColumn("__else", F.row_number().over(inside.orderBy(F.col("__won").cast("int"), rate.desc(), arm)))
        rows = rows.withColumn("__won", F.when(F.col("__third") & more, F.col("__else") == 1).otherwise(F.col("__won")))
    return rows.where("__won").select(*keys, knob, arm, "experiment")
