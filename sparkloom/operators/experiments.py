"""Which setting to try next: the one whose best two options are hardest to tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What an option without examples loses, how near an example has to be, and how often something is tried.
UNTRIED, NEAR, EVERY = 0.06, 0.22, 7


def supported(options: DataFrame, examples: DataFrame, knob: str, value: str, weight: str, near: float = NEAR) -> DataFrame:
    """``options(knob, value, ...)`` with support: the weights of the ``examples(knob, value, weight)``, less the further off they are.

    Examples are summed up by value first, so their number doesn't multiply with that of the options. A null value is no
    example, and an option without one has no support.
    """
    sums = examples.where(F.col(value).isNotNull()).groupBy(F.col(knob).alias("__k"), F.col(value).cast("double").alias("__x")).agg(F.sum(weight).alias("__w"))
    names = options.select(knob, value).distinct()
    near_ = F.exp(-0.5 * F.pow((F.col("__x") - F.col(value)) / near, F.lit(2.0)))
    told = names.join(sums, F.col(knob) == F.col("__k")).groupBy(knob, value).agg(F.sum(F.col("__w") * near_).alias("support"))
    return options.join(told, [knob, value], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def judged(options: DataFrame, knob: str, place: str, expected: str) -> DataFrame:
    """``options(knob, place, expected, support)`` with use, rank (1 is best) and certainty, the distance of a knob's best two; 1 for a lone one.

    An option's use is what is expected of it, less UNTRIED shared by one more than its support. Of equal uses the later place is
    better.
    """
    rated = options.withColumn("use", F.col(expected) - UNTRIED / (1 + F.col("support")))
    order = Window.partitionBy(knob).orderBy(F.col("use").desc(), F.col(place).desc())
    rated = rated.withColumn("rank", F.row_number().over(order))
    whole = Window.partitionBy(knob)
    first, second = (F.max(F.when(F.col("rank") == k, F.col("use"))).over(whole) for k in (1, 2))
    return rated.withColumn("certainty", F.when(second.isNull(), 1.0).otherwise(F.abs(first - second)))


def next_experiment(rated: DataFrame, current: DataFrame, steps: DataFrame, knob: str, place: str, value: str, every: int = EVERY) -> DataFrame:
    """step, knob, value for every ``every``-th of ``steps(step)``, counted from 0: the least certain knob, in turn each option but its current one.

    ``current(knob, value)`` is what is in use. Of equally certain knobs the first by name is tried; one without another
    option isn't.
    """
    others = rated.join(current.select(F.col(knob), F.col(value).alias("__now")), knob, "left").where(~F.col(value).eqNullSafe(F.col("__now")))
    open_ = others.groupBy(knob).agg(F.first("certainty").alias("__c"), F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias("__others"))  # a knob's options
    least = open_.orderBy("__c", knob).limit(1)
    due = steps.where((F.col("step") + 1) % every == 0)
    which = F.pmod(F.floor(F.col("step") / every), F.size("__others")).cast("int") + 1
    return due.crossJoin(F.broadcast(least)).select("step", knob, F.element_at("__others", which).alias(value))  # one row
