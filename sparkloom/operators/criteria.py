"""Criteria of a cut: onsets, rhythm, what happens near cuts and inside intervals, gates and total scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import micros, overlaps, seconds, thin

# The total of a video that violates a gate, and of one without any part.
GATE_CAP, EMPTY_TOTAL = 40.0, 50.0


def onsets(series: DataFrame, key: str, at: str, value: str, rise: float, back_s: tuple[float, float], apart_s: float) -> DataFrame:
    """key, kept: times at which a value is ``rise`` over the least one from ``back_s[0]`` to ``back_s[1]`` before,
    ``apart_s`` or more after the onset before."""
    frame = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(-seconds(back_s[0]), -seconds(back_s[1]))
    risen = series.withColumn("__low", F.min(value).over(frame)).where(F.col(value) - F.col("__low") >= rise)
    return thin(risen, key, at, apart_s)


def rhythm(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """key, n, middle, spread, trend: steps between events: their median, their deviation as a share of the mean (of all),
    and the median of the second half as a share of the first's."""
    order = Window.partitionBy(key).orderBy(at, tie)
    steps = events.withColumn("__step", (F.lead(micros(at)).over(order) - micros(at)) / 1e6).where("__step is not null")
    steps = steps.withColumn("__half", F.ntile(2).over(order))
    s = steps.groupBy(key).agg(
        F.count("*").alias("n"), F.median("__step").alias("middle"), F.try_divide(F.stddev_pop("__step"), F.avg("__step")).alias("spread"),
        F.try_divide(F.median(F.when(F.col("__half") == 2, F.col("__step"))), F.median(F.when(F.col("__half") == 1, F.col("__step")))).alias("trend"),
    )
    return s


def around(series: DataFrame, cut: Column, key: str, at: str, tie: str, value: str, frames: int) -> DataFrame:
    """Rows at a cut with the means of the ``frames`` values before and after them."""
    order = Window.partitionBy(key).orderBy(at, tie)
    both = series.withColumn("before", F.avg(value).over(order.rowsBetween(-frames, -1))).withColumn("after", F.avg(value).over(order.rowsBetween(1, frames)))
    return both.where(cut)


def away_from(series: DataFrame, cut: Column, key: str, at: str, near_s: float) -> DataFrame:
    """Rows that have no cut of their key within ``near_s``, by a range frame instead of a join."""
    frame = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(-seconds(near_s), seconds(near_s))
    return series.withColumn("__cuts", F.max(cut.cast("int")).over(frame)).where("__cuts = 0").drop("__cuts")


def normalised(series: DataFrame, cut: Column, key: str, at: str, value: str, near_s: float, out: str) -> DataFrame:
    """Rows with their value divided by the median of the key's rows away from cuts; null where that is 0 or missing."""
    quiet = away_from(series, cut, key, at, near_s).groupBy(key).agg(F.median(value).alias("__middle"))
    return series.join(quiet, key, "left").withColumn(out, F.try_divide(F.col(value), F.col("__middle"))).drop("__middle")


def impulses(series: DataFrame, cut: Column, key: str, at: str, tie: str, value: str, least: float, near_s: float, apart_s: float) -> DataFrame:
    """key, kept: steps of ``least`` or more from one row to the next, away from cuts, thinned."""
    order = Window.partitionBy(key).orderBy(at, tie)
    jumped = series.withColumn("__jump", F.abs(F.col(value) - F.lag(value).over(order)))
    return thin(away_from(jumped, cut, key, at, near_s).where(F.col("__jump") >= least), key, at, apart_s)


def inside_median(series: DataFrame, spans: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, inside, n: the median over a key's rows that lie in one of its spans(key, start, end)."""
    points = series.withColumns({"start": F.col(at), "end": F.col(at)})
    hit = overlaps(points, spans.select(key, F.col("start").alias("p_start"), F.col("end").alias("p_end")), key)
    return hit.groupBy(key).agg(F.median(value).alias("inside"), F.count("*").alias("n"))


def cooling(shown: DataFrame, family: str, item: str, at: str, within_s: float, last: int, most: int) -> DataFrame:
    """item, recent, blocked: how many families within ``within_s`` of the newest showed it, and whether it was shown
    more than ``most`` times in the ``last`` newest families."""
    newest = shown.agg(F.max(micros(at))).first()[0]
    families = shown.groupBy(family).agg(F.max(micros(at)).alias("us"))
    top = families.orderBy(F.desc("us"), family).limit(last).select(family, F.lit(True).alias("late"))
    each = shown.select(family, item).distinct().join(families, family).join(top, family, "left")
    counts = each.groupBy(item).agg(F.count_if(F.lit(newest) - F.col("us") <= seconds(within_s)).alias("recent"), F.count_if("late").alias("late"))
    return counts.select(item, "recent", (F.col("late") > most).alias("blocked"))


def first_gate(gates: dict[str, Column]) -> Column:
    """The name of the first gate that is violated (false); null is not measurable and never a violation."""
    failed = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), ok.alias("ok")) for n, ok in gates.items()]), lambda g: ~g["ok"])
    return F.get(failed, F.lit(0))["name"]


def total(parts: dict[str, tuple[float, Column]], violated: Column) -> Column:
    """0 to 100 by the weights of the parts (0 to 1) that are there; EMPTY_TOTAL without any, GATE_CAP at most if violated."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w, c in parts.values():
        top, bottom = top + F.coalesce(c * w, F.lit(0.0)), bottom + F.when(c.isNull(), 0.0).otherwise(w)
    out = F.when(bottom > 0, 100.0 * top / bottom).otherwise(EMPTY_TOTAL)
    return F.when(violated, F.least(out, F.lit(GATE_CAP))).otherwise(out)


def losses(parts: dict[str, tuple[float, Column]], n: int) -> Column:
    """Names of the ``n`` parts that cost most (weight times what is missing to 1), dearest first."""
    all_ = F.array(*[F.struct((-(1.0 - c) * w).alias("minus"), F.lit(name).alias("name")) for name, (w, c) in parts.items()])
    known = F.filter(all_, lambda x: x["minus"] < 0)
    return F.transform(F.slice(F.array_sort(known), 1, n), lambda x: x["name"])


def level(points: Column, thresholds: list[float]) -> Column:
    """How many thresholds are reached."""
    out = F.lit(0)
    for t in thresholds:
        out = out + F.coalesce((points >= t).cast("int"), F.lit(0))
    return out


def best_mood(scores: dict[str, Column]) -> Column:
    """struct<name, margin>: the highest score and its lead over the next; the first named among equals."""
    all_ = F.array_sort(F.array(*[F.struct((-c).alias("minus"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(scores.items())]))
    return F.struct(all_[0]["name"].alias("name"), (all_[1]["minus"] - all_[0]["minus"]).alias("margin"))
