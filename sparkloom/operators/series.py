"""Series of numbers: greedy suppression, runs, rises, ranks, exposures and counts of votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import by_stretch, micros, seconds


def strongest_first(rows: DataFrame, key: str, at: str, strength: str, apart_s: float) -> DataFrame:
    """key, kept (microseconds), strength: the strongest of each key first, leaving out what is nearer than ``apart_s``
    to one that is kept; of equal strength the earlier goes first, a null strength last. Events on both sides of a step of
    ``apart_s`` don't touch each other, so each stretch between such steps is chosen from on its own; a kept event rules out
    its neighbours, each of which at most two kept ones reach."""
    step = seconds(apart_s)
    strong = F.col(strength).cast("double")

    def fold(part, starts) -> list[int]:
        us, v = part["us"].to_numpy(), part["v"].to_numpy()  # a null is NaN
        stretch = np.zeros(len(us), dtype=np.int64)
        stretch[starts] = 1
        order = np.lexsort((us, np.where(np.isnan(v), np.inf, -v), np.cumsum(stretch)))
        times, first, end = us.tolist(), set(starts.tolist()), {*starts.tolist(), len(us)}
        open_, kept = [True] * len(times), []
        for i in order.tolist():
            if open_[i]:
                kept.append(i)
                t, j = times[i], i
                while j not in first and t - times[j - 1] < step:
                    j -= 1
                    open_[j] = False
                j = i + 1
                while j not in end and times[j] - t < step:
                    open_[j] = False
                    j += 1
        return kept

    return by_stretch(rows, key, at, apart_s, {"v": F.when(~F.isnan(strong), strong)}, {"kept": "us", "strength": "v"}, fold)


def unlike_last_kept(rows: DataFrame, key: str, at: str, what: str, within_s: float, tie: str) -> DataFrame:
    """key, kept (ids): events without those that say the same as the last kept one less than ``within_s`` after it.

    After a step of ``within_s`` an event is kept whatever came before: each stretch between such steps is a fold, whose
    state is the last kept event. Events of the same time are taken in order of ``tie``."""
    step = seconds(within_s)

    def fold(part, starts) -> list[int]:
        begins, kept, due, said = set(starts.tolist()), [], 0, None
        for i, (us, h) in enumerate(zip(part["us"].to_pylist(), part["h"].to_pylist(), strict=True)):
            if i in begins or us >= due or h != said:
                kept.append(i)
                due, said = us + step, h
        return kept

    # What is said is compared by its JSON, so it may be of any type, and null equals null.
    said = F.to_json(F.struct(F.col(what).alias("w")))
    return by_stretch(rows, key, at, within_s, {"id": F.col(tie), "h": said}, {"kept": "id"}, fold, ("id",))


def floor_level(rows: DataFrame, key: str, value: str, share: float, out: str) -> DataFrame:
    """key, ``out``: of each key's n values in order the one at place floor(n * share) from 0, the last one at most. Nulls are left out."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__v"))
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__v")) - 1
    n = F.count("*").over(Window.partitionBy("__key"))
    ranked = known.withColumn("__i", place).withColumn("__at", F.least(n - 1, F.floor(n * share)))
    return ranked.where("__i = __at").select(F.col("__key").alias(key), F.col("__v").alias(out))


def percent_below(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds the share of the key's other values that are below each; 0.5 for a lone one."""
    w = Window.partitionBy(key).orderBy(value)
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn(out, F.when(n <= 1, 0.5).otherwise(F.percent_rank().over(w)))


def steepest_rise(rows: DataFrame, key: str, at: str, tie: str, value: str, before: int, after: int) -> DataFrame:
    """key, id, rise: where the mean of the next ``after`` values (itself first) exceeds that of the ``before`` ones most."""
    order = Window.partitionBy(key).orderBy(at, tie)
    back, ahead = order.rowsBetween(-before, -1), order.rowsBetween(0, after - 1)
    full = (F.count("*").over(back) == before) & (F.count("*").over(ahead) == after)
    rise = rows.withColumn("rise", F.when(full, F.round(F.avg(value).over(ahead) - F.avg(value).over(back), 9))).where("rise is not null")
    rise = rise.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rise"), at, tie)))
    return rise.where("place = 1").select(key, F.col(tie).alias("id"), "rise")


def longest_run(rows: DataFrame, key: str, at: str, tie: str, what: Column) -> DataFrame:
    """key, longest: the most neighbours in a row for which ``what`` holds, 0 for none."""
    order = Window.partitionBy(key).orderBy(at, tie)
    runs = rows.withColumn("on", F.coalesce(what, F.lit(False)).cast("int")).withColumn("off", F.sum(1 - F.col("on")).over(order))
    lengths = runs.groupBy(key, "off").agg(F.sum("on").alias("n"))
    return lengths.groupBy(key).agg(F.max("n").alias("longest"))


def floor_quantile(values: Column, q: float) -> Column:
    """The element at the floor of q * n of a sorted array (from 0), the last one at most."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), (F.least(n - 1, F.floor(n * q)) + 1).cast("int"))


def idle_share(events: DataFrame, key: str, at: str, begin: Column, end: Column, step_s: float, near_s: float) -> DataFrame:
    """key, idle: share of a raster's points that have no event within ``near_s``; events are dealt to raster points.

    A key whose events meet no point is idle throughout. Events without a key are left out."""
    events = events.where(F.col(key).isNotNull())
    step, near = seconds(step_s), seconds(near_s)
    b, e = micros(begin), micros(end)
    us = micros(at)
    first, last = F.ceil((us - near - b) / step), F.floor((us + near - b) / step)
    total = F.floor((e - b) / step) + 1
    hit = events.select(key, F.greatest(first, F.lit(0)).alias("i"), F.least(last, total - 1).alias("j"), total.alias("total"))
    hit = hit.where("i <= j").select(key, "total", F.explode(F.sequence("i", "j")).alias("point")).distinct()
    met = hit.groupBy(key).agg((1 - F.count("*") / F.first("total")).alias("idle"))
    return events.select(key).distinct().join(met, key, "left").select(key, F.coalesce("idle", F.lit(1.0)).alias("idle"))


def exposure(shown: DataFrame, item: str, draft: str, age: Column, amount: Column, half: float = 0.5) -> DataFrame:
    """item, exposure (1 at most), times: each draft that showed an item counts once, halved for each draft since."""
    once = shown.select(item, draft, (amount * F.pow(F.lit(half), age)).alias("x")).dropDuplicates([item, draft])
    return once.groupBy(item).agg(F.least(F.lit(1.0), F.sum("x")).alias("exposure"), F.count("*").alias("times"))


def newest_block(rows: DataFrame, key: str, start: str, end: str, gap_s: float) -> DataFrame:
    """The rows of each key's newest block: a new one begins where a start is over ``gap_s`` after the row before's own end."""
    order = Window.partitionBy(key).orderBy(start, end)
    apart = micros(start) - F.lag(micros(end)).over(order) > seconds(gap_s)
    block = rows.withColumn("block", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    return block.withColumn("newest", F.max("block").over(Window.partitionBy(key))).where("block = newest").drop("block", "newest")


def shrunk(mean: Column, n: Column, prior: float, strength: float = 8.0) -> Column:
    """A mean pulled towards ``prior``, as if it had ``strength`` more values there."""
    return (mean * n + prior * strength) / (n + strength)


def feature_means(pairs: DataFrame, better: str, worse: str, weight: str) -> DataFrame:
    """name, mean, n: weighted mean difference of each feature that both sides of a pair have."""
    both = F.map_filter(F.map_zip_with(better, worse, lambda k, x, y: x - y), lambda k, v: v.isNotNull())
    each = pairs.select(weight, F.explode(both).alias("name", "difference"))
    return each.groupBy("name").agg((F.sum(F.col(weight) * F.col("difference")) / F.sum(weight)).alias("mean"), F.count("*").alias("n"))


def kernel_support(rows: DataFrame, key: str, x: str, weight: Column, at: float, width: float) -> DataFrame:
    """key, support: sum of weights by a Gaussian of each row's distance from ``at``."""
    d = (F.col(x) - at) / width
    return rows.groupBy(key).agg(F.sum(weight * F.exp(-0.5 * d * d)).alias("support"))


def flashes(rows: DataFrame, key: str, at: str, tie: str, value: str, hysteresis: float) -> DataFrame:
    """key, turns: how often a series turns by more than ``hysteresis`` from its last extremum, as a fold."""
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(micros(at).alias("us"), F.col(tie).alias("id"), F.col(value).cast("double").alias("v")))).alias("all"))
    start = F.struct(F.lit(None).cast("double").alias("extreme"), F.lit(0).alias("way"), F.lit(0).alias("turns"))

    def step(s: Column, x: Column) -> Column:
        v, d = x["v"], x["v"] - s["extreme"]
        further = F.struct(v.alias("extreme"), s["way"].alias("way"), s["turns"].alias("turns"))
        turned = lambda way: F.struct(v.alias("extreme"), F.lit(way).alias("way"), (s["turns"] + 1).alias("turns"))
        return (
            F.when(s["extreme"].isNull(), F.struct(v.alias("extreme"), F.lit(0).alias("way"), F.lit(0).alias("turns")))
            .when((s["way"] >= 0) & (d < -hysteresis), turned(-1)).when((s["way"] <= 0) & (d > hysteresis), turned(1))
            .when(((s["way"] > 0) & (d > 0)) | ((s["way"] < 0) & (d < 0)), further).otherwise(s)
        )

    return ordered.select(key, F.aggregate("all", start, step, lambda s: s["turns"]).alias("turns"))
