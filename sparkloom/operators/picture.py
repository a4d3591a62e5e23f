"""What a cut list and a measured series say about each other: planned cuts, light, dose of effects, time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import merge_windows, micros, overlaps, seconds

# How bright a segment's median may be, and how far it may be from the segment before.
LIGHT, LIGHT_STEP = (60.0, 170.0), 25.0


def matched_cuts(planned: DataFrame, measured: DataFrame, key: str, at: str, near_s: float) -> DataFrame:
    """key, at_us, from_plan: one row for each planned cut at its nearest measured time within ``near_s`` (earlier one
    of two), unless fewer than half of the key's planned cuts have one: then all stay as planned. Measured times that
    no planned cut is near follow with from_plan false.

    Nearest times come from the last and the next measurement of the key in order of time, without a join.
    """
    both = planned.select(key, micros(at).alias("us"), F.lit(True).alias("plan")).unionByName(measured.select(key, micros(at).alias("us"), F.lit(False).alias("plan")))
    order = Window.partitionBy(key).orderBy("us").rangeBetween

    def side(plan: bool):
        x = F.when(F.col("plan") == plan, F.col("us"))
        return F.max(x).over(order(Window.unboundedPreceding, 0)), F.min(x).over(order(0, Window.unboundedFollowing))

    def nearest(plan: bool):
        before, after = side(plan)
        return F.when(after.isNull() | (F.col("us") - before <= after - F.col("us")), before).otherwise(after)

    near = both.withColumn("other", F.when(F.col("plan"), nearest(False)).otherwise(nearest(True)))
    near = near.withColumn("hit", F.coalesce(F.abs(F.col("us") - F.col("other")) <= seconds(near_s), F.lit(False)))
    share = F.avg(F.when(F.col("plan"), F.col("hit").cast("double"))).over(Window.partitionBy(key))
    near = near.withColumn("share", share).where("plan or not hit")
    return near.select(key, F.when(F.col("plan") & F.col("hit") & (F.col("share") >= 0.5), F.col("other")).otherwise(F.col("us")).alias("at_us"), F.col("plan").alias("from_plan"))


def weighted_share(length: Column, share: Column) -> Column:
    """Aggregate: the share weighted by length (negative lengths count 0); null shares are left out, 0 without length."""
    long = F.greatest(F.lit(0.0), length)
    return F.coalesce(F.try_divide(F.sum(long * share), F.sum(F.when(share.isNotNull(), long))), F.lit(0.0))


def steady_light(frames: DataFrame, key: str, segment: str, value: str, skip: Column) -> DataFrame:
    """key, light: share of a key's segments whose median value (without skipped frames) lies in LIGHT and at most
    LIGHT_STEP from the segment before; segments without frames are passed over."""
    middles = frames.where(~skip & F.col(value).isNotNull()).groupBy(key, segment).agg(F.median(value).alias("middle"))
    before = F.lag("middle").over(Window.partitionBy(key).orderBy(segment))
    good = F.col("middle").between(*LIGHT) & (F.col("before").isNull() | (F.abs(F.col("middle") - F.col("before")) <= LIGHT_STEP))
    return middles.withColumn("before", before).groupBy(key).agg(F.avg(good.cast("double")).alias("light"))


def effect_dose(impulses: DataFrame, causes: DataFrame, lengths: DataFrame, key: str, at: str, near: float) -> DataFrame:
    """key, inside, n, contrast, dose: impulses inside the merged neighbourhoods (``near`` at each side, cut to the
    length) of causes, all impulses, the density inside over that outside (0.05 at least), and impulses by 10 seconds.

    ``at`` and length are numbers of seconds. Keys without causes have no contrast.
    """
    spans = causes.join(lengths, key).select(key, F.greatest(F.lit(0.0), F.col(at) - near).alias("start"), F.least(F.col("length"), F.col(at) + near).alias("end"))
    merged = merge_windows(spans, key, "start", "end").select(key, "start", "end")
    time = merged.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("time"))
    points = impulses.select(key, F.col(at).alias("start"), F.col(at).alias("end"))
    hit = overlaps(points, merged.select(key, F.col("start").alias("p_start"), F.col("end").alias("p_end")), key)  # one ordered pass
    inside = hit.groupBy(key).agg(F.count("*").alias("inside"))
    n = impulses.groupBy(key).agg(F.count("*").alias("n"))
    out = lengths.select(key, "length").join(n, key, "left").join(inside, key, "left").join(time, key, "left")
    out = out.fillna(0, ["n", "inside"])
    least = F.lit(1e-6)
    outside = F.greatest((F.col("n") - F.col("inside")) / F.greatest(least, F.col("length") - F.col("time")), F.lit(0.05))
    contrast = F.when(F.col("time").isNotNull() & (F.col("length") > 0), F.col("inside") / F.greatest(F.col("time"), least) / outside)
    return out.select(key, "inside", "n", contrast.alias("contrast"), F.when(F.col("length") > 0, F.col("n") / F.col("length") * 10).alias("dose"))


def same_in_row(effects: DataFrame, key: str, at: str, tie: str, kind: str) -> DataFrame:
    """key, repeats: how often an effect follows one of the same kind directly."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(at, tie))
    return effects.withColumn("__same", F.col(kind) == before).groupBy(key).agg(F.count_if("__same").alias("repeats"))


def to_timeline(t: Column, start: Column, source_start: Column, windows: Column) -> Column:
    """The place in the video of source second ``t``: each of ``windows`` (array<struct<from, to, speed>>) stretches what
    lies inside it by 1 / speed."""
    extra = F.aggregate(windows, F.lit(0.0), lambda s, w: s + F.greatest(F.lit(0.0), F.least(t, w["to"]) - w["from"]) * (1.0 / w["speed"] - 1.0))
    return start + (t - source_start) + extra


def to_source(t: Column, start: Column, source_start: Column, windows: Column) -> Column:
    """Turns to_timeline() around; windows are in order and do not overlap."""
    state = F.struct((t - start).alias("rest"), source_start.cast("double").alias("at"), F.lit(None).cast("double").alias("found"))

    def walk(s, w):
        plain, long = w["from"] - s["at"], (w["to"] - w["from"]) / w["speed"]
        found = F.when(s["found"].isNotNull(), s["found"]).when(s["rest"] <= plain, s["at"] + s["rest"]).when(s["rest"] - plain <= long, w["from"] + (s["rest"] - plain) * w["speed"])
        return F.struct((s["rest"] - plain - long).alias("rest"), w["to"].cast("double").alias("at"), found.alias("found"))

    return F.aggregate(windows, state, walk, lambda s: F.coalesce(s["found"], s["at"] + s["rest"]))


def duration_basis(length: Column, centres: tuple[float, ...], width: float) -> Column:
    """array<double>: how near a length is to each centre, on a bell curve of ``width``."""
    return F.array(*[F.exp(-0.5 * F.pow((length - c) / width, 2)) for c in centres])


def nearest_moods(tempo: Column, energy: Column, targets: dict[str, tuple[float, float]]) -> Column:
    """array<string>: names of ``targets`` (tempo, energy), nearest first; the first named among equals."""
    far = [F.struct((F.abs(energy - e) + F.abs(tempo - b) / 100.0).alias("far"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, (b, e)) in enumerate(targets.items())]
    return F.transform(F.array_sort(F.array(*far)), lambda x: x["name"])
