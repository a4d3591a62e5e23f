"""How a video ends and whether its texts can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ramp_down, ramp_up, trapezoid
from .cohort import renormalised
from .timeline import micros

# Shares of a text's size that its ink and its outline take.
INK, EDGE = 0.9, 0.08


def on_beat(beats: DataFrame, ends: DataFrame, key: str, at: str, end: str) -> DataFrame:
    """key, beat: 1 if the key's end is within an eighth of its median beat step of a beat, else 0.2; null under two beats.
    A median step of 0 counts as half a second."""
    order = Window.partitionBy(key).orderBy(micros(at))
    steps = beats.join(ends.select(key, end), key).withColumn("__step", F.lead(micros(at)).over(order) - micros(at))
    found = steps.groupBy(key).agg(F.median("__step").alias("step"), F.min(F.abs(micros(end) - micros(at))).alias("near"))
    step = F.when(F.col("step") == 0, 500_000.0).otherwise(F.col("step"))
    return found.select(key, F.when(F.col("step").isNotNull(), F.when(F.col("near") <= step / 8, 1.0).otherwise(0.2)).alias("beat"))


def fade_out(series: DataFrame, ends: DataFrame, key: str, at: str, value: str, end: str, level: str) -> DataFrame:
    """key, fade_s: from the last sample at most 3 under the key's ``level`` to the first one after it that is more than
    20 under it, or to the end; null without a loud one."""
    both = series.join(ends.select(key, end, level), key)
    loud = F.max(F.when(F.col(value) >= F.col(level) - 3.0, micros(at))).over(Window.partitionBy(key))
    both = both.withColumn("__loud", loud)
    quiet = F.min(F.when((micros(at) > F.col("__loud")) & (F.col(value) < F.col(level) - 20.0), micros(at)))
    found = both.groupBy(key).agg(F.max("__loud").alias("loud"), quiet.alias("quiet"), F.max(micros(end)).alias("end"))
    return found.select(key, ((F.coalesce("quiet", "end") - F.col("loud")) / 1e6).alias("fade_s"))


def ending_short(tail: Column, black: Column, beat: Column, seam: Column) -> Column:
    """Loudness of the tail over the whole's, no black at the end, on the beat, seam to the beginning; parts that are
    null don't count."""
    lit = F.when(black.isNotNull(), (~black).cast("double"))
    return renormalised([(0.40, ramp_up(tail, -15.0, -6.0)), (0.15, lit), (0.25, beat), (0.20, ramp_up(seam, 0.15, 0.5))])


def ending_long(beat: Column, fade_s: Column, planned_black: Column) -> Column:
    """On the beat, a fade of 0.5 to 2.5 seconds, and no black but in planned fades."""
    return renormalised([(0.5, beat), (0.3, trapezoid(fade_s, 0.0, 0.5, 2.5, 5.0)), (0.2, planned_black.cast("double"))])


def inside_zone(middle: Column, size: Column, chars: Column, char_width: float, width: float, height: float, zone: tuple[float, float, float, float]) -> Column:
    """Whether a text's ink is inside the zone (shares kept free at top, bottom, left and right)."""
    top, bottom, left, right = zone
    half, wide = (INK / 2 + EDGE) * size, chars * char_width * size
    upright = (middle - half >= top * height) & (middle + half <= (1 - bottom) * height)
    return upright & ((width - wide) / 2 >= left * width) & ((width + wide) / 2 <= (1 - right) * width)


def reading(shown_s: Column, chars: Column, size: Column, height: float, safe: Column) -> Column:
    """The least of: time shown, characters a second, size, and whether the text is in the safe zone."""
    fast = chars / F.greatest(shown_s, F.lit(1e-3))
    return F.least(ramp_up(shown_s, 0.4, 0.83), ramp_down(fast, 17.0, 25.0), ramp_up(size / height, 0.015, 0.03), safe.cast("double"))
