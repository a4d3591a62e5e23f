"""Cut points on a beat grid: segments one after another, each of which ends on a beat if one lies within its limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is left free at a file's end, the shortest usable source and must zone, how far over its length a segment may go,
# the share of spare length that goes before the core, and what counts as equal.
FREE_S, USABLE_S, MUST_S, OVER_S, BEFORE, NEAR = 0.25, 0.5, 0.5, 2.0, 0.6, 1e-6
#: What a segment is described by, beside its key and number; all in seconds of its source.
SEGMENT = ("core_begin", "core_end", "must_begin", "must_end", "source_s", "most_s")


def limits(segments: DataFrame, least_s: float) -> DataFrame:
    """``segments`` with wish, low and high, the lengths that a segment wants and may have, plain (its length without a beat) and usable."""
    c = F.col
    usable = F.greatest(F.lit(USABLE_S), c("source_s") - FREE_S)
    must, core = F.greatest(F.lit(MUST_S), c("must_end") - c("must_begin")), c("core_end") - c("core_begin")
    wish = F.least(c("most_s"), F.greatest(F.lit(least_s), core, must), usable)
    low, high = F.greatest(F.lit(least_s), must), F.least(usable, F.greatest(wish, must) + OVER_S)
    plain = F.greatest(F.least(wish, usable), F.least(low, usable))
    return segments.withColumns({"usable": usable, "wish": wish, "low": low, "high": high, "plain": plain})


def snapped(low: np.ndarray, high: np.ndarray, wish: np.ndarray, plain: np.ndarray, grid: np.ndarray, begin: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each segment, and whether it ends on a beat of the sorted ``grid``: on the one nearest to its wish, the earlier
    of two, if it lies within its limits."""
    begins, ends, on = np.zeros(len(low)), np.zeros(len(low)), np.zeros(len(low), dtype=bool)
    t = begin
    for i in range(len(low)):
        a, z = np.searchsorted(grid, [t + low[i] - NEAR, t + high[i] + NEAR])
        z += z < len(grid) and grid[z] <= t + high[i] + NEAR
        begins[i], ends[i], on[i] = t, t + plain[i], z > a
        if on[i]:
            target = t + wish[i]
            k = min(max(int(np.searchsorted(grid, target)), a), z - 1)
            if k > a and abs(grid[k - 1] - target) <= abs(grid[k] - target):
                k -= 1
            ends[i] = grid[k]
        t = ends[i]
    return begins, ends, on


def source_begin(length: Column) -> Column:
    """Where the source begins for a segment of a length: more before the core than after it, with the must zone inside, and inside the source."""
    c = F.col
    start = c("core_begin") - BEFORE * (length - (c("core_end") - c("core_begin")))
    start = F.greatest(F.least(start, c("must_begin")), c("must_end") - length)
    return F.greatest(F.lit(0.0), F.least(start, c("usable") - length))


def timeline(segments: DataFrame, grid: DataFrame, key: str, number: str, at: str, least_s: float) -> DataFrame:
    """``segments(key, number, *SEGMENT)`` in order of their numbers with time_begin, time_end, on_beat, source_begin and source_end.

    ``grid(key, at)`` has the beats of each key in seconds from its beginning; a key without beats has lengths as wished. A
    segment ends where the next begins, so where each ends depends on all before it: a key's segments and beats are one
    group, and the work grows with their number. Nulls in a grid are no beats; segments need all their numbers.
    """
    rows = limits(segments.dropna(subset=[key, number, *SEGMENT]), least_s)
    columns = [key, number, "low", "high", "wish", "plain"]
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def run(mine: pd.DataFrame, beats: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(number)
        begins, ends, on = snapped(*(mine[c].to_numpy(dtype=float) for c in ("low", "high", "wish", "plain")), np.sort(beats[at].to_numpy(dtype=float)))
        return pd.DataFrame({key: mine[key], number: mine[number], "time_begin": begins, "time_end": ends, "on_beat": on})

    placed = rows.select(*columns).groupBy(key).cogroup(grid.select(key, at).dropna().groupBy(key)).applyInPandas(run, f"`{key}` {kinds[key]}, `{number}` {kinds[number]}, time_begin double, time_end double, on_beat boolean")
    both = rows.join(placed, [key, number]).withColumn("__length", F.col("time_end") - F.col("time_begin"))
    both = both.withColumn("source_begin", source_begin(F.col("__length")))
    both = both.withColumn("source_end", F.col("source_begin") + F.col("__length"))
    return both.select(*[F.col(f"`{c}`") for c in segments.columns], "time_begin", "time_end", "on_beat", "source_begin", "source_end")


def with_handles(placed: DataFrame, key: str, number: str, wanted_s: str, fps: float) -> DataFrame:
    """``timeline()`` with transition_s: the wanted transition into each segment, as far as both sources have that much more to show.

    Half of it lies before the cut and half after. Under two frames it is a plain cut (0), as is a key's first.
    """
    order = Window.partitionBy(key).orderBy(number)
    rest = F.lag(F.col("source_s") - F.col("source_end")).over(order)
    room = 2 * F.greatest(F.lit(0.0), F.least(rest, F.col("source_begin")))
    length = F.least(F.col(wanted_s), room)
    return placed.withColumn("transition_s", F.when(rest.isNull() | F.coalesce(length < 2.0 / fps, F.lit(True)), 0.0).otherwise(length))
