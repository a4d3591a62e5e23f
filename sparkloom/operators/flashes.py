"""Flashes of a picture: changes of brightness against the last extreme, and the most of them in any second.

The state of the search is the last extreme and its direction, two numbers. A long series is cut into pieces that are
searched at the same time, each from the state that the piece before it ended in; as two searches soon agree whatever
they began with, few pieces have to be searched again once they are told.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..settled import settled
from .timeline import seconds

# Levels of black and of the range above it, the exponent that makes them brightness, the least change that
# counts, and the brightness that the darker side has to be under.
BLACK, RANGE, GAMMA, STEP, DARK = 16.0, 219.0, 2.2, 0.10, 0.8
#: Seconds of a piece.
PIECE_S = 600.0


def brightness(level: Column) -> Column:
    """Relative brightness, 0 to 1, of a video level; null stays null."""
    return F.when(level.isNotNull(), F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - BLACK) / RANGE)), F.lit(GAMMA)))


def turns(values: np.ndarray, extreme: float | None, direction: int, step: float = STEP, dark: float = DARK) -> tuple[list[int], float | None, int]:
    """Places where a series turns, and the extreme and direction (1 up, -1 down, 0 not known) that it ends with.

    A value further on in the same direction moves the extreme; one that is ``step`` or more off it the other way, with
    the darker of the two under ``dark``, is a turn and the new extreme.
    """
    found = []
    for i, v in enumerate(values.tolist()):
        if extreme is None or (direction > 0 and v > extreme) or (direction < 0 and v < extreme):
            extreme = v
        elif abs(v - extreme) >= step and min(v, extreme) < dark:
            found.append(i)
            direction, extreme = (1 if v > extreme else -1), v
    return found, extreme, direction


def turning_points(series: DataFrame, key: str, at: str, value: str, step: float = STEP, dark: float = DARK, piece_s: float = PIECE_S) -> DataFrame:
    """key, at: when the series of each key turns; ``at`` in whole microseconds. Null values are left out, null keys and times too.

    Of values at the same time the smaller comes first. The rounds end when no piece begins otherwise than it was searched:
    after as many as there are pieces in a row through which a state is handed on unchanged, two as a rule.
    """
    kind = series.schema[key].dataType.simpleString()
    rows = series.select(F.col(key).alias("key"), F.col(at).cast("long").alias("us"), F.col(value).cast("double").alias("v")).dropna()
    size = seconds(piece_s)
    pieces = rows.groupBy("key", F.floor(F.col("us") / size).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("us", "v"))).alias("all"))  # what a piece's time holds
    pieces = settled(pieces.select("key", "piece", F.col("all.us").alias("us"), F.col("all.v").alias("v")))

    def run(batches):
        for b in batches:
            out = []
            for us, v, extreme, direction in zip(b.column("us"), b.column("v"), b.column("extreme").to_pylist(), b.column("direction").to_pylist(), strict=True):
                found, end, way = turns(np.asarray(v.values, dtype=np.float64), extreme, direction, step, dark)
                times = np.asarray(us.values)[found]
                out.append((times.tolist(), end, way))
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.list_(pa.int64()), pa.float64(), pa.int32()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "piece", "extreme", "direction")], *columns], names=["key", "piece", "extreme", "direction", "found", "end", "way"])

    fields = f"key {kind}, piece long, extreme double, direction int, found array<long>, end double, way int"
    order = Window.partitionBy("key").orderBy("piece")
    begun = pieces.withColumn("extreme", F.lit(None).cast("double")).withColumn("direction", F.lit(0))
    known = settled(begun.mapInArrow(run, fields))
    while True:
        told = known.withColumns({"__e": F.lag("end").over(order), "__w": F.coalesce(F.lag("way").over(order), F.lit(0))})
        stale = settled(told.where(~F.col("extreme").eqNullSafe(F.col("__e")) | (F.col("direction") != F.col("__w"))).select("key", "piece", F.col("__e").alias("extreme"), F.col("__w").alias("direction")))
        if not stale.limit(1).count():
            return known.select(F.col("key").alias(key), F.explode("found").alias(at))
        again = pieces.join(stale, ["key", "piece"]).mapInArrow(run, fields)
        known = settled(known.join(stale.select("key", "piece"), ["key", "piece"], "left_anti").unionByName(again))


def most_flashes(found: DataFrame, key: str, at: str, keys: DataFrame | None = None) -> DataFrame:
    """key, flashes: the most pairs of turns in any second; 0 for those of ``keys(key)`` without a turn."""
    inside = Window.partitionBy(key).orderBy(F.col(at).cast(LongType())).rangeBetween(-seconds(1.0) + 1, 0)
    counts = found.withColumn("__n", F.floor(F.count("*").over(inside) / 2)).groupBy(key).agg(F.max("__n").alias("flashes"))
    return counts if keys is None else keys.select(key).distinct().join(counts, key, "left").withColumn("flashes", F.coalesce("flashes", F.lit(0)))
