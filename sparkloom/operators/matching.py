"""Rows that meet in time or by what they cover: banded pairs, equal times, nearest beats, merged changes, groups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decay
from .timeline import micros, seconds, thin


def banded_pairs(rows: DataFrame, key: str, at: str, item: str, y: str, trust: str, within_s: float, least: float, now: Column, half_life: float) -> DataFrame:
    """key, good, bad, weight: pairs of a key's rows at most ``within_s`` apart whose ``y`` differ by ``least`` or more.

    The weight is 2 * sqrt(trust * trust), decayed by the age in days of the earlier row. A row goes to the time band of
    its own and the next one, so a hot key is spread over its bands and every pair meets once. Equal ``y`` is no pair.
    """
    band = seconds(within_s) + 1
    one = rows.select(F.col(key).alias("key"), F.col(item).alias("id"), micros(at).alias("us"), F.col(y).alias("y"), F.col(trust).alias("c")).where("us is not null and y is not null")
    own = F.floor(F.col("us") / band)
    a = one.select("key", *[F.col(c).alias(f"a_{c}") for c in ("id", "us", "y", "c")], F.explode(F.array(own, own + 1)).alias("band"))
    b = one.select("key", *[F.col(c).alias(f"b_{c}") for c in ("id", "us", "y", "c")], own.alias("band"))
    later = (F.col("b_us") > F.col("a_us")) | ((F.col("b_us") == F.col("a_us")) & (F.col("b_id") > F.col("a_id")))
    pairs = a.join(b, ["key", "band"]).where(later & (F.col("b_us") - F.col("a_us") <= seconds(within_s)) & (F.abs(F.col("a_y") - F.col("b_y")) >= least) & (F.col("a_y") != F.col("b_y")))
    better = F.col("a_y") > F.col("b_y")
    age = (micros(now) - F.col("a_us")) / 86_400_000_000.0
    weight = 2.0 * F.sqrt(F.col("a_c") * F.col("b_c")) * decay(age, half_life)
    return pairs.select("key", F.when(better, F.col("a_id")).otherwise(F.col("b_id")).alias("good"), F.when(better, F.col("b_id")).otherwise(F.col("a_id")).alias("bad"), weight.alias("weight"))


def nearest_distance(points: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """``points`` with ``distance_us`` to the nearest of the key's ``marks(key, at)``, null without any: one ordered pass."""
    whole = F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row")
    p = points.select(F.col(key).alias("__key"), micros(at).alias("us"), F.lit(None).cast("long").alias("mark"), whole)
    m = marks.select(F.col(key).alias("__key"), micros(at).alias("us"), micros(at).alias("mark"), F.lit(None).cast(p.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("__key").orderBy("us")  # frames by value: equal times see each other
    before = F.max("mark").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("mark").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.least(F.col("us") - before, after - F.col("us"))
    return p.unionByName(m).withColumn("distance_us", near).where("row is not null").select("row.*", "distance_us")


def near_share(points: DataFrame, marks: DataFrame, key: str, at: str, within_s: float) -> DataFrame:
    """key, share: of a key's points, those at most ``within_s`` from a mark of it; a key without marks has none."""
    d = nearest_distance(points, marks, key, at)
    return d.groupBy(key).agg(F.avg(F.coalesce((F.col("distance_us") <= seconds(within_s)).cast("double"), F.lit(0.0))).alias("share"))


def merged_changes(rows: DataFrame, key: str, at: str, strength: str, near_s: float) -> DataFrame:
    """key, us, strength, n: changes nearer than ``near_s`` to the first of their group as one, with its time and the largest strength."""
    kept = thin(rows, key, at, near_s).select(F.col(key).alias("__key"), F.col("kept").alias("us"), F.col("kept").alias("first"), F.lit(None).cast("double").alias("strength")).distinct()
    all_ = rows.select(F.col(key).alias("__key"), micros(at).alias("us"), F.lit(None).cast("long").alias("first"), F.col(strength).cast("double").alias("strength"))
    order = Window.partitionBy("__key").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = kept.unionByName(all_.withColumn("own", F.lit(1)), allowMissingColumns=True).withColumn("group", F.max("first").over(order)).where("own = 1")
    return grouped.groupBy("__key", "group").agg(F.max("strength").alias("strength"), F.count("*").alias("n")).select(F.col("__key").alias(key), F.col("group").alias("us"), "strength", "n")


def largest_group(rows: DataFrame, group: str) -> DataFrame:
    """group, n: the commonest array of ``group``; of equally common ones that with more parts, then the last in order."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(F.size(group)), F.desc(group)).limit(1)


def phase(at: Column, start: Column, end: Column) -> Column:
    """How far ``at`` is from start (0) to end (1), held inside; 0 without a length."""
    length = micros(end) - micros(start)
    return F.when(length <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (micros(at) - micros(start)) / length)))


def job_report(jobs: DataFrame, kind: str, result: Column, held: Column, waited: Column, error: Column) -> DataFrame:
    """kind, n, blocked, errors, median, p90 (nearest rank) and max of held and waited, error_kinds (name to number) for each kind.

    Blocked jobs held nothing, but they waited. Kinds of errors are counted before they meet in a map.
    """
    rows = jobs.select(F.col(kind).alias("kind"), result.alias("result"), held.alias("held"), waited.alias("waited"), F.coalesce(error.cast("string"), F.lit("None")).alias("error"))
    ran = F.when(F.coalesce(F.col("result") != "blocked", F.lit(True)), F.col("held"))
    sums = rows.withColumn("ran", ran).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") == "blocked").alias("blocked"), F.count_if(F.col("result") == "error").alias("errors"),
        *[x for c in ("ran", "waited") for x in (F.median(c).alias(f"{c}_median"), F.expr(f"percentile_disc(0.9) within group (order by {c})").alias(f"{c}_p90"), F.max(c).alias(f"{c}_max"))],
    )
    sums = sums.withColumnsRenamed({f"ran_{k}": f"held_{k}" for k in ("median", "p90", "max")})
    kinds = rows.where("result = 'error'").groupBy("kind", "error").agg(F.count("*").alias("times"))
    maps = kinds.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "times")))).alias("error_kinds"))
    return sums.join(maps, "kind", "left")
