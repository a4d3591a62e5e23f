"""Robust cohort scores, composites, quantiles and comparisons of means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The factor that makes a median absolute deviation a standard deviation, and where scores are clipped.
MAD_SIGMA, CLIP = 1.4826, 2.5
# Composite weights of watch ratio, engagement and log views.
WEIGHTS = (0.5, 0.3, 0.2)
# Rows of a side that a comparison needs, and how far mean lengths may differ.
LEAST_SIDE, LENGTH_BAND = 8, 0.15
#: Comparisons that the fixed family has, and its error level.
FAMILY, LEVEL = 9, 0.01


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def middle(values: Column) -> Column:
    """The median of an array of numbers, the mean of the middle pair where there are two; null if it's empty."""

    def of(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
        return F.when(n > 0, (F.element_at(s, low) + F.element_at(s, high)) / 2.0)

    return let(F.array_sort(F.filter(values, lambda v: v.isNotNull())), of)


def robust_score(x: Column, cohort: Column, least_spread: float, clip: float = CLIP) -> Column:
    """(x - median) / (1.4826 * max(MAD, least_spread)) over an array, clipped; null for an empty cohort."""

    def clipped(m: Column) -> Column:
        spread = F.greatest(middle(F.transform(cohort, lambda v: F.abs(v - m))), F.lit(least_spread))
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - m) / (F.lit(MAD_SIGMA) * spread)))

    return let(middle(cohort), clipped)


def robust_z(rows: DataFrame, key: str, value: str, least_spread: float, out: str = "z") -> DataFrame:
    """Adds the robust score of each row within its key, from two aggregations.

    Medians are exact, so a key's distinct values are held by one task; a key of many millions should be rounded before."""
    medians = rows.groupBy(key).agg(F.median(value).alias("m"))
    spreads = rows.join(medians, key).groupBy(key).agg(F.first("m").alias("m"), F.median(F.abs(F.col(value) - F.col("m"))).alias("mad"))
    z = (F.col(value) - F.col("m")) / (F.lit(MAD_SIGMA) * F.greatest("mad", F.lit(least_spread)))
    return rows.join(spreads, key).withColumn(out, F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))).drop("m", "mad")


def trailing(rows: DataFrame, key: str, at: str, tie: str, value: str, most: int, out: str = "cohort") -> DataFrame:
    """Adds the ``most`` newest values of the key that are strictly earlier than each row; rows without a value take no place.

    Rows of equal time don't see each other: the frame reaches back from the first row of that time. Places are counts
    of the values before a row, so a frame of places holds as many values, however many rows without one lie between.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    place = F.count(F.col(value)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.collect_list(F.col(value)).over(Window.partitionBy(key).orderBy("__place").rangeBetween(-most, -1))
    first = F.first("__before").over(Window.partitionBy(key, at).orderBy(tie))
    return rows.withColumn("__place", place).withColumn("__before", before).withColumn(out, first).drop("__place", "__before")


def components(watch_s: Column, length_s: Column, views: Column, likes: Column, shares: Column) -> tuple[Column, Column, Column]:
    """Watch ratio (1.2 at most, null without watch time), engagement with shares counted twice, log views."""
    ratio = F.when(watch_s.isNotNull() & (length_s > 0), F.least(watch_s / length_s, F.lit(1.2)))
    engaged = (F.coalesce(likes, F.lit(0)) + 2 * F.coalesce(shares, F.lit(0))) / F.greatest(views, F.lit(1))
    return ratio, engaged, F.log1p(views)


def composite(r: Column, e: Column, v: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted sum of three scores; without r the other weights are scaled up to 1."""
    wr, we, wv = weights
    return F.when(r.isNull(), (we * e + wv * v) / (we + wv)).otherwise(wr * r + we * e + wv * v)


def renormalised(parts: list[tuple[float, Column]], empty: float | None = None) -> Column:
    """Weighted mean of the parts that aren't null; ``empty`` if all are."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        top, bottom = top + F.when(c.isNotNull(), w * c).otherwise(0.0), bottom + F.when(c.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def weighted_mean(rows: DataFrame, key: str, value: str, weight: str, at: str) -> DataFrame:
    """key, value (mean by weight), weight (plain mean), first: several results of one item as one."""
    return rows.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value), F.avg(weight).alias(weight), F.min(at).alias("first"))


def run_times(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median, p90 (nearest rank), most."""
    return rows.groupBy(key).agg(
        F.count(value).alias("n"), F.median(value).alias("median"),
        F.expr(f"percentile_disc(0.9) within group (order by `{value}`)").alias("p90"), F.max(value).alias("most"),
    )


def last_quantile(rows: DataFrame, key: str, at: str, tie: str, value: str, most: int, q: float, low: float, high: float) -> DataFrame:
    """key, level: the q-quantile (linear interpolation) of each key's newest ``most`` values, clamped."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    newest = rows.withColumn("place", place).where(F.col("place") <= most)
    return newest.groupBy(key).agg(F.greatest(F.lit(low), F.least(F.lit(high), F.percentile(value, q))).alias("level"))


def spearman(rows: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """key, rho: rank correlation of a series with its order; ties have mean ranks; null under 3 values, 0 if constant."""
    by_value = Window.partitionBy(key).orderBy(value)
    ties = Window.partitionBy(key, value)
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(at, tie)).cast("double"))
    ranked = ranked.withColumn("r", F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2.0)
    stats = ranked.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop("i", "r").alias("c"), F.stddev_pop("i").alias("si"), F.stddev_pop("r").alias("sr"))
    rho = F.when(F.col("n") < 3, None).when((F.col("si") == 0) | (F.col("sr") == 0), 0.0).otherwise(F.col("c") / (F.col("si") * F.col("sr")))
    return stats.select(key, rho.alias("rho"))


def autocorrelation(rows: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """key, lag1: correlation of neighbours around the common mean; 0 for a constant series, null under 3 values."""
    mean = F.avg(value).over(Window.partitionBy(key))
    d = rows.withColumn("d", F.col(value) - mean)
    d = d.withColumn("p", F.lag("d").over(Window.partitionBy(key).orderBy(at, tie)))
    stats = d.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("p")).alias("c"), F.sum(F.col("d") * F.col("d")).alias("v"))
    return stats.select(key, F.when(F.col("n") < 3, None).when(F.col("v") == 0, 0.0).otherwise(F.col("c") / F.col("v")).alias("lag1"))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def t_quantile(p: Column | float, df: Column) -> Column:
    """Student's quantile for a fixed p by the Cornish-Fisher expansion around the normal one."""
    z = normal_quantile(p)
    a = (z**3 + z) / 4
    b = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    c = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return F.lit(z) + a / df + b / (df * df) + c / (df * df * df)


def welch(
    rows: DataFrame, side: Column, value: str, length: str, by: str | list[str] | None = None, tests: int = FAMILY, level: float = LEVEL, extra: tuple[Column, ...] = ()
) -> DataFrame:
    """One row (for each ``by``): what ``extra`` aggregates, sizes, means, their difference, its interval at level / (2 * tests), and a verdict.

    ``side`` is true for the one, false for the other; null rows don't count. A verdict needs LEAST_SIDE rows on both
    sides and mean lengths within LENGTH_BAND of each other; it is the sign of an interval that leaves out 0.
    """
    one, other = F.when(side, F.col(value)), F.when(~side, F.col(value))
    agg = [F.count(one).alias("n1"), F.count(other).alias("n2"), F.avg(one).alias("m1"), F.avg(other).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(other).alias("v2")]
    agg += [F.avg(F.when(side & F.col(value).isNotNull(), F.col(length))).alias("l1"), F.avg(F.when(~side & F.col(value).isNotNull(), F.col(length))).alias("l2")]
    keys = [by] if isinstance(by, str) else list(by or [])
    s = rows.groupBy(*keys).agg(*agg, *extra)
    kept = [c for c in s.columns if c not in ("n1", "n2", "m1", "m2", "v1", "v2", "l1", "l2")]
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    s = s.withColumn("difference", F.col("m1") - F.col("m2")).withColumn("half", t_quantile(1 - level / (2 * tests), df) * F.sqrt(a + b))
    far = F.abs(F.col("l1") - F.col("l2")) > LENGTH_BAND * F.greatest("l1", "l2")
    verdict = (
        F.when((F.col("n1") < LEAST_SIDE) | (F.col("n2") < LEAST_SIDE), "few").when(far, "lengths")
        .when(F.col("difference") - F.col("half") > 0, "more").when(F.col("difference") + F.col("half") < 0, "less").otherwise("open")
    )
    return s.withColumn("verdict", verdict).select(*kept, "n1", "n2", "m1", "m2", "difference", "half", "verdict")


def holdout(rows: DataFrame, at: str, tie: str, share: float = 0.2, least: int = 10, key: str | None = None) -> DataFrame:
    """Adds whether a row is in its key's newest ``share`` (1 at least; none under ``least`` rows)."""
    k = [key] if key else []
    n = F.count("*").over(Window.partitionBy(*k))
    place = F.row_number().over(Window.partitionBy(*k).orderBy(at, tie))
    return rows.withColumn("held_out", (n >= least) & (place > n - F.greatest(F.lit(1), F.bround(n * share, 0).cast("int"))))
