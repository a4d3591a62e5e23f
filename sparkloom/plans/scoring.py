"""Score queries: orders stand for posts and their priority for the platform, lineitems for samples and cross-posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort as C
from .base import rounded, table


def _posts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", "o_custkey")


def robust_z(spark, sf_dir):
    z = C.robust_z(_posts(spark, sf_dir), "o_orderpriority", "o_totalprice", 0.1)
    return z.select("o_orderkey", rounded("z").alias("z"))


def trailing_score(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    t = C.trailing(rows, "user_id", "ts", "event_id", "value", 20)
    score = F.when(F.size("cohort") >= 5, C.robust_score(F.col("value"), F.col("cohort"), 0.1)).otherwise(0.0)
    return t.select("event_id", F.size("cohort").cast("long").alias("n"), rounded(score).alias("score"))


def composite_score(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    watch = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    r, e, v = C.components(watch, F.lit(25.0), F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    return lines.select("l_orderkey", "l_linenumber", rounded(C.composite(r, e, v)).alias("score"), rounded(C.renormalised([(2.0, r), (1.0, e)], 50.0)).alias("part"))


def cross_posts(spark, sf_dir):
    cents, percent = (F.round(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_discount"))  # whole numbers: sums are exact
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", cents.alias("cents"), percent.alias("percent"), "l_shipdate")
    m = C.weighted_mean(lines, "l_orderkey", "cents", "percent", "l_shipdate")
    return m.select("l_orderkey", rounded("cents", 3).alias("value"), rounded("percent").alias("confidence"), F.col("first").alias("first_ship"))


def run_times(spark, sf_dir):
    t = C.run_times(table(spark, sf_dir, "events"), "event_type", "value")
    return t.select("event_type", "n", rounded("median").alias("median"), rounded("p90").alias("p90"), rounded("most").alias("most"))


def last_quantile(spark, sf_dir):
    q = C.last_quantile(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 40, 0.2, 1.0, 30.0)
    return q.select("user_id", rounded("level").alias("level"))


def spearman(spark, sf_dir):
    s = C.spearman(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")
    return s.select("user_id", rounded("rho").alias("rho"))


def autocorrelation(spark, sf_dir):
    s = C.autocorrelation(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")
    return s.select("user_id", rounded("lag1").alias("lag1"))


def welch_by_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = C.welch(o, F.col("o_orderstatus") == "F", "o_totalprice", "o_custkey", by="o_orderpriority")
    return w.select("o_orderpriority", "n1", "n2", rounded("m1", 4).alias("m1"), rounded("m2", 4).alias("m2"), rounded("difference", 4).alias("difference"), rounded("half", 4).alias("half"), "verdict")


def chronological_holdout(spark, sf_dir):
    h = C.holdout(table(spark, sf_dir, "events"), "ts", "event_id", key="user_id")
    return h.where("held_out").select("event_id", "user_id")


def decayed_exposure(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    age = S.age_days(F.col("ts"), F.lit("2024-02-01"))
    x = e.groupBy("user_id").agg(F.sum(S.decay(age, 60.0)).alias("x"), F.max(S.ramp_down(age, 3.0, 20.0)).alias("fresh"))
    return x.select("user_id", rounded("x").alias("exposure"), rounded("fresh").alias("fresh"))


_Z = "1.4826::DOUBLE"


def _t_sql(df: str) -> str:
    z = C.normal_quantile(1 - C.LEVEL / (2 * C.FAMILY))
    a, b, c = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z!r}::DOUBLE + {a!r}::DOUBLE / {df} + {b!r}::DOUBLE / ({df} * {df}) + {c!r}::DOUBLE / ({df} * {df} * {df}))"


QUERIES = {
    f.__name__: f
    for f in (
        robust_z, trailing_score, composite_score, cross_posts, run_times, last_quantile, spearman, autocorrelation, welch_by_priority,
        chronological_holdout, decayed_exposure,
    )
}

ORACLE = {
    "robust_z": f"""WITH m AS (SELECT o_orderpriority AS p, median(o_totalprice) AS m FROM orders GROUP BY 1),
s AS (SELECT p, any_value(m) AS m, median(abs(o_totalprice - m)) AS mad FROM orders JOIN m ON o_orderpriority = p GROUP BY p)
SELECT o_orderkey, round(greatest(-2.5::DOUBLE, least(2.5::DOUBLE, (o_totalprice - m) / ({_Z} * greatest(mad, 0.1::DOUBLE)))), 6) AS z FROM orders JOIN s ON o_orderpriority = p""",
    "trailing_score": f"""WITH a AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS l FROM events),
c AS (SELECT event_id, value, l[greatest(len(l) - 19, 1):] AS l FROM a),
m AS (SELECT *, coalesce(len(l), 0) AS n, list_median(l) AS m FROM c),
s AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM m)
SELECT event_id, n, CASE WHEN n >= 5 THEN round(greatest(-2.5::DOUBLE, least(2.5::DOUBLE, (value - m) / ({_Z} * greatest(mad, 0.1::DOUBLE)))), 6) ELSE 0.0::DOUBLE END AS score FROM s""",
    "composite_score": """WITH c AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN least(l_quantity / 25.0::DOUBLE, 1.2::DOUBLE) END AS r,
    (l_quantity + 2 * l_linenumber::DOUBLE) / greatest(l_extendedprice, 1) AS e, ln(1 + l_extendedprice) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN r IS NULL THEN (0.3::DOUBLE * e + 0.2::DOUBLE * v) / (0.3::DOUBLE + 0.2::DOUBLE) ELSE 0.5::DOUBLE * r + 0.3::DOUBLE * e + 0.2::DOUBLE * v END, 6) AS score,
  round(CASE WHEN r IS NULL THEN e ELSE (2.0::DOUBLE * r + e) / 3.0::DOUBLE END, 6) AS part FROM c""",
    "cross_posts": """WITH l AS (SELECT l_orderkey, l_shipdate, round(l_extendedprice * 100)::BIGINT AS c, round(l_discount * 100)::BIGINT AS p FROM lineitem)
SELECT l_orderkey, round(CASE WHEN sum(p) <> 0 THEN sum(c * p)::DOUBLE / sum(p)::DOUBLE END, 3) AS value, round(avg(p), 6) AS confidence, min(l_shipdate) AS first_ship FROM l GROUP BY l_orderkey""",
    "run_times": "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "last_quantile": """WITH n AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40)
SELECT user_id, round(greatest(1.0::DOUBLE, least(30.0::DOUBLE, quantile_cont(value, 0.2))), 6) AS level FROM n GROUP BY user_id""",
    "spearman": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i,
    rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS r FROM events)
SELECT user_id, CASE WHEN count(*) < 3 THEN NULL WHEN stddev_pop(r) = 0 THEN 0 ELSE round(covar_pop(i, r) / (stddev_pop(i) * stddev_pop(r)), 6) END AS rho FROM r GROUP BY user_id""",
    "autocorrelation": """WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events),
p AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d)
SELECT user_id, CASE WHEN count(*) < 3 THEN NULL WHEN sum(d * d) = 0 THEN 0 ELSE round(sum(d * p) / sum(d * d), 6) END AS lag1 FROM p GROUP BY user_id""",
    "welch_by_priority": f"""WITH s AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2,
    avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS m2,
    var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus <> 'F') AS v2,
    avg(o_custkey) FILTER (o_orderstatus = 'F') AS l1, avg(o_custkey) FILTER (o_orderstatus <> 'F') AS l2 FROM orders GROUP BY o_orderpriority),
d AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM s), f AS (SELECT *, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM d),
h AS (SELECT *, m1 - m2 AS diff, {_t_sql('df')} * sqrt(a + b) AS half FROM f)
SELECT o_orderpriority, n1, n2, round(m1, 4) AS m1, round(m2, 4) AS m2, round(diff, 4) AS difference, round(half, 4) AS half,
  CASE WHEN n1 < 8 OR n2 < 8 THEN 'few' WHEN abs(l1 - l2) > 0.15 * greatest(l1, l2) THEN 'lengths' WHEN diff - half > 0 THEN 'more' WHEN diff + half < 0 THEN 'less' ELSE 'open' END AS verdict FROM h""",
    "chronological_holdout": """WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, user_id FROM n WHERE n >= 10 AND i > n - greatest(1, round_even(n * 0.2, 0))""",
    "decayed_exposure": """WITH a AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM events)
SELECT user_id, round(sum(0.25::DOUBLE + 0.75::DOUBLE * pow(2.0::DOUBLE, -age / 60.0::DOUBLE)), 6) AS exposure, round(max(1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (age - 3.0::DOUBLE) / 17.0::DOUBLE))), 6) AS fresh FROM a GROUP BY user_id""",
}
