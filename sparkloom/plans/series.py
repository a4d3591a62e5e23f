"""Series queries over ``events``, ``lineitem`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as R
from .base import rounded, table

HOUR = 3600


def strongest_events(spark, sf_dir):
    k = R.strongest_first(table(spark, sf_dir, "events"), "user_id", "ts", "value", 24 * HOUR)
    return k.select("user_id", F.col("kept").alias("kept_us"), rounded("strength").alias("strength"))


def unlike_last(spark, sf_dir):
    return R.unlike_last_kept(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", 24 * HOUR, "event_id").select("user_id", F.col("kept").alias("event_id"))


def price_ranks(spark, sf_dir):
    p = R.percent_below(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "share")
    return p.select("p_partkey", rounded("share").alias("share"))


def steepest_rises(spark, sf_dir):
    return R.steepest_rise(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 4, 2).select("user_id", "id", rounded("rise").alias("rise"))


def longest_quiet(spark, sf_dir):
    return R.longest_run(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") < 10).select("user_id", "longest")


def audible_level(spark, sf_dir):
    return R.floor_level(table(spark, sf_dir, "events"), "user_id", "value", 0.9, "p90").select("user_id", rounded("p90").alias("p90"))


def idle_shares(spark, sf_dir):
    i = R.idle_share(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"), HOUR, HOUR)
    return i.select("user_id", rounded("idle").alias("idle"))


def part_exposure(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = R.exposure(li, "l_partkey", "l_orderkey", F.col("l_orderkey") % 7, F.lit(0.25))
    return x.select("l_partkey", rounded("exposure").alias("exposure"), "times")


def newest_visits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("start"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.lit(1))).alias("end"))
    return R.newest_block(e, "user_id", "start", "end", 12 * HOUR).select("user_id", "event_id")


def shrunk_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n"))
    return p.select("p_type", rounded(R.shrunk(F.col("m"), F.col("n"), 1000.0), 4).alias("price"))


def supplier_support(spark, sf_dir):
    k = R.kernel_support(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", F.col("l_discount"), 25.0, 5.0)
    return k.select("l_suppkey", rounded("support").alias("support"))


def value_turns(spark, sf_dir):
    return R.flashes(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 10.0).select("user_id", "turns")


def feature_means(spark, sf_dir):
    """Each line with the next of its order: mean differences of quantity (always known) and discount (known unless 0)."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_extendedprice")
    m = F.map_filter(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.when(F.col("l_discount") != 0, F.col("l_discount"))), lambda k, v: v.isNotNull())
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount")
    pairs = li.withColumn("a", m).withColumn("b", F.lead("a").over(order)).where("b is not null").withColumn("w", F.lit(1.0))
    return R.feature_means(pairs, "a", "b", "w").select("name", rounded("mean", 4).alias("mean"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        strongest_events, unlike_last, price_ranks, steepest_rises, longest_quiet, audible_level, idle_shares, part_exposure, newest_visits,
        shrunk_prices, supplier_support, value_turns, feature_means,
    )
}

ORACLE = {
    "strongest_events": """WITH l AS (SELECT user_id, list({'u': epoch_us(ts), 'v': value} ORDER BY value DESC, ts) AS l FROM events GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda y: abs(y.u - b[1].u) < 86400000000)) = 0 THEN list_concat(a, b) ELSE a END) AS k FROM l),
u AS (SELECT user_id, unnest(k) AS k FROM k) SELECT user_id, k.u AS kept_us, round(k.v, 6) AS strength FROM u""",
    "unlike_last": """WITH l AS (SELECT user_id, list({'u': epoch_us(ts), 'w': event_type, 'i': event_id} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN b[1].u - a[-1].u < 86400000000 AND b[1].w = a[-1].w THEN a ELSE list_concat(a, b) END) AS k FROM l),
u AS (SELECT user_id, unnest(k) AS k FROM k) SELECT user_id, k.i AS event_id FROM u""",
    "price_ranks": """SELECT p_partkey, round(CASE WHEN count(*) OVER (PARTITION BY p_brand) <= 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) END, 6) AS share FROM part""",
    "steepest_rises": """WITH r AS (SELECT user_id, event_id, ts, avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rise,
    count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS a, count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS id, round(rise, 6) AS rise FROM r WHERE a = 2 AND b = 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(rise, 9) DESC, ts, event_id) = 1""",
    "longest_quiet": """WITH o AS (SELECT user_id, (value < 10)::INT AS o, sum(1 - (value < 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
n AS (SELECT user_id, g, sum(o) AS n FROM o GROUP BY user_id, g) SELECT user_id, max(n)::BIGINT AS longest FROM n GROUP BY user_id""",
    "audible_level": """WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT user_id, round(v[least(len(v) - 1, floor(len(v) * 0.9)::BIGINT) + 1], 6) AS p90 FROM s""",
    "idle_shares": """WITH p AS (SELECT DISTINCT user_id, unnest(generate_series(greatest(0, ceil((epoch_us(ts) - 3600000000 - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0)::BIGINT),
    least(720, floor((epoch_us(ts) + 3600000000 - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0)::BIGINT))) AS i FROM events)
SELECT user_id, round(1 - count(*) / 721.0::DOUBLE, 6) AS idle FROM p GROUP BY user_id""",
    "part_exposure": """WITH o AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)
SELECT l_partkey, round(least(1.0::DOUBLE, sum(0.25::DOUBLE * pow(0.5::DOUBLE, l_orderkey % 7))), 6) AS exposure, count(*) AS times FROM o GROUP BY l_partkey""",
    "newest_visits": """WITH b AS (SELECT user_id, event_id, ts, CASE WHEN ts - (lag(ts) OVER w + INTERVAL 1 HOUR) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b)
SELECT user_id, event_id FROM k QUALIFY k = max(k) OVER (PARTITION BY user_id)""",
    "shrunk_prices": "SELECT p_type, round((avg(p_retailprice) * count(*) + 8000) / (count(*) + 8), 4) AS price FROM part GROUP BY p_type",
    "supplier_support": """SELECT l_suppkey, round(sum(l_discount * exp(-0.5::DOUBLE * ((l_quantity - 25) / 5) * ((l_quantity - 25) / 5))), 6) AS support FROM lineitem GROUP BY l_suppkey""",
    "value_turns": """WITH l AS (SELECT user_id, list({'x': value, 'w': 0, 't': 0} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
SELECT user_id, list_reduce(l, lambda s, v: CASE WHEN s.w >= 0 AND v.x - s.x < -10 THEN {'x': v.x, 'w': -1, 't': s.t + 1} WHEN s.w <= 0 AND v.x - s.x > 10 THEN {'x': v.x, 'w': 1, 't': s.t + 1}
  WHEN (s.w > 0 AND v.x > s.x) OR (s.w < 0 AND v.x < s.x) THEN {'x': v.x, 'w': s.w, 't': s.t} ELSE s END).t AS turns FROM l""",
    "feature_means": """WITH n AS (SELECT l_quantity AS q, nullif(l_discount, 0) AS d, lead(l_quantity) OVER w AS q2, nullif(lead(l_discount) OVER w, 0) AS d2, lead(l_orderkey) OVER w AS more
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_tax, l_discount))
SELECT 'quantity' AS name, round(avg(q - q2), 4) AS mean, count(*) AS n FROM n WHERE more IS NOT NULL UNION ALL
SELECT 'discount', round(avg(d - d2), 4), count(*) FROM n WHERE more IS NOT NULL AND d IS NOT NULL AND d2 IS NOT NULL""",
}
