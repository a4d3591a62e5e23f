"""Timeline queries over ``events``: purchases stand for kills, clicks for knocks, errors for deaths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import timeline as T
from .base import rounded, table

HOUR = 3600


def _bought(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")


def gap_chains(spark, sf_dir):
    return T.gap_chains(_bought(spark, sf_dir), "user_id", "ts", 6 * HOUR).groupBy("user_id", "chain").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


_CHAINS = """g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b
  FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS chain FROM g)"""


def series_points(spark, sf_dir):
    n = gap_chains(spark, sf_dir)
    return n.select("user_id", "chain", "n", S.points(F.col("n")).alias("points")).orderBy(F.desc("points"), "user_id", "chain").limit(100)


def longest_series(spark, sf_dir):
    n = gap_chains(spark, sf_dir)
    best = n.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("chain")).alias("minus"))).alias("b"))
    return best.select("user_id", F.col("b.n").alias("n"), (-F.col("b.minus")).alias("chain"))


def _padded(spark, sf_dir, kinds, before, after):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    ts = F.col("ts").cast("timestamp")
    return e.select("user_id", "event_id", (ts - F.make_dt_interval(hours=F.lit(before))).alias("start"), (ts + F.make_dt_interval(hours=F.lit(after))).alias("end"), ts.alias("ts"))


def merged_windows(spark, sf_dir):
    w = T.merge_windows(_padded(spark, sf_dir, ["purchase"], 8, 5), "user_id", "start", "end")
    return w.select("user_id", "window", T.micros("start").alias("start_us"), T.micros("end").alias("end_us"), "n")


_MERGED = """m AS (SELECT user_id, ts - INTERVAL 8 HOUR AS s, ts + INTERVAL 5 HOUR AS e, ts FROM events WHERE event_type = 'purchase'),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM m),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, e) AS win FROM n),
w AS (SELECT user_id, win, min(s) AS s, max(e) AS e, min(ts) AS first, max(ts) AS last, count(*) AS n FROM k GROUP BY user_id, win)"""


def best_cover(spark, sf_dir):
    each = _padded(spark, sf_dir, ["purchase"], 8, 5)
    merged = T.merge_windows(each, "user_id", "start", "end")
    first = F.col("start") + F.make_dt_interval(hours=F.lit(8))
    last = F.col("end") - F.make_dt_interval(hours=F.lit(5))
    w = merged.select("user_id", F.col("window").alias("w_id"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), first.alias("first"), last.alias("last"))
    r = _padded(spark, sf_dir, ["click", "view"], 9, 9).select("user_id", F.col("event_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    best = T.best_cover(w, r, "user_id", 0.5, [F.col("r_start"), F.col("r_id")])
    return best.select("user_id", "w_id", "r_id", rounded("coverage", 2).alias("coverage"))


def credited(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    done = T.credited(e, "user_id", "ts", F.col("event_type") == "click", F.col("event_type") == "purchase", 90 * HOUR, "event_id", "event_id")
    return done.select("event_id", "user_id", "credit")


def running_deaths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.running_count(e, "user_id", "ts", F.col("event_type") == "error", "dead").select("event_id", (F.lit(100) - F.col("dead")).alias("remaining"))


def clutch_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = T.exists_within(e, "user_id", "ts", F.col("event_type") == "click", -30 * HOUR * 1_000_000, 0, "knocked")
    e = T.exists_within(e, "user_id", "ts", F.col("event_type") == "error", 1, 10 * HOUR * 1_000_000, "died")
    return e.where("event_type = 'purchase'").select("event_id", (F.col("knocked") & ~F.col("died")).alias("clutch"))


def overlap_pairs(spark, sf_dir):
    spans = _padded(spark, sf_dir, ["purchase", "click"], 3, 3).select("user_id", F.col("event_id").alias("id"), "start", "end")
    return T.overlap_pairs(spans, "user_id", 6 * HOUR, 3 * HOUR, 0.4).select(F.col("key").alias("user_id"), "a", "b", "overlap_us")


def protected_overlap(spark, sf_dir):
    spans = _padded(spark, sf_dir, ["purchase"], 1, 1)
    kept = _padded(spark, sf_dir, ["error"], 2, 2).select("user_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return T.overlaps(spans, kept, "user_id").select("event_id", "user_id")


def next_pairs(spark, sf_dir):
    return T.next_pairs(_bought(spark, sf_dir), "user_id", "ts", "event_id", 8, 14 * 24 * HOUR)


def nearest_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    best = T.nearest_sample(both, "l_orderkey", S.age_days(F.col("o_orderdate"), F.col("l_shipdate")), 7.0, 3.0, "l_linenumber")
    return best.select("l_orderkey", "l_linenumber", rounded("age").alias("age"))


def latest_sample(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return T.latest(lines, "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


def thinned(spark, sf_dir):
    return T.thin(table(spark, sf_dir, "events"), "user_id", "ts", 12 * HOUR).select("user_id", F.col("kept").alias("kept_us"))


def bursts(spark, sf_dir):
    b = T.bursts(table(spark, sf_dir, "events"), "user_id", "ts", "value", 5.0, 0.3, "event_id")
    return b.select("user_id", T.micros("start").alias("start_us"), T.micros("end").alias("end_us"), "n")


def longest_gap(spark, sf_dir):
    return T.longest_gap(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))


def peaks(spark, sf_dir):
    return T.peaks(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", 40.0).select("event_id", "user_id", "value")


def busiest_hour(spark, sf_dir):
    e = T.count_within(table(spark, sf_dir, "events"), "user_id", "ts", 0, HOUR * 1_000_000 - 1, "n")
    return e.groupBy("user_id").agg(F.max("n").alias("most"))


def evenings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(T.evening("ts", "Europe/Berlin", 6).cast("string").alias("evening")).agg(F.count("*").alias("n"))


def night_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(S.in_day_window(F.col("ts"), "UTC", "22:30", "06:15")).groupBy("event_type").agg(F.count("*").alias("n"))


def tempo(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = (T.micros("ts") - F.lag(T.micros("ts")).over(order)) / 3_600_000_000.0
    m = e.withColumn("step", step).groupBy("user_id").agg(F.median("step").alias("m"))
    return m.select("user_id", rounded("m").alias("median_h"), rounded(S.trapezoid(F.col("m"), 1.0, 5.0, 8.0, 20.0)).alias("tempo"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_chains, series_points, longest_series, merged_windows, best_cover, credited, running_deaths, clutch_flags, overlap_pairs,
        protected_overlap, next_pairs, nearest_sample, latest_sample, thinned, bursts, longest_gap, peaks, busiest_hour, evenings, night_events, tempo,
    )
}

ORACLE = {
    "gap_chains": f"WITH {_CHAINS} SELECT user_id, chain::BIGINT AS chain, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY user_id, chain",
    "series_points": f"""WITH {_CHAINS}, s AS (SELECT user_id, chain::BIGINT AS chain, count(*) AS n FROM c GROUP BY user_id, chain)
SELECT *, ([0.0::DOUBLE, 1, 3, 6, 10])[least(n, 4) + 1] AS points FROM s ORDER BY points DESC, user_id, chain LIMIT 100""",
    "longest_series": f"""WITH {_CHAINS}, s AS (SELECT user_id, chain::BIGINT AS chain, count(*) AS n FROM c GROUP BY user_id, chain)
SELECT user_id, n, chain FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, chain) = 1""",
    "merged_windows": f"WITH {_MERGED} SELECT user_id, win::BIGINT AS \"window\", epoch_us(s) AS start_us, epoch_us(e) AS end_us, n FROM w",
    "best_cover": f"""WITH {_MERGED}, r AS (SELECT user_id, event_id, ts - INTERVAL 9 HOUR AS rs, ts + INTERVAL 9 HOUR AS re FROM events WHERE event_type IN ('click', 'view')),
j AS (SELECT w.user_id, win, event_id, rs, round(greatest(0, epoch_us(least(re, e)) - epoch_us(greatest(rs, s))) / greatest(1, epoch_us(e) - epoch_us(s)), 2) AS coverage
  FROM w JOIN r ON w.user_id = r.user_id AND rs <= first + INTERVAL 500 MILLISECOND AND re >= last - INTERVAL 500 MILLISECOND),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id, win ORDER BY coverage DESC, rs, event_id) = 1)
SELECT w.user_id, w.win::BIGINT AS w_id, b.event_id AS r_id, round(b.coverage, 2) AS coverage FROM w LEFT JOIN b ON w.user_id = b.user_id AND w.win = b.win""",
    "credited": """WITH p AS (SELECT *, lag(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS before,
    lag(CASE WHEN event_type = 'click' THEN {'t': ts, 'i': event_id} END IGNORE NULLS) OVER w AS mark
  FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN (before IS NULL OR mark.t > before) AND ts - mark.t <= INTERVAL 90 HOUR THEN mark.i END AS credit FROM p WHERE event_type = 'purchase'""",
    "running_deaths": """SELECT event_id, 100 - sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS remaining FROM events""",
    "clutch_flags": """WITH f AS (SELECT *, coalesce(max((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 HOUR PRECEDING AND CURRENT ROW), 0) AS k,
    coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 10 HOUR FOLLOWING), 0) AS d FROM events)
SELECT event_id, k = 1 AND d = 0 AS clutch FROM f WHERE event_type = 'purchase'""",
    "overlap_pairs": """WITH s AS (SELECT user_id, event_id AS id, epoch_us(ts - INTERVAL 3 HOUR) AS s, epoch_us(ts + INTERVAL 3 HOUR) AS e FROM events WHERE event_type IN ('purchase', 'click'))
SELECT a.user_id, a.id AS a, b.id AS b, least(a.e, b.e) - b.s AS overlap_us FROM s a JOIN s b ON a.user_id = b.user_id AND (a.s < b.s OR (a.s = b.s AND a.id < b.id)) AND b.s < a.e
WHERE least(a.e, b.e) - b.s >= 10800000000 OR least(a.e, b.e) - b.s >= 0.4 * least(a.e - a.s, b.e - b.s)""",
    "protected_overlap": """SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'error' AND p.user_id = e.user_id
  AND e.ts - INTERVAL 1 HOUR <= p.ts + INTERVAL 2 HOUR AND e.ts + INTERVAL 1 HOUR >= p.ts - INTERVAL 2 HOUR)""",
    "next_pairs": """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM r a JOIN r b ON a.user_id = b.user_id AND b.n BETWEEN a.n + 1 AND a.n + 8 AND b.ts - a.ts <= INTERVAL 14 DAY""",
    "nearest_sample": """WITH a AS (SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, round(age, 6) AS age FROM a WHERE age >= 3 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(age - 7), age DESC, l_linenumber DESC) = 1""",
    "latest_sample": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC) = 1",
    "thinned": """WITH t AS (SELECT user_id, list_sort(list(epoch_us(ts))) AS ts FROM events GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(ts, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= 43200000000 THEN list_concat(a, b) ELSE a END) AS kept FROM t)
SELECT user_id, unnest(kept) AS kept_us FROM k""",
    "bursts": """WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id),
l AS (SELECT e.user_id, ts, event_id, (value >= m + 5)::INT AS loud FROM events e JOIN m ON e.user_id = m.user_id),
b AS (SELECT *, CASE WHEN loud = 1 AND coalesce(lag(loud) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS b FROM l),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM r WHERE loud = 1 GROUP BY user_id, run HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 300000""",
    "longest_gap": """WITH p AS (SELECT user_id, epoch_us(ts) AS us FROM events UNION ALL SELECT DISTINCT user_id, unnest([epoch_us(TIMESTAMP '2024-01-01'), epoch_us(TIMESTAMP '2024-02-01')]) FROM events),
s AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) - us AS gap FROM p)
SELECT user_id, gap AS gap_us, us AS gap_start_us FROM s WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, us) = 1""",
    "peaks": """WITH p AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, value FROM p WHERE value >= 40 AND (b IS NULL OR value > b) AND (a IS NULL OR value >= a)""",
    "busiest_hour": """WITH c AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL '3599.999999' SECOND FOLLOWING) AS n FROM events)
SELECT user_id, max(n) AS most FROM c GROUP BY user_id""",
    "evenings": "SELECT (ts + INTERVAL 1 HOUR - INTERVAL 6 HOUR)::DATE::VARCHAR AS evening, count(*) AS n FROM events GROUP BY 1",
    "night_events": "SELECT event_type, count(*) AS n FROM events WHERE hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 375 GROUP BY event_type",
    "tempo": """WITH s AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000.0::DOUBLE AS step FROM events),
m AS (SELECT user_id, median(step) AS m FROM s GROUP BY user_id)
SELECT user_id, round(m, 6) AS median_h, round(CASE WHEN m IS NULL THEN NULL WHEN m <= 1 THEN 0 WHEN m < 5 THEN (m - 1) / 4 WHEN m <= 8 THEN 1 WHEN m < 20 THEN (20 - m) / 12 ELSE 0 END, 6) AS tempo FROM m""",
}
