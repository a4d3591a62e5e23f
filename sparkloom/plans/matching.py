"""Queries of rows that meet in time or by what they cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from .base import rounded, table


def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


def value_pairs(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase").withColumn("trust", F.col("value") / 100.0)
    p = M.banded_pairs(e, "user_id", "ts", "event_id", "value", "trust", 2 * 86_400, 15.0, F.lit("2024-02-01 00:00:00").cast("timestamp"), 60.0)
    return p.select(F.col("key").alias("user_id"), "good", "bad", rounded("weight").alias("weight"))


def near_clicks(spark, sf_dir):
    s = M.near_share(_events(spark, sf_dir, "error"), _events(spark, sf_dir, "click"), "user_id", "ts", 3600)
    return s.select("user_id", rounded("share").alias("share"))


def merged_errors(spark, sf_dir):
    m = M.merged_changes(_events(spark, sf_dir, "error"), "user_id", "ts", "value", 2 * 86_400)
    return m.select("user_id", "us", rounded("strength").alias("strength"), "n")


def commonest_kinds(spark, sf_dir):
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("kinds"))
    g = M.largest_group(kinds, "kinds")
    return g.select(F.array_join("kinds", ",").alias("kinds"), "n")


def event_phases(spark, sf_dir):
    begin, end = (F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-25 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", rounded(M.phase(F.col("ts"), begin, end)).alias("phase"))


def order_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "blocked").otherwise("done")
    r = M.job_report(o, "o_orderpriority", result, F.col("o_totalprice"), F.col("o_totalprice") / 2, F.col("o_custkey") % 3)
    shown = F.array_join(F.transform(F.map_entries("error_kinds"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return r.select("kind", "n", "blocked", "errors", *[rounded(c, 4).alias(c) for c in ("held_median", "held_p90", "held_max", "waited_median", "waited_p90", "waited_max")], shown.alias("error_kinds"))


QUERIES = {f.__name__: f for f in (value_pairs, near_clicks, merged_errors, commonest_kinds, event_phases, order_report)}

ORACLE = {
    "value_pairs": """WITH p AS (SELECT user_id, event_id AS id, ts, value AS y, value / 100.0 AS c FROM events WHERE event_type = 'purchase')
SELECT a.user_id, CASE WHEN a.y > b.y THEN a.id ELSE b.id END AS good, CASE WHEN a.y > b.y THEN b.id ELSE a.id END AS bad,
  round(2.0 * sqrt(a.c * b.c) * (0.25 + 0.75 * pow(2.0, -((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(a.ts)) / 86400000000.0) / 60.0)), 6) AS weight
FROM p a JOIN p b ON a.user_id = b.user_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) AND b.ts - a.ts <= INTERVAL 2 DAY AND abs(a.y - b.y) >= 15.0""",
    "near_clicks": """SELECT e.user_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id
  AND abs(epoch_us(c.ts) - epoch_us(e.ts)) <= 3600000000) THEN 1.0 ELSE 0.0 END), 6) AS share FROM events e WHERE event_type = 'error' GROUP BY 1""",
    "merged_errors": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'error'),
k AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1
  UNION ALL SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + 172800000000) FROM k
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + 172800000000)),
n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS until FROM k)
SELECT n.user_id, n.us, round(max(e.value), 6) AS strength, count(*) AS n FROM n JOIN e ON e.user_id = n.user_id AND e.us >= n.us AND (n.until IS NULL OR e.us < n.until) GROUP BY 1, 2""",
    "commonest_kinds": """WITH g AS (SELECT list_sort(list(DISTINCT l_linestatus)) AS kinds FROM lineitem GROUP BY l_orderkey)
SELECT array_to_string(kinds, ',') AS kinds, count(*) AS n FROM g GROUP BY g.kinds ORDER BY n DESC, len(g.kinds) DESC, g.kinds DESC LIMIT 1""",
    "event_phases": """SELECT event_id, round(greatest(0.0, least(1.0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05'))
  / (epoch_us(TIMESTAMP '2024-01-25') - epoch_us(TIMESTAMP '2024-01-05'))::DOUBLE)), 6) AS phase FROM events""",
    "order_report": """WITH k AS (SELECT kind, string_agg(error || ':' || times, ',' ORDER BY error) AS error_kinds FROM
  (SELECT o_orderpriority AS kind, (o_custkey % 3)::VARCHAR AS error, count(*) AS times FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS blocked, count(*) FILTER (o_orderstatus = 'F') AS errors,
  round(median(o_totalprice) FILTER (o_orderstatus <> 'P'), 4) AS held_median, round(max(o_totalprice) FILTER (o_orderstatus <> 'P'), 4) AS held_max,
  round(quantile_disc(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 0.9), 4) AS held_p90, round(quantile_disc(o_totalprice / 2, 0.9), 4) AS waited_p90,
  round(median(o_totalprice / 2), 4) AS waited_median, round(max(o_totalprice / 2), 4) AS waited_max, any_value(k.error_kinds) AS error_kinds
FROM orders LEFT JOIN k ON k.kind = o_orderpriority GROUP BY 1""",
}
