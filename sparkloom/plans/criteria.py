"""Criteria queries over ``events`` (clicks stand for cuts), ``documents`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria as K
from .base import rounded, table

HOUR = 3600


def _cut():
    return F.col("event_type") == "click"


def value_onsets(spark, sf_dir):
    k = K.onsets(table(spark, sf_dir, "events"), "user_id", "ts", "value", 6.0, (48 * HOUR, HOUR), 24 * HOUR)
    return k.select("user_id", F.col("kept").alias("kept_us"))


def purchase_rhythm(spark, sf_dir):
    r = K.rhythm(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", "ts", "event_id")
    return r.select("user_id", "n", rounded("middle", 3).alias("middle"), rounded("spread").alias("spread"), rounded("trend").alias("trend"))


def around_clicks(spark, sf_dir):
    a = K.around(table(spark, sf_dir, "events"), _cut(), "user_id", "ts", "event_id", "value", 3)
    return a.select("event_id", rounded("before").alias("before"), rounded("after").alias("after"))


def normalised_motion(spark, sf_dir):
    n = K.normalised(table(spark, sf_dir, "events"), _cut(), "user_id", "ts", "value", 6 * HOUR, "motion")
    return n.select("event_id", rounded("motion").alias("motion"))


def impulses(spark, sf_dir):
    i = K.impulses(table(spark, sf_dir, "events"), _cut(), "user_id", "ts", "event_id", "value", 15.0, HOUR, 12 * HOUR)
    return i.select("user_id", F.col("kept").alias("kept_us"))


def near_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'error'").select("user_id", (F.col("ts") - F.make_dt_interval(hours=F.lit(6))).alias("start"), (F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("end"))
    return K.inside_median(e, s, "user_id", "ts", "value").select("user_id", rounded("inside").alias("inside"), "n")


def cooling_parts(spark, sf_dir):
    c = K.cooling(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_shipdate", 90 * 86_400, 400, 1)
    return c.select("l_partkey", "recent", "blocked")


def _document_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = {"quality": (3.0, F.col("quality").cast("double")), "length": (1.0, F.least(F.col("n_chars") / 2000.0, F.lit(1.0))), "calm": (2.0, 1.0 - F.col("toxic").cast("double"))}
    gates = {"calm": F.col("toxic") == 0, "long": F.col("n_chars") >= 100}
    return d, parts, K.first_gate(gates)


def document_totals(spark, sf_dir):
    d, parts, gate = _document_parts(spark, sf_dir)
    moods = K.best_mood({"good": F.coalesce(F.col("quality"), F.lit(0)) * 2, "long": F.floor(F.col("n_chars") / 3000), "plain": F.lit(1)})
    return d.select(
        "doc_id", gate.alias("gate"), rounded(K.total(parts, gate.isNotNull()), 4).alias("total"), F.array_join(K.losses(parts, 2), ",").alias("losses"),
        K.level(F.col("n_chars"), [100, 1000, 5000]).alias("level"), moods["name"].alias("mood"), moods["margin"].cast("long").alias("margin"),
    )


QUERIES = {f.__name__: f for f in (value_onsets, purchase_rhythm, around_clicks, normalised_motion, impulses, near_errors, cooling_parts, document_totals)}

_THIN = """t AS (SELECT user_id, list_sort(list(epoch_us(ts))) AS ts FROM r GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(ts, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] >= {} THEN list_concat(a, b) ELSE a END) AS kept FROM t)
SELECT user_id, unnest(kept) AS kept_us FROM k"""

ORACLE = {
    "value_onsets": """WITH l AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS low FROM events),
r AS (SELECT * FROM l WHERE value - low >= 6), """ + _THIN.format(86_400_000_000),
    "purchase_rhythm": """WITH s AS (SELECT user_id, ts, event_id, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000000.0::DOUBLE AS step FROM events WHERE event_type = 'purchase'),
h AS (SELECT *, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS half FROM s WHERE step IS NOT NULL)
SELECT user_id, count(*) AS n, round(median(step), 3) AS middle, round(stddev_pop(step) / avg(step), 6) AS spread, round(median(step) FILTER (half = 2) / median(step) FILTER (half = 1), 6) AS trend FROM h GROUP BY user_id""",
    "around_clicks": """WITH a AS (SELECT event_id, event_type, avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(b, 6) AS before, round(a, 6) AS after FROM a WHERE event_type = 'click'""",
    "normalised_motion": """WITH q AS (SELECT user_id, value FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts + INTERVAL 6 HOUR)),
m AS (SELECT user_id, median(value) AS m FROM q GROUP BY user_id)
SELECT event_id, round(CASE WHEN m <> 0 THEN value / m END, 6) AS motion FROM events e LEFT JOIN m ON e.user_id = m.user_id""",
    "impulses": """WITH j AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS jump FROM events),
r AS (SELECT * FROM j e WHERE jump >= 15 AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR)), """ + _THIN.format(43_200_000_000),
    "near_errors": """SELECT user_id, round(median(value), 6) AS inside, count(*) AS n FROM events e
WHERE EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'error' AND e.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR) GROUP BY user_id""",
    "cooling_parts": """WITH f AS (SELECT l_orderkey AS f, max(l_shipdate) AS t FROM lineitem GROUP BY 1), l AS (SELECT f FROM f ORDER BY t DESC, f LIMIT 400),
e AS (SELECT DISTINCT l_orderkey AS f, l_partkey FROM lineitem)
SELECT l_partkey, count(*) FILTER (t >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY) AS recent, count(*) FILTER (e.f IN (SELECT f FROM l)) > 1 AS blocked FROM e JOIN f ON e.f = f.f GROUP BY l_partkey""",
    "document_totals": """WITH d AS (SELECT d.doc_id, n_chars, quality::DOUBLE AS q, 1 - toxic::DOUBLE AS c, least(n_chars / 2000.0::DOUBLE, 1) AS l, quality, toxic FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id),
g AS (SELECT *, CASE WHEN toxic <> 0 THEN 'calm' WHEN n_chars < 100 THEN 'long' END AS gate,
    100 * (coalesce(q * 3, 0) + coalesce(l, 0) + coalesce(c * 2, 0)) / (CASE WHEN q IS NULL THEN 0 ELSE 3 END + 1 + CASE WHEN c IS NULL THEN 0 ELSE 2 END) AS t,
    list_filter([{'m': (q - 1) * 3, 'n': 'quality'}, {'m': l - 1, 'n': 'length'}, {'m': (c - 1) * 2, 'n': 'calm'}], lambda x: x.m < 0) AS k,
    list_sort([{'m': -2 * coalesce(quality, 0), 'i': 0, 'n': 'good'}, {'m': -floor(n_chars / 3000)::BIGINT, 'i': 1, 'n': 'long'}, {'m': -1, 'i': 2, 'n': 'plain'}]) AS s FROM d)
SELECT doc_id, gate, round(CASE WHEN gate IS NOT NULL THEN least(t, 40) ELSE t END, 4) AS total, array_to_string(list_transform(list_sort(k)[:2], lambda x: x.n), ',') AS losses,
  (n_chars >= 100)::INT + (n_chars >= 1000)::INT + (n_chars >= 5000)::INT AS level, s[1].n AS mood, (s[2].m - s[1].m)::BIGINT AS margin FROM g""",
}
