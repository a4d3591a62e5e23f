"""Rhythm of what users do: events an hour as an onset series, a day's rhythm as its tempo."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audio as A
from .base import rounded, table

#: An hour is a step; 24 of them are a second, so a rhythm of a day is 60 a minute.
FPS = 24.0
_TEMPI = {"slowest": 20.0, "fastest": 240.0, "likely": 60.0}


def _hours(spark, sf_dir):
    """user_id, hour, value: a user's events in each hour of the table's time, without gaps."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 60).cast("long")
    counts = e.groupBy("user_id", hour.alias("hour")).agg(F.sum(F.round("value").cast("long")).alias("value"))
    spans = e.agg(F.min(hour).alias("a"), F.max(hour).alias("z"))  # a row
    whole = e.select("user_id").distinct().crossJoin(F.broadcast(spans)).select("user_id", F.explode(F.sequence("a", "z")).alias("hour"))
    return whole.join(counts, ["user_id", "hour"], "left").select("user_id", (F.col("hour") - F.min("hour").over(Window.partitionBy("user_id"))).alias("hour"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def _envelope(spark, sf_dir):
    return A.onset_envelope(_hours(spark, sf_dir), "user_id", "hour", "value", FPS)


def onset_envelopes(spark, sf_dir):
    return _envelope(spark, sf_dir).select("user_id", "hour", rounded("value").alias("value"))


def user_tempos(spark, sf_dir):
    found = A.tempos(_envelope(spark, sf_dir), "user_id", "hour", "value", FPS, **_TEMPI)
    return found.select("user_id", rounded("bpm", 5).alias("bpm"), rounded(A.folded_tempo(F.col("bpm")), 5).alias("folded"))


def user_beats(spark, sf_dir):
    envelope = _envelope(spark, sf_dir)
    found = A.tempos(envelope, "user_id", "hour", "value", FPS, **_TEMPI)
    return A.beats(envelope, found, "user_id", "hour", "value", FPS, 0.0)


QUERIES = {f.__name__: f for f in (onset_envelopes, user_tempos, user_beats)}

_ENVELOPE = """hours AS (SELECT user_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS hour, sum(CAST(round(value) AS BIGINT)) AS value FROM events GROUP BY ALL),
span AS (SELECT min(hour) AS a, max(hour) AS z FROM hours),
grid AS (SELECT user_id, unnest(generate_series(a, z)) AS hour FROM (SELECT DISTINCT user_id FROM events), span),
plain AS (SELECT g.user_id, g.hour - (SELECT a FROM span) AS hour, CAST(coalesce(value, 0) AS DOUBLE) AS v FROM grid g LEFT JOIN hours h ON h.user_id = g.user_id AND h.hour = g.hour),
risen AS (SELECT user_id, hour, greatest(0, v - sum(v) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) / 24) AS r FROM plain),
env AS (SELECT user_id, hour, CASE WHEN stddev_pop(r) OVER (PARTITION BY user_id) > 0 THEN r / stddev_pop(r) OVER (PARTITION BY user_id) ELSE r END AS e FROM risen)"""

ORACLE = {
    "onset_envelopes": f"WITH {_ENVELOPE} SELECT user_id, hour, round(e, 6) AS value FROM env",
    "user_tempos": f"""WITH {_ENVELOPE},
centred AS (SELECT user_id, hour, e - avg(e) OVER (PARTITION BY user_id) AS h FROM env),
products AS (SELECT a.user_id, k, sum(a.h * b.h) AS ak FROM centred a CROSS JOIN generate_series(6, 72) t(k) JOIN centred b ON b.user_id = a.user_id AND b.hour = a.hour + k GROUP BY a.user_id, k),
sums AS (SELECT user_id, k, ak * exp(-0.5 * power(log2(1440.0 / k / 60), 2)) AS w FROM products),
best AS (SELECT *, lag(w) OVER u AS a, lead(w) OVER u AS c, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, k) AS place FROM sums WINDOW u AS (PARTITION BY user_id ORDER BY k)),
tempo AS (SELECT user_id, 1440 / (k + coalesce(CASE WHEN a - 2 * w + c <> 0 THEN 0.5 * (a - c) / (a - 2 * w + c) END, 0)) AS bpm FROM best WHERE place = 1),
raised AS (SELECT *, bpm * power(2, greatest(0, ceil(log2(75 / bpm)))) AS up FROM tempo)
SELECT user_id, round(bpm, 5) AS bpm, round(up / power(2, greatest(0, ceil(log2(up / 185)))), 5) AS folded FROM raised""",
}
