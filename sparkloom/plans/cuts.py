"""Timelines of users: purchases as segments, other events as the beats they snap to; half an hour there is 0.1 seconds here."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cutting as C
from .base import rounded, table

LEAST_S, FPS = 2.0, 30.0


def _timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 18_000.0
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    i = F.col("event_id")
    core = 3.0 + (i % 50) / 10.0
    segments = e.where("event_type = 'purchase'").select("user_id", number.alias("nr"), core.alias("core_begin"), (core + 1 + (i % 30) / 10.0).alias("core_end"), (core + 0.3).alias("must_begin"), (core + 0.3 + (i % 25) / 10.0).alias("must_end"), (9.0 + (i % 60) / 10.0).alias("source_s"), (2.5 + (i % 7) / 2.0).alias("most_s"), ((i % 5) / 4.0).alias("wanted_s"))
    grid = e.where("event_type <> 'purchase' and user_id % 10 > 0").select("user_id", at.alias("at"))
    return C.with_handles(C.timeline(segments, grid, "user_id", "nr", "at", LEAST_S), "user_id", "nr", "wanted_s", FPS)


def snapped_timeline(spark, sf_dir):
    out = _timeline(spark, sf_dir)
    return out.select("user_id", "nr", *[rounded(c, 5).alias(c) for c in ("time_begin", "time_end", "source_begin", "source_end", "transition_s")], "on_beat")


QUERIES = {"snapped_timeline": snapped_timeline}

ORACLE = {
    "snapped_timeline": f"""
WITH RECURSIVE given AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr, 3.0::DOUBLE + (event_id % 50) / 10.0::DOUBLE AS core, (event_id % 30) / 10.0::DOUBLE AS c, (event_id % 25) / 10.0::DOUBLE AS m,
    9.0::DOUBLE + (event_id % 60) / 10.0::DOUBLE AS source_s, 2.5::DOUBLE + (event_id % 7) / 2.0::DOUBLE AS most_s, (event_id % 5) / 4.0::DOUBLE AS wanted FROM events WHERE event_type = 'purchase'),
sizes AS (SELECT *, core + 1 + c AS core_end, core + 0.3 AS must_begin, core + 0.3 + m AS must_end, greatest(0.5, source_s - 0.25) AS usable FROM given),
wishes AS (SELECT *, greatest({LEAST_S}, greatest(0.5, must_end - must_begin)) AS low, least(most_s, greatest({LEAST_S}, core_end - core, greatest(0.5, must_end - must_begin)), usable) AS wish FROM sizes),
seg AS (SELECT *, least(usable, greatest(wish, greatest(0.5, must_end - must_begin)) + 2.0) AS high, greatest(least(wish, usable), least(low, usable)) AS plain FROM wishes),
grid AS (SELECT user_id, list(CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) / 18000.0::DOUBLE) AS beats FROM events WHERE event_type <> 'purchase' AND user_id % 10 > 0 GROUP BY user_id),
fold(user_id, nr, t0, t1, hit) AS (
  SELECT user_id, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, FALSE FROM seg WHERE nr = 1
  UNION ALL
  SELECT f.user_id, s.nr, f.t1,
    coalesce(list_sort(list_transform(list_filter(g.beats, lambda b: b - f.t1 >= s.low - 1e-6 AND b - f.t1 <= s.high + 1e-6), lambda b: {{'d': abs(b - (f.t1 + s.wish)), 'b': b}}))[1].b, f.t1 + s.plain),
    coalesce(len(list_filter(g.beats, lambda b: b - f.t1 >= s.low - 1e-6 AND b - f.t1 <= s.high + 1e-6)) > 0, FALSE)
  FROM fold f JOIN seg s ON s.user_id = f.user_id AND s.nr = f.nr + 1 LEFT JOIN grid g ON g.user_id = f.user_id),
placed AS (SELECT s.*, t0, t1, hit, t1 - t0 AS len, core - 0.6 * (t1 - t0 - (core_end - core)) AS s0 FROM fold f JOIN seg s USING (user_id, nr)),
src AS (SELECT *, greatest(0, least(greatest(least(s0, must_begin), must_end - len), usable - len)) AS b FROM placed),
room AS (SELECT *, lag(source_s - (b + len)) OVER (PARTITION BY user_id ORDER BY nr) AS rest FROM src)
SELECT user_id, CAST(nr AS INTEGER) AS nr, round(t0, 5) AS time_begin, round(t1, 5) AS time_end, round(b, 5) AS source_begin, round(b + len, 5) AS source_end,
  round(CASE WHEN rest IS NULL OR least(wanted, 2 * greatest(0, least(rest, b))) < 2.0 / {FPS} THEN 0 ELSE least(wanted, 2 * greatest(0, least(rest, b))) END, 5) AS transition_s, hit AS on_beat FROM room""",
}
