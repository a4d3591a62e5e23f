"""Guarded changes of users' states, and flashes of a series of brightness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flashes as L
from ..operators import transitions as T
from .base import table

STATES = ["new", "rated", "sent", "approved", "rejected", "published"]
_GUARDS = {"view": (["new", "rejected"], "rated"), "click": (["rated"], "sent"), "purchase": (["sent", "rejected"], "approved"), "error": (["sent", "approved", "gone"], "rejected"), "signup": (["approved"], "published")}


def guarded_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    guard, target = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for name, (allowed, to) in _GUARDS.items():
        guard, target = F.when(kind == name, F.array(*[F.lit(a) for a in allowed])).otherwise(guard), F.when(kind == name, F.lit(to)).otherwise(target)
    requests = e.select("user_id", "event_id", "ts", guard.alias("guard"), F.when(F.col("event_id") % 41 == 0, "lost").otherwise(target).alias("target"))
    begin = e.select("user_id").distinct().where("user_id % 3 = 0").select("user_id", F.when(F.col("user_id") % 2 == 0, "approved").otherwise("sent").alias("state"))
    return T.guarded(requests, begin, "user_id", "ts", "event_id", "guard", "target", STATES).select("event_id", "user_id", "before", "after", "done")


def _levels(spark, sf_dir):
    """key, at (an hour is 0.1 s), level: users' events as a picture's levels, ten users one key."""
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) * 28
    return e.select((F.col("user_id") % 15).alias("key"), us.alias("at"), F.when(F.col("event_id") % 9 > 0, 16 + F.pmod(F.col("event_id") * 37, F.lit(220))).alias("level"))


def flash_counts(spark, sf_dir):
    series = _levels(spark, sf_dir).withColumn("light", L.brightness(F.col("level")))
    found = L.turning_points(series, "key", "at", "light", piece_s=5.0)
    return L.most_flashes(found, "key", "at", series).select("key", F.col("flashes").cast("long").alias("flashes"))


QUERIES = {f.__name__: f for f in (guarded_changes, flash_counts)}

_ALLOWED = " ".join(f"WHEN '{k}' THEN {a!r}" for k, (a, _) in _GUARDS.items())
_TO = " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t) in _GUARDS.items())

ORACLE = {
    "guarded_changes": f"""
WITH RECURSIVE asked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr, CASE event_type {_ALLOWED} END AS guard, CASE WHEN event_id % 41 = 0 THEN 'lost' ELSE CASE event_type {_TO} END END AS target FROM events),
fold(user_id, nr, event_id, before, after, done) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, '', CASE WHEN user_id % 3 > 0 THEN 'new' WHEN user_id % 2 = 0 THEN 'approved' ELSE 'sent' END, FALSE FROM events
  UNION ALL
  SELECT a.user_id, a.nr, a.event_id, f.after, CASE WHEN coalesce(list_contains(a.guard, f.after) AND a.target <> 'lost', FALSE) THEN a.target ELSE f.after END, coalesce(list_contains(a.guard, f.after) AND a.target <> 'lost', FALSE)
  FROM fold f JOIN asked a ON a.user_id = f.user_id AND a.nr = f.nr + 1)
SELECT event_id, user_id, before, after, done FROM fold WHERE nr > 0""",
    "flash_counts": f"""
WITH RECURSIVE given AS (SELECT user_id % 15 AS key, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) * 28 AS us, CASE WHEN event_id % 9 > 0 THEN power(greatest(0.0, least(1.0, (16 + event_id * 37 % 220 - {L.BLACK}) / {L.RANGE})), {L.GAMMA}) END AS v FROM events),
series AS (SELECT key, us, v, row_number() OVER (PARTITION BY key ORDER BY us, v) AS nr FROM given WHERE v IS NOT NULL),
fold(key, nr, us, extreme, way, turn) AS (
  SELECT key, nr, us, v, 0, FALSE FROM series WHERE nr = 1
  UNION ALL
  SELECT s.key, s.nr, s.us,
    CASE WHEN (way > 0 AND v > extreme) OR (way < 0 AND v < extreme) OR (abs(v - extreme) >= {L.STEP} AND least(v, extreme) < {L.DARK}) THEN v ELSE extreme END,
    CASE WHEN (way > 0 AND v > extreme) OR (way < 0 AND v < extreme) THEN way WHEN abs(v - extreme) >= {L.STEP} AND least(v, extreme) < {L.DARK} THEN CASE WHEN v > extreme THEN 1 ELSE -1 END ELSE way END,
    NOT ((way > 0 AND v > extreme) OR (way < 0 AND v < extreme)) AND abs(v - extreme) >= {L.STEP} AND least(v, extreme) < {L.DARK}
  FROM fold f JOIN series s ON s.key = f.key AND s.nr = f.nr + 1),
counts AS (SELECT key, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) // 2 AS n FROM fold WHERE turn)
SELECT k.key, coalesce(max(n), 0) AS flashes FROM (SELECT DISTINCT key FROM given) k LEFT JOIN counts USING (key) GROUP BY k.key""",
}
