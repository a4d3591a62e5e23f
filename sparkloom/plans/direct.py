"""Queries that apply single operators to whole tables: sessions, messages, cutoffs, keys, hashes, features, plausibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import timeline as T
from ..streaming import ingest
from .base import rounded, table


def user_sessions(spark, sf_dir):
    s = ingest.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours", "45 minutes")
    return s.select("user_id", T.micros("start").alias("start_us"), T.micros("last").alias("last_us"), "n")


def known_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(S.composite_key(F.col("event_type"), F.col("user_id")).alias("message"), "ts")
    return ingest.first_messages(e, "message", "ts", "1 day").select("message")


def weekly_counts(spark, sf_dir):
    """Events between neighbouring cutoffs: Sundays at 18:00 in Berlin."""
    at = S.utc_time(F.col("ts"))
    e = table(spark, sf_dir, "events").select(S.instant(at, "UTC").alias("t"))
    first, last = e.agg(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
    cuts = T.weekly_cutoffs(F.timestamp_micros(F.lit(first or 0)), F.timestamp_micros(F.lit(last or 0)), "Europe/Berlin", 7, 18)
    week = F.size(F.filter(cuts, lambda c: c <= F.col("t")))
    return e.select(week.cast("long").alias("week")).groupBy("week").agg(F.count("*").alias("n"))


def keyed_hashes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", S.composite_key(F.col("event_type"), F.col("user_id")).alias("item"),
        S.canonical_hash(user=F.col("user_id"), kind=F.col("event_type"), none=F.lit(None).cast("string")).alias("hash"),
        S.hamming(F.col("event_id") * 7919, F.col("user_id") * 104729).cast("long").alias("apart"),
    )


def elo_chances(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", rounded(S.elo_expected(F.col("p_retailprice"), F.lit(1000.0) + F.col("p_partkey") % 400)).alias("chance"))


def line_features(spark, sf_dir):
    """A weighted sum over what a line has; returned lines have no tax, and large quantities are capped."""
    li = table(spark, sf_dir, "lineitem")
    own = F.map_from_arrays(F.array(F.lit("quantity"), F.lit("discount")), F.array("l_quantity", "l_discount"))
    tax = F.when(F.col("l_returnflag") != "R", F.map_from_arrays(F.array(F.lit("tax")), F.array("l_tax"))).otherwise(F.create_map().cast("map<string,double>"))
    features = S.merged_maps(own, tax, cap=20.0)
    score = S.feature_sum(features, {"quantity": 0.5, "discount": -10.0, "tax": 2.0})
    return li.select("l_orderkey", "l_linenumber", rounded(score).alias("score"), F.size(features).cast("long").alias("n"))


def implausible_events(spark, sf_dir):
    """What can't be against the user's event before: a value that fell, watch time of the value, share of it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(order))
    what = S.implausible({"value": F.col("value")}, {"value": F.col("before")}, F.col("value") * 2, F.lit(60.0), F.col("value") * 3)
    return e.select("event_id", F.array_join(what, ",").alias("what"), rounded(S.measured(F.col("value") - 20)).alias("over"))


QUERIES = {f.__name__: f for f in (user_sessions, known_messages, weekly_counts, keyed_hashes, elo_chances, line_features, implausible_events)}

ORACLE = {
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM c GROUP BY user_id, s""",
    "known_messages": "SELECT DISTINCT event_type || ':' || user_id AS message FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL",
    "weekly_counts": """WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 17:00:00', (SELECT max(ts) FROM events), INTERVAL 7 DAY)) AS cut),
k AS (SELECT cut FROM c WHERE cut >= (SELECT min(ts) FROM events))
SELECT (SELECT count(*) FROM k WHERE k.cut <= e.ts) AS week, count(*) AS n FROM events e GROUP BY 1""",
    "keyed_hashes": """SELECT event_id, event_type || ':' || user_id AS item,
  sha256('{"kind":"' || event_type || '","none":null,"user":' || user_id || '}') AS hash,
  bit_count(xor(event_id * 7919, user_id * 104729))::BIGINT AS apart FROM events""",
    "elo_chances": "SELECT p_partkey, round(1.0 / (1.0 + pow(10.0, (1000.0 + p_partkey % 400 - p_retailprice) / 400.0)), 6) AS chance FROM part",
    "line_features": """SELECT l_orderkey, l_linenumber, round(0.5 * least(l_quantity, 20.0) - 10.0 * least(l_discount, 20.0)
  + CASE WHEN l_returnflag <> 'R' THEN 2.0 * least(l_tax, 20.0) ELSE 0 END, 6) AS score, CASE WHEN l_returnflag <> 'R' THEN 3 ELSE 2 END::BIGINT AS n FROM lineitem""",
    "implausible_events": """WITH b AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, concat_ws(',', CASE WHEN value < before THEN 'value' END, CASE WHEN value * 2 > 90 THEN 'watch' END, CASE WHEN value * 3 > 100 THEN 'full' END) AS what,
  CASE WHEN value >= 20 THEN round(value - 20, 6) END AS over FROM b""",
}
