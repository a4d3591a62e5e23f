"""Alerts from errors, messages held back at night, and experiments with parts' sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import experiments as X
from .base import rounded, table

HOUR = 3600
NIGHT = ("Europe/Berlin", "23:00", "08:00")


def coalesced_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'click')")
    kind = F.when(F.col("user_id") % 11 > 0, F.concat(F.col("event_type"), F.lit(":"), (F.col("user_id") % 40).cast("string")))
    told = e.select(kind.alias("kind"), "ts", "event_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text"))
    return A.coalesced(told, "kind", "ts", "event_id", "text", 6 * HOUR, 18 * HOUR)


def quiet_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    due = A.due(F.col("ts"), F.col("event_type") != "error", *NIGHT)
    return e.select("event_id", F.unix_micros(due).alias("due_us"))


def _options(spark, sf_dir):
    """knob, value, place, expected, and what is known of them: brands' part sizes, what lines of such parts brought."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("knob"), (F.floor(F.col("p_size") / 10) / 5.0).alias("value"), (F.col("p_size") / 50.0).alias("seen"), "l_discount", "l_tax")
    options = lines.groupBy("knob", "value").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100.0).alias("expected"), (F.col("value") * 5).alias("place"))
    examples = lines.where("l_tax > 0.07").select("knob", F.col("seen").alias("value"), F.round(F.col("l_discount") * 10).cast("long").alias("weight"))
    return options, examples


def option_uses(spark, sf_dir):
    options, examples = _options(spark, sf_dir)
    rated = X.judged(X.supported(options, examples, "knob", "value", "weight"), "knob", "place", "expected")
    return rated.select("knob", "value", rounded("support", 5).alias("support"), rounded("use", 8).alias("use"), "rank", rounded("certainty", 8).alias("certainty"))


def next_experiments(spark, sf_dir):
    options, examples = _options(spark, sf_dir)
    rated = X.judged(X.supported(options, examples, "knob", "value", "weight"), "knob", "place", "expected")
    steps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"))
    current = options.groupBy("knob").agg(F.min("value").alias("value"))
    return X.next_experiment(rated, current, steps, "knob", "place", "value")


QUERIES = {f.__name__: f for f in (coalesced_alerts, quiet_messages, option_uses, next_experiments)}

_RATED = """lines AS (SELECT p_brand AS knob, floor(p_size / 10) / 5.0::DOUBLE AS value, p_size / 50.0::DOUBLE AS seen, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey),
options AS (SELECT knob, value, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100.0::DOUBLE AS expected, value * 5 AS place FROM lines GROUP BY knob, value),
examples AS (SELECT knob, seen, CAST(round(l_discount * 10) AS BIGINT) AS w FROM lines WHERE l_tax > 0.07),
support AS (SELECT o.knob, o.value, any_value(expected) AS expected, any_value(place) AS place, coalesce(sum(w * exp(-0.5 * power((seen - o.value) / 0.22, 2))), 0) AS support FROM options o LEFT JOIN examples e ON e.knob = o.knob GROUP BY o.knob, o.value),
uses AS (SELECT *, expected - 0.06 / (1 + support) AS use FROM support),
ranked AS (SELECT *, row_number() OVER (PARTITION BY knob ORDER BY use DESC, place DESC) AS rank FROM uses),
rated AS (SELECT *, coalesce(abs(max(use) FILTER (rank = 1) OVER (PARTITION BY knob) - max(use) FILTER (rank = 2) OVER (PARTITION BY knob)), 1) AS certainty FROM ranked)"""

ORACLE = {
    "coalesced_alerts": """
WITH RECURSIVE told AS (SELECT event_type || ':' || user_id % 40 AS kind, (epoch_us(ts) // 21600000000 + 1) * 21600000000 AS tick_us, ts, event_id FROM events WHERE event_type IN ('error', 'click') AND user_id % 11 > 0),
ticks AS (SELECT kind, tick_us, count(*) - 1 AS more, arg_max('event ' || event_id, (ts, event_id)) AS text, row_number() OVER (PARTITION BY kind ORDER BY tick_us) AS nr FROM told GROUP BY kind, tick_us),
fold(kind, nr, tick_us, sent, now) AS (
  SELECT kind, nr, tick_us, tick_us, TRUE FROM ticks WHERE nr = 1
  UNION ALL
  SELECT t.kind, t.nr, t.tick_us, CASE WHEN t.tick_us - f.sent > 64800000000 THEN t.tick_us ELSE f.sent END, t.tick_us - f.sent > 64800000000 FROM fold f JOIN ticks t ON t.kind = f.kind AND t.nr = f.nr + 1)
SELECT kind, tick_us, text, more FROM fold JOIN ticks USING (kind, nr, tick_us) WHERE now""",
    "quiet_messages": """
WITH local AS (SELECT event_id, event_type, ts, timezone('Europe/Berlin', timezone('UTC', ts)) AS here FROM events),
ends AS (SELECT *, hour(here) >= 23 OR hour(here) < 8 AS night, date_trunc('day', here) + CASE WHEN hour(here) >= 8 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END + INTERVAL 8 HOUR AS until FROM local)
SELECT event_id, epoch_us(CASE WHEN night AND event_type <> 'error' THEN timezone('Europe/Berlin', until) ELSE timezone('UTC', ts) END) AS due_us FROM ends""",
    "option_uses": f"WITH {_RATED} SELECT knob, value, round(support, 5) AS support, round(use, 8) AS use, CAST(rank AS INTEGER) AS rank, round(certainty, 8) AS certainty FROM rated",
    "next_experiments": f"""WITH {_RATED},
others AS (SELECT r.* FROM rated r JOIN (SELECT knob, min(value) AS now FROM options GROUP BY knob) USING (knob) WHERE value <> now),
least AS (SELECT knob, list(value ORDER BY place) AS others FROM others GROUP BY knob ORDER BY min(certainty), knob LIMIT 1)
SELECT c_custkey AS step, knob, others[CAST(c_custkey // 7 % len(others) AS INTEGER) + 1] AS value FROM customer CROSS JOIN least WHERE (c_custkey + 1) % 7 = 0""",
}
