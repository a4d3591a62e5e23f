"""Queries of sampling, clip starts, render times, teachers, endings and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ending as N
from ..operators import teaching as T
from ..operators import upkeep as U
from ..operators.timeline import micros
from .base import rounded, table
from .matching import _events


def _time(text):
    return F.lit(text).cast("timestamp")


def due_orders(spark, sf_dir):
    scored = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    o = table(spark, sf_dir, "orders").where(U.due(F.col("o_orderdate"), scored, _time("2000-01-01 00:00:00"), 7))
    return o.select("o_orderkey")


def new_samples(spark, sf_dir):
    level = lambda e: e.select("user_id", "event_id", "ts", F.floor(F.col("value") / 50).alias("level"))
    new, old = (level(_events(spark, sf_dir, kind)) for kind in ("purchase", "click"))
    return U.accepted_samples(new, old, "user_id", "ts", "event_id", ["level"], F.col("user_id") % 2 == 0, 20 * 3600).select("event_id", "user_id", "level")


def next_polls(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("scored"))
    samples = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    p = U.poll_order(posts, samples, "o_orderkey", "o_orderdate", "scored", "l_shipdate", _time("1996-01-01 00:00:00"), _time("2001-06-01 00:00:00"), 100)
    return p.select("o_orderkey", micros("last_sample").alias("last_us"))


def led_clips(spark, sf_dir):
    clips = _events(spark, sf_dir, "purchase").select(
        "event_id", "user_id", "ts", F.timestamp_micros(micros("ts") + F.floor(F.col("value") * 2000) * 1_000_000).alias("until"),
        F.when(F.col("event_id") % 3 == 0, _time("2024-01-10 00:00:00")).alias("earliest"), F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("INTERVAL 30 HOURS")).alias("latest"),
    )
    c = U.clip_starts(clips, _events(spark, sf_dir, "error"), "user_id", "ts", "until", "earliest", "latest", "ts", 86_400, 3600, 7200, 2 * 86_400)
    return c.select("event_id", "start_us", "uncapped_us", "foreign")


def render_times(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    measured = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))
    r = U.render_report(lines, F.col("l_returnflag"), F.col("l_linestatus"), "F", measured, F.col("l_quantity"), F.col("l_quantity") + 1, F.col("l_discount") * 100_000 - 500, F.col("l_linenumber") == 2, 7200.0)
    return r.select("encoder", "version", "n", *[rounded(c, 8).alias(c) for c in ("median", "p90", "max")], "from_files", "fallbacks")


def _duels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("winner"), (F.col("event_id") % 150).alias("loser"), F.when(F.col("value") > 20, F.col("value") / 200).alias("sure"))


def duel_pairs(spark, sf_dir):
    drafts = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return T.won_pairs(_duels(spark, sf_dir), drafts, "c_custkey", "c_mktsegment", "sure", 0.5)


def teachers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    good = F.when(F.col("l_linenumber") != 2, F.floor(F.col("l_extendedprice") / 1500))
    t = T.teacher_weights(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), lines, good, F.col("l_quantity"), _events(spark, sf_dir, "click"), 500.0, 40.0, 8)
    return t.select(*[rounded(c).alias(c) for c in ("share", "hit", "trust", "weight")], "checked")


def arms(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    per = lines.groupBy(F.col("l_orderkey").alias("draft")).agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    choices = per.unpivot("draft", ["flag", "status"], "knob", "choice")
    verdicts = orders.select(F.col("o_orderkey").alias("draft"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("thumb"), F.when(F.col("o_custkey") % 4 == 0, F.array(F.lit("flag"))).alias("knobs"))
    audience = orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("draft"), ((F.col("o_custkey") % 250) / 100.0 - 1.2).alias("y"))
    machine = orders.where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("draft"), (F.col("o_custkey") % 110).alias("note"))
    duels = orders.select(F.col("o_orderkey").alias("winner"), (F.col("o_orderkey") - 3).alias("loser"), F.lit(0.34).alias("weight"))
    a = T.arm_statistics(choices, verdicts, audience, machine, duels)
    return a.select("knob", "choice", *[rounded(c, 4).alias(c) for c in ("n", "s", "viewers_s")], "yes", "no", "viewers")


def gate(spark, sf_dir):
    difference = F.create_map(F.lit("a"), F.col("l_quantity") - 25, F.lit("b"), F.col("l_tax") * 100 - 4, F.lit("c"), F.col("l_discount") * 100 - 5)
    return T.never_worse(table(spark, sf_dir, "lineitem"), difference, F.col("l_linenumber"), {"a": 0.5, "b": -0.25}, {"a": 1.0, "b": 2.0, "c": 3.0}, 0.5)


def beat_ends(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("until"))
    return N.on_beat(_events(spark, sf_dir, "error"), ends, "user_id", "ts", "until")


def fades(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ends = e.groupBy("user_id").agg(F.max("ts").alias("until"), F.max("value").alias("level"))
    ends = ends.withColumn("level", F.col("level") - F.col("user_id") % 50)
    f = N.fade_out(e, ends, "user_id", "ts", "value", "until", "level")
    return f.select("user_id", rounded("fade_s", 4).alias("fade_s"))


def endings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    tail, seam = F.when(F.col("l_linenumber") != 1, -F.col("l_quantity") / 2), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 6)
    black, beat = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R"), F.when(F.col("l_tax") > 0.02, F.lit(1.0)).otherwise(0.2)
    short, long_ = N.ending_short(tail, black, beat, seam), N.ending_long(beat, F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 8), ~black)
    return lines.select("l_orderkey", "l_linenumber", rounded(short).alias("short"), rounded(long_).alias("long"))


def readings(spark, sf_dir):
    size, chars, middle = 40 + F.col("l_discount") * 1000, F.col("l_linenumber") * 8, F.col("l_extendedprice") / 40
    safe = N.inside_zone(middle, size, chars, 0.5, 1080.0, 1920.0, (0.1, 0.2, 0.05, 0.1))
    note = N.reading(F.col("l_quantity") / 30, chars, size, 1920.0, safe)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rounded(F.avg(note)).alias("note"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (due_orders, new_samples, next_polls, led_clips, render_times, duel_pairs, teachers, arms, gate, beat_ends, fades, endings, readings)}

_UP = "greatest(0.0, least(1.0, ({} - ({})) / ({})))"

ORACLE = {
    "due_orders": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '2000-01-01' - INTERVAL 7 DAY",
    "new_samples": """WITH l AS (SELECT user_id, ts, floor(value / 50)::BIGINT AS level FROM events WHERE event_type = 'click'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.event_id, p.user_id, floor(p.value / 50)::BIGINT AS level FROM events p LEFT JOIN l ON l.user_id = p.user_id
WHERE p.event_type = 'purchase' AND NOT coalesce(floor(p.value / 50)::BIGINT = l.level AND (p.user_id % 2 = 0 OR p.ts - l.ts < INTERVAL 20 HOUR), false)""",
    "next_polls": """SELECT o_orderkey, epoch_us(last) AS last_us FROM (SELECT *, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3) AS last FROM orders)
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND (last IS NULL OR last <= TIMESTAMP '2001-06-01')
ORDER BY o_orderstatus = 'F', CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END DESC NULLS LAST, last ASC NULLS FIRST, o_orderdate DESC, o_orderkey DESC LIMIT 100""",
    "led_clips": """WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS act, epoch_us(ts) + floor(value * 2000)::BIGINT * 1000000 AS until,
  CASE WHEN event_id % 3 = 0 THEN epoch_us(TIMESTAMP '2024-01-10') END AS lo, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) - 108000000000 END AS hi FROM events WHERE event_type = 'purchase'),
b AS (SELECT *, CASE WHEN hi IS NULL THEN x ELSE least(x, hi) END AS begin_us FROM (SELECT *, CASE WHEN lo IS NULL THEN act - 86400000000 ELSE greatest(act - 86400000000, lo) END AS x FROM c)),
k AS (SELECT b.*, (SELECT max(epoch_us(e.ts)) FROM events e WHERE e.event_type = 'error' AND e.user_id = b.user_id AND epoch_us(e.ts) >= b.begin_us AND epoch_us(e.ts) < b.act) AS kill FROM b),
m AS (SELECT *, CASE WHEN kill IS NOT NULL THEN least(kill + 3600000000, act - 7200000000) END AS moved FROM k),
u AS (SELECT *, coalesce(moved > begin_us, false) AS "foreign", CASE WHEN coalesce(moved > begin_us, false) THEN moved ELSE begin_us END AS uncapped_us FROM m)
SELECT event_id, uncapped_us, "foreign", CASE WHEN until - uncapped_us > 172800000000
  THEN greatest(uncapped_us, CASE WHEN hi IS NULL THEN until - 172800000000 ELSE least(hi, until - 172800000000) END) ELSE uncapped_us END AS start_us FROM u""",
    "render_times": """WITH r AS (SELECT CASE WHEN l_linenumber = 2 THEN l_returnflag || ' (fell back)' ELSE l_returnflag END AS encoder, l_linestatus AS version,
  l_extendedprice / l_quantity AS ratio, 0 AS old, (l_linenumber = 2)::INT AS fell FROM lineitem WHERE l_linenumber % 3 <> 0
  UNION ALL SELECT l_returnflag, l_linestatus, (l_discount * 100000 - 500) / (l_quantity + 1), 1, 0 FROM lineitem
  WHERE l_linenumber % 3 = 0 AND l_linestatus = 'F' AND l_discount * 100000 - 500 > 0 AND l_discount * 100000 - 500 <= 7200)
SELECT encoder, version, count(*) AS n, round(median(ratio), 8) AS median, round(quantile_disc(ratio, 0.9), 8) AS p90, round(max(ratio), 8) AS max,
  sum(old)::BIGINT AS from_files, sum(fell)::BIGINT AS fallbacks FROM r GROUP BY 1, 2""",
    "duel_pairs": """SELECT e.user_id AS winner, e.event_id % 150 AS loser, a.c_mktsegment AS format FROM events e JOIN customer a ON a.c_custkey = e.user_id
JOIN customer b ON b.c_custkey = e.event_id % 150 WHERE a.c_mktsegment = b.c_mktsegment AND coalesce(CASE WHEN e.value > 20 THEN e.value / 200 END, 0.5) >= 0.5""",
    "teachers": """WITH s AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS p, count(*) AS checked,
  avg(CASE WHEN floor(l_extendedprice / 1500) > l_quantity THEN 1.0 WHEN floor(l_extendedprice / 1500) = l_quantity THEN 0.5 ELSE 0.0 END) AS hit,
  (SELECT count(*) FROM events WHERE event_type = 'click') AS m FROM lineitem WHERE l_linenumber <> 2),
t AS (SELECT *, p / (p + 500.0) AS share, greatest(0.0, least(1.0, (hit - 0.5) / 0.2)) AS trust FROM s)
SELECT round(share, 6) AS share, checked, round(hit, 6) AS hit, round(trust, 6) AS trust, round(0.5 * (1 - share) * trust * least(1.0, 40.0 / m), 6) AS weight FROM t""",
    "arms": """WITH per AS (SELECT l_orderkey AS draft, min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1),
c AS (SELECT draft, 'flag' AS knob, flag AS choice FROM per UNION ALL SELECT draft, 'status', status FROM per),
o AS (SELECT *, o_custkey AS k FROM orders),
r AS (SELECT knob, choice, 1.0::DOUBLE AS n, (o_orderstatus = 'F')::INT::DOUBLE AS s, (o_orderstatus = 'F')::INT AS yes, (o_orderstatus = 'P')::INT AS no, 0 AS v, 0.0::DOUBLE AS vs
    FROM o JOIN c ON draft = o_orderkey WHERE o_orderstatus IN ('F', 'P') AND (k % 4 <> 0 OR knob = 'flag')
  UNION ALL SELECT knob, choice, 2.0, 2.0 * y, 0, 0, 1, y FROM (SELECT *, greatest(0.0, least(1.0, ((k % 250) / 100.0::DOUBLE - 0.2) / 2)) AS y FROM o WHERE k % 3 = 0) JOIN c ON draft = o_orderkey
  UNION ALL SELECT knob, choice, 0.34, 0.34 * least(1.0, (k % 110) / 100.0::DOUBLE), 0, 0, 0, 0 FROM o JOIN c ON draft = o_orderkey WHERE k % 5 = 0
  UNION ALL SELECT a.knob, unnest([a.choice, b.choice]), 0.34, unnest([0.34, 0.0]), 0, 0, 0, 0 FROM o JOIN c a ON a.draft = o_orderkey JOIN c b ON b.draft = o_orderkey - 3 AND a.knob = b.knob WHERE a.choice <> b.choice)
SELECT knob, choice, round(sum(n), 4) AS n, round(sum(s), 4) AS s, sum(yes)::BIGINT AS yes, sum(no)::BIGINT AS no, sum(v)::BIGINT AS viewers, round(sum(vs), 4) AS viewers_s FROM r GROUP BY 1, 2""",
    "gate": """WITH d AS (SELECT l_linenumber AS w, (l_quantity - 25) * exp(0.25::DOUBLE) + (l_tax * 100 - 4) * (2.0::DOUBLE * exp(-0.125::DOUBLE)) + (l_discount * 100 - 5) * 3.0::DOUBLE AS x,
  (l_quantity - 25) * 1.0::DOUBLE + (l_tax * 100 - 4) * 2.0::DOUBLE + (l_discount * 100 - 5) * 3.0::DOUBLE AS y FROM lineitem),
s AS (SELECT round(sum(w * CASE WHEN x > 0 THEN 1.0 WHEN x = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE / sum(w), 4) AS rate,
  round(sum(w * CASE WHEN y > 0 THEN 1.0 WHEN y = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE / sum(w), 4) AS rate_start FROM d)
SELECT rate, rate_start, rate >= rate_start AS active FROM s""",
    "beat_ends": """WITH u AS (SELECT user_id, max(epoch_us(ts)) AS until FROM events GROUP BY 1),
b AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) - epoch_us(ts) AS step FROM events WHERE event_type = 'error'),
m AS (SELECT user_id, median(step) AS step, min(abs(until - us)) AS near FROM b JOIN u USING (user_id) GROUP BY 1)
SELECT user_id, CASE WHEN step IS NOT NULL THEN CASE WHEN near <= CASE WHEN step = 0 THEN 500000.0 ELSE step END / 8 THEN 1.0 ELSE 0.2 END END::DOUBLE AS beat FROM m""",
    "fades": """WITH u AS (SELECT user_id, max(epoch_us(ts)) AS until, max(value) - user_id % 50 AS level FROM events GROUP BY 1),
l AS (SELECT user_id, max(epoch_us(ts)) AS loud FROM events JOIN u USING (user_id) WHERE value >= level - 3 GROUP BY 1),
q AS (SELECT user_id, min(epoch_us(ts)) AS quiet FROM events JOIN u USING (user_id) JOIN l USING (user_id) WHERE epoch_us(ts) > loud AND value < level - 20 GROUP BY 1)
SELECT user_id, round((coalesce(quiet, until) - loud) / 1000000.0, 4)::DOUBLE AS fade_s FROM u LEFT JOIN l USING (user_id) LEFT JOIN q USING (user_id)""",
    "endings": f"""WITH x AS (SELECT *, CASE WHEN l_linenumber <> 1 THEN {_UP.format('-l_quantity / 2', '-15.0', '9.0::DOUBLE')} END AS tail, CASE WHEN l_returnflag <> 'A' THEN (l_returnflag <> 'R')::INT END AS lit,
  CASE WHEN l_tax > 0.02 THEN 1.0 ELSE 0.2 END::DOUBLE AS beat, CASE WHEN l_linenumber <> 3 THEN {_UP.format('l_discount * 6', '0.15', '0.35::DOUBLE')} END AS seam,
  CASE WHEN l_linenumber <> 2 THEN CASE WHEN l_quantity / 8 < 0.5 THEN l_quantity / 4 WHEN l_quantity / 8 <= 2.5 THEN 1.0 WHEN l_quantity / 8 < 5 THEN (5 - l_quantity / 8) / 2.5 ELSE 0.0 END END AS fade FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round((coalesce(0.4 * tail, 0) + coalesce(0.15 * lit, 0) + 0.25 * beat + coalesce(0.2 * seam, 0)) / (0.25 + (tail IS NOT NULL)::INT * 0.4 + (lit IS NOT NULL)::INT * 0.15 + (seam IS NOT NULL)::INT * 0.2)::DOUBLE, 6) AS short,
  round((0.5 * beat + coalesce(0.3 * fade, 0) + coalesce(0.2 * lit, 0)) / (0.5 + (fade IS NOT NULL)::INT * 0.3 + (lit IS NOT NULL)::INT * 0.2)::DOUBLE, 6) AS long FROM x""",
    "readings": f"""WITH t AS (SELECT l_orderkey, l_quantity / 30 AS shown, l_linenumber * 8 AS chars, 40 + l_discount * 1000 AS size, l_extendedprice / 40 AS mid FROM lineitem),
z AS (SELECT *, mid - 0.53 * size >= 192.0 AND mid + 0.53 * size <= 0.8::DOUBLE * 1920 AND (1080 - chars * 0.5 * size) / 2 >= 54.0 AND (1080 + chars * 0.5 * size) / 2 <= 0.9::DOUBLE * 1080 AS safe FROM t)
SELECT l_orderkey, round(avg(least({_UP.format('shown', '0.4', '0.43::DOUBLE')}, 1 - {_UP.format('chars / greatest(shown, 0.001)', '17.0', '8.0::DOUBLE')}, {_UP.format('size / 1920', '0.015', '0.015::DOUBLE')}, safe::INT::DOUBLE)), 6) AS note, count(*) AS n FROM z GROUP BY 1""",
}
