"""Evidence and picture queries over ``events``, ``lineitem``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import picture as P
from .base import rounded, table

HOUR = 3600
MOODS = {"calm": (80.0, 0.2), "epic": (120.0, 0.6), "wild": (160.0, 0.9)}
WEIGHTS = {"quantity": 2.0, "discount": 1.0, "tax": 1.0}


def _seconds(at="ts"):
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6 - F.lit(1_704_067_200.0)  # since 2024-01-01


def recent_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.least(F.col("value") / 40.0, F.lit(1.0)))
    good = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return V.hits_of_newest(e, "ts", "event_id", "p", good, 200).withColumn("band", F.lit("all")).unionByName(
        V.hits_of_newest(e, "ts", "event_id", "p", good, 30, F.col("p") >= 0.8).withColumn("band", F.lit("high"))
    )


def repeat_counts(spark, sf_dir):
    return V.repetition(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 3)[0]


def repeat_leaders(spark, sf_dir):
    return V.repetition(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 3)[1]


def last_shown(spark, sf_dir):
    return V.last_shown(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_shipdate")


def user_supply(spark, sf_dir):
    s = V.supply(table(spark, sf_dir, "events"), "user_id", "event_id", "value", F.col("event_type") == "purchase")
    return s.select("user_id", rounded("supply", 4).alias("supply"))


def folded_factors(spark, sf_dir):
    step = F.when(F.col("event_type") == "purchase", 1.15).when(F.col("event_type") == "error", 0.9)
    return V.folded(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", step, 1.0, 0.5, 2.0).select("user_id", rounded("factor").alias("factor"))


def challenger_check(spark, sf_dir):
    li, seen = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    p = V.promotion(li, seen, "l_orderkey", F.col("l_discount"), F.col("l_quantity"), F.lit(0.05), F.col("l_tax"))
    return p.select(rounded("challenger_mse", 8).alias("challenger_mse"), rounded("champion_mse", 8).alias("champion_mse"), "n", "promote")


def _line_pairs(spark, sf_dir):
    """Each order's lines and their next ones, scaled to 0 to 1; a discount of 0 is unknown."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount")
    parts = {"quantity": F.col("l_quantity") / 50.0, "discount": F.when(F.col("l_discount") != 0, F.col("l_discount") * 10.0), "tax": F.col("l_tax") * 10.0}
    both = li.withColumn("n", F.row_number().over(order)).withColumn("more", F.lead("l_orderkey").over(order))
    cols = [c for k, x in parts.items() for c in (x.alias(f"a_{k}"), F.lead(x).over(order).alias(f"b_{k}"))]
    return both.select("l_orderkey", "l_suppkey", "n", "more", F.lit(1.0).alias("worth"), *cols).where("more is not null").drop("more")


def line_weights(spark, sf_dir):
    d = _line_pairs(spark, sf_dir)
    d = d.select("l_suppkey", F.struct("l_orderkey", "n").alias("o"), "worth", *[(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(k) for k in WEIGHTS])
    d = d.withColumn("place", F.col("o.l_orderkey") * 1000 + F.col("o.n"))
    return V.perceptron(d, "l_suppkey", "place", list(WEIGHTS), "worth", WEIGHTS, 0.05, 2, 0.5, 0.5)


def line_factors(spark, sf_dir):
    u = V.pair_factors(_line_pairs(spark, sf_dir), WEIGHTS, "worth", 0.5, 2.0, 4.0, 0.05, 0.5, 8)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in u.items()], "name string, log_factor double")


def matched_cuts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = P.matched_cuts(e.where("event_type = 'click'"), e.where("event_type in ('view', 'purchase')"), "user_id", "ts", 4 * HOUR)
    return m.groupBy("user_id").agg(F.count_if("from_plan").alias("planned"), F.count_if(~F.col("from_plan")).alias("unplanned"), F.sum("at_us").alias("sum_us"))


def weighted_discounts(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(P.weighted_share(F.col("l_quantity"), F.col("l_discount")).alias("share"))
    return w.select("l_suppkey", rounded("share").alias("share"))


def steady_light(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), (F.col("value") * 10).alias("light"))
    return P.steady_light(e, "user_id", "day", "light", F.col("event_type") == "error").select("user_id", rounded("light").alias("light"))


def effect_doses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", _seconds().alias("s"))
    lengths = e.groupBy("user_id").agg(F.max("s").alias("length"))
    d = P.effect_dose(e.where("event_type = 'purchase'").select("user_id", "s"), e.where("event_type = 'error'").select("user_id", "s"), lengths, "user_id", "s", 6.0 * HOUR)
    return d.select("user_id", "inside", "n", rounded("contrast", 4).alias("contrast"), rounded("dose", 9).alias("dose"))


def repeated_kinds(spark, sf_dir):
    return P.same_in_row(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


def video_places(spark, sf_dir):
    windows = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(f).alias("speed")) for a, b, f in ((2.0, 4.0, 0.5), (6.0, 9.0, 2.0))])
    place = P.to_timeline(F.col("value"), F.lit(10.0), F.lit(1.0), windows)
    return table(spark, sf_dir, "events").select("event_id", rounded(place).alias("place"), rounded(P.to_source(place, F.lit(10.0), F.lit(1.0), windows)).alias("back"))


def part_moods(spark, sf_dir):
    basis = P.duration_basis(F.col("p_size").cast("double"), (10.0, 30.0), 8.0)
    moods = P.nearest_moods(F.col("p_retailprice") / 10.0, F.col("p_size") / 50.0, MOODS)
    return table(spark, sf_dir, "part").select("p_partkey", rounded(basis[0]).alias("near_10"), rounded(basis[1]).alias("near_30"), F.array_join(moods, ",").alias("moods"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_hits, repeat_counts, repeat_leaders, last_shown, user_supply, folded_factors, challenger_check, line_weights, line_factors, matched_cuts,
        weighted_discounts, steady_light, effect_doses, repeated_kinds, video_places, part_moods,
    )
}

#: line_weights and line_factors are iterative; tests hold their operators against plain loops.
_LINE_PAIRS = """parts AS (SELECT l_orderkey, l_suppkey, l_quantity / 50.0 AS q, CASE WHEN l_discount <> 0 THEN l_discount * 10.0 END AS d, l_tax * 10.0 AS t,
    row_number() OVER w AS n, lead(l_orderkey) OVER w AS more, lead(l_quantity / 50.0) OVER w AS q2, lead(CASE WHEN l_discount <> 0 THEN l_discount * 10.0 END) OVER w AS d2, lead(l_tax * 10.0) OVER w AS t2
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_tax, l_discount))"""

_MOVE = "greatest({start} - {width}, least({start} + {width}, {w} + 0.05 * {x}))"

ORACLE = {
    "line_factors": f"""
WITH RECURSIVE {_LINE_PAIRS},
pairs AS (SELECT q - q2 AS x, d - d2 AS y, t - t2 AS z FROM parts WHERE more IS NOT NULL),
eta AS (SELECT 0.5::DOUBLE / greatest(1.0, count(*) / 20.0::DOUBLE) AS e FROM pairs),
fold(k, u, v, w) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, greatest(ln(0.5), least(ln(2), u - e * (0.1 * u + coalesce(sum(push * fx * (gx - lead)), 0)))), greatest(ln(0.5), least(ln(2), v - e * (0.1 * v + coalesce(sum(push * fy * (gy - lead)), 0)))),
    greatest(ln(0.5), least(ln(2), w - e * (0.1 * w + coalesce(sum(push * fz * (gz - lead)), 0))))
  FROM (SELECT *, -4.0 / (1 + exp(4.0 * lead)) / (fx + fy + fz) AS push FROM (SELECT *, (fx * gx + fy * gy + fz * gz) / (fx + fy + fz) AS lead FROM (
    SELECT k, u, v, w, e, CASE WHEN x IS NULL THEN 0 ELSE 2 * exp(u) END AS fx, CASE WHEN y IS NULL THEN 0 ELSE exp(v) END AS fy, CASE WHEN z IS NULL THEN 0 ELSE exp(w) END AS fz, coalesce(x, 0) AS gx, coalesce(y, 0) AS gy, coalesce(z, 0) AS gz
    FROM fold CROSS JOIN pairs CROSS JOIN eta WHERE k < 8) WHERE fx + fy + fz > 0)) GROUP BY k, u, v, w, e)
SELECT name, round(x, 6) AS log_factor FROM (SELECT unnest([{{'name': 'quantity', 'x': u}}, {{'name': 'discount', 'x': v}}, {{'name': 'tax', 'x': w}}], recursive := true) FROM fold WHERE k = 8)""",
    "line_weights": f"""
WITH RECURSIVE {_LINE_PAIRS},
pairs AS (SELECT l_suppkey, coalesce(q - q2, 0) AS x, coalesce(d - d2, 0) AS y, coalesce(t - t2, 0) AS z, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 1000 + n) AS i, count(*) OVER (PARTITION BY l_suppkey) AS m FROM parts WHERE more IS NOT NULL),
fold(l_suppkey, k, m, a, b, c) AS (
  SELECT DISTINCT l_suppkey, 0::BIGINT, m, 2.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM pairs
  UNION ALL
  SELECT f.l_suppkey, f.k + 1, f.m,
    CASE WHEN x * a + y * b + z * c < {V.LEAD} AND x <> 0 THEN {_MOVE.format(start="2.0", width="1.0", w="a", x="x")} ELSE a END,
    CASE WHEN x * a + y * b + z * c < {V.LEAD} AND y <> 0 THEN {_MOVE.format(start="1.0", width="0.5", w="b", x="y")} ELSE b END,
    CASE WHEN x * a + y * b + z * c < {V.LEAD} AND z <> 0 THEN {_MOVE.format(start="1.0", width="0.5", w="c", x="z")} ELSE c END
  FROM fold f JOIN pairs p ON p.l_suppkey = f.l_suppkey AND p.i = f.k % f.m + 1 WHERE f.k < 2 * f.m),
ended AS (SELECT * FROM fold WHERE k = 2 * m)
SELECT l_suppkey, 'quantity' AS name, round(a, 4) AS weight FROM ended UNION ALL SELECT l_suppkey, 'discount', round(b, 4) FROM ended UNION ALL SELECT l_suppkey, 'tax', round(c, 4) FROM ended""",
    "recent_hits": """WITH e AS (SELECT ts, event_id, least(value / 40.0::DOUBLE, 1) AS p, event_type = 'purchase' AS good FROM events WHERE event_type IN ('purchase', 'error') AND value IS NOT NULL),
a AS (SELECT *, 'all' AS band FROM e ORDER BY ts DESC, event_id DESC LIMIT 200), b AS (SELECT *, 'high' AS band FROM e WHERE p >= 0.8 ORDER BY ts DESC, event_id DESC LIMIT 30)
SELECT x AS band, count(*) FILTER ((p >= 0.5) = good) AS hits, count(p) AS n FROM (VALUES ('all'), ('high')) v(x) LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) ON band = x GROUP BY x""",
    "repeat_counts": "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT count(DISTINCT l_orderkey) AS families, count(*) AS places, count(DISTINCT l_partkey) AS different FROM p",
    "repeat_leaders": "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 3",
    "last_shown": """WITH f AS (SELECT l_orderkey, row_number() OVER (ORDER BY max(l_shipdate) DESC, l_orderkey) - 1 AS age FROM lineitem GROUP BY 1)
SELECT l_partkey, min(age) AS age FROM lineitem JOIN f USING (l_orderkey) GROUP BY 1""",
    "user_supply": """WITH r AS (SELECT user_id, value, event_type = 'purchase' AS fresh, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY value DESC, event_id) AS i,
  count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(coalesce(sum(value) FILTER (fresh OR i <= n), 0), 4) AS supply FROM r GROUP BY user_id""",
    "folded_factors": """WITH l AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 1.15::DOUBLE WHEN 'error' THEN 0.9 ELSE 1 END ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_concat([1.0::DOUBLE], l), lambda a, b: greatest(0.5, least(2.0, a * b))), 6) AS factor FROM l""",
    "challenger_check": """WITH m AS (SELECT sum(l_quantity * (l_discount - 0.05) ** 2) / sum(l_quantity) AS a, sum(l_quantity * (l_discount - l_tax) ** 2) / sum(l_quantity) AS b, count(*) AS n
  FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
SELECT round(a, 8) AS challenger_mse, round(b, 8) AS champion_mse, n, coalesce(a + 0.002 < b, false) AS promote FROM m""",
    "matched_cuts": """WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), v AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'purchase')),
n AS (SELECT c.user_id, c.event_id, c.us, arg_min(v.us, (abs(v.us - c.us), v.us)) AS other, coalesce(min(abs(v.us - c.us)) <= 14400000000, false) AS hit FROM c LEFT JOIN v ON v.user_id = c.user_id GROUP BY ALL),
p AS (SELECT user_id, CASE WHEN hit AND avg(hit::INT) OVER (PARTITION BY user_id) >= 0.5 THEN other ELSE us END AS us, true AS plan FROM n),
u AS (SELECT user_id, us, false AS plan FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = v.user_id AND abs(c.us - v.us) <= 14400000000))
SELECT user_id, count(*) FILTER (plan) AS planned, count(*) FILTER (NOT plan) AS unplanned, sum(us)::BIGINT AS sum_us FROM (SELECT * FROM p UNION ALL SELECT * FROM u) GROUP BY user_id""",
    "weighted_discounts": "SELECT l_suppkey, round(coalesce(sum(l_quantity * l_discount) / sum(l_quantity), 0), 6) AS share FROM lineitem GROUP BY l_suppkey",
    "steady_light": """WITH m AS (SELECT user_id, ts::DATE AS day, median(value * 10) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL),
b AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY day) AS before FROM m)
SELECT user_id, round(avg((m BETWEEN 60 AND 170 AND (before IS NULL OR abs(m - before) <= 25))::INT), 6) AS light FROM b GROUP BY user_id""",
    "effect_doses": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS s FROM events), l AS (SELECT user_id, max(s) AS length FROM e GROUP BY 1),
w AS (SELECT user_id, greatest(0, s - 21600) AS a, least(length, s + 21600) AS b FROM e JOIN l USING (user_id) WHERE event_type = 'error'),
r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS g FROM w),
k AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r), m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM k GROUP BY user_id, k),
t AS (SELECT user_id, sum(b - a) AS t FROM m GROUP BY 1),
i AS (SELECT user_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND e.s BETWEEN m.a AND m.b)) AS h FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT l.user_id, coalesce(h, 0) AS inside, coalesce(n, 0) AS n, round(CASE WHEN t IS NOT NULL AND length > 0 THEN coalesce(h, 0) / greatest(t, 1e-6) / greatest((coalesce(n, 0) - coalesce(h, 0)) / greatest(1e-6, length - t), 0.05) END, 4) AS contrast,
  round(CASE WHEN length > 0 THEN coalesce(n, 0) / length * 10 END, 9) AS dose FROM l LEFT JOIN i USING (user_id) LEFT JOIN t USING (user_id)""",
    "repeated_kinds": """WITH b AS (SELECT user_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) SELECT user_id, count(*) FILTER (s) AS repeats FROM b GROUP BY 1""",
    "video_places": """SELECT event_id, round(9 + value + greatest(0, least(value, 4) - 2) - 0.5 * greatest(0, least(value, 9) - 6), 6) AS place, round(value, 6) AS back FROM events""",
    "part_moods": """SELECT p_partkey, round(exp(-0.5::DOUBLE * ((p_size - 10) / 8.0::DOUBLE) ** 2), 6) AS near_10, round(exp(-0.5::DOUBLE * ((p_size - 30) / 8.0::DOUBLE) ** 2), 6) AS near_30,
array_to_string(list_transform(list_sort([{'f': abs(p_size / 50.0::DOUBLE - 0.2) + abs(p_retailprice / 10.0::DOUBLE - 80) / 100.0::DOUBLE, 'i': 0, 'n': 'calm'},
  {'f': abs(p_size / 50.0::DOUBLE - 0.6) + abs(p_retailprice / 10.0::DOUBLE - 120) / 100.0::DOUBLE, 'i': 1, 'n': 'epic'}, {'f': abs(p_size / 50.0::DOUBLE - 0.9) + abs(p_retailprice / 10.0::DOUBLE - 160) / 100.0::DOUBLE, 'i': 2, 'n': 'wild'}]), lambda x: x.n), ',') AS moods FROM part""",
}
