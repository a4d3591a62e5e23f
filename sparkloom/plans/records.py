"""Parsers over texts built from the tables, tables that keep what they first got, and models with their closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as M
from ..settled import shared_path
from ..sources import parsers as P
from ..streaming import ingest
from .base import rounded, table

HOSTS = {"videos.example": r"/v/([0-9]+)", "short.example": r"example/([a-z0-9]+)$"}


def file_stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy.MM.dd - HH.mm.ss")
    name = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("Game "), F.col("event_type"), F.lit(" "), stamp, F.when(F.col("event_id") % 2 == 0, ".07.DVR").otherwise(""), F.lit(".mp4"))).otherwise("notes.txt")
    found = e.select("event_id", P.stamped_name(name, "Europe/Berlin").alias("s"))
    return found.select("event_id", F.col("s.game").alias("game"), F.unix_micros("s.at").alias("at_us"))


def tag_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    tags = F.map_from_arrays(F.array(F.lit("part10"), F.lit("part2"), F.lit("part1"), F.lit("other1"), F.lit("party")), F.array(F.lit("}"), F.concat(k, F.lit(',"b":2')), F.lit('{"a":'), F.lit("no"), F.lit("no")))
    return o.select("o_orderkey", P.joined_tags(tags, "part").alias("text"))


def reference_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    named = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    tag = F.when(F.col("event_id") % 4 > 0, named + F.make_dt_interval(secs=F.pmod(F.col("event_id"), F.lit(240)).cast("decimal(18,6)")))
    return e.select("event_id", F.unix_micros(P.reference_time(tag, named)).alias("at_us"))


def typed_metrics(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("int").cast("string")
    line = F.when(n == 1, F.concat(q, F.lit("  61 6,8 -"))).when(n == 2, F.concat(F.lit(" "), q, F.lit(" 61 6.8 34 3 5 2 "))).when(n == 3, F.concat(q, F.lit(" x 1 2"))).otherwise(F.concat(q, F.lit(" 1 2")))
    found = l.select("l_orderkey", "l_linenumber", P.hand_metrics(line).alias("m"))
    return found.groupBy("l_linenumber").agg(F.count("m").alias("n"), F.sum(F.try_element_at("m", F.lit(1))).alias("views"), F.sum(F.try_element_at("m", F.lit(2))).alias("likes"), rounded(F.sum(F.try_element_at("m", F.lit(3)))).alias("watched"), F.sum(F.try_element_at("m", F.lit(4))).alias("full"))


def video_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://www.Videos.example/v/"), k.cast("string"), F.lit("?x=1"))).when(k % 4 == 1, F.concat(F.lit("http://m.short.example/a"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("https://videos.example/w/"), k.cast("string"))).otherwise(F.concat(F.lit("https://evil.example/v/"), k.cast("string")))
    return o.select("o_orderkey", P.video_id(url, HOSTS).alias("video"))


def frame_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id % 4 = 0")
    i = F.col("event_id")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("frame:1 pts_time:"), F.round("value", 2).cast("string"))).when(F.col("event_type") == "click", F.concat(F.lit("lavfi.light="), (i % 9).cast("string"), F.lit(".5"))).when(F.col("event_type") == "error", F.lit("lavfi.r128.M=-inf")).otherwise(F.lit("other"))
    lines = e.select("user_id", F.struct("ts", "event_id").alias("nr"), text.alias("text"))
    found = P.frame_series(lines, "user_id", "nr", "text").withColumn("value", F.when(F.col("value") > float("-inf"), F.col("value")))
    return found.groupBy("user_id", "name").agg(F.count("*").alias("n"), rounded(F.sum("t"), 3).alias("t"), rounded(F.sum("value"), 3).alias("value"))


def log_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.round(F.col("value"), 2).cast("string")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("silence_start: "), t)).when(F.col("event_type") == "click", F.concat(F.lit("silence_end: "), t)).otherwise("noise")
    lines = e.select("user_id", F.struct("ts", "event_id").alias("nr"), text.alias("text"))
    found = P.intervals(lines, "user_id", "nr", "text", r"silence_start: ([0-9.]+)", r"silence_end: ([0-9.]+)", F.lit(999.0))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.sum("start"), 3).alias("start"), rounded(F.sum("end"), 3).alias("end"))


def platform_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    payload = F.to_json(F.struct(F.struct(k.alias("views"), (k - 1000).alias("likes")).alias("stats"), F.when(k % 3 > 0, F.concat(k.cast("string"), F.when(k % 2 == 0, "").otherwise("k"))).alias("shares")))
    found = o.select("o_orderkey", P.platform_metrics(payload, {"views": "$.stats.views", "likes": "$.stats.likes", "shares": "$.shares"}).alias("m"))
    return found.select("o_orderkey", "m.views", "m.likes", "m.shares")


def first_rows_kept(spark, sf_dir):
    """What a table has after three runs: rows of a key that it has are left as they are."""
    import uuid

    o, path = table(spark, sf_dir, "orders"), f"{shared_path(spark)}/kept-{uuid.uuid4().hex}"
    runs = (o.where("o_orderkey % 2 = 0").withColumn("run", F.lit(1)), o.where("o_orderkey % 3 = 0").withColumn("run", F.lit(2)), o.withColumn("run", F.lit(3)))
    for rows in runs:
        ingest.add_absent(spark, rows.select("o_orderkey", "o_custkey", "run"), path, ["o_orderkey", "o_custkey"])
    return spark.read.parquet(path)


def duel_factors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.k_factor(F.col("p_size")).alias("k"))


def standings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("rating"), (F.col("c_nationkey") * 4).cast("double").alias("deviation"))
    return M.leaderboard(c).select("c_custkey", "standing")


def _model_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("q"), F.when(F.col("l_linenumber") < 6, F.col("l_tax") * 10).alias("t"), (F.col("l_discount") * 8 + F.col("l_quantity") / 200.0).alias("y"), (F.col("l_linenumber") / 7.0).alias("w"))


def ridge_predictions(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    model = M.ridge(rows.where("l_orderkey % 40 = 0"), ["q", "t"], F.col("y"), F.col("w"))
    return rows.where("l_orderkey % 40 = 1").groupBy("l_linenumber").agg(F.count("*").alias("n"), rounded(F.avg(M.predict(model)), 8).alias("predicted"))


def calibrated_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10.0 - 2.5).alias("z"), F.when(F.col("l_linenumber") < 7, (F.col("l_discount") * 100 + F.col("l_quantity") > 30).cast("int")).alias("good"))
    slope, offset = M.calibrate(rows, "z", "good")
    return spark.createDataFrame([(round(slope, 8), round(offset, 8))], "slope double, offset_ double")


QUERIES = {f.__name__: f for f in (file_stamps, tag_texts, reference_times, typed_metrics, video_ids, frame_values, log_spans, platform_records, first_rows_kept, duel_factors, standings, ridge_predictions, calibrated_verdicts)}

ORACLE = {
    "file_stamps": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'Game ' || event_type END AS game, CASE WHEN event_id % 5 > 0 THEN epoch_us(timezone('Europe/Berlin', date_trunc('second', ts))) END AS at_us FROM events",
    "tag_texts": "SELECT o_orderkey, '{\"a\":' || o_orderkey || ',\"b\":2}' AS text FROM orders",
    "reference_times": "SELECT event_id, epoch_us(ts) + CASE WHEN event_id % 4 > 0 AND event_id % 240 <= 120 THEN event_id % 240 * 1000000 ELSE 0 END AS at_us FROM events",
    "typed_metrics": """SELECT l_linenumber, count(*) FILTER (l_linenumber <= 3) AS n, sum(CAST(floor(l_quantity) AS DOUBLE)) FILTER (l_linenumber <= 3) AS views, sum(61.0::DOUBLE) FILTER (l_linenumber <= 2) AS likes,
  CAST(round(sum(CASE WHEN l_linenumber <= 2 THEN 6.8 ELSE 1.0 END) FILTER (l_linenumber <= 3), 6) AS DOUBLE) AS watched, sum(CASE WHEN l_linenumber = 2 THEN 34.0::DOUBLE ELSE 2.0 END) FILTER (l_linenumber IN (2, 3)) AS full FROM lineitem GROUP BY l_linenumber""",
    "video_ids": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'a' || o_orderkey END AS video FROM orders",
    "frame_values": """WITH timed AS (SELECT user_id, event_type, event_id, last_value(CASE WHEN event_type = 'view' THEN round(value, 2) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE user_id % 4 = 0)
SELECT user_id, CASE event_type WHEN 'click' THEN 'light' ELSE 'r128.M' END AS name, count(*) AS n, round(sum(t), 3) AS t, CASE WHEN event_type = 'click' THEN round(sum(event_id % 9 + 0.5::DOUBLE), 3) END AS value FROM timed WHERE event_type IN ('click', 'error') GROUP BY user_id, event_type""",
    "log_spans": """WITH marks AS (SELECT user_id, event_type, round(value, 2) AS v, lead(CASE WHEN event_type = 'click' THEN round(value, 2) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, count(*) AS n, round(sum(v), 3) AS start, round(sum(coalesce(until, 999.0)), 3) AS end FROM marks WHERE event_type = 'view' GROUP BY user_id""",
    "platform_records": "SELECT o_orderkey, o_orderkey AS views, CASE WHEN o_orderkey >= 1000 THEN o_orderkey - 1000 END AS likes, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN o_orderkey END AS shares FROM orders",
    "first_rows_kept": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS run FROM orders",
    "duel_factors": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 48.0::DOUBLE WHEN p_size < 25 THEN 32.0 ELSE 24.0 END AS k FROM part",
    "standings": "SELECT c_custkey, round(c_acctbal - 0.5 * c_nationkey * 4, 2) AS standing FROM customer",
    "ridge_predictions": """
WITH rows AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS q, CASE WHEN l_linenumber < 6 THEN l_tax * 10 END AS t, l_discount * 8 + l_quantity / 200.0 AS y, l_linenumber / 7.0::DOUBLE AS w FROM lineitem),
means AS (SELECT avg(q) AS mq, avg(t) AS mt FROM rows WHERE l_orderkey % 40 = 0),
terms AS (SELECT w, y, q - mq AS a, coalesce(t, mt) - mt AS b FROM rows, means WHERE l_orderkey % 40 = 0),
s AS (SELECT sum(w) + 1.0 AS m00, sum(w * a) AS m01, sum(w * b) AS m02, sum(w * a * a) + 1.2 AS m11, sum(w * a * b) AS m12, sum(w * b * b) + 1.2 AS m22, sum(w * y) AS r0, sum(w * y * a) AS r1, sum(w * y * b) AS r2 FROM terms),
d AS (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det FROM s),
solved AS (SELECT greatest(-0.65, least(0.65, (r0 * (m11 * m22 - m12 * m12) - m01 * (r1 * m22 - m12 * r2) + m02 * (r1 * m12 - m11 * r2)) / det)) AS c0,
  greatest(-0.65, least(0.65, (m00 * (r1 * m22 - m12 * r2) - r0 * (m01 * m22 - m12 * m02) + m02 * (m01 * r2 - r1 * m02)) / det)) AS c1,
  greatest(-0.65, least(0.65, (m00 * (m11 * r2 - r1 * m12) - m01 * (m01 * r2 - r1 * m02) + r0 * (m01 * m12 - m11 * m02)) / det)) AS c2 FROM d)
SELECT l_linenumber, count(*) AS n, round(avg(greatest(-1, least(1, c0 + c1 * (q - mq) + c2 * (coalesce(t, mt) - mt)))), 8) AS predicted FROM rows, means, solved WHERE l_orderkey % 40 = 1 GROUP BY l_linenumber""",
    "calibrated_verdicts": """
WITH RECURSIVE rows AS (SELECT l_quantity / 10.0 - 2.5 AS z, CASE WHEN l_discount * 100 + l_quantity > 30 THEN 1 ELSE 0 END AS good FROM lineitem WHERE l_linenumber < 7),
fold(k, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, a - 0.5 * (avg(e * z) + 0.01 * a), b - 0.5 * avg(e) FROM (SELECT k, a, b, z, 1 / (1 + exp(-(a * z + b))) - good AS e FROM fold CROSS JOIN rows WHERE k < 50) GROUP BY k, a, b)
SELECT round(a, 8) AS slope, round(b, 8) AS offset_ FROM fold WHERE k = 50""",
}
