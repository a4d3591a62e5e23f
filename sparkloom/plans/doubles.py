"""Users' events as frames of a video at two a second, and orders' lines as segments of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import repeats as R
from .base import rounded, table

RATE = 2.0


def doubled_sources(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    start = F.pmod(F.col("l_partkey") * 3, F.lit(60)) + F.col("l_quantity") / 10.0
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    segments = l.where("l_orderkey % 20 = 0").select("l_suppkey", (F.col("l_partkey") % 7).alias("file"), number.alias("nr"), start.alias("s"), (start + 1.0 + F.col("l_linenumber")).alias("e"))
    found = R.doubled_sources(segments, "l_suppkey", "file", "nr", "s", "e")
    return found.select("l_suppkey", "file", "a", "b", rounded("twice_s").alias("twice_s"))


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    x = F.col("i") % 17 + F.col("user_id") % 5
    words = [(x + 3) * c % 65536 for c in (40503, 30011, 52711)]
    picture = words[0] + words[1] * 65536 + words[2] * 4294967296 + F.when(F.col("event_id") % 4 == 0, 5).otherwise(0)
    return e.select("user_id", "event_id", i.alias("i")).withColumn("picture", F.when(F.col("event_id") % 29 > 0, picture))


def repeated_runs(spark, sf_dir):
    return R.repeated_runs(_frames(spark, sf_dir), "user_id", "i", "picture", RATE)


def repeated_moments(spark, sf_dir):
    f = _frames(spark, sf_dir)
    number = F.floor(F.col("i") / 6)
    segments = f.groupBy("user_id", number.alias("nr")).agg((F.min("i") / RATE).alias("s"), ((F.min("i") + 6) / RATE).alias("e"))
    segments = segments.select("user_id", "s", "e", (F.col("nr") % 4).alias("moment"), F.when(F.col("nr") % 5 > 0, F.col("nr") % 2).alias("match"), (F.col("nr") == 0).alias("hook"))
    return R.repeated_moments(R.repeated_runs(f, "user_id", "i", "picture", RATE), segments, "user_id", RATE, "s", "e", "moment", "match", "hook")


QUERIES = {f.__name__: f for f in (doubled_sources, repeated_runs, repeated_moments)}

_RUNS = f"""frames AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
pictures AS (SELECT user_id, i, (i % 17 + user_id % 5 + 3) * 40503 % 65536 + (i % 17 + user_id % 5 + 3) * 30011 % 65536 * 65536 + (i % 17 + user_id % 5 + 3) * 52711 % 65536 * 4294967296 + CASE WHEN event_id % 4 = 0 THEN 5 ELSE 0 END AS h FROM frames WHERE event_id % 29 > 0),
hits AS (SELECT a.user_id, a.i, b.i - a.i AS shift FROM pictures a JOIN pictures b ON a.user_id = b.user_id AND b.i - a.i >= 6 AND bit_count(xor(a.h, b.h)) <= {R.BITS} AND bit_count(a.h) BETWEEN 4 AND 60),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, shift ORDER BY i) AS island FROM hits),
runs AS (SELECT user_id, min(i) AS first, shift, count(*) AS n FROM islands GROUP BY user_id, shift, island HAVING count(*) >= 3)"""

ORACLE = {
    "doubled_sources": """
WITH parts AS (SELECT l_suppkey, l_partkey % 7 AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS nr, l_partkey * 3 % 60 + l_quantity / 10.0 AS s, l_linenumber FROM lineitem WHERE l_orderkey % 20 = 0),
spans AS (SELECT *, s + 1.0 + l_linenumber AS e FROM parts)
SELECT a.l_suppkey, a.file, CAST(a.nr AS INTEGER) AS a, CAST(b.nr AS INTEGER) AS b, round(least(a.e, b.e) - b.s, 6) AS twice_s FROM spans a JOIN spans b ON a.l_suppkey = b.l_suppkey AND a.file = b.file AND (a.s < b.s OR (a.s = b.s AND a.nr < b.nr))
WHERE least(a.e, b.e) - greatest(a.s, b.s) > 1.5 + 1e-6""",
    "repeated_runs": f'WITH {_RUNS} SELECT user_id, first, shift AS "offset", n FROM runs',
    "repeated_moments": f"""WITH {_RUNS},
segments AS (SELECT user_id, i // 6 AS nr, min(i) / 2.0 AS s, (min(i) + 6) / 2.0 AS e FROM frames GROUP BY user_id, i // 6),
good AS (SELECT user_id, s, e, nr % 4 AS moment, nr % 2 AS match FROM segments WHERE nr % 5 > 0 AND nr > 0),
each AS (SELECT user_id, first, shift, n, unnest(generate_series(first + 2, first + n - 1)) AS i FROM runs)
SELECT DISTINCT r.user_id, r.first, r.shift AS "offset", r.n, a.moment, b.moment AS again FROM each r JOIN good a ON a.user_id = r.user_id AND r.i / 2.0 >= a.s AND r.i / 2.0 < a.e
  JOIN good b ON b.user_id = r.user_id AND (r.i + r.shift) / 2.0 >= b.s AND (r.i + r.shift) / 2.0 < b.e WHERE a.match = b.match AND a.moment <> b.moment""",
}
