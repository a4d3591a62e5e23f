"""Selections under quotas: a nation's orders as candidates, customers as matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quota
from .base import table

RULES = quota.Rules(per_match=2)


def _candidates(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    length = (k % 13 + 2).cast("double")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), k.alias("order_id"), F.col("o_totalprice").alias("points"), length.alias("length"), F.when(k % 11 > 0, F.col("o_custkey")).alias("match"),
        F.when(F.col("c_nationkey") % 3 == 0, k % 40 != 0).otherwise(k % 4 == 0).alias("earlier"), (k % 3).cast("int").alias("shown"), (k % 997 == 0).alias("must"), (k % (F.col("c_nationkey") % 5 + 1) == 0).alias("locked"),
    )


def quota_selection(spark, sf_dir):
    return quota.quota_choice(_candidates(spark, sf_dir), "nation", "order_id", RULES).select("nation", "order_id", "points", "match", "earlier", "target", "released")


def fresh_selection(spark, sf_dir):
    return quota.fresh_choice(_candidates(spark, sf_dir), "nation", "order_id", RULES)


QUERIES = {f.__name__: f for f in (quota_selection, fresh_selection)}

_PREFIX = """SELECT * FROM (SELECT *, row_number() OVER w - 1 AS n_before, coalesce(sum(length) OVER (PARTITION BY nation ORDER BY points DESC, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before FROM {0}
    WINDOW w AS (PARTITION BY nation ORDER BY points DESC, order_id)) WHERE NOT ((s0 + s_before >= target AND n0 + n_before >= 4) OR n0 + n_before >= 10 OR n_before >= room)"""

ORACLE = {
    "quota_selection": f"""
WITH r AS (SELECT c_nationkey AS nation, o_orderkey AS order_id, o_totalprice AS points, CAST(o_orderkey % 13 + 2 AS DOUBLE) AS length, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS match,
    CASE WHEN c_nationkey % 3 = 0 THEN o_orderkey % 40 <> 0 ELSE o_orderkey % 4 = 0 END AS earlier, o_orderkey % 997 = 0 AS must, o_orderkey % (c_nationkey % 5 + 1) = 0 AS locked
  FROM orders JOIN customer ON o_custkey = c_custkey),
longest AS (SELECT *, row_number() OVER (PARTITION BY nation, earlier ORDER BY length DESC) AS a, row_number() OVER (PARTITION BY nation, earlier, locked ORDER BY length DESC) AS f FROM r),
counts AS (SELECT nation, count(*) FILTER (NOT earlier) AS n, count(*) FILTER (NOT earlier AND NOT locked) AS nf, count(*) FILTER (locked) AS locked FROM r GROUP BY nation),
stock AS (SELECT nation, any_value(c.locked) AS locked, sum(length) FILTER (NOT earlier OR a <= n) AS every, CASE WHEN any_value(nf) > 0 THEN sum(length) FILTER (NOT l.locked AND (NOT earlier OR f <= nf)) END AS free
  FROM longest l JOIN counts c USING (nation) GROUP BY nation),
target AS (SELECT nation, locked, free, round(least(75, greatest(30, least(45, greatest(30, 0.8 * CASE WHEN n > 0 THEN every ELSE 0 END)))), 1) AS target FROM stock JOIN counts USING (nation, locked)),
plan AS (SELECT nation, target, locked > 0 AND coalesce(free, 0) < greatest(30, target) AS released FROM target),
usable AS (SELECT r.*, target, released FROM r JOIN plan USING (nation) WHERE must OR NOT locked OR released),
first AS (SELECT nation, count(*) FILTER (must) AS n, coalesce(sum(length) FILTER (must), 0) AS s, count(*) FILTER (must AND earlier) AS e FROM r GROUP BY nation),
tonight_ranked AS (SELECT u.*, row_number() OVER (PARTITION BY nation, match ORDER BY points DESC, order_id) AS place, (SELECT count(*) FROM usable m WHERE m.must AND m.nation = u.nation AND m.match = u.match) AS taken FROM usable u WHERE NOT must AND NOT earlier),
tonight_open AS (SELECT t.*, n AS n0, s AS s0, 10 AS room FROM tonight_ranked t JOIN first USING (nation) WHERE match IS NULL OR place + taken <= 2),
tonight AS ({_PREFIX.format("tonight_open")}),
so_far AS (SELECT nation, order_id, points, match, earlier, target, released, length FROM usable WHERE must UNION ALL SELECT nation, order_id, points, match, earlier, target, released, length FROM tonight),
second AS (SELECT nation, count(order_id) AS n, coalesce(sum(length), 0) AS s, count(order_id) - 2 * any_value(f.e) AS room FROM first f LEFT JOIN so_far USING (nation) GROUP BY nation),
earlier_ranked AS (SELECT u.*, row_number() OVER (PARTITION BY nation, match ORDER BY points DESC, order_id) AS place, (SELECT count(*) FROM so_far m WHERE m.nation = u.nation AND m.match = u.match) AS taken FROM usable u WHERE NOT must AND earlier),
earlier_open AS (SELECT t.*, n AS n0, s AS s0, room FROM earlier_ranked t JOIN second USING (nation) WHERE match IS NULL OR place + taken <= 2),
later AS ({_PREFIX.format("earlier_open")})
SELECT nation, order_id, points, match, earlier, target, released FROM so_far UNION ALL SELECT nation, order_id, points, match, earlier, target, released FROM later""",
}
