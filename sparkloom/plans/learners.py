"""Verdicts on orders as votes for their parts, scores of orders as an audience's, and what both teach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learner as L
from .base import table

MOST = 400
START = {"price": 2.0, "size": 1.0, "name": 0.5}


def _votes(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    k = F.col("o_orderkey")
    reasons = F.when(k % 3 == 0, F.array(F.lit("dull"))).when(k % 3 == 1, F.array().cast("array<string>"))
    votes = o.select(k.alias("draft"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1).alias("thumb"), reasons.alias("reasons"))
    return L.vote_sums(votes, l.select(F.col("l_orderkey").alias("draft"), F.col("l_partkey").alias("moment")), "draft", "moment")


def vote_sums(spark, sf_dir):
    return _votes(spark, sf_dir)


def voted_pairs(spark, sf_dir):
    return L.voted_pairs(_votes(spark, sf_dir), "moment", MOST)


def _audience(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderkey") % 9 > 0, F.round(F.col("o_totalprice") / 100_000.0, 2))
    posts = o.select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 400).alias("moment"), "o_orderdate", score.alias("score"))
    return L.audience_pairs(posts, ["o_orderpriority", "o_orderstatus"], "o_orderkey", "moment", "o_orderdate", "score", 1.5, MOST)


def audience_pairs(spark, sf_dir):
    return _audience(spark, sf_dir)


def learned_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000.0).alias("price"), (F.col("p_size") / 50.0).alias("size"), F.when(F.col("p_partkey") % 4 > 0, F.length("p_name") / 20.0).alias("name"))
    voted = voted_pairs(spark, sf_dir).select(F.lit("votes").alias("source"), "place", F.lit(0.5).alias("weight"), "good", "bad")
    seen = _audience(spark, sf_dir).select(F.lit("viewers").alias("source"), "place", F.lit(1.0).alias("weight"), F.pmod("good", F.lit(1999)).alias("good"), F.pmod("bad", F.lit(1999)).alias("bad"))
    a, b = (p.select(F.col("p_partkey").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in START]) for s in ("good", "bad"))
    pairs = voted.unionByName(seen).join(a, "good").join(b, "bad").select("source", "place", "weight", *[(F.col(f"good_{n}") - F.col(f"bad_{n}")).alias(n) for n in START])
    weights, report = L.learned_weights(pairs, START, "viewers", 150, 50, 300, 30, epochs=3)
    return spark.createDataFrame([(n, w, report["rate"], report["rate_start"], report["active"]) for n, w in weights.items()], "name string, weight double, rate double, rate_start double, active boolean")


QUERIES = {f.__name__: f for f in (vote_sums, voted_pairs, audience_pairs, learned_weights)}

_SUMS = """sums AS (SELECT moment, sum(said) AS votes FROM (SELECT DISTINCT o_orderkey, l_partkey AS moment, CASE WHEN o_orderstatus = 'O' THEN 1.0 WHEN o_orderkey % 3 > 0 THEN -1.0 END AS said FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  WHERE said IS NOT NULL GROUP BY moment HAVING sum(said) <> 0)"""
_VOTED = f"""{_SUMS},
good AS (SELECT moment AS good, row_number() OVER (ORDER BY -abs(votes), moment) - 1 AS i, count(*) OVER () AS n FROM sums WHERE votes > 0),
bad AS (SELECT moment AS bad, row_number() OVER (ORDER BY -abs(votes), moment) - 1 AS j, count(*) OVER () AS m FROM sums WHERE votes < 0)"""

ORACLE = {
    "vote_sums": f"WITH {_SUMS} SELECT moment, CAST(votes AS DOUBLE) AS votes FROM sums",
    "voted_pairs": f"WITH {_VOTED} SELECT good, bad, s * n + i AS place FROM good CROSS JOIN bad CROSS JOIN generate_series(0, {MOST}) t(s) WHERE j = (i + s) % m AND s < m AND s * n + i < {MOST}",
    "audience_pairs": f"""
WITH posts AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s, o_custkey % 400 AS m, o_orderdate AS d, round(o_totalprice / 100000.0::DOUBLE, 2) AS y FROM orders WHERE o_orderkey % 9 > 0),
pairs AS (SELECT CASE WHEN a.y > b.y THEN a.id ELSE b.id END AS good, CASE WHEN a.y > b.y THEN b.id ELSE a.id END AS bad, greatest(a.d, b.d) AS newer, a.id AS hi, b.id AS lo FROM posts a JOIN posts b ON a.p = b.p AND a.s = b.s AND a.id > b.id AND a.m <> b.m AND abs(a.y - b.y) + 1e-9 >= 1.5)
SELECT good, bad, CAST(row_number() OVER (ORDER BY newer DESC, hi DESC, lo DESC) - 1 AS INTEGER) AS place FROM pairs QUALIFY place < {MOST}""",
}
