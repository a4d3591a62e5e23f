"""Audience scores: orders as posts, their lines as what is measured of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audience as A
from .base import rounded, table

MOST = 20


def _posts(spark, sf_dir):
    o, c, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("q"), F.max("l_shipdate").alias("sampled"))
    k, q = F.col("o_orderkey"), F.col("q")
    posts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(lines, k == F.col("l_orderkey"))
    posts = posts.select(k.alias("post"), F.col("o_orderpriority").alias("platform"), F.col("c_nationkey").alias("account"), (k % 50).alias("target"), F.col("o_orderdate").alias("posted"), "sampled", (F.col("n") * 5 + k % 7).cast("double").alias("seconds"), "q", "n")
    p = F.col("post")
    numbers = {
        "views": F.when(p % 13 > 0, q * 20).otherwise(F.when(p % 2 == 0, 0)), "impressions": F.when(p % 3 == 0, q * 50), "retention_pct": F.when(p % 4 == 0, q % 160),
        "watch_s": F.when(p % 4 == 1, q % 30), "full_pct": F.when(p % 5 > 0, q % 120), "likes": F.when(p % 6 > 0, q), "comments": q % 9, "shares": F.when(p % 7 > 0, q % 15),
        "saves": q % 4, "follows": F.when(p % 2 == 0, q % 3), "rewatches": q % 21,
    }
    return A.described(posts, "posted", "sampled", "seconds", numbers).drop("sampled", "seconds", "q", "n")


def audience_scores(spark, sf_dir):
    scored = A.audience_scores(_posts(spark, sf_dir), "post", ["platform", "account"], "target", "posted", MOST)
    return scored.select("post", rounded(F.col("score") + 1e-9).alias("score"), rounded("confidence").alias("confidence"), "compared", rounded("standing.retention").alias("retention"), rounded("standing.shares").alias("shares"), rounded("standing.reach").alias("reach"))


QUERIES = {"audience_scores": audience_scores}

_NAMES = tuple(A.COMPONENTS)
_RATES = ", ".join(f"CASE WHEN {c} IS NOT NULL AND views > 0 THEN (least({c} / views, 2.0) * views + 100 * {A.COMPONENTS[n][1]}) / (views + 100) END AS {n}" for n, c in
                   {"shares": "shares_n", "saves": "saves_n", "follows": "follows_n", "rewatches": "rewatches_n", "comments": "comments_n", "likes": "likes_n"}.items())
_WEIGHTS = ", ".join(f"('{n}', {w}, {s}, {least})" for n, (w, s, least) in A.COMPONENTS.items())

ORACLE = {
    "audience_scores": f"""
WITH lines AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q, max(l_shipdate) AS sampled FROM lineitem GROUP BY l_orderkey),
posts AS (SELECT o_orderkey AS p, o_orderpriority AS platform, c_nationkey AS account, o_orderkey % 50 AS target, o_orderdate AS posted, n * 5 + o_orderkey % 7 AS len, q,
    greatest(0, (epoch_us(sampled) - epoch_us(o_orderdate)) / 86400000000.0) AS age FROM orders JOIN customer ON o_custkey = c_custkey JOIN lines ON l_orderkey = o_orderkey),
given AS (SELECT *, CASE WHEN p % 13 > 0 THEN q * 20 WHEN p % 2 = 0 THEN 0 END AS views, CASE WHEN p % 3 = 0 THEN q * 50 END AS impressions, CASE WHEN p % 4 = 0 THEN q % 160 END AS ret,
    CASE WHEN p % 4 = 1 THEN q % 30 END AS watch, CASE WHEN p % 5 > 0 THEN q % 120 END AS full_pct, CASE WHEN p % 6 > 0 THEN q END AS likes_n, q % 9 AS comments_n, CASE WHEN p % 7 > 0 THEN q % 15 END AS shares_n,
    q % 4 AS saves_n, CASE WHEN p % 2 = 0 THEN q % 3 END AS follows_n, q % 21 AS rewatches_n FROM posts),
parts AS (SELECT p, platform, account, target, posted, len, age, views, coalesce(impressions > 0, false) AS shown,
    CASE WHEN ret IS NOT NULL THEN least(1.5, ret / 100) WHEN watch IS NOT NULL AND len > 0 THEN least(1.5, watch / len) END AS retention,
    CASE WHEN full_pct IS NOT NULL THEN least(1.0, full_pct / 100) END AS completion, {_RATES},
    CASE WHEN views > 0 AND impressions > 0 THEN ln(1 + 1000 * least(2.0, views / impressions)) WHEN views > 0 THEN ln(1 + views / sqrt(greatest(0.5, age))) END AS reach FROM given),
long AS (UNPIVOT (SELECT p, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _NAMES)} FROM parts) ON {', '.join(_NAMES)} INTO NAME name VALUE x),
earlier AS (SELECT a.p, b.p AS other, a.len AS alen, b.len AS blen, a.age AS aage, b.age AS bage, a.target AS t, b.target AS u, row_number() OVER (PARTITION BY a.p ORDER BY b.posted DESC, b.p DESC) AS place
  FROM parts a JOIN parts b ON a.platform = b.platform AND a.account = b.account AND b.posted < a.posted),
cohort AS (SELECT *, CASE WHEN alen > 0 AND CAST(blen AS DOUBLE) / alen BETWEEN 0.75 AND 1.33 AND greatest(0.1, bage) / greatest(0.1, aage) BETWEEN 0.5 AND 2 THEN 1 ELSE 0 END AS near FROM earlier WHERE place <= {MOST} AND t <> u),
chosen AS (SELECT c.p, other FROM cohort c JOIN (SELECT p, sum(near) AS n FROM cohort GROUP BY p) USING (p) WHERE n < 3 OR near = 1),
sizes AS (SELECT p, count(*) AS compared FROM chosen GROUP BY p),
vals AS (SELECT c.p, l.name, l.x FROM chosen c JOIN long l ON l.p = c.other JOIN parts a ON a.p = c.p JOIN parts b ON b.p = c.other WHERE l.name <> 'reach' OR a.shown = b.shown),
medians AS (SELECT p, name, count(*) AS n, median(x) AS m FROM vals GROUP BY p, name),
spreads AS (SELECT v.p, v.name, any_value(m.n) AS n, any_value(m.m) AS m, median(abs(v.x - m.m)) AS mad FROM vals v JOIN medians m USING (p, name) GROUP BY v.p, v.name),
weights(name, w, start, least_spread) AS (VALUES {_WEIGHTS}),
standing AS (SELECT l.p, name, w, round(tanh((x - ((1 - coalesce(n, 0) / (coalesce(n, 0) + 8)) * start + coalesce(n, 0) / (coalesce(n, 0) + 8) * coalesce(m, 0))) / greatest(least_spread, {A.MAD_SIGMA} * coalesce(mad, 0))), 6) AS z
  FROM long l JOIN weights USING (name) LEFT JOIN spreads USING (p, name)),
totals AS (SELECT p, coalesce(sum(w) FILTER (name <> 'reach'), 0) AS quality, coalesce(sum(w * z) FILTER (name <> 'reach'), 0) AS total, max(z) FILTER (name = 'reach') AS reach,
    max(z) FILTER (name = 'retention') AS retention, max(z) FILTER (name = 'shares') AS shares FROM standing GROUP BY p),
scored AS (SELECT q.p, q.views, q.age, compared, t.retention, t.shares, t.reach, coalesce(quality, 0) AS quality, total, CASE WHEN t.reach IS NOT NULL THEN least(0.08, 0.05 / (quality + 0.05)) ELSE 0 END AS share
  FROM parts q LEFT JOIN totals t USING (p) LEFT JOIN sizes USING (p))
SELECT p AS post, CASE WHEN quality > 0 AND coalesce(views, 1) <> 0 THEN round((1 - share) * total / quality + share * coalesce(reach, 0) + 1e-9, 6) END AS score,
  round(CASE WHEN quality > 0 AND coalesce(views, 1) <> 0 THEN least(0.98, (quality + CASE WHEN reach IS NOT NULL THEN 0.05 ELSE 0 END) * CASE WHEN views IS NOT NULL THEN sqrt(views / (views + 200)) ELSE 0.25 END * (0.3 + 0.7 * (1 - exp(-age / 1.5)))) ELSE 0 END, 6) AS confidence,
  CAST(coalesce(compared, 0) AS INTEGER) AS compared, retention, shares, reach FROM scored""",
}
