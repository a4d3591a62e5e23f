"""Relational queries: joins, anti joins, conditional aggregates, unions, pairings and ranked selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import selection as P
from .base import rounded, table


def status_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done, open_ = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(open_).alias("open"),
        F.count_distinct("o_custkey").alias("customers"), rounded(F.try_divide(F.count_if(done), F.count_if(done | open_))).alias("share"),
    )


def unjudged_documents(spark, sf_dir):
    d, judged = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(judged, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def verdicts(spark, sf_dir):
    """Judged toxicity, and quality where toxicity isn't judged as 1: the stronger verdict shadows the other."""
    labels = table(spark, sf_dir, "labels")
    strong = labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("verdict"))
    weak = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("verdict")).join(strong.select("doc_id"), "doc_id", "left_anti")
    return strong.unionByName(weak)


def rejected_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 0, "rejected").when(F.col("quality") == 1, "approved")
    who = F.when(F.col("toxic") == 1, "auto")
    reason = S.first_reason([("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 200), ("poor", F.col("quality") == 0)])
    return d.select("doc_id", S.hard_rejected(status, who).alias("rejected"), reason.alias("reason"))


def exclusion_histogram(spark, sf_dir):
    r = rejected_documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return r.where("reason is not null").groupBy("lang", "reason").agg(F.count("*").alias("n"))


def served_customers(spark, sf_dir):
    """Customers with a finished order or one of urgent priority, and none that is pending."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    some = o.where("o_orderstatus = 'F' or o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    none = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(some, "c_custkey", "left_semi").join(none, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


def newest_first(spark, sf_dir):
    """Suppliers by their last delivery: a correlated maximum as an aggregate and a left join."""
    s, last = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    both = s.join(last, s["s_suppkey"] == last["l_suppkey"], "left")
    return both.orderBy(F.col("last").desc_nulls_last(), "s_suppkey").limit(50).select("s_suppkey", "last")


def changed_rows(spark, sf_dir):
    """Labelled documents whose judgement differs from what a ledger (the conversations' even ids) holds; null-safe."""
    labels = table(spark, sf_dir, "labels")
    ledger = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") % 2).cast("int").alias("quality"))
    return labels.join(ledger, (labels["doc_id"] == ledger["doc_id"]) & labels["quality"].eqNullSafe(ledger["quality"]), "left_anti").select("doc_id", "quality")


def round_robin(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return P.round_robin(labels.where("quality = 1"), labels.where("quality = 0"), "doc_id", 400)


def knapsack(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return P.knapsack(e, "user_id", "event_id", F.col("value"), F.col("value"), 120.0, 12)


def top_per_key(spark, sf_dir):
    """The three dearest lines of each supplier: the only limit is the report's own."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return lines.withColumn("place", place).where("place <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


def hit_rate(spark, sf_dir):
    """Share of order pairs of a customer (one and the next) in which the later one is dearer; ties count half."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_totalprice").over(order)).where("before is not null")
    right = F.when(F.col("o_totalprice") > F.col("before"), 1.0).when(F.col("o_totalprice") == F.col("before"), 0.5).otherwise(0.0)
    return p.groupBy("o_orderpriority").agg(rounded(F.sum(right) / F.count("*"), 4).alias("rate"), F.count("*").alias("n"))


def revenue_by_nation(spark, sf_dir):
    """A report over six tables; the small ones are broadcast by their size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c, o, li, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    j = j.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "n_name").agg(rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("s_suppkey").alias("suppliers"))


def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        rounded(F.sum("l_quantity"), 2).alias("sum_qty"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        rounded(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("count_order"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        status_report, unjudged_documents, verdicts, rejected_documents, exclusion_histogram, served_customers, newest_first, changed_rows,
        round_robin, knapsack, top_per_key, hit_rate, revenue_by_nation, pricing_summary,
    )
}

_REJECTED = """j AS (SELECT d.doc_id, d.lang, d.n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT doc_id, lang, coalesce(quality = 0, false) AND (CASE WHEN toxic = 1 THEN 'auto' END) IS DISTINCT FROM 'auto' AS rejected,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN quality = 0 THEN 'poor' END AS reason FROM j)"""

ORACLE = {
    "status_report": """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) AS customers,
  round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0), 6) AS share FROM orders GROUP BY o_orderpriority""",
    "unjudged_documents": "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source",
    "verdicts": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS verdict FROM labels",
    "rejected_documents": f"WITH {_REJECTED} SELECT doc_id, rejected, reason FROM r",
    "exclusion_histogram": f"WITH {_REJECTED} SELECT lang, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY lang, reason",
    "served_customers": """SELECT c_custkey, c_nationkey FROM customer WHERE (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
  OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "newest_first": "SELECT s_suppkey, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS last FROM supplier ORDER BY last DESC NULLS LAST, s_suppkey LIMIT 50",
    "changed_rows": """WITH k AS (SELECT conv_id AS doc_id, (max(turn) % 2)::INT AS q FROM conversations GROUP BY 1)
SELECT l.doc_id, l.quality FROM labels l LEFT JOIN k ON l.doc_id = k.doc_id AND l.quality IS NOT DISTINCT FROM k.q WHERE k.doc_id IS NULL""",
    "round_robin": """WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality = 1), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality = 0),
p AS (SELECT g.doc_id AS good, b.doc_id AS bad, ((b.i - g.i) % b.n + b.n) % b.n AS shift, g.i FROM g, b)
SELECT good, bad FROM p ORDER BY shift, i LIMIT 400""",
    "knapsack": """WITH l AS (SELECT user_id, list({'i': event_id, 'v': value} ORDER BY value DESC, event_id) AS l FROM events WHERE event_type = 'purchase' GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend({'sum': 0.0::DOUBLE, 'ids': []::BIGINT[]}, list_transform(l, lambda x: {'sum': x.v, 'ids': [x.i]})),
  lambda a, x: CASE WHEN len(a.ids) < 12 AND a.sum + x.sum <= 120 THEN {'sum': a.sum + x.sum, 'ids': list_concat(a.ids, x.ids)} ELSE a END) AS f FROM l)
SELECT user_id, unnest(f.ids) AS event_id FROM f""",
    "top_per_key": "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS place FROM lineitem QUALIFY place <= 3",
    "hit_rate": """WITH p AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT o_orderpriority, round(sum(CASE WHEN o_totalprice > b THEN 1.0::DOUBLE WHEN o_totalprice = b THEN 0.5 ELSE 0 END) / count(*), 4) AS rate, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY o_orderpriority""",
    "revenue_by_nation": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT s_suppkey) AS suppliers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
}
