"""Ranked selections under limits, pairings and greedy choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settled import settled


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """Adds each row's place (0, 1, ...) by ``by``: rows are dealt out by range, counted for each part, and numbered
    within their part, so no task sees all of them. ``by`` must be unique; equal values share a part.

    A row's part depends on the plan that deals it out, so it is written before it is counted and looked up."""
    dealt = settled(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return dealt.withColumn("inside", inside).join(before, "part").withColumn(out, F.col("before") + F.col("inside")).drop("part", "inside", "before")


def round_robin(good: DataFrame, bad: DataFrame, item: str, most: int) -> DataFrame:
    """good, bad: up to ``most`` pairs; the i-th good item meets the (i + shift)-th bad one, shift 0 first.

    Only the pairs that are asked for are made: the i-th good item has as many shifts as fit into ``most``.
    """
    g = numbered(good.select(F.col(item).alias("good")), "good", "i")
    b = numbered(bad.select(F.col(item).alias("bad")), "bad", "j")
    n_good, n_bad = good.count(), bad.count()
    if not n_good or not n_bad:
        return g.select("good", F.lit(None).cast(bad.schema[item].dataType).alias("bad")).limit(0)
    full, rest = divmod(min(most, n_good * n_bad), n_good)
    shifts = F.lit(full) + F.when(F.col("i") < rest, 1).otherwise(0)
    pairs = g.where(shifts > 0).withColumn("shift", F.explode(F.sequence(F.lit(0), shifts.cast("int") - 1)))
    pairs = pairs.withColumn("j", F.pmod(F.col("i") + F.col("shift"), F.lit(n_bad)))
    return pairs.join(b, "j").select("good", "bad")


def knapsack(rows: DataFrame, key: str, item: str, worth: Column, length: Column, most_length: float, most_items: int) -> DataFrame:
    """key, item: for each key the best items first, leaving out what would exceed ``most_length``, ``most_items`` at most.

    A greedy choice depends on every choice before it, so it is a fold over the key's candidates as one array.
    """
    one = F.struct((-worth).alias("minus"), F.col(item).alias("item"), length.alias("length"))
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast(f"array<{rows.schema[item].dataType.simpleString()}>").alias("items"))

    def choose(state, x):
        fits = (F.size(state["items"]) < most_items) & (state["total"] + x["length"] <= most_length)
        more = F.struct((state["total"] + x["length"]).alias("total"), F.concat(state["items"], F.array(x["item"])).alias("items"))
        return F.when(fits, more).otherwise(state)

    return ordered.select(key, F.explode(F.aggregate("all", start, choose, lambda s: s["items"])).alias(item))


def one_per_scene(items: DataFrame, links: DataFrame, item: str, worth: str) -> DataFrame:
    """The items that a greedy choice takes: best ``worth`` first (then smallest id), leaving out what is linked to one taken.

    ``links(a, b)`` names each linked pair once or twice. Every round takes all items that no better undecided item is
    linked to and drops their neighbours, which gives the same items as going through them one by one. Rounds are
    checkpointed to the session's shared folder.
    """
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    undecided = items.select(F.col(item).alias("id"), F.col(worth).alias("worth")).checkpoint()
    taken = None
    while undecided.take(1):
        left, right = undecided.select(F.col("id").alias("a"), F.col("worth").alias("aw")), undecided.select(F.col("id").alias("b"), F.col("worth").alias("bw"))
        open_ = pairs.join(left, "a").join(right, "b")
        beaten = open_.where((F.col("bw") > F.col("aw")) | ((F.col("bw") == F.col("aw")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("id"))
        chosen = undecided.join(beaten, "id", "left_anti").select("id").checkpoint()
        taken = chosen if taken is None else taken.unionByName(chosen)
        gone = pairs.join(chosen.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"))
        undecided = undecided.join(chosen, "id", "left_anti").join(gone, "id", "left_anti").checkpoint()
    kept = undecided.select("id") if taken is None else taken
    return items.join(kept.withColumnRenamed("id", item), item, "left_semi")
