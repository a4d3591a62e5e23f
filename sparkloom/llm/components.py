"""Connected components of links by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def star_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for each end of ``links(u, v)``; root is the smallest node reachable.

    A round ties each node's larger neighbours, then its smaller ones, to the smallest node around; it ends with
    stars around the roots, in a number of rounds that grows with the logarithm of the nodes. Degrees are taken by
    aggregation and a join that AQE can split, so a hub isn't gathered in one task.
    """
    edges = written(_pairs(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    seen = _mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(_pairs(large), "links-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(_pairs(small.select("e.u", "e.v")), "links")
        now = _mark(edges)
        if now == seen:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return written(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots")
        seen = now
    raise RuntimeError("components did not settle")


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of links does."""
    folded = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*").alias("n"), folded.alias("h")).first())
