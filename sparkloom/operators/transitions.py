"""Guarded changes of state: a request is carried out only if the item is in one of the states that it asks for.

What a request does is a map of states to states, and maps compose. So a long history is cut into pieces, each piece's
map is worked out on its own, maps of pieces are composed in the same way, and each piece is told the state that it
begins in. No task sees more than a piece, however many requests one item has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settled import settled
from .selection import numbered

#: Requests, or pieces, that are folded as one array.
PIECE = 512


def _step(state: Column, guard: Column, target: Column) -> Column:
    return F.when(F.array_contains(guard, state), target).otherwise(state)


def _grouped(nodes: DataFrame) -> DataFrame:
    """Pieces of PIECE nodes(item, pos, map) at most, with the map that they make together."""
    each = nodes.groupBy("item", F.floor(F.col("pos") / PIECE).cast("long").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", "map"))).alias("parts"))
    first = F.element_at("parts", 1)["map"]
    rest = F.slice(F.col("parts"), F.lit(2), F.greatest(F.size("parts") - 1, F.lit(1)))
    composed = F.aggregate(rest, first, lambda made, p: F.transform(made, lambda s: F.element_at(p["map"], s)))
    return settled(each.withColumn("map", composed))


def _begun(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """item, piece, state of the nodes in ``pieces``, given the state that each piece begins in, ``states(item, piece, state)``: a node's piece is its place."""

    def fold(acc: Column, p: Column) -> Column:
        return F.struct(F.element_at(p["map"], acc["now"]).alias("now"), F.concat(acc["all"], F.array(F.struct(p["pos"].alias("pos"), acc["now"].alias("state")))).alias("all"))

    start = F.struct(F.col("state").alias("now"), F.array().cast("array<struct<pos:bigint,state:int>>").alias("all"))
    told = pieces.join(states, ["item", "piece"]).select("item", F.explode(F.aggregate("parts", start, fold)["all"]).alias("x"))
    return told.select("item", F.col("x.pos").alias("piece"), "x.state")


def guarded(requests: DataFrame, begin: DataFrame, item: str, at: str, tie: str, guard: str, target: str, states: list[str]) -> DataFrame:
    """``requests`` with before, after and done: the state that each meets and leaves, and whether it was carried out.

    Requests of an item are taken in order of (at, tie), which is unique within it. ``guard`` is an array of the states in
    which a request is carried out, ``target`` the state it leads to; ``begin(item, state)`` has the first state of each item,
    the first of ``states`` where it has none. A request for an unknown target is refused, an unknown state in a guard never
    met; so is a request with a null guard. Requests without item or time are refused, before and after null.
    """
    known = F.array(*[F.lit(s) for s in states])
    number = lambda c: F.array_position(known, c).cast("int")  # noqa: E731  from 1; 0 is unknown
    row = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("__row")
    whole = requests.select(row, F.col(item).alias("__item"), F.col(at).alias("__at"), F.struct(item, at, tie).alias("__by"), F.col(guard).alias("__guard"), F.col(target).alias("__target"))
    placed = numbered(whole.where("__item is not null and __at is not null"), "__by", "__place")
    firsts = placed.groupBy("__item").agg(F.min("__place").alias("__first"))
    asked, wanted = F.transform(F.coalesce("__guard", F.array().cast("array<string>")), number), number(F.col("__target"))
    made = F.array(*[F.when(wanted > 0, _step(F.lit(k + 1), asked, wanted)).otherwise(F.lit(k + 1)) for k in range(len(states))])
    rows = settled(placed.join(firsts, "__item").select("__row", F.col("__item").alias("item"), (F.col("__place") - F.col("__first")).alias("pos"), asked.alias("asked"), wanted.alias("wanted"), made.alias("map")))
    levels = [_grouped(rows.select("item", "pos", "map"))]
    while (levels[-1].agg(F.max("piece")).first()[0] or 0) > 0:
        levels.append(_grouped(levels[-1].select("item", F.col("piece").alias("pos"), "map")))
    given = begin.select(F.col(item).alias("item"), number(F.col("state")).alias("state")).where("state > 0").dropDuplicates(["item"])
    now = levels[-1].select("item", "piece").join(given, "item", "left").withColumn("state", F.coalesce("state", F.lit(1)))
    for pieces in reversed(levels):
        now = _begun(pieces, now)
    met = rows.join(now.withColumnRenamed("piece", "pos"), ["item", "pos"])
    done = F.array_contains("asked", F.col("state")) & (F.col("wanted") > 0)
    out = met.select("__row.*", F.element_at(known, F.col("state")).alias("before"), F.element_at(known, F.element_at("map", F.col("state"))).alias("after"), F.coalesce(done, F.lit(False)).alias("done"))
    none = F.lit(None).cast("string")
    return out.unionByName(requests.where(f"`{item}` is null or `{at}` is null").select(*requests.columns, none.alias("before"), none.alias("after"), F.lit(False).alias("done")))
