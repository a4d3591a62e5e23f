"""Selections under quotas: must-haves, a limit for each match, no more from earlier evenings than from tonight, a share of fresh items.

A greedy choice takes the best item that is allowed, again and again. What an item's match allows depends on its place
among the match's items only, and items of tonight go before earlier ones, so the choice is two prefixes of ranked
items. Ranks are taken within a match and within parts of a group first, so a large group is cut down to the few items
that can be chosen before any task sees it whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settled import settled

#: Parts that a group is cut into before its items are ranked.
PARTS = 64
#: What a candidate has beside its group and id.
CANDIDATE = ("points", "length", "match", "earlier", "shown", "must", "locked")


@dataclass(frozen=True)
class Rules:
    """How long a selection is to be, in seconds and items, and its quotas."""

    target_s: float = 45.0
    factor: float = 1.0
    least_s: float = 30.0
    most_s: float = 75.0
    least: int = 4
    most: int = 10
    per_match: int = 3
    fresh_share: float = 0.5

    def target(self, stock: Column) -> Column:
        """The length to reach: ``target_s``, or 80 % of the stock if that is less, but always from least_s to most_s."""
        basis = F.least(F.lit(self.target_s), F.greatest(F.lit(self.least_s), 0.8 * stock)) * self.factor
        return F.round(F.least(F.lit(self.most_s), F.greatest(F.lit(self.least_s), basis)), 1)

    @property
    def enough(self) -> float:
        """A stock from which on more makes no difference."""
        return max(self.target_s / 0.8, self.most_s, self.least_s) + 1.0


def _part(item: str) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(PARTS))


def stock(rows: DataFrame, group: str, item: str, enough: float, out: str) -> DataFrame:
    """group, ``out``: seconds of tonight's items and of as many of the longest earlier ones; exact up to ``enough``."""
    tonight = rows.where("not earlier").groupBy(group).agg(F.sum("length").alias("__t"), F.count("*").alias("__n"))
    longest = [F.col("length").desc(), F.col(item)]
    inside = F.sum("length").over(Window.partitionBy(group, "__part").orderBy(*longest).rowsBetween(Window.unboundedPreceding, -1))
    few = rows.where("earlier").withColumn("__part", _part(item)).withColumn("__before", inside).where(F.coalesce("__before", F.lit(0.0)) < enough)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*longest))
    used = few.join(tonight, group).withColumn("__place", place).where(F.col("__place") <= F.col("__n")).groupBy(group).agg(F.sum("length").alias("__e"))
    return tonight.join(used, group, "left").select(group, (F.col("__t") + F.coalesce("__e", F.lit(0.0))).alias(out))


def _ranked(rows: DataFrame, group: str, item: str, most: int, *by: str) -> DataFrame:
    """The first ``most`` of each group by (points, item), cut down in parts first."""
    best = [F.col("points").desc(), F.col(item)]
    cut = rows.withColumn("__part", _part(item)).withColumn("__rank", F.row_number().over(Window.partitionBy(group, *by, "__part").orderBy(*best)))
    return cut.where(F.col("__rank") <= most).drop("__part", "__rank")


def _prefix(rows: DataFrame, begun: DataFrame, taken: DataFrame, group: str, item: str, rules: Rules) -> DataFrame:
    """The items that a greedy choice adds, best first: ``begun(group, __n, __s, __room, __target)`` is what it begins with, and
    ``taken(group, match, __taken)`` how many each match has in it."""
    best = [F.col("points").desc(), F.col(item)]
    single = F.when(F.col("match").isNull(), _part(item))  # items without a match have no limit, and needn't meet
    place = F.row_number().over(Window.partitionBy(group, "match", "__single").orderBy(*best))
    allowed = rows.join(taken, [group, "match"], "left").withColumn("__single", single).withColumn("__place", place)
    allowed = allowed.where(F.col("match").isNull() | (F.col("__place") + F.coalesce("__taken", F.lit(0)) <= rules.per_match)).drop("__single", "__place", "__taken")
    order = Window.partitionBy(group).orderBy(*best)
    few = _ranked(allowed, group, item, rules.most).join(begun, group)
    n, s = F.row_number().over(order) - 1, F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    counted = few.withColumn("__before", n).withColumn("__reached", s)
    done = (F.col("__s") + F.col("__reached") >= F.col("__target")) & (F.col("__n") + F.col("__before") >= rules.least)
    full = (F.col("__n") + F.col("__before") >= rules.most) | (F.col("__before") >= F.col("__room"))
    return counted.where(~(done | full)).drop("__n", "__s", "__room", "__target", "__before", "__reached")


def _taken(chosen: DataFrame, group: str) -> DataFrame:
    return chosen.where("match is not null").groupBy(group, "match").agg(F.count("*").alias("__taken"))


def quota_choice(rows: DataFrame, group: str, item: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The chosen ``rows(group, item, *CANDIDATE)`` of each group, with target and released.

    Must-haves are in. Then the best items of tonight, ``per_match`` of a match at most, until the target is reached with
    ``least`` items, or ``most`` are in; then earlier items likewise, never more of them than of tonight. Locked items
    take part only if the others can't reach the target (``released``). An item without a match is under no limit; ties
    go to the smaller id. Ids are unique; a group without items of tonight has a stock of 0. A null flag counts as no,
    null points are worst, a null length is 0.
    """
    none = F.lit(False)
    r = rows.select(group, item, F.coalesce("points", F.lit(float("-inf"))).alias("points"), F.coalesce("length", F.lit(0.0)).cast("double").alias("length"), "match",
                    F.coalesce("earlier", none).alias("earlier"), F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("must", none).alias("must"), F.coalesce("locked", none).alias("locked"))
    groups = r.where(f"`{group}` is not null").groupBy(group).agg(F.sum(F.col("locked").cast("int")).alias("__locked"), F.sum(F.col("must").cast("int")).alias("__n"), F.sum(F.when(F.col("must"), F.col("length")).otherwise(0.0)).alias("__s"), F.sum((F.col("must") & F.col("earlier")).cast("int")).alias("__e"))
    every, free = stock(r, group, item, rules.enough, "__all"), stock(r.where("not locked"), group, item, rules.enough, "__free")
    plan = groups.join(every, group, "left").join(free, group, "left").withColumn("__target", rules.target(F.coalesce("__all", F.lit(0.0))))
    short = F.coalesce("__free", F.lit(0.0)) < F.greatest(F.lit(rules.least_s), F.col("__target"))
    plan = settled(plan.withColumn("__released", (F.col("__locked") > 0) & short).select(group, "__n", "__s", "__e", "__target", "__released"))  # a row for each group
    usable = r.join(plan.select(group, "__released"), group).where("must or not locked or __released").drop("__released")
    must = usable.where("must")
    tonight = settled(_prefix(usable.where("not must and not earlier"), plan.select(group, "__n", "__s", F.lit(rules.most).alias("__room"), "__target"), _taken(must, group), group, item, rules))
    so_far = must.unionByName(tonight)
    added = tonight.groupBy(group).agg(F.count("*").alias("__k"), F.sum("length").alias("__l"))
    k, length = F.coalesce("__k", F.lit(0)), F.coalesce("__l", F.lit(0.0))
    # As many earlier ones as of tonight: must-haves of either kind count too.
    begun = plan.join(added, group, "left").select(group, (F.col("__n") + k).alias("__n"), (F.col("__s") + length).alias("__s"), F.greatest(F.col("__n") + k - 2 * F.col("__e"), F.lit(0)).alias("__room"), "__target")
    earlier = _prefix(usable.where("not must and earlier"), begun, _taken(so_far, group), group, item, rules)
    return so_far.unionByName(earlier).join(plan.select(group, F.col("__target").alias("target"), F.col("__released").alias("released")), group)


def repaired(chosen: list[dict], fresh: list[dict], rules: Rules) -> list[dict]:
    """``chosen`` with the weakest items that were shown before swapped for the best ``fresh`` ones, until enough are fresh or none fits.

    Must-haves stay. A fresh item may come if its match has room, if need be the place of the one that goes, and if earlier
    items don't come to outnumber tonight's, or no more than before.
    """
    chosen, fresh = list(chosen), list(fresh)
    over = lambda items: sum(1 if x["earlier"] else -1 for x in items)
    need = math.ceil(rules.fresh_share * len(chosen) - 1e-9)
    while sum(x["shown"] == 0 for x in chosen) < need:
        old = [x for x in chosen if x["shown"] > 0 and not x["must"]]
        if not old:
            break
        out = min(old, key=lambda x: (x["points"], x["item"]))
        rest = [x for x in chosen if x is not out]
        for new in fresh:
            room = new["match"] is None or new["match"] == out["match"] or sum(x["match"] == new["match"] for x in chosen) < rules.per_match
            if room and (not new["earlier"] or over([*rest, new]) <= max(0, over(chosen))):
                break
        else:
            break
        fresh.remove(new)
        chosen[chosen.index(out)] = new
    return chosen


def fresh_choice(rows: DataFrame, group: str, item: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """group, ``item``, target, released of ``quota_choice()``, then swapped for fresh items (shown 0) until ``fresh_share`` of them are.

    A group's repair sees its choice and the fresh items that can come into question: ``most`` of each match that is in the
    choice, ``most`` others of tonight and of earlier, whatever the group's size.
    """
    chosen = settled(quota_choice(rows, group, item, rules))
    count = chosen.groupBy(group).agg(F.count("*").alias("__n"), F.sum((F.col("shown") == 0).cast("int")).alias("__f"), F.first("released").alias("released"), F.first("target").alias("target"))
    lacking = count.where(F.col("__f") < F.ceil(rules.fresh_share * F.col("__n") - 1e-9)).select(group, "target", "released")
    kinds = chosen.schema
    normal = rows.select(group, item, F.coalesce("points", F.lit(float("-inf"))).alias("points"), F.coalesce("length", F.lit(0.0)).cast("double").alias("length"), F.col("match"),
                         F.coalesce("earlier", F.lit(False)).alias("earlier"), F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("must", F.lit(False)).alias("must"), F.coalesce("locked", F.lit(False)).alias("locked"))
    open_ = normal.where("shown = 0 and not must").join(lacking, group).where("not locked or released").join(chosen.select(group, item), [group, item], "left_anti")
    matches = chosen.where("match is not null").select(group, "match").distinct().withColumn("__in", F.lit(True))
    open_ = open_.join(matches, [group, "match"], "left").withColumn("__kind", F.when(F.col("__in"), F.col("match")))
    few = _ranked(open_, group, item, rules.most, "earlier", "__kind")
    place = F.row_number().over(Window.partitionBy(group, "earlier", "__kind").orderBy(F.col("points").desc(), item))
    few = few.withColumn("__place", place).where(F.col("__place") <= rules.most).select(*[c for c in chosen.columns if c not in ("target", "released")], "target", "released")
    both = chosen.join(lacking.select(group), group, "left_semi").withColumn("__new", F.lit(False)).unionByName(few.withColumn("__new", F.lit(True)))
    fields = ["points", "match", "earlier", "shown", "must"]

    def repair(part: pd.DataFrame) -> pd.DataFrame:
        part = part.rename(columns={item: "item"})
        whole = part[["item", *fields, "__new"]].astype(object).where(part[["item", *fields, "__new"]].notna(), None).to_dict("records")
        fresh = sorted((x for x in whole if x["__new"]), key=lambda x: (x["earlier"], -x["points"], x["item"]))
        kept = repaired([x for x in whole if not x["__new"]], fresh, rules)
        return pd.DataFrame({group: part[group].iloc[0], item: [x["item"] for x in kept], "target": part["target"].iloc[0], "released": part["released"].iloc[0]})

    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (group, item, "target", "released"))
    mended = both.groupBy(group).applyInPandas(repair, ddl)
    return chosen.join(lacking.select(group), group, "left_anti").select(group, item, "target", "released").unionByName(mended)
