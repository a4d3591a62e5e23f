"""Whose kill it is: eliminations belong to the one who knocked the victim down, for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds that a knock counts; later its victim has been helped up.
KNOCK_MS = 90_000


def owned(events: DataFrame, key: str, knock_ms: int = KNOCK_MS) -> DataFrame:
    """Finishing ``events(key, seq, at_ms, doer, victim, knock, self, weapon)`` with owner, owner_ms, action_ms, owner_weapon.

    The owner is who last knocked the victim down, if at most ``knock_ms`` ago and not used up by another finish of that
    victim; else the doer, who owns nothing if it finished itself or there is no victim (null). ``action_ms`` is that
    knock's time, and its weapon counts. The kill's time is the knock's where someone else finished, the finish's if
    the owner did. Order is by (at_ms, seq). Null names never match and own nothing.
    """
    order = Window.partitionBy(key, "victim").orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.coalesce(F.sum((~F.col("knock")).cast("int")).over(order), F.lit(0))
    inside = Window.partitionBy(key, "victim", "__stretch").orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("knock"), F.struct("at_ms", "doer", "weapon")), ignorenulls=True).over(inside)
    marked = events.withColumn("__stretch", stretch).withColumn("__mark", last).where(~F.col("knock"))
    marked = marked.withColumn("__mark", F.when(F.col("at_ms") - F.col("__mark.at_ms") <= knock_ms, F.col("__mark")))
    knocked = F.col("__mark").isNotNull()
    named = (F.col("victim") != "") & (knocked | ~F.coalesce("self", F.lit(False)))
    owner = F.when(named, F.nullif(F.when(knocked, F.col("__mark.doer")).otherwise(F.col("doer")), F.lit("")))
    out = marked.withColumns({"owner": owner, "action_ms": F.when(owner.isNotNull(), F.col("__mark.at_ms"))})
    weapon = F.when(F.col("action_ms").isNotNull(), F.col("__mark.weapon")).otherwise(F.col("weapon"))
    return out.withColumns({"owner_weapon": weapon}).drop("__stretch", "__mark")


def remaining(events: DataFrame, key: str, total: str) -> DataFrame:
    """``events`` with remaining: ``total`` less the finishes of the key up to the event's time, ties included, 0 at least; null without a total."""
    until = Window.partitionBy(key).orderBy("at_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.coalesce(F.sum((~F.col("knock")).cast("int")).over(until), F.lit(0))
    return events.withColumn("remaining", F.when(F.col(total).isNotNull(), F.greatest(F.col(total) - gone, F.lit(0)).cast("int")))


OWN_EVENT = ("kind", "at_ms", "action_ms", "weapon", "victim_bot", "remaining", "doer_bot", "self")


def own_events(events: DataFrame, found: DataFrame, key: str, knock_ms: int = KNOCK_MS) -> DataFrame:
    """key, seq and OWN_EVENT for what concerns the own player (ids ``mine`` of ``found(key, mine, players)``).

    kind is knock, knock_suffered, kill or death. A kill's time is its knock's where a team mate finished; remaining
    counts to the finish all the same. Who did it, and whether to oneself, is told for what the player suffered only.
    """
    both = remaining(events.join(found.select(key, "mine", "players"), key), key, "players")
    mine = lambda name: F.array_contains("mine", F.col(name))
    suffered = ["victim_bot", "remaining", "doer_bot", "self"]
    dealt = ["victim_bot", "remaining", F.lit(None).cast("boolean").alias("doer_bot"), F.lit(None).cast("boolean").alias("self")]
    none = F.lit(None).cast("bigint").alias("action_ms")
    hit = both.where(mine("victim")).select(key, "seq", F.when(F.col("knock"), "knock_suffered").otherwise("death").alias("kind"), "at_ms", none, "weapon", *suffered)
    knocks = both.where(F.col("knock") & mine("doer") & ~mine("victim")).select(key, "seq", F.lit("knock").alias("kind"), "at_ms", none, "weapon", *dealt)
    done = owned(both, key, knock_ms).where(mine("owner") & ~mine("victim"))
    at = F.when(mine("doer") | F.col("action_ms").isNull(), F.col("at_ms")).otherwise(F.col("action_ms"))
    kills = done.select(key, "seq", F.lit("kill").alias("kind"), at.alias("at_ms"), "action_ms", F.col("owner_weapon").alias("weapon"), *dealt)
    return hit.unionByName(knocks).unionByName(kills)
