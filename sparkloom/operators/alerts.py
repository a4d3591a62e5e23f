"""Alerts without a flood: the last of a kind in a tick with how many there were, not again for a while, none in quiet hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_day_window, instant, local_time
from .timeline import micros, seconds, thin


def tick_end(at: Column, tick_s: float) -> Column:
    """The end of the tick that a time lies in, in microseconds: the next multiple of ``tick_s`` after it."""
    tick = seconds(tick_s)
    return (F.floor(micros(at) / tick) + 1) * tick


def coalesced(messages: DataFrame, kind: str, at: str, tie: str, text: str, tick_s: float, pause_s: float) -> DataFrame:
    """kind, tick_us, text, more: what is sent at the end of each tick: the last message of a kind, by (at, tie), and how many others.

    A kind that was sent ``pause_s`` ago or less isn't sent; what waited then is dropped, as it says nothing new. Messages
    without a kind or a time are never sent.
    """
    known = messages.where(f"`{kind}` is not null and `{at}` is not null")
    ticks = known.groupBy(F.col(kind).alias("__kind"), tick_end(F.col(at), tick_s).alias("tick_us")).agg(F.max_by(F.struct(F.col(text).alias("t")), F.struct(micros(at), F.col(tie))).alias("__last"), (F.count("*") - 1).alias("more"))
    times = ticks.select("__kind", F.timestamp_micros("tick_us").alias("__at"))
    sent = thin(times, "__kind", "__at", pause_s + 1e-6).withColumnRenamed("kept", "tick_us")
    return ticks.join(sent, ["__kind", "tick_us"], "left_semi").select(F.col("__kind").alias(kind), "tick_us", F.col("__last.t").alias(text), "more")


def due(at: Column, quiet: Column, zone: str, begin: str, end: str) -> Column:
    """When a message may be sent (timestamp): at once, or if it is a ``quiet`` one and the local time is in quiet hours, at their end.

    Equal or empty bounds are no quiet hours; hours may cross midnight. Where the clock changes, the end is the local one.
    """
    inside = F.coalesce(quiet & in_day_window(at, zone, begin, end), F.lit(False))
    now = at.cast("timestamp")
    if not begin or not end or begin == end:
        return now
    local = local_time(at, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    last = int(end[:2]) * 60 + int(end[3:5])
    day = F.when(minute >= last, F.date_add(local.cast("date"), 1)).otherwise(local.cast("date"))
    ends = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(last // 60), F.lit(last % 60), F.lit(0))
    return F.when(inside, instant(ends, zone)).otherwise(now)
