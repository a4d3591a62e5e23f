"""Alerts of a stream: the same rows as ``operators.alerts.coalesced`` gives for a table, by timers at the ends of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.alerts import tick_end
from ..operators.timeline import micros, seconds

_OPEN = StructType([StructField("tick_us", LongType()), StructField("us", LongType()), StructField("tie", LongType()), StructField("text", StringType()), StructField("n", LongType())])
_SENT = StructType([StructField("tick_us", LongType())])


class Calmer(StatefulProcessor):
    """For a kind: of each tick that is still open the last message and how many there were, and when it was last sent."""

    def __init__(self, names: list[str], pause_us: int):
        self.row, self.pause = Row(*names), pause_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.sent = handle.getListState("open", _OPEN), handle.getValueState("sent", _SENT)

    def handleInputRows(self, key, rows, timerValues):
        ticks = {t[0]: tuple(t) for t in self.open.get()}
        for r in rows:
            tick, us, tie, text, n = ticks.get(r["__tick"], (r["__tick"], None, None, None, 0))
            if us is None or (r["__us"], r["__tie"]) > (us, tie):
                us, tie, text = r["__us"], r["__tie"], r["__text"]
            ticks[tick] = (tick, us, tie, text, n + 1)
            self.handle.registerTimer(tick // 1000)
        self.open.put(list(ticks.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ticks = sorted(tuple(t) for t in self.open.get())
        over = [t for t in ticks if t[0] <= until]
        rest = [t for t in ticks if t[0] > until]
        if not over:
            return
        self.open.put(rest) if rest else self.open.clear()
        sent = self.sent.get()[0] if self.sent.exists() else None
        for tick, _, _, text, n in over:
            if sent is None or tick - sent > self.pause:
                sent = tick
                yield self.row(key[0], tick, text, n - 1)
        if sent is not None:
            self.sent.update((sent,))

    def close(self) -> None:
        pass


def coalesced_stream(messages: DataFrame, kind: str, at: str, tie: str, text: str, tick_s: float, pause_s: float, delay: str) -> DataFrame:
    """kind, tick_us, text, more of a stream of messages, each tick once the watermark, ``delay`` behind the newest message, has passed its end.

    ``tie`` is a whole number. Ticks are whole milliseconds long. Needs a state store for operators of this kind (RocksDB).
    """
    known = messages.where(f"`{kind}` is not null and `{at}` is not null")
    timed = known.select(F.col(kind), F.col(at).cast("timestamp").alias("__at"), tick_end(F.col(at), tick_s).alias("__tick"), micros(at).alias("__us"), F.col(tie).cast("long").alias("__tie"), F.col(text).cast("string").alias("__text")).withWatermark("__at", delay)
    fields = StructType([messages.schema[kind], StructField("tick_us", LongType()), StructField(text, StringType()), StructField("more", LongType())])
    return timed.groupBy(kind).transformWithState(Calmer(fields.names, seconds(pause_s)), fields, "append", "EventTime")
