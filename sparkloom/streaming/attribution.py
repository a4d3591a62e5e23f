"""Kill attribution of a stream: the same rows as ``operators.attribution.owned`` gives for a table.

A victim's last knock is its state. Events wait for the watermark, so they are taken in order of their times however
they arrive; what comes after the watermark is dropped, as by any stream operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.attribution import KNOCK_MS

_EVENT = StructType([StructField("at_ms", LongType()), StructField("seq", LongType()), StructField("doer", StringType()), StructField("knock", BooleanType()), StructField("self", BooleanType()), StructField("weapon", IntegerType())])
_MARK = StructType([StructField("at_ms", LongType()), StructField("doer", StringType()), StructField("weapon", IntegerType())])
_FIELDS = ["seq", "at_ms", "doer", "owner", "action_ms", "owner_weapon"]
_TYPES = [LongType(), LongType(), StringType(), StringType(), LongType(), IntegerType()]


class Owner(StatefulProcessor):
    """Finishes of one victim with their owners, once the watermark has passed them."""

    def __init__(self, names: list[str], knock_ms: int):
        self.row, self.knock_ms = Row(*names), knock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.mark = handle.getValueState("mark", _MARK)

    def handleInputRows(self, key, rows, timerValues):
        times = set()
        for r in rows:
            self.waiting.appendValue((r["at_ms"], r["seq"], r["doer"], r["knock"], r["self"], r["weapon"]))
            times.add(r["at_ms"])
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        due = [e for e in held if e[0] <= until]
        if not due:
            return
        rest = [tuple(e) for e in held if e[0] > until]
        self.waiting.put(rest) if rest else self.waiting.clear()
        mark = tuple(self.mark.get()) if self.mark.exists() else None
        for at, seq, doer, knock, own, weapon in due:
            if knock:
                mark = (at, doer, weapon)
                continue
            fresh = mark is not None and at - mark[0] <= self.knock_ms
            owner = (mark[1] if fresh else doer) if key[1] and (fresh or not own) else None
            known = fresh and bool(owner)
            yield self.row(*key, seq, at, doer, owner or None, mark[0] if known else None, mark[2] if known else weapon)
            mark = None
        self.mark.update(mark) if mark else self.mark.clear()

    def close(self) -> None:
        pass


def owned_stream(events: DataFrame, key: str, delay: str, knock_ms: int = KNOCK_MS) -> DataFrame:
    """key, victim and seq, at_ms, doer, owner, action_ms, owner_weapon for each finish in a stream of ``events(key, seq, at_ms, doer,
    victim, knock, self, weapon)``, ``at_ms`` being milliseconds since the epoch.

    A finish comes out when the watermark, ``delay`` behind the newest event, has passed it. Needs a state store for
    operators of this kind (RocksDB). Rows with a null time, key or victim are dropped.
    """
    timed = events.where(f"at_ms is not null and victim is not null and `{key}` is not null").withColumn("__at", F.timestamp_millis("at_ms")).withWatermark("__at", delay)
    fields = [events.schema[key], StructField("victim", StringType()), *[StructField(n, t) for n, t in zip(_FIELDS, _TYPES, strict=True)]]
    return timed.groupBy(key, "victim").transformWithState(Owner([f.name for f in fields], knock_ms), StructType(fields), "append", "EventTime")
