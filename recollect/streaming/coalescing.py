"""Coalesced builds on a stream: a state and a timer per catalog, by event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.coalescing import Catalog, CoalescePolicy, due, happened, passes

LATENESS = "2 hours"
#: The state store that timers need; set it on the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_FIELDS = "generation long, published long, building long, started_at long, dirty_at long, force_at long, completed_at long, failed_at long, seen_at long"


class _Builds(StatefulProcessor):
    """Events wait until the watermark has passed them, so that they are taken in the order of time; a timer stands at each
    instant at which something happens or is due."""

    def __init__(self, policy: CoalescePolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.catalog = handle.getValueState("catalog", _FIELDS)
        self.waiting = handle.getListState("waiting", "at long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.appendValue((row["micros"], row["kind"]))
            self._timer(row["micros"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed: what it says is over, whichever timer comes first
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        c = Catalog(*self.catalog.get()) if self.catalog.exists() else Catalog()
        out = []
        for at, kind in sorted(e for e in held if e[0] <= now):
            c, fired = passes(c, at, self.policy, False)
            out += fired
            c = happened(c, kind, at, self.policy)
        c, fired = passes(c, now, self.policy, True)
        out += fired
        later = [e for e in held if e[0] > now]
        self.waiting.put(later) if later else self.waiting.clear()
        self.catalog.update((c.generation, c.published, c.building, c.started_at, c.dirty_at, c.force_at, c.completed_at, c.failed_at, c.seen_at))
        if (next_ := due(c, self.policy)) is not None:
            self._timer(next_[0])
        return iter([Row(catalog=key[0], at=at, generation=generation, reason=reason) for at, generation, reason in out])

    def _timer(self, micros: int) -> None:
        # timers count milliseconds: the first that is not before the instant
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def builds(events: DataFrame, policy: CoalescePolicy = CoalescePolicy()) -> DataFrame:
    """(catalog, at, generation, reason) of a stream events(catalog, at, kind), each build as soon as the watermark is past
    it; what coalescing.builds gives for the same events up to the watermark. Late events are dropped."""
    rows = events.withWatermark("at", LATENESS).select("catalog", "at", F.coalesce("kind", F.lit("")).alias("kind"), F.unix_micros("at").alias("micros"))
    kind = events.schema["catalog"].dataType.simpleString()
    found = rows.groupBy("catalog").transformWithState(statefulProcessor=_Builds(policy), outputStructType=f"catalog {kind}, at long, generation long, reason string", outputMode="append", timeMode="eventTime")
    return found.withColumn("at", F.timestamp_micros("at"))
