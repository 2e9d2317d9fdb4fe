"""Events of a key handled in event-time order, once the watermark has passed them.

Events wait in a list state until the watermark is beyond them, so one that
arrives in a later batch, but within the delay, takes its place in time. One
timer per key wakes it for its first waiting event, or for a silence it was
told to look out for. Events behind the watermark on arrival are dropped.

A stream that ends tells its last events after a closing batch: rows with a
null key carry nothing but time (see ``closing``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that list states and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Subclasses say what a key knows and what an event or a silence tells.

    ``columns`` are the result's, ``known`` the schema of what a key knows (one
    row, or nothing yet), ``value`` the event's column that is kept.
    """

    columns: list[str]
    known: str
    value: str
    value_type: str = "string"

    def event(self, key: tuple, known: tuple | None, micros: int, event_id: int, value: object) -> tuple[tuple, list[tuple]]:
        """What the key knows after an event, and the rows it tells."""
        raise NotImplementedError

    def silent_from(self, known: tuple | None) -> int | None:
        """The time in microseconds from which no event is worth telling."""
        return None

    def silence(self, key: tuple, known: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("known", self.known)
        self.waiting = handle.getListState("waiting", f"micros long, event_id long, value {self.value_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            fresh = [r for r in zip(micros.tolist(), batch["event_id"].tolist(), batch[self.value].tolist(), strict=True) if r[0] >= passed]
            if fresh:
                self.waiting.appendList(fresh)
        self._wake(passed)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        done = [r for r in rows if r[0] < passed]
        known, told = tuple(self.memory.get()) if self.memory.exists() else None, []

        def until(time: int) -> None:
            nonlocal known
            quiet = self.silent_from(known)
            if quiet is not None and quiet < time:
                known, more = self.silence(key, known)
                told.extend(more)

        for micros, event_id, value in done:
            until(micros)
            known, more = self.event(key, known, micros, event_id, value)
            told.extend(more)
        until(passed if len(done) == len(rows) else min(passed, rows[len(done)][0]))
        if known is not None:
            self.memory.update(known)
        if len(done) == len(rows):
            self.waiting.clear()
        elif done:
            self.waiting.put(rows[len(done):])
        self._wake(passed, known)
        if told:
            yield pd.DataFrame(told, columns=self.columns)

    def _wake(self, passed: int, known: tuple | None = None) -> None:
        """Keep one timer: for the first event that waits, or the silence, whichever is earlier."""
        if known is None and self.memory.exists():
            known = tuple(self.memory.get())
        times = [r[0] for r in self.waiting.get()]
        quiet = self.silent_from(known)
        times = [min(times)] if times else []
        times += [quiet] if quiet is not None else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(max(min(times), passed) // 1000 + 1)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, processor: InOrder, output: str, delay: str) -> DataFrame:
    """``events`` (``key``, ts, event_id and the processor's value column) through the processor, by key."""
    for name, value in STORE.items():
        events.sparkSession.conf.set(name, value)
    chosen = events.select(key, "ts", "event_id", processor.value).withWatermark("ts", delay)
    return chosen.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


def closing(events: DataFrame, after: str, key: str | None = None) -> DataFrame:
    """The one row of a closing batch for a bounded ``events`` (with ts): all columns null but ts, ``after`` behind the last event."""
    last = events.agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    return last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
