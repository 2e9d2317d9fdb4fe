"""Source health per refresh interval, and sources that fall silent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .inorder import InOrder, in_order

C = F.col


def stream_source_health(visits: DataFrame, interval: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """``visits(ts, source, ok)`` -> rows and successes per source and interval.

    Counts are partial before the shuffle; an interval is emitted once the
    watermark has passed its end.
    """
    return (
        visits.withWatermark("ts", delay)
        .groupBy(F.window("ts", interval).alias("w"), "source")
        .agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
        .select(C("w.start").alias("window_start"), C("w.end").alias("window_end"), "source", "n", "n_ok")
    )


def stale_sources(health: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Sources whose newest interval ended more than ``hours`` before ``as_of``."""
    newest = health.groupBy("source").agg(F.max("window_end").alias("newest"))
    return newest.withColumn("stale", C("newest") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))


class Silence(InOrder):
    """Knows a source's newest visit and whether it counts as stale; tells when that changes."""

    columns = ["source", "at", "flag"]
    known = "newest long, stale boolean"
    value = "ok"
    value_type = "boolean"

    def __init__(self, hours: int):
        self.gap = hours * 3_600_000_000

    def _row(self, key, micros: int, flag: str) -> list[tuple]:
        return [(key[0], pd.Timestamp(micros, unit="us"), flag)]

    def event(self, key, known, micros, event_id, value):
        return (micros, False), self._row(key, micros, "back") if known is not None and known[1] else []

    def silent_from(self, known):
        return None if known is None or known[1] else known[0] + self.gap

    def silence(self, key, known):
        return (known[0], True), self._row(key, known[0] + self.gap, "stale")


def stream_staleness(visits: DataFrame, hours: int = 6, delay: str = "10 minutes") -> DataFrame:
    """``visits(source, ts, event_id, ok)`` -> (source, at, flag): ``stale`` when a source has been silent
    for more than ``hours``, ``back`` at its next visit.

    By event time: late visits within ``delay`` count where they belong. State
    is one row a source and its visits of the last ``delay``; a timer a source
    tells of a silence while it lasts.
    """
    return in_order(visits, "source", Silence(hours), "source string, at timestamp, flag string", delay)
