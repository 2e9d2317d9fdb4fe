"""Date columns. The day everything is measured from is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean

UNKNOWN_AGE = 999
YMD = r"(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})"


def parse_date(c: Column) -> Column:
    """Epoch (seconds, or ms above 1e10), then Y-M-D in any common spelling, then ISO."""
    raw = clean(c)
    number = F.when(raw.rlike("^[0-9]{10,15}(\\.[0-9]+)?$"), raw.cast("double"))
    seconds = F.floor(F.when(number > 10_000_000_000, number / 1000).otherwise(number))
    epoch = F.timestamp_seconds(seconds).cast("date")
    part = [F.regexp_extract(raw, YMD, i) for i in (1, 2, 3)]
    written = F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    found = F.when(part[0] != "", written.try_cast("date"))
    iso = F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(raw, 1, 10).try_cast("date"))
    return F.coalesce(epoch, found, iso)


def age_days(day: Column, as_of: str) -> Column:
    """Whole days before ``as_of``; the future is 0, unknown is 999."""
    days = F.datediff(F.lit(as_of).cast("date"), day)
    # greatest() passes over nulls, so an unknown day is told apart first.
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days)).otherwise(UNKNOWN_AGE)


def freshness(age: Column) -> Column:
    return F.when(age <= 14, 5.0).when(age <= 30, 4.0).when(age <= 60, 2.5).when(age <= 120, 1.0).otherwise(0.0)


def freshness_v4(age: Column) -> Column:
    return F.when(age <= 7, 8).when(age <= 30, 5).when(age <= 60, 2).otherwise(0)


def is_fresh(age: Column, days: int = 30) -> Column:
    """Recent or of unknown age.

    The published rule applies only when some row of the set has a known age;
    a row this drops has one itself, so no look at the rest of the set is needed.
    """
    return (age <= days) | (age == UNKNOWN_AGE)
