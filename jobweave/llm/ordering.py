"""Positions of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

#: monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
PLACE_BITS = 33


def numbered(df: DataFrame, *order: str, position: str = "position") -> DataFrame:
    """``df`` with a long column counting its rows from 0 in ascending ``order`` (nulls first).

    Rows equal in ``order`` come in any order, so name enough columns to tell
    different rows apart. A range sort deals the rows, a written table fixes
    which row lies where, and only one count per sorted partition meets in one
    task, whatever the number of rows. An empty table stays empty.
    """
    laid = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", PLACE_BITS).cast("int").alias("_part")
    counts = laid.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = laid.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(position, F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_at", "_part", "_before")
