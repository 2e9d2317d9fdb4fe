"""What the operators share: tables, folds, staged results and a guard for column names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, stage

#: White space between words, as a character class shared by Spark's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n; null keys are in fold 0's complement (null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns can't clash with its own."""
    return df.select(*[df[n] for n in names])


def parallel(df: DataFrame, at_least: int) -> DataFrame:
    """Deal a result of few scan splits to more tasks before heavy work per row.

    A scan that is already in enough splits passes through without a shuffle.
    """
    return df.repartition(at_least) if df.rdd.getNumPartitions() < at_least else df


def seed(*parts: object) -> int:
    """A stable 31-bit seed from any parts."""
    return int.from_bytes(hashlib.sha1("|".join(map(str, parts)).encode()).digest()[:4], "big") >> 1


__all__ = ["SPACE", "fold", "narrow", "parallel", "scratch_path", "seed", "stage", "table"]
