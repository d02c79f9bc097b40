"""Sorts of record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def external_sort(df: DataFrame, *order) -> DataFrame:
    """Global order: range partitions, each sorted with spill."""
    return df.orderBy(*order)


def chunk_sort(df: DataFrame, chunk: str, *order) -> DataFrame:
    """Order inside each chunk only: rows of a chunk meet in one partition."""
    return df.repartition(chunk).sortWithinPartitions(chunk, *order)


def remap_then_sort(df: DataFrame, column: str, remapped, *order) -> DataFrame:
    """Projection before the sort."""
    return df.withColumn(column, remapped).orderBy(*order)


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows: every task keeps k."""
    return df.orderBy(*order).limit(k)


def aligned_records(size):
    """How many records of `size` bytes fill whole pages of 4096 bytes at the least: 4096 over the common divisor, which
    for a power of two is the lowest set bit of the size, at most 4096."""
    low = size.bitwiseAND(-size)
    return (F.lit(4096) / F.least(low, F.lit(4096))).cast("long")
