"""Dense ids and dictionaries: string or key <-> ordinal in first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftyard.session import checkpointed


def dense_ids(df: DataFrame, order: list[str] | list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """Adds consecutive ids in the order of `order` without sending all rows to one task: a range-partitioned sort, the
    row's place in its partition, and the rows of earlier partitions, one number for each partition.

    The sorted rows are checkpointed: range bounds come from a sample, and both uses must see the same partitions."""
    placed = checkpointed(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg((F.max(row) + 1).alias("__n"))
    # one row for each partition: the only ordering that needs a single task
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, (F.col("__before") + row + start).cast("long")).drop("__part", "__at", "__before")


def dictionary(df: DataFrame, value: str, seq: str, start: int = 0) -> DataFrame:
    """id, value: the distinct non-null values, numbered by where `seq` first has them. The map-side aggregation leaves
    one row a value and task."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(seq).alias("first"))
    return dense_ids(firsts, ["first", "value"], "id", start).select("id", "value")


def encode(df: DataFrame, known: DataFrame, value: str, name: str = "id") -> DataFrame:
    """`df` with the dictionary id of `value`; null where the dictionary has none."""
    return df.join(known.select(F.col("id").alias(name), F.col("value").alias("__value")), F.col(value) == F.col("__value"), "left").drop("__value")


def decode(df: DataFrame, known: DataFrame, key: str, name: str = "value") -> DataFrame:
    """`df` with the string of id `key`; null where the id is out of range."""
    return df.join(known.select(F.col("id").alias("__id"), F.col("value").alias(name)), F.col(key) == F.col("__id"), "left").drop("__id")
