"""Remapping ids through tables of disjoint ranges, with identity where no range holds the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Range rows up to which a nested loop over a broadcast table is used.
BROADCAST_RANGES = 10_000


def remap_small(rows: DataFrame, ranges: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """For range tables of checked size: a nested-loop join with the broadcast table."""
    r = F.broadcast(ranges.select("src_begin", "tgt_begin", "size"))
    held = (F.col(key) >= F.col("src_begin")) & (F.col(key) < F.col("src_begin") + F.col("size"))
    new = F.coalesce(F.col("tgt_begin") + F.col(key) - F.col("src_begin"), F.col(key))
    return rows.join(r, held, "left").withColumn(name, new).drop("src_begin", "tgt_begin", "size")


def remap_buckets(rows: DataFrame, ranges: DataFrame, key: str, width: int, name: str = "new_id") -> DataFrame:
    """For range tables of any size: ids and ranges meet in buckets of `width` ids by an equi-join. A range enters every
    bucket it reaches into; ranges are disjoint, so at most one matches an id."""
    last = F.col("src_begin") + F.col("size") - 1
    r = ranges.filter("size > 0").select("src_begin", "tgt_begin", "size", F.explode(F.sequence(F.floor(F.col("src_begin") / width), F.floor(last / width))).alias("__bucket"))
    probe = rows.withColumn("__bucket", F.floor(F.col(key) / width))
    held = (probe["__bucket"] == r["__bucket"]) & (F.col(key) >= F.col("src_begin")) & (F.col(key) < F.col("src_begin") + F.col("size"))
    new = F.coalesce(F.col("tgt_begin") + F.col(key) - F.col("src_begin"), F.col(key))
    return probe.join(r, held, "left").withColumn(name, new).drop(probe["__bucket"]).drop("src_begin", "tgt_begin", "size", "__bucket")


def remap(rows: DataFrame, ranges: DataFrame, key: str, name: str = "new_id", width: int = 1 << 12) -> DataFrame:
    """Chooses by the counted size of the range table."""
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return remap_small(rows, ranges, key, name) if small else remap_buckets(rows, ranges, key, width, name)


def _reached(ranges: DataFrame, width: int) -> DataFrame:
    """A row for every bucket of `width` ids that a range reaches into."""
    last = F.col("src_begin") + F.greatest(F.col("size"), F.lit(1)) - 1
    return ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("src_begin") / width), F.floor(last / width))))


def overlapping(ranges: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Ranges (src_begin, tgt_begin, size, family) that begin before an earlier one of their family ends, that stand twice, or
    whose target does not lie before the source: none in a valid table. Ranges meet in buckets of ids, by an equi-join."""
    key = ("src_begin", "tgt_begin", "size")
    once = ranges.groupBy(*key, "family").agg((F.count(F.lit(1)) > 1).alias("__twice"))
    before = _reached(once.drop("__twice"), width).select(F.struct(*key).alias("__a"), "family", "__bucket")
    own = _reached(once.drop("__twice"), width).select(F.struct(*key).alias("__b"), "family", "__bucket")
    met = before.join(own, ["family", "__bucket"]).filter((F.col("__a") < F.col("__b")) & (F.col("__b.src_begin") < F.col("__a.src_begin") + F.col("__a.size")))
    clash = met.select("__b.*", "family").distinct().withColumn("__clash", F.lit(True))
    bad = F.coalesce("__clash", F.lit(False)) | F.col("__twice") | (F.col("tgt_begin") + F.col("size") > F.col("src_begin"))
    return once.join(clash, [*key, "family"], "left").filter(bad).drop("__clash", "__twice")


def unused(ranges: DataFrame, rows: DataFrame, key: str, width: int = 1 << 12) -> DataFrame:
    """Ranges that no id of `rows` falls in. Ranges and ids meet in buckets, by an equi-join."""
    r = _reached(ranges, width)
    ids = rows.select(F.col(key).alias("__id")).distinct().withColumn("__b", F.floor(F.col("__id") / width))
    held = (F.col("__bucket") == F.col("__b")) & (F.col("__id") >= F.col("src_begin")) & (F.col("__id") < F.col("src_begin") + F.col("size"))
    used = r.join(ids, held, "left_semi").select(ranges.columns).distinct()
    return ranges.join(used, [ranges[x].eqNullSafe(used[x]) for x in ranges.columns], "left_anti")
