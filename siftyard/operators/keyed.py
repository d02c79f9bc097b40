"""Keyed state as DataFrames: first wins, upsert, update, delete, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(ops: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """Insert if absent. `min_by` aggregates on the map side, so a hot key costs one row a task."""
    return ops.groupBy(key).agg(*[F.min_by(v, seq).alias(v) for v in values])


def last_wins(ops: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """Upsert, the latest value stays; `inserted_at` is the operation that was an insert."""
    return ops.groupBy(key).agg(*[F.max_by(v, seq).alias(v) for v in values], F.min(seq).alias("inserted_at"))


def update_existing(state: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """New values for keys of the state; keys that only `updates` has are not added. `updates` has one row a key."""
    new = updates.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return state.join(new, key, "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def delete_keys(state: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return state.join(gone.select(key), key, "left_anti")


def lookup(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows whose key the state has, with its values."""
    return rows.join(state, key)


def lookup_default(rows: DataFrame, state: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """All rows; `value` of the state where it has the keys, else `default`."""
    found = state.select(*keys, F.col(value).alias("__value"))
    return rows.join(found, keys, "left").withColumn(value, F.coalesce("__value", default)).drop("__value")


def known(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return rows.join(state.select(key), key, "left_semi")


def unknown(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return rows.join(state.select(key), key, "left_anti")
