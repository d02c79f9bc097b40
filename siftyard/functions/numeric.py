"""Integer codecs, bit helpers and hashes as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
MULTIPLIERS = {"c1": 0xDCB22CA68CB134ED, "golden": 11400714819323198485}


def zigzag_encode(n: Column) -> Column:
    """0, -1, 1, -2 ... -> 0, 1, 2, 3 ..., in 64 bits so that no int32 overflows."""
    n = n.cast("long")
    return F.when(n >= 0, 2 * n).otherwise(-2 * n - 1)


def zigzag_decode(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("long")))


def delta_code(value: Column, prev: Column) -> tuple[Column, Column]:
    """(code, raw): zeros stay; a value without predecessor is written as it is; so are repeats and jumps beyond 32 bits,
    which are reported as raw; all else is the zigzag of the difference."""
    d = value - prev
    odd = (d == 0) | (d < INT_MIN) | (d > INT_MAX)
    raw = F.coalesce((value != 0) & prev.isNotNull() & odd, F.lit(False))
    return F.when((value == 0) | prev.isNull() | odd, value).otherwise(zigzag_encode(d)), raw


def delta_encode_rows(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds code and raw to sequences of any length, one row a value."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.nullif(F.col(value), F.lit(0)), ignorenulls=True).over(before)
    rows = df.withColumn("__prev", prev)
    code, raw = delta_code(F.col(value), F.col("__prev"))
    return rows.withColumn("code", code).withColumn("raw", raw).drop("__prev")


def delta_encode(values: Column) -> Column:
    """struct<codes array<bigint>, raw_at array<int>> of an array."""
    start = F.struct(F.lit(None).cast("long").alias("prev"), F.array().cast("array<bigint>").alias("codes"), F.array().cast("array<int>").alias("raw_at"))

    def step(s, v):
        code, raw = delta_code(v, s["prev"])
        at = F.when(raw, F.array_append(s["raw_at"], F.size(s["codes"]))).otherwise(s["raw_at"])
        return F.struct(F.when(v != 0, v).otherwise(s["prev"]).alias("prev"), F.array_append(s["codes"], code).alias("codes"), at.alias("raw_at"))

    return F.aggregate(F.transform(values, lambda v: v.cast("long")), start, step, lambda s: F.struct(s["codes"].alias("codes"), s["raw_at"].alias("raw_at")))


def delta_decode(codes: Column, raw_at: Column) -> Column:
    """The array that `delta_encode` was given."""
    start = F.struct(F.lit(None).cast("long").alias("prev"), F.array().cast("array<bigint>").alias("out"))

    def step(s, c):
        raw = (c == 0) | s["prev"].isNull() | F.array_contains(raw_at, F.size(s["out"]))
        v = F.when(raw, c).otherwise(s["prev"] + zigzag_decode(c))
        return F.struct(F.when(v != 0, v).otherwise(s["prev"]).alias("prev"), F.array_append(s["out"], v).alias("out"))

    return F.aggregate(codes, start, step, lambda s: s["out"])


def lowest_bit_cleared(n: Column) -> Column:
    return n.bitwiseAND(n - 1)


def trailing_zeros(n: Column) -> Column:
    """Of a non-zero integer."""
    return F.bit_count(n.bitwiseAND(-n) - 1)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below n (n from 1 to 2**62)."""
    bits = F.length(F.bin(F.greatest(n - 1, F.lit(0)))) * F.when(n > 1, 1).otherwise(0)
    return F.pow(F.lit(2.0), bits).cast("long")


def hash_tag(h: Column) -> Column:
    """The top seven bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 57)


def hash_bucket(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n))


def int_hash(multiplier: str = "c1", folded: bool = False):
    """(key ^ C) * C modulo 2**64 as a vectorized function; `folded` first xors the high half into the low one."""
    c = np.uint64(MULTIPLIERS[multiplier])

    @F.pandas_udf(T.LongType())
    def run(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64).view(np.uint64)
        if folded:
            k = k ^ (k >> np.uint64(32))
        return pd.Series(((k ^ c) * c).view(np.int64))

    return run
