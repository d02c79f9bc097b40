"""CRC-32 of texts, of ordered groups, and the Castagnoli variant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def crc32_grouped(df: DataFrame, key: str, order: list[str], data: str) -> DataFrame:
    """The checksum of a group's parts in order, as if they were one text. Groups are files: their parts fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(*order, data)))
    return df.groupBy(key).agg(parts.alias("p")).select(key, F.crc32(F.array_join(F.transform("p", lambda x: x[data]), "").cast("binary")).alias("crc"))


def _table(polynomial: int) -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (polynomial if n & 1 else 0)
        out.append(n)
    return out


_CASTAGNOLI = _table(0x82F63B78)


def crc32c_bytes(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _CASTAGNOLI
    for b in data:
        c = c >> 8 ^ table[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())  # a type, not its name: workers import this module and have no session
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series(np.array([crc32c_bytes(x or b"") for x in data], np.int64))
