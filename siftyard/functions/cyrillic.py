"""A compact text code: ASCII and Russian letters take one byte, other characters two or three.

One byte: code points below 128 as they are; А to я, Ё and ё by their place in code page 1251. Two bytes up to U+07FF:
0x90 with the lowest four bits, 0x80 with the seven above. Three bytes for every other UTF-16 unit: 0x80 with the lowest
four bits (these lead bytes are below 0x90), then twice the next six bits with 0x80. Characters beyond U+FFFF are two units.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ONE = {chr(i): bytes([i]) for i in range(128)} | {c: c.encode("cp1251") for c in [*map(chr, range(0x410, 0x450)), "Ё", "ё"]}
_BACK = {v[0]: k for k, v in _ONE.items()}


def _units(c: str) -> list[int]:
    raw = c.encode("utf-16-le", "surrogatepass")
    return list(struct.unpack(f"<{len(raw) // 2}H", raw))


def _long(c: str) -> bytes:
    out = bytearray()
    for u in _units(c):
        out += bytes([0x90 | u & 15, 0x80 | u >> 4]) if u < 0x800 else bytes([0x80 | u & 15, 0x80 | u >> 4 & 0x3F, 0x80 | u >> 10])
    return bytes(out)


class _Codes(dict):
    def __missing__(self, c: str) -> bytes:
        found = self[c] = _long(c)
        return found


_CODES = _Codes(_ONE)


def encode_text(text: str) -> bytes:
    return text.encode() if text.isascii() else b"".join(map(_CODES.__getitem__, text))


def decode_text(data: bytes) -> str:
    if data.isascii():
        return data.decode()
    units, i, n = [], 0, len(data)
    while i < n:
        b = data[i]
        if b in _BACK:
            units.append(ord(_BACK[b]))
            i += 1
        elif b & 0xF0 == 0x90:
            units.append(b & 15 | (data[i + 1] & 0x7F) << 4)
            i += 2
        else:
            units.append(b & 15 | (data[i + 1] & 0x3F) << 4 | (data[i + 2] & 0x3F) << 10)
            i += 3
    return struct.pack(f"<{len(units)}H", *units).decode("utf-16-le", "surrogatepass")


@F.pandas_udf(T.BinaryType())  # types, not their names: workers import this module and have no session
def encode(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else encode_text(x))


@F.pandas_udf(T.StringType())
def decode(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else decode_text(bytes(x)))


def encoded_size(text: Column) -> Column:
    """Bytes of the code, counted without encoding: inside the JVM."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    one = count("[\\x00-\\x7FА-яЁё]")
    two = count("[\\x80-ЀЂ-Џѐђ-߿]")
    three, pairs = count("[ࠀ-￿]"), count("[\\x{10000}-\\x{10FFFF}]")
    return (one + 2 * two + 3 * three + 6 * pairs).cast("long")
