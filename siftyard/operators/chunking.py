"""Content-defined chunking with an order-1 predictor.

A table remembers which byte last followed each byte of the fragment; a byte that it foretells is a hit. After the least
fragment size a 32-bit hash runs over the bytes, multiplied by an odd number on hits and an even one on misses, so that
misses push old bytes out. A fragment ends where the hash falls below a limit, or at the greatest size. Its score is the
percentage of hits.

Hits depend on the fragment's own bytes only and are found with numpy for a whole stretch at once; what is left of the
byte loop is one multiplication past the least size. Files are independent: one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SIZE, SIZE_BITS, AVERAGE = 4096, 19, 6
#: Bytes that are looked at first for a fragment's end; most end within them.
FIRST_LOOK = 1 << 16
_HIT, _MISS, _MASK = 314159265, 271828182, 0xFFFFFFFF


def check(min_size: int, size_bits: int, average: int) -> tuple[int, int]:
    """(greatest size, limit of the hash)."""
    most = (1 << size_bits) - 1
    if not 19 <= size_bits <= 20 or min_size < 1024 or min_size % 1024 or 2 * min_size > most + 1:
        raise ValueError("min_size must be a multiple of 1024 of at most half the greatest size; size_bits 19 or 20")
    if not 0 <= average <= 7:
        raise ValueError("average must be from 0 to 7")
    return most, (1 << (22 - average)) + 4096


def hits(data: np.ndarray) -> np.ndarray:
    """Which bytes of a fragment that starts here are foretold."""
    n = len(data)
    context = np.empty(n, np.uint8)
    context[0] = data[0]
    context[1:] = data[:-1]
    order = np.argsort(context, kind="stable")
    sorted_context = context[order]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = sorted_context[1:] != sorted_context[:-1]
    told = np.empty(n, np.uint8)
    told[1:] = data[order][:-1]
    told[first] = np.where(sorted_context[first] == data[0], data[0], 0)  # the table begins as zeros, but for the first byte
    out = np.empty(n, bool)
    out[order] = told == data[order]
    return out


def cut(data: bytes, min_size: int = MIN_SIZE, size_bits: int = SIZE_BITS, average: int = AVERAGE) -> Iterator[tuple[int, int, int]]:
    """(offset, size, score) of the fragments of one file."""
    most, limit = check(min_size, size_bits, average)
    raw, start = np.frombuffer(data, np.uint8), 0
    while start < len(raw):
        whole = raw[start : start + most]
        ahead, done, h, size = min(len(whole), FIRST_LOOK), min_size, 0, 0
        while not size:  # the look ahead doubles until the fragment ends in it
            part, hit = whole[:ahead], hits(whole[:ahead])
            factors = np.where(hit[done:], _HIT, _MISS).tolist()
            for i, (c, m) in enumerate(zip((part[done:].astype(np.int64) + 1).tolist(), factors, strict=True), done + 1):
                h = (h + c) * m & _MASK
                if h < limit:
                    size = i
                    break
            if ahead == len(whole):
                size = size or ahead
            done, ahead = max(done, ahead), min(len(whole), 2 * ahead)
        yield start, size, int(hit[:size].sum()) * 100 // size
        start += size


SCHEMA = "file_index long, seq int, file_offset long, size int, score int, payload binary"


def fragments(files: DataFrame, min_size: int = MIN_SIZE, size_bits: int = SIZE_BITS, average: int = AVERAGE) -> DataFrame:
    """Fragments of (file_index, payload) rows. Null and empty payloads have none."""
    check(min_size, size_bits, average)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for index, data in zip(batch.column("file_index").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                for seq, (offset, size, score) in enumerate(cut(data or b"", min_size, size_bits, average)):
                    for column, x in zip(rows, (index, seq, offset, size, score, data[offset : offset + size]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["file_index", "seq", "file_offset", "size", "score", "payload"])

    return files.select(F.col("file_index").cast("long").alias("file_index"), F.col("payload").cast("binary").alias("payload")).mapInArrow(run, SCHEMA)
