"""Scalar codecs against the vectors of FIXTURES.md, and as properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftyard.functions import checksums, cyrillic, dates, numeric
from siftyard.operators import chunking, sorting

LCG = bytearray()
_x = 12345
for _ in range(400_000):
    _x = (1103515245 * _x + 12345) % (1 << 31)
    LCG.append(_x >> 16 & 255)


def chunks(data: bytes, **kw):
    return list(chunking.cut(data, **kw))


def by_the_byte(data: bytes, min_size: int, average: int, most: int = (1 << 19) - 1):
    """The chunker's rule, one byte at a time."""
    out, start, limit = [], 0, (1 << (22 - average)) + 4096
    while start < len(data):
        table, prev, h, hits, i = [0] * 256, data[start], 0, 0, start
        table[prev] = prev
        while i < len(data):
            c = data[i]
            hit = table[prev] == c
            hits += hit
            table[prev] = prev = c
            i += 1
            if i - start > min_size:
                h = (h + 1 + c) * (314159265 if hit else 271828182) & 0xFFFFFFFF
                if h < limit:
                    break
            if i - start >= most:
                break
        out.append((start, i - start, hits * 100 // (i - start)))
        start = i
    return out


def test_chunk_vectors():
    assert chunks(b"") == []
    assert chunks(b"A") == [(0, 1, 100)]
    assert chunks(bytes(100_000)) == [(0, 45439, 100), (45439, 45439, 100), (90878, 9122, 100)]
    assert [s for _, s, _ in chunks(bytes(100_000), min_size=1024, average=7)] == [42367, 42367, 15266]
    fox = b"the quick brown fox jumps over the lazy dog. " * 20_000
    assert chunks(fox) == [(0, 524287, 57), (524287, 375713, 57)]
    assert chunks(bytes((i * i + 7 * i) % 251 for i in range(300_000))) == [(0, 300_000, 0)]
    found = chunks(bytes(LCG))
    assert len(found) == 6 and found[:4] == [(0, 68222, 0), (68222, 123235, 0), (191457, 75866, 0), (267323, 11198, 0)] and found[-1] == (369366, 30634, 0)
    assert [s for _, s, _ in chunks(bytes(LCG), min_size=1024, average=7)] == [68222, 123235, 208543]


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 40), st.sampled_from([0, 2, 7]))
def test_chunks_follow_the_rule(seed, times, average):
    data = seed * times
    assert chunks(data, min_size=1024, average=average) == by_the_byte(data, 1024, average)


def test_chunk_parameters():
    for bad in ({"min_size": 0}, {"min_size": 1500}, {"size_bits": 18}, {"average": 8}):
        with pytest.raises(ValueError):
            chunks(b"x", **bad)


def test_fragments_of_null_and_empty(spark):
    files = spark.createDataFrame([(1, None), (2, b""), (3, b"abc")], "file_index long, payload binary")
    assert [tuple(r) for r in chunking.fragments(files).drop("payload").collect()] == [(3, 0, 0, 3, 33)]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_cyrillic_round_trip(text):
    text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    assert cyrillic.decode_text(cyrillic.encode_text(text)) == text


def test_cyrillic_vector(spark):
    text = "Привет Ёж é € 😀"
    assert cyrillic.encode_text(text).hex() == "cff0e8e2e5f220a8e620998e208c8a88208d83b680a0b7"
    every = "".join(chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x10000)])
    assert cyrillic.decode_text(cyrillic.encode_text(every)) == every
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = df.select(F.hex(cyrillic.encode("t")), cyrillic.decode(cyrillic.encode("t")), cyrillic.encoded_size(F.col("t"))).collect()
    assert [r[0] for r in got] == [cyrillic.encode_text(text).hex().upper(), None, ""]
    assert [r[1] for r in got] == [text, None, ""] and [r[2] for r in got] == [len(cyrillic.encode_text(text)), None, 0]


def delta(values):
    """The delta rule on a list: codes and raw places."""
    prev, codes, raw = None, [], []
    for i, v in enumerate(values):
        d = v - prev if prev is not None else None
        if v and prev is not None and (d == 0 or not -(1 << 31) <= d < 1 << 31):
            raw.append(i)
            codes.append(v)
        else:
            codes.append(v if not v or prev is None else 2 * d if d >= 0 else -2 * d - 1)
        prev = v or prev
    return codes, raw


def test_delta(spark):
    rnd = random.Random(5)
    fixed = [[], [1, 2, 3], [10, 9, 8], [5, 5, 5, 6], [0, 0, 5, 7, 7, 3], [5, 0, 7], [1, 4_000_000_000, 4_000_000_001]]
    every = fixed + [[rnd.choice([0, 1, 7, rnd.randrange(1 << 32)]) for _ in range(rnd.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(every)], "i int, v array<bigint>").withColumn("x", numeric.delta_encode(F.col("v")))
    got = df.select("i", "x.codes", "x.raw_at", numeric.delta_decode(F.col("x.codes"), F.col("x.raw_at")).alias("back")).orderBy("i").collect()
    for r, v in zip(got, every, strict=True):
        assert (list(r["codes"]), list(r["raw_at"])) == delta(v) and list(r["back"]) == v
    assert list(got[4]["codes"]) == [0, 0, 5, 4, 7, 7] and list(got[4]["raw_at"]) == [4]


def test_zigzag(spark):
    ns = [0, -1, 1, -2, 2, (1 << 31) - 1, -(1 << 31)]
    df = spark.createDataFrame([(n,) for n in ns], "n int").select("n", numeric.zigzag_encode(F.col("n")).alias("z"))
    got = df.select("n", "z", numeric.zigzag_decode(F.col("z")).alias("back")).collect()
    assert [r["z"] for r in got] == [0, 1, 2, 3, 4, (1 << 32) - 2, (1 << 32) - 1] and all(r["back"] == r["n"] for r in got)


def test_integer_hashes(spark):
    told = {0: ("9ee867e972ab2369",) * 2 + ("df442d22ce4859b9",) * 2, 42: ("dc75c730905d483b",) * 2 + ("d45e2591b080b52b",) * 2, 4294967301: ("dc1ebd95b3351ac8", "b8d0ea3c3fe64fb5", "48e4506e51d3ed50", "e71bca27d11e6965")}
    df = spark.createDataFrame([(k,) for k in told], "k long")
    hashes = [numeric.int_hash(m, f)("k").alias(f"{m}{f}") for m in ("c1", "golden") for f in (False, True)]
    for r in df.select("k", *hashes).collect():
        assert tuple(f"{x & 0xFFFFFFFFFFFFFFFF:016x}" for x in r[1:]) == told[r[0]]


def test_checksums(spark):
    df = spark.createDataFrame([("123456789",), (None,)], "t string")
    assert [r[0] for r in df.select(checksums.crc32(F.col("t"))).collect()] == [0xCBF43926, None]
    assert checksums.crc32c_bytes(b"123456789") == 0xE3069283
    parts = spark.createDataFrame([(1, 2, "456789"), (1, 1, "123")], "k int, i int, t string")
    assert checksums.crc32_grouped(parts, "k", ["i"], "t").collect()[0]["crc"] == 0xCBF43926


def test_dates(spark):
    df = spark.createDataFrame([(20240229010203,), (19700101000000,), (19691231235959,), (21000301000000,), (None,)], "d long")
    got = df.select(dates.to_epoch(F.col("d")), dates.show(F.col("d")), dates.show(F.col("d"), "Asia/Tokyo")).collect()
    assert [r[0] for r in got] == [1709168523, 0, 0, 4107542400, None]
    assert [r[1] for r in got] == ["2024-02-29 01:02:03", "1970-01-01 00:00:00", " " * 19, "2100-03-01 00:00:00", None] and got[0][2] == "2024-02-29 10:02:03"
    ts = spark.sql("SELECT timestamp'1965-05-05 05:05:05' AS t UNION ALL SELECT timestamp'2024-02-29 01:02:03'").select(dates.decimal_date(F.col("t")).alias("d"))
    assert sorted(r[0] for r in ts.collect()) == [19700101000000, 20240229010203]
    one = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS now, timestamp'2024-01-01 00:00:00' AS same, timestamp'2023-01-01 00:00:00' AS old")
    r = one.select(dates.after(F.col("now"), F.col("same")), dates.after(F.col("now"), F.col("old"))).first()
    assert r[0].second == 1 and r[1].year == 2024
    assert spark.range(1).select(dates.zero_pad(F.lit(1234567), 6)).first()[0] == "234567"


def test_bits(spark):
    ns = [1, 2, 3, 4, 5, 1023, 1024, 1025, 1 << 40]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.select("n", numeric.lowest_bit_cleared(F.col("n")), numeric.trailing_zeros(F.col("n")), numeric.next_power_of_two(F.col("n")), sorting.aligned_records(F.col("n"))).collect()
    for n, cleared, zeros, power, records in got:
        assert cleared == n & (n - 1) and zeros == (n & -n).bit_length() - 1 and power == 1 << (n - 1).bit_length() and records == np.lcm(4096, n) // n
