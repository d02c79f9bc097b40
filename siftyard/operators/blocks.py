"""Blocks: packing by size, headers, compression."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftyard.operators.dedup import chained_fingerprints

#: Savings (bytes) beyond which a full block may grow to twice its size.
SAVINGS = 0x3FFFF
#: Bytes of blocks that a Python worker holds before it hands them over.
PIECE = 1 << 22


def fingerprint_text(date: Column, kind: Column, index: Column, magic: str = "##") -> Column:
    """Magic, 14-digit date, type letter, 10-digit index, magic."""
    digits = lambda n, d: F.lpad(F.pmod(n.cast("long"), F.lit(10**d)).cast("string"), d, "0")
    return F.concat(F.lit(magic), digits(date, 14), kind, digits(index, 10), F.lit(magic))


def fingerprint_fields(text: Column, magic: str = "##") -> list[Column]:
    """date, kind and index of such a text."""
    n = len(magic)
    at = lambda a, k: F.substring(text, n + a, k)
    return [at(1, 14).cast("long").alias("date"), at(15, 1).alias("kind"), at(16, 10).cast("long").alias("idx")]


def pack_by_size(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds `block`: rows of a group are packed in order, a block is closed when the next row would pass `limit`.
    Greedy packing depends on all rows before, so a group is one sequence; groups are what runs in parallel."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        block, filled, out = 0, 0, []
        for s in pdf["size"].tolist():
            if filled and filled + s > limit:
                block, filled = block + 1, 0
            filled += s
            out.append(block)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "size": pdf["size"], "block": out})

    kinds = dict(rows.dtypes)
    found = rows.select(group, order, F.col(size).cast("long").alias("size"))
    return found.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, size long, block long")


def pack_zstd(rows: DataFrame, group: str, order: str, payload: str, block_bytes: int, level: int = 3) -> DataFrame:
    """Packs payloads in zstandard frames: (group, block, n, raw_size, data). A block takes input up to `block_bytes`;
    beyond that, while compression has saved more than SAVINGS, up to twice as much, once."""

    def run(batches):
        at, block, o, done, held = None, -1, None, [], 0
        schema = pa.schema([("group", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("raw_size", pa.int64()), ("data", pa.binary())])

        def flush():
            nonlocal o, held
            if o:
                done.append((at, block, o["n"], o["raw"], b"".join(o["out"]) + o["c"].flush()))
                held += len(done[-1][-1])
            o = None

        def table():
            nonlocal held
            found = pa.RecordBatch.from_pydict({k: [x[i] for x in done] for i, k in enumerate(schema.names)}, schema=schema)
            done.clear()
            held = 0
            return found

        for batch in batches:
            for g, data in zip(batch.column(group), batch.column(payload), strict=True):  # one row at a time: a batch may be large
                g, data = g.as_py(), data.as_py() or b""
                if g != at:  # sorted by group: the one before is complete
                    flush()
                    at, block = g, -1
                if o and o["raw"] + len(data) > block_bytes:
                    saved = o["raw"] - sum(map(len, o["out"]))
                    if not (saved > SAVINGS and o["raw"] + len(data) <= 2 * block_bytes):
                        flush()
                if o is None:
                    block += 1
                    o = {"n": 0, "raw": 0, "out": [], "c": zstandard.ZstdCompressor(level=level, write_checksum=True).compressobj()}
                o["out"].append(o["c"].compress(data))
                o["n"] += 1
                o["raw"] += len(data)
                if held >= PIECE:
                    yield table()
        flush()
        yield table()

    source = rows.select(F.col(group).cast("long").alias(group), order, F.col(payload).cast("binary").alias(payload))
    return source.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, "group long, block long, n long, raw_size long, data binary")


@F.arrow_udf(T.BinaryType())
def unpack_zstd(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What is in the frames. A batch has thousands of blocks: they are unpacked one at a time and handed over in pieces."""
    for frames in data:
        out, held = [], 0
        for x in frames:
            out.append(zstandard.ZstdDecompressor().decompressobj().decompress(x.as_buffer()) if x.is_valid else None)
            held += len(out[-1] or b"")
            if held >= PIECE:
                yield pa.array(out, pa.binary())
                out, held = [], 0
        if out:
            yield pa.array(out, pa.binary())


@F.pandas_udf(T.BinaryType())
def bwt_compress(data: pd.Series) -> pd.Series:
    """Block-sorting compression (bz2, of the same family)."""
    return data.map(lambda x: None if x is None else bz2.compress(bytes(x)))


@F.pandas_udf(T.BinaryType())
def bwt_decompress(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else bz2.decompress(bytes(x)))


def data_blocks(rows: DataFrame, index: str, order: str, key: str, payload: str, date: Column) -> DataFrame:
    """idx, header, counter, flags (0: raw), raw_size, block_size and fingerprints of data blocks from rows that are packed
    (`index`). Keys are hex and count 32 bytes each, the header 66. A block fits a row: its packing has bounded it."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(payload).alias("t"))))
    whole = rows.groupBy(F.col(index).cast("long").alias("idx")).agg(F.count(F.lit(1)).alias("counter"), parts.alias("p"))
    text = lambda x: F.array_join(F.transform("p", lambda r: r[x]), "")
    own = whole.withColumn("header", fingerprint_text(date, F.lit("d"), F.col("idx"))).select(
        "idx", "header", "counter", F.lit(0).cast("long").alias("flags"), F.octet_length(text("t")).cast("long").alias("raw_size"),
        F.sha2(F.col("header").cast("binary"), 256).alias("header_fingerprint"), F.sha2(F.concat("header", text("k"), text("t")).cast("binary"), 256).alias("block_fingerprint"),
    )
    chain = chained_fingerprints(rows, index, order, key).select(F.col("block").alias("idx"), F.col("fingerprint").alias("keys_fingerprint"))
    return own.withColumn("block_size", F.lit(66) + F.col("counter") * 32 + F.col("raw_size")).join(chain, "idx")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Headers, keys and data of blocks as Parquet, one folder for each type."""
    blocks.write.partitionBy("type").mode("overwrite").parquet(path)
