"""Queries over a table of many files, over odd rows, and over large batches, against their SQL or by their memory."""

import os
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from helpers import plain

from siftyard import plans
from siftyard.operators import blocks


def documents(folder, parts: list[list[tuple]]) -> str:
    """Writes `documents` (doc_id, text) as one file for each part, the later ones older. Returns the folder of the table."""
    at = folder / "documents.parquet"
    at.mkdir(parents=True)
    for i, part in enumerate(parts):
        found = pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([r[1] for r in part], pa.string())})
        pq.write_table(found, at / f"part-{i:04d}.parquet")
        os.utime(at / f"part-{i:04d}.parquet", (2_000_000 - i * 60,) * 2)
    return str(folder)


def same(df, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(x) for x in r]) for r in found.fetchall())


def test_stream_numbers_by_place_not_by_age_of_files(spark, tmp_path):
    """Ten files, four a batch, the youngest ids in the oldest file; keys known to earlier batches come again at earlier places,
    and the null text comes in every batch."""
    parts = [[(i * 10 + k, None if k == 7 else f"text {(i * 10 + k) * 7 % 31}") for k in range(9)] for i in range(10)]
    at = documents(tmp_path, parts)
    same(plans.QUERIES["streaming_dedup"](spark, at), plans.ORACLES["streaming_dedup"], at)


def test_compact_sizes_of_odd_rows(spark, tmp_path):
    """Null and empty texts, ids that come more than once, a null id."""
    at = documents(tmp_path, [[(1, ""), (2, None), (3, "ab"), (4, None), (5, ""), (None, "n")], [(3, "Привет"), (4, "é€😀"), (5, "yz"), (6, "x")]])
    same(plans.QUERIES["utf8rus_size"](spark, at), plans.ORACLES["utf8rus_size"], at)


def test_compact_codes_without_null_texts(spark, tmp_path):
    at = documents(tmp_path, [[(1, "Ёж"), (2, None)], [(3, "é€😀")]])
    same(plans.QUERIES["utf8rus_encode"](spark, at), plans.ORACLES["utf8rus_encode"], at)


def test_packing_hands_over_in_pieces(spark, monkeypatch):
    """One batch of 24 MB that does not compress: no more than a piece and a block is held, and nothing is lost."""
    df, caught = spark.createDataFrame([], "g long, i int, t string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f))
    blocks.pack_zstd(df, "g", "i", "t", 262144)
    texts = [os.urandom(300_000) for _ in range(80)]
    batch = pa.RecordBatch.from_pydict({"g": [k // 40 for k in range(80)], "i": list(range(80)), "t": texts})
    found = list(caught[0](iter([batch])))
    assert max(x.nbytes for x in found) < blocks.PIECE + 2 * 262144 + 4096 and len(found) > 4
    rows = [r for x in found for r in x.to_pylist()]
    assert [(r["group"], r["block"], r["n"], r["raw_size"]) for r in rows] == [(k // 40, k % 40, 1, 300_000) for k in range(80)]
    assert [zstandard.ZstdDecompressor().decompressobj().decompress(r["data"]) for r in rows] == texts


def test_unpacking_holds_a_piece():
    """One batch of 96 frames, 96 MB when unpacked."""
    frames = pa.array([zstandard.ZstdCompressor().compress(bytes([k]) * (1 << 20)) for k in range(96)] + [None])
    tracemalloc.start()
    before, sizes = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes(), []
    for piece in blocks.unpack_zstd.func(iter([frames])):
        held = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
        assert held < 4 * blocks.PIECE
        sizes += [len(x.as_py() or b"") for x in piece]
    tracemalloc.stop()
    assert sizes == [1 << 20] * 96 + [0]
