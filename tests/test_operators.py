"""Keyed state, dictionaries, ranges, deduplication, blocks, sources and streams on small tables, edge cases included."""

import base64
import hashlib
import os
import random

from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftyard.operators import blocks, chunking, dedup, ids, keyed, ranges, sorting
from siftyard.sources import files
from siftyard.streaming import incremental

QUIET = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_keyed(spark):
    ops = spark.createDataFrame([(1, 0, 10), (1, 5, 11), (2, 3, None), (None, 4, 7), (None, 1, 8)], "k int, seq int, v int")
    assert rows(keyed.first_wins(ops, "k", "seq", ["v"])) == rows(spark.createDataFrame([(1, 10), (2, None), (None, 8)], "k int, v int"))
    assert rows(keyed.last_wins(ops, "k", "seq", ["v"])) == rows(spark.createDataFrame([(1, 11, 0), (2, None, 3), (None, 7, 1)], "k int, v int, i int"))
    state = spark.createDataFrame([(1, 5), (2, 6), (4, 8)], "k int, v int")
    new = spark.createDataFrame([(2, None), (3, 9), (4, 0)], "k int, v int")
    assert rows(keyed.update_existing(state, new, "k", "v")) == [(1, 5), (2, None), (4, 0)]
    assert rows(keyed.delete_keys(state, new, "k")) == [(1, 5)] == rows(keyed.unknown(state, new, "k"))
    assert rows(keyed.known(state, new, "k")) == [(2, 6), (4, 8)]
    assert rows(keyed.lookup_default(state.select("k"), new, ["k"], "v", F.lit(-1))) == [(1, -1), (2, -1), (4, 0)]


@settings(**QUIET)
@given(st.lists(st.sampled_from(["a", "b", "c", "ä", ""]), max_size=30))
def test_dictionary_is_a_bijection(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, v string")
    found = ids.dictionary(df, "v", "i")
    firsts = list(dict.fromkeys(values))
    assert {r["value"]: r["id"] for r in found.collect()} == {v: i for i, v in enumerate(firsts)}
    coded = ids.encode(df, found, "v")
    back = ids.decode(coded, found, "id", "again")
    assert all(r["v"] == r["again"] for r in back.collect())


def test_dense_ids_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    got = ids.dense_ids(df, ["x"], "n", 5).collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(i, i + 5) for i in range(1000)]
    assert ids.dense_ids(df.filter("x < 0"), ["x"]).count() == 0


@settings(**QUIET)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 9)), max_size=12), st.integers(0, 1 << 30))
def test_ranges_equal_brute_force(spark, parts, seed):
    at, table = 40, []
    for gap, size in parts:
        at += gap
        table.append((at, at // 2 - size, size))
        at += size
    rnd = random.Random(seed)
    keys = [b + d for b, _, s in table for d in (0, s - 1, s)] + [rnd.randrange(200) for _ in range(20)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    r = spark.createDataFrame([(*x, "L") for x in table], "src_begin long, tgt_begin long, size int, family string")
    expected = sorted((k, next((t + k - b for b, t, s in table if b <= k < b + s), k)) for k in keys)
    for got in (ranges.remap_small(df, r, "k"), ranges.remap_buckets(df, r, "k", 7), ranges.remap(df, r, "k")):
        assert sorted(map(tuple, got.collect())) == expected


def test_range_validation(spark):
    r = spark.createDataFrame([(10, 1, 5, "L"), (14, 2, 2, "L"), (14, 2, 2, "H"), (20, 19, 5, "H")], "src_begin long, tgt_begin long, size int, family string")
    assert [(x["src_begin"], x["family"]) for x in sorted(ranges.overlapping(r).collect())] == [(14, "L"), (20, "H")]
    assert [x["src_begin"] for x in ranges.unused(r, spark.createDataFrame([(11,), (14,)], "k long"), "k").collect()] == [20]


def test_dedup(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, "a"), (4, 1, "c"), (5, 1, None), (6, 2, "b")], "seq long, block long, text string")
    df = df.withColumn("key", dedup.fragment_key(F.col("text")))
    known = df.filter("text = 'c'").select("key")
    got = {r["seq"]: r["is_new"] for r in dedup.mark_new(df, "key", "seq", known).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    flushed = {r["first"]: r["id"] for r in dedup.flush_ids(df.filter("key is not null"), "key", "block", "seq").collect()}
    assert flushed == {1: 1, 2: 2, 4: 3}
    pairs = dedup.two_stage_match(df.select("seq", "key"), known, "key", 4)
    assert [r["seq"] for r in pairs.filter("verified").collect()] == [4]
    rows_ = spark.createDataFrame([(1, 2, 8), (1, 1, 9), (2, 1, 0), (2, 2, 5), (3, 1, 7)], "f long, o int, i long")
    assert rows(dedup.manifests(rows_, "f", ["o"], "i")) == [(1, [9, 8]), (3, [7])]


def test_sorts(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 10) for i in range(30)], "c int, v int")
    assert [tuple(r) for r in sorting.external_sort(df, "c", "v").collect()] == sorted((i % 3, (i * 7) % 10) for i in range(30))
    by: dict = {}
    for c, v in sorting.chunk_sort(df, "c", "v").collect():
        by.setdefault(c, []).append(v)
    assert all(v == sorted(v) for v in by.values()) and len(by) == 3
    assert len(sorting.top_k(df, 4, "v").collect()) == 4


def test_packing(spark):
    sizes = [50, 60, 200, 10, 10, 90, 1]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)] + [("h", 0, 7)], "g string, i int, s int")
    got = {(r["g"], r["i"]): r["block"] for r in blocks.pack_by_size(df, "g", "i", "s", 110).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 2, ("g", 5): 2, ("g", 6): 3, ("h", 0): 0}


def test_zstd_blocks_grow_with_savings(spark):
    easy = [(0, i, "a" * 300_000) for i in range(4)]
    hard = [(1, i, base64.b64encode(os.urandom(225_000)).decode()) for i in range(4)]
    df = spark.createDataFrame(easy + hard, "g long, i int, t string")
    got = blocks.pack_zstd(df, "g", "i", "t", 600_000)
    assert {g: sorted(r["raw_size"] for r in got.collect() if r["group"] == g) for g in (0, 1)} == {0: [1_200_000], 1: [600_000, 600_000]}
    back = got.orderBy("group", "block").select("group", blocks.unpack_zstd("data").alias("d")).collect()
    assert b"".join(bytes(r["d"]) for r in back if r["group"] == 1) == "".join(x[2] for x in hard).encode()


def test_headers(spark):
    text = spark.range(1).select(blocks.fingerprint_text(F.lit(20240229010203), F.lit("d"), F.lit(42)).alias("t"))
    assert text.first()[0] == "##20240229010203d0000000042##"
    assert tuple(text.select(*blocks.fingerprint_fields(F.col("t"))).first()) == (20240229010203, "d", 42)


def test_listing_with_errors(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("hello")
    (tmp_path / "y.bin").write_bytes(b"12")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    listed = {(r["name"], r["size"]) for r in files.list_files(spark, f"file://{tmp_path}").collect()}
    assert {("x.txt", 5), ("y.bin", 2)} <= listed and ".hidden" not in {n for n, _ in listed}
    spark.dataSource.register(files.ListingSource)
    got = spark.read.format("file_listing").option("path", str(tmp_path)).load().collect()
    assert {(r["name"], r["size"], r["error"]) for r in got} == {("x.txt", 5, None), ("y.bin", 2, None)}
    missing = spark.read.format("file_listing").option("path", f"{tmp_path}/none").load().collect()
    assert len(missing) == 1 and missing[0]["error"]


def test_stream_equals_batch(spark, tmp_path):
    docs = [(i, f"text {i % 7}") for i in range(40)]
    for part in range(4):
        spark.createDataFrame(docs[part * 10 : part * 10 + 10], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keys = incremental.KeyTable(spark, f"{tmp_path}/keys")
    incremental.dedup_stream(source, keys, f"{tmp_path}/state")
    got = keys.read().collect()
    assert len(got) == 7 and sorted(r["id"] for r in got) == list(range(1, 8))
    # a batch that is run again replaces its own rows
    keys.add(spark.createDataFrame(docs[:10], "doc_id long, text string"), 0, "text", "doc_id")
    assert keys.read().count() == 7
    distinct = incremental.distinct_stream(source, "text")
    distinct.writeStream.format("memory").queryName("distinct_texts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("distinct_texts").count() == 7


def test_stream_with_watermark(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id % 5 AS k FROM range(50)").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, k long").parquet(f"{tmp_path}/in")
    query = incremental.distinct_stream(source, "k", "ts").writeStream.format("memory").queryName("marked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("marked").count() == 5


def test_fragments_of_a_stream(spark, tmp_path):
    """Chunking on a stream gives what it gives on the table."""
    rnd = random.Random(3)
    for part in range(3):
        files_ = [(part * 10 + i, rnd.randbytes(rnd.randrange(0, 200_000))) for i in range(3)]
        spark.createDataFrame(files_, "file_index long, payload binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("file_index long, payload binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    chunking.fragments(source).drop("payload").writeStream.format("memory").queryName("fragments").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("fragments")) == rows(chunking.fragments(spark.read.parquet(f"{tmp_path}/in")).drop("payload")) and spark.table("fragments").count() > 9


def test_collision_repair(spark):
    """The first key of a prefix keeps its id; others get one by the first fragment that reads the same again, or 0."""
    texts = ["a", "b", "a", "c", "b", "b", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").withColumn("key", dedup.fragment_key(F.col("text")))
    again = spark.createDataFrame([(1, "changed"), (4, "b"), (6, "other")], "seq long, text string")
    got = dedup.repair_collisions(df.select("seq", "key"), again, "key", "seq", "text", 0).collect()
    assert {r["seq"]: r["id"] for r in got} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 2, 5: 2, 6: 0}


def test_fingerprints_cover_earlier_blocks(spark):
    keys = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (2, 4, "d"), (1, 3, "c")], "block long, id long, key string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = digest(digest("ab"))
    second = digest(first + digest("c"))
    assert rows(dedup.chained_fingerprints(keys, "block", "id", "key")) == [(0, 2, first), (1, 1, second), (2, 1, digest(second + digest("d")))]
