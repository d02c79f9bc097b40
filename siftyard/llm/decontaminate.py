"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of every benchmark item (an item of fewer words, but not
none, is one pattern). For each pattern length there is a shift table over blocks of up to three words: a block that
ends no pattern lets the search skip ahead; a block that may end one leads to the bucket of patterns with that
suffix, narrowed by their first words, and direct comparison confirms an occurrence.

Edge cases: null and empty texts have no words and no hits. Null benchmark texts give no pattern; an item with a null
id marks words but is not listed. Repeated document rows give one row each; repeated items count once by id. An empty
benchmark marks nothing. Other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import item_words, read, resident, utf8

WINDOW = 10
#: Text of benchmark items whose tables are held at once, about 100 bytes of tables for each byte.
BLOCK_BYTES = 2 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WuManber:
    """Shift tables and suffix buckets of word patterns; `items` of a pattern are what its occurrences report."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset]):
        self.tables = []
        by_length: dict[int, list] = {}
        for words, items in patterns.items():
            by_length.setdefault(len(words), []).append((list(words), items))
        for m, own in sorted(by_length.items()):
            b = min(3, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, list]] = {}
            for words, items in own:
                for end in range(b, m + 1):
                    block = tuple(words[end - b : end])
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(tuple(words[m - b :]), {}).setdefault(tuple(words[:b]), []).append((words, items))
            self.tables.append((m, b, shift, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(start, length, items) of every occurrence."""
        n = len(words)
        for m, b, shift, buckets in self.tables:
            end, far, get = m, m - b + 1, shift.get
            while end <= n:
                block = tuple(words[end - b : end])
                step = get(block, far)
                if step:
                    end += step
                    continue
                start = end - m
                for pattern, items in buckets[block].get(tuple(words[start : start + b]), ()):
                    if words[start:end] == pattern:
                        yield start, m, items
                end += 1


def patterns_of(items: list[tuple], window: int) -> dict[tuple[bytes, ...], frozenset]:
    """Windows of (item_id, text as bytes) with the ids of the items that hold them."""
    found: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        words = item_words(text or b"")
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).update([] if item_id is None else [str(item_id)])
    return {k: frozenset(v) for k, v in found.items()}


def hits(matcher: WuManber, words: list[bytes]) -> tuple[bytearray | None, set]:
    mask, items = None, set()
    for start, m, own in matcher.find(words):
        mask = mask or bytearray(len(words))
        mask[start : start + m] = b"\x01" * m
        items |= own
    return mask, items


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple]]:
    """Items in blocks of about `block_bytes` of text each. The benchmark is a stated query set; its size is read first."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], bytes(r[1])) for r in part.collect()]


def _matcher(shared, window: int) -> WuManber:
    """One block's tables per Python worker."""
    return resident(("patterns", shared.value[0], window), lambda: WuManber(patterns_of(shared.value[1], window)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: words, words inside occurrences of benchmark windows, and the items that occur.

    One narrow pass over the documents for each block of the benchmark; a benchmark within `block_bytes` needs no
    shuffle at all. Further blocks are merged by document."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = [spark.sparkContext.broadcast((uuid.uuid4().hex, items)) for items in _blocks(benchmark, block_bytes)]

    if len(shared) == 1:

        def scan(batches, own=shared[0]):
            matcher = _matcher(own, window)
            for batch in batches:
                out = [[], [], [], [], []]
                for text in utf8(batch, "text"):
                    words = item_words(text)
                    mask, items = hits(matcher, words)
                    n_hit = mask.count(1) if mask else 0
                    for column, x in zip(out, (len(words), n_hit, len(items), digest(items), n_hit > 0), strict=True):
                        column.append(x)
                yield _batch(batch.column("doc_id"), out)

        return source.mapInArrow(scan, SCHEMA)

    def part(own):
        def scan(batches):
            matcher = _matcher(own, window)
            for batch in batches:
                out = [[], [], []]
                for text in utf8(batch, "text"):
                    words = item_words(text)
                    mask, items = hits(matcher, words)
                    out[0].append(len(words))
                    out[1].append([i for i, x in enumerate(mask or ()) if x])
                    out[2].append(sorted(items))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("tid"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.string()))],
                    ["doc_id", "tid", "n_words", "places", "items"],
                )

        keyed = source.withColumn("tid", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        return keyed.mapInArrow(scan, "doc_id long, tid string, n_words long, places array<int>, items array<string>")

    every = part(shared[0])
    for own in shared[1:]:
        every = every.unionByName(part(own))
    merged = every.groupBy("doc_id", "tid").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(shared)).cast("int").alias("copies"),
    )
    return merged.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with __contaminated: the form for filters. Every block of the benchmark is one more narrow pass."""
    out = docs.withColumn("__contaminated", F.lit(False))
    for items in _blocks(benchmark, block_bytes):
        own = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

        def scan(batches, own=own):
            matcher = _matcher(own, window)
            for batch in batches:
                before = batch.column("__contaminated").to_pylist()
                found = [was or next(matcher.find(item_words(x)), None) is not None for was, x in zip(before, utf8(batch, "text"), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.bool_())], batch.schema.names)

        out = out.mapInArrow(scan, out.schema)
    return out


def _batch(doc_id, out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays([doc_id, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
h AS (SELECT uid, i, x.m, p.item_id
      FROM (SELECT uid, m.m, i, array_to_string(w[i:i + m.m - 1], ' ') AS s
            FROM d, m, LATERAL (SELECT unnest(generate_series(1, len(w) - m.m + 1)) AS i)) x JOIN p ON p.m = x.m AND p.s = x.s),
k AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY uid),
t AS (SELECT uid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.uid = d.uid LEFT JOIN t ON t.uid = d.uid
"""
