"""Deduplication of fragments: keys, first occurrences, ids in flush order, collisions, manifests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftyard.operators.ids import dense_ids


def fragment_key(payload: Column) -> Column:
    """256 bits as hex."""
    return F.sha2(payload.cast("binary"), 256)


def sized_key(payload: Column, flag: Column) -> Column:
    """A key that tells its fragment's size: 236 bits of hash, a flag, 19 bits of size. 64 hex digits."""
    tail = flag.cast("long") * (1 << 19) + F.octet_length(payload) % (1 << 19)
    return F.concat(F.substring(fragment_key(payload), 1, 59), F.lpad(F.lower(F.hex(tail)), 5, "0"))


def size_of(key: Column) -> Column:
    """The size in a sized key."""
    return F.conv(F.substring(key, 60, 5), 16, 10).cast("long") % (1 << 19)


def flag_of(key: Column) -> Column:
    return F.conv(F.substring(key, 60, 5), 16, 10).cast("long") >= (1 << 19)


def prefix(key: Column, bits: int = 64) -> Column:
    """The leading bits of a hex key, a multiple of four; few bits force collisions in tests."""
    return F.substring(key, 1, bits // 4)


def first_seen(fragments: DataFrame, key: str, seq: str) -> DataFrame:
    """key, first: one row a key. Unlike a window over the key, copies of a hot key meet on the map side."""
    return fragments.groupBy(key).agg(F.min(seq).alias("first"))


def mark_new(fragments: DataFrame, key: str, seq: str, known: DataFrame | None = None) -> DataFrame:
    """`fragments` with is_new: first of its key, and not among the known keys."""
    firsts = first_seen(fragments, key, seq)
    if known is not None:
        firsts = firsts.join(known.select(key), key, "left_anti")
    firsts = firsts.select(F.col(key).alias("__key"), F.col("first").alias("__first"))
    same = (F.col(key) == F.col("__key")) & (F.col(seq) == F.col("__first"))
    return fragments.join(firsts, same, "left").withColumn("is_new", F.col("__key").isNotNull()).drop("__key", "__first")


def flush_ids(fragments: DataFrame, key: str, block: str, seq: str, start: int = 1) -> DataFrame:
    """key, block, first, id: ids are given when a block is flushed, in the block's first-seen order; 0 is reserved."""
    at = fragments.groupBy(key).agg(F.min(F.struct(F.col(block).alias("block"), F.col(seq).alias("first"))).alias("x"))
    return dense_ids(at.select(key, "x.block", "x.first"), ["block", "first"], "id", start)


def fragment_ids(fragments: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return fragments.join(ids.select(key, "id"), key)


def prefix_collisions(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """prefix, n_keys, of the prefixes that different keys share."""
    return keys.select(key).distinct().groupBy(prefix(F.col(key), bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n_keys")).filter("n_keys > 1")


def two_stage_match(rows: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows joined on the prefix, then `verified` by the whole key: a false one is a collision to be repaired."""
    right = keys.select(prefix(F.col(key), bits).alias("__prefix"), F.col(key).alias("known_key"))
    return rows.withColumn("__prefix", prefix(F.col(key), bits)).join(right, "__prefix").withColumn("verified", F.col(key) == F.col("known_key")).drop("__prefix")


def merge_verify(fragments: DataFrame, keys: DataFrame) -> DataFrame:
    """Fragments merge-joined with the key table on id; `intact` where the stored key is the fragment's."""
    stored = keys.select("id", F.col("key").alias("stored_key"))
    return fragments.join(stored.hint("merge"), "id").withColumn("intact", F.col("key") == F.col("stored_key"))


def manifests(fragments: DataFrame, file: str, order: list[str], item: str) -> DataFrame:
    """file, ids: each file's fragment ids in order. A file with id 0 (a dropped fragment) is left out."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__item"))))
    whole = fragments.groupBy(file).agg(parts.alias("p"), F.min(item).alias("least"))
    return whole.filter("least > 0").select(file, F.transform("p", lambda x: x["__item"].cast("long")).alias("ids"))


def drop_files(manifest: DataFrame, bad: DataFrame, file: str) -> DataFrame:
    """Without the files whose fragments could not be read again."""
    return manifest.join(bad.select(file), file, "left_anti")


def counts(fragments: DataFrame, key: str, selector: str, bits: int = 64) -> DataFrame:
    """Fragments, different keys, different prefixes, and keys beyond the first of their prefix (collisions): of each
    selector, and of all (`all`)."""
    once = fragments.groupBy(F.col(selector).cast("string").alias(selector), key).agg(F.count(F.lit(1)).alias("n"))
    every = once.groupBy(key).agg(F.sum("n").alias("n")).select(F.lit("all").alias(selector), key, "n")

    def told(rows):
        by = rows.groupBy(selector, prefix(F.col(key), bits).alias("p")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
        return by.groupBy(selector).agg(F.sum("n").alias("n_fragments"), F.sum("keys").alias("n_keys"), F.count(F.lit(1)).alias("n_prefixes"), F.sum(F.col("keys") - 1).alias("n_collisions"))

    return told(once).unionByName(told(every))


def repair_collisions(fragments: DataFrame, reread: DataFrame, key: str, seq: str, payload: str, bits: int = 64) -> DataFrame:
    """`fragments` (seq, key) with `id`. The first key of every prefix has its id by order of appearance. Another key with
    that prefix is a collision: its first fragment that can be read again (`reread`: seq, payload) with the same key gives it
    an id after all others; fragments of it before that, or of keys never read again, have id 0, and their file is to drop."""
    firsts = fragments.groupBy(key).agg(F.min(seq).alias("first"))
    known = firsts.groupBy(prefix(F.col(key), bits).alias("p")).agg(F.min_by(key, "first").alias("known_key"), F.min("first").alias("first"))
    known = dense_ids(known, ["first"], "id", 1).drop("first")
    rows = fragments.select(seq, key, prefix(F.col(key), bits).alias("p")).join(known, "p").drop("p")
    other = rows.filter(F.col(key) != F.col("known_key")).select(seq, key)
    again = other.join(reread.select(seq, fragment_key(F.col(payload)).alias("again")), seq).filter(F.col(key) == F.col("again"))
    start = (known.agg(F.max("id")).first()[0] or 0) + 1
    new = dense_ids(again.groupBy(key).agg(F.min(seq).alias("from_seq")), ["from_seq"], "new_id", start)
    own = F.when(F.col(key) == F.col("known_key"), F.col("id")).when(F.col(seq) >= F.col("from_seq"), F.col("new_id")).otherwise(F.lit(0))
    return rows.join(new, key, "left").select(seq, key, own.cast("long").alias("id"))


def chained_fingerprints(keys: DataFrame, block: str, order: str, key: str) -> DataFrame:
    """block, n_keys, fingerprint: of all keys up to and with this block's. Each block's keys, in order, are digested by
    themselves, in parallel; the digests, one row a block, are then chained in the order of the blocks: SHA-256 over the
    fingerprint before and the digest, as hex."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))))
    own = keys.groupBy(F.col(block).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n_keys"), F.sha2(F.array_join(F.transform(parts, lambda x: x["k"]), "").cast("binary"), 256).alias("digest"))

    def chain(batches):
        before = ""
        for batch in batches:
            out = []
            for digest in batch.column("digest").to_pylist():
                before = hashlib.sha256((before + digest).encode()).hexdigest()
                out.append(before)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n_keys"), pa.array(out, pa.string())], ["block", "n_keys", "fingerprint"])

    return own.repartition(1).sortWithinPartitions("block").mapInArrow(chain, "block long, n_keys long, fingerprint string")
