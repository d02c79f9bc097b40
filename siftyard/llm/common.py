"""What the operators of this subpackage share: words, Arrow helpers, tables in the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the search operators: ASCII letters and digits after lower-casing A-Z, and all that is not ASCII.
ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The ASCII white space that ends a word elsewhere; `bytes.split()` splits at just these.
BLANKS = b" \t\n\x0b\x0c\r"


def item_words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z (`bytes.lower` touches ASCII only)."""
    return ITEM_WORD.findall(data.lower())


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


_resident: dict = {}


def resident(key, build):
    """What `build()` gives, kept in this Python worker under `key` until another key is asked for: workers live on from
    stage to stage, and the tables of one operator should not fill the memory of the next."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _resident[key] = build()
    return _resident[key]


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo `modulus`; a null id falls in fold 0 of the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_column(col, modulus: int):
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def plainly(docs: DataFrame, work) -> DataFrame:
    """work(docs) with the columns that are not those of documents under plain names meanwhile: they may be called as the
    operators' own, or have dots and quotes in their names. `work` keeps the columns and their order."""
    return work(docs.toDF(*[x if x in DOCUMENT else f"further_{i}" for i, x in enumerate(docs.columns)])).toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, else the session's checkpoint folder. Where neither is set, a temporary one is
    made and set if all runs on one machine; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context.getCheckpointDir()
        if known.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = known.get() if known.isDefined() else f"file://{tempfile.mkdtemp(prefix='siftyard-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, tell: bool = False):
    """Writes `df` as Parquet in the shared folder and reads it again: the lineage ends at a table that
    survives lost executors. The folder is the caller's to empty after the job, as with checkpoints. With `tell`, also its
    path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    return (found, path) if tell else found


def tidy(spark: SparkSession) -> None:
    """Gives back what is garbage on the driver: Python's objects, and with them the plans they hold, then the JVM's heap, which
    shrinks to what is left in use, and the broadcasts and shuffles that Spark's cleaner finds. Between queries of
    a job of many plans; the heap of the driver grows to its limit otherwise, whatever is in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, fs = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    at, fs = _files(spark, path)
    fs.delete(at, True)


def folder_of(table: DataFrame) -> str:
    """The folder that a DataFrame read from one table has its files in; empty where it has none."""
    return (table.inputFiles() or [""])[0].rpartition("/")[0]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `written`, but hash-bucketed by `key`, so that later joins on it read this side without a shuffle."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
        .bucketBy(buckets, key).format("parquet").saveAsTable(table)
    )
    return spark.table(table)


def distinct_texts(docs: DataFrame, name: str) -> DataFrame:
    """One row per different text: tid (MD5 of the text, 16 bytes), text, copies (rows that have it), doc_id (the
    smallest non-null one), in a table bucketed by tid. Null counts as empty. Copies meet in the map-side part of the
    aggregation, so a text that a third of all rows share sends one row per map task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = rows.groupBy("tid").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")
    )
    return bucketed(found, name, "tid")


def text_id(col="text"):
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary")))
