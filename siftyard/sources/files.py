"""Files as tables: recursive listings, error rows, fixed-width records."""

from __future__ import annotations

import os
import stat
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftyard.functions.dates import decimal_date


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, name, mtime (decimal date), size of all files below `root`, hidden ones left out; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return found.select(
        F.regexp_extract("path", "^(.*/)", 1).alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        decimal_date(F.col("modificationTime")).alias("mtime"), F.col("length").alias("size"),
    )


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path and payload."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("content").alias("payload"))


class ListingSource(DataSource):
    """A listing of local folders that goes on where a folder cannot be read and gives an error row for it.
    One partition for each folder directly below the root."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, name string, mtime bigint, size bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        try:
            below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
        except OSError:
            below = []
        return [InputPartition((self.root, False)), *(InputPartition((x, True)) for x in sorted(below))]

    def read(self, partition):
        root, deep = partition.value
        stack = [root]
        while stack:
            folder = stack.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield folder, None, None, None, str(e)
                continue
            for entry in entries:
                if entry.name.startswith("."):
                    continue
                try:
                    info = entry.stat(follow_symlinks=False)
                except OSError as e:
                    yield folder, entry.name, None, None, str(e)
                    continue
                if stat.S_ISDIR(info.st_mode):
                    if deep:
                        stack.append(entry.path)
                elif stat.S_ISREG(info.st_mode):
                    at = datetime.fromtimestamp(info.st_mtime, timezone.utc)
                    yield folder, entry.name, max(19700101000000, int(at.strftime("%Y%m%d%H%M%S"))), info.st_size, None


def fixed_width(df: DataFrame, payload: str, width: int) -> DataFrame:
    """idx and record: the payload in records of `width` bytes; the last may be shorter."""
    data = F.col(payload).cast("binary")
    n = F.ceil(F.octet_length(data) / width).cast("int")
    rows = df.withColumn("idx", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.withColumn("record", F.substr(data, F.col("idx") * width + 1, F.lit(width)))


def file_catalog(listing: DataFrame, directories: DataFrame) -> DataFrame:
    """d_index, size, name: files with the dictionary id of their folder."""
    return listing.join(directories.select(F.col("id").alias("d_index"), F.col("value").alias("path")), "path").select("d_index", "size", "name")
