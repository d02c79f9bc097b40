"""Incremental deduplication: micro-batches against a table of known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.operators.dedup import fragment_key
from siftyard.operators.ids import dense_ids
from siftyard.session import checkpointed


class KeyTable:
    """Known keys with dense ids in Parquet, one folder a micro-batch: a batch that is run again replaces its own
    folder, so ids and counts do not depend on retries. The null key is a key like others.

    A batch may also have a known key at an earlier place than all batches before. That place is written too, without an
    id: ids of arrival stay as they are, and `in_order` can number by place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, before: int | None = None) -> DataFrame:
        schema = "key string, first long, id long, batch long"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """batch, key, id of the batches earlier than `before`: ids of arrival."""
        return self._rows(before).filter("id is not null")

    def in_order(self) -> DataFrame:
        """key, id: dense ids by the least place of each key over all batches, in whatever order the batches came."""
        firsts = self._rows().groupBy("key").agg(F.min("first").alias("first"))
        return dense_ids(firsts, [F.col("first").asc_nulls_last(), F.col("key")], "id", 1).select("key", "id")

    def add(self, batch: DataFrame, batch_id: int, text: str, seq: str) -> None:
        """New keys of a micro-batch get the next ids, in the order in which the batch has them."""
        start = (self.read(batch_id).agg(F.max("id")).first()[0] or 0) + 1
        known = self._rows(batch_id).groupBy(F.col("key").alias("__key")).agg(F.min("first").alias("__least")).withColumn("__known", F.lit(True))
        keys = batch.select(fragment_key(F.col(text)).alias("key"), F.col(seq).cast("long").alias("seq"))
        firsts = keys.groupBy("key").agg(F.min("seq").alias("first")).join(known, F.col("key").eqNullSafe(F.col("__key")), "left")
        earlier = (F.col("first") < F.col("__least")) | (F.col("first").isNotNull() & F.col("__least").isNull())
        found = checkpointed(firsts.filter(F.col("__known").isNull() | earlier).select("key", "first", "__known"))
        new = dense_ids(found.filter("__known is null").select("key", "first"), ["first"], "id", start)
        moved = found.filter("__known").select("key", "first", F.lit(None).cast("long").alias("id"))
        new.unionByName(moved).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def dedup_stream(source: DataFrame, keys: KeyTable, checkpoint: str, text: str = "text", seq: str = "doc_id"):
    """Runs what is there in micro-batches (at the pace of the source's maxFilesPerTrigger) and stops."""
    writer = source.writeStream.foreachBatch(lambda df, n: keys.add(df, n, text, seq)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def distinct_stream(source: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First occurrences only. With an event time, state is bounded by the watermark."""
    if event_time is None:
        return source.dropDuplicates([key])
    return source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
