"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. language   rows whose language compression cannot tell go (text null, without a letter, or margins too narrow); counts,
              dictionaries and least margins are of all learning rows
2. near_dedup of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays
3. benchmark  rows that contain a benchmark window go
4. secrets    secrets in the text are replaced by a mark; n_chars follows
5. tokens     token ids, their number and digests; the last stage, not in the columns of documents

Null texts go in stage 1. Rows that repeat a text are copies, whatever their ids: one stays. Further columns of documents pass
through to stage 4 unchanged, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm import bpe, decontaminate, langid, near_dedup, secrets
from siftyard.llm.common import plainly, read, shared_dir, tidy


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def work(rows):
        found = langid.identify(rows, langid.fit(rows), keep=True)
        return found.filter(~F.col("__rejected")).drop("__lang_pred", "__rejected")

    return plainly(docs, work)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest id. Rows without a word are all kept."""
    return plainly(docs, near_dedup.one_of_each)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def work(rows):
        found = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"))
        return found.filter(~F.col("__contaminated")).drop("__contaminated")

    return plainly(docs, work)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def work(rows):
        found = secrets.redact(rows)
        n = F.when(F.col("__found"), F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return found.withColumn("n_chars", n).select(rows.columns)

    return plainly(docs, work)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(docs, bpe.default_path(), with_ids=True)


STAGES = [("language", language), ("near_dedup", near_duplicates), ("benchmark", benchmark), ("secrets", redaction), ("tokens", tokens)]

#: Compression and tokenizer stages have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what a stage left on the driver should not fill its memory in the next: tables, plans, and the broadcasts they hold
        tidy(spark)
    return docs
