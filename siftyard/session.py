"""Sessions, tables and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "siftyard", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for: UTC, ANSI, AQE, Arrow."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`, else the session's checkpoint folder. Where neither is set, a temporary folder
    is made and set if all runs on one machine; on a cluster, whose executors would not see it, that is an error."""
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


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that what was dealt out once is read as it was."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
