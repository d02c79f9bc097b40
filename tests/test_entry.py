"""The entry module with and without the training-data subpackage, and the shape of plans that scale."""

import os
import shutil
import subprocess
import sys

from helpers import ROOT, SF
from pyspark.sql import functions as F

from siftyard import plans
from siftyard.operators import dedup, ids, ranges
from siftyard.session import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q), q.keys(); assert e.oracle_sql().keys() <= q.keys()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scans_read_what_is_needed(spark):
    shown = plan(plans.QUERIES["fragment_keys"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown
    found = table(spark, SF, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(found)


def test_no_window_over_hot_keys(spark):
    docs = table(spark, SF, "documents").select("doc_id", dedup.fragment_key(F.col("text")).alias("key"))
    assert "Window" not in plan(dedup.mark_new(docs, "key", "doc_id"))


def test_dense_ids_have_no_single_task_over_rows(spark):
    shown = plan(ids.dense_ids(spark.range(1000), ["id"], "n"))
    assert "rangepartitioning" not in shown.split("Window")[0]  # the sort was checkpointed: only one row a partition meets in the window
    assert "BroadcastHashJoin" in shown or "BroadcastExchange" in shown


def test_large_range_tables_join_by_buckets(spark):
    rows, r = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(50, 1, 5, "L")], "src_begin long, tgt_begin long, size int, family string")
    assert "NestedLoop" not in plan(ranges.remap_buckets(rows, r, "k", 16))
