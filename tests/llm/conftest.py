"""Tables and odd documents that the tests of this folder share."""

import pytest
from odd import SCHEMA, odd_documents


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="session")
def odd_list():
    return [(r[0], r[1]) for r in odd_documents()]


@pytest.fixture(scope="session")
def crowded(spark, odd):
    """The same with further columns, some named as the operators' own."""
    from pyspark.sql import functions as F

    extra = ("tid", "copies", "group", "node", "uid", "base", "hits", "flagged", "score", "labels", "n_words", "kept", "rejected", "hash", "__base")
    return odd.withColumns({x: F.lit("clash") for x in extra}).withColumn("missing", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest tables."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))
