"""The pipeline's stages, one by one against brute force, and as a whole."""

import hashlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from helpers import SF, rows
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def listed(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "benchmark", "secrets", "tokens"]
    for name in list(passed)[:-1]:
        assert passed[name][1].columns == COLUMNS and passed[name][1].dtypes == passed[name][0].dtypes


def test_language(passed):
    before, after = (x.count() for x in passed["language"])
    assert 0.9 * before <= after <= before


def test_near_dedup(passed):
    before, after = map(listed, passed["near_dedup"])
    found = brute.near(before, 5)
    assert sorted(after) == sorted({x for x, r in zip(before, found, strict=True) if r[3] or not r[1]})


def test_benchmark(spark, passed):
    before, after = map(listed, passed["benchmark"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(after) == sorted(x for x, r in zip(before, brute.contamination(before, items), strict=True) if not r[5])


def test_secrets(passed):
    before, after = map(dict, map(listed, passed["secrets"]))
    assert before.keys() == after.keys()
    for doc, n in ((r[0], sum(r[1:4])) for r in brute.secrets(list(before.items()))):
        assert (after[doc] != before[doc]) or not n
    assert all(sum(r[1:4]) == 0 for r in brute.secrets(list(after.items())))
    assert all(r["n"] == r["n_chars"] for r in passed["secrets"][1].select("n_chars", F.length("text").cast("long").alias("n")).collect())


def test_tokens(passed):
    from siftyard.llm import bpe

    texts = dict(listed(passed["tokens"][0]))
    own = bpe.vocabulary(bpe.default_path())
    got = passed["tokens"][1].collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(r["ids"], "<u4").tobytes()
        assert own.decode(ids) == texts[r["doc_id"]] and hashlib.sha256(ids).hexdigest() == r["ids_sha256"] and r["n_tokens"] == len(r["ids"])


def test_run(spark, passed):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(passed["tokens"][1])


def test_odd_documents(spark, odd, empty):
    """Nulls, repeated rows and empty tables go through every stage."""
    for docs in (odd, empty, odd.withColumn("tid", F.lit("clash")).withColumn("group", F.lit(1))):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name == "near_dedup":
                ids = [tuple(r) for r in docs.select("doc_id", "text").collect()]
                assert len(ids) == len(set(ids))
        docs.count()


def test_near_stage_keeps_one_of_each_group(spark, odd, odd_list):
    after = listed(corpus_pipeline.near_duplicates(spark, odd, SF))
    found = brute.groups(odd_list, 5)
    with_words = [x for x in after if brute.BLANK.search(x[1] or "")]
    assert len(with_words) == len({g for size, g in found if size})
    assert {x for x, (size, _) in zip(odd_list, found, strict=True) if not size} <= set(after)


CLASHING = (
    "tid", "group", "copies", "uid", "base", "node", "comp", "row", "order", "x", "lang_pred", "rejected", "__lang_pred", "__rejected", "__contaminated",
    "__base", "__random", "__found", "a.b", "with `ticks`", "two words", "further_5",
)


@pytest.mark.parametrize("name", ["language", "near_dedup", "benchmark", "secrets"])
def test_further_columns_pass_unchanged(spark, name):
    """Columns named as the stages' own, with dots and quotes: kept as they are, and the rows are the same."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.read.parquet(f"{SF}/documents.parquet")
    plain = rows(stage(spark, docs, SF))
    more = docs.withColumns({x: F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")) for i, x in enumerate(CLASHING)})
    got = stage(spark, more, SF)
    assert got.columns == [*COLUMNS, *CLASHING]
    found = got.collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == plain
    assert all(tuple(r)[5:] == tuple(f"{i} {r[0]}" for i in range(len(CLASHING))) for r in found)
