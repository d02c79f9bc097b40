"""Operators 6 and 7 by brute force, and their parts."""

import random

import brute
import numpy as np
import pytest
from helpers import SF, rows, same
from odd import prose
from pyspark.sql import functions as F

from siftyard.llm import near_dedup, substring_dedup
from siftyard.llm.common import listed
from siftyard.llm.hashing import Spans, leftmost_minimum


def by_repr(x):
    return sorted(x, key=repr)


def chained(rnd):
    """Groups in which some links only hold through a third text, and short sets with few shingles."""
    out = []
    for g in range(12):
        words = prose(rnd, rnd.choice([4, 8, 15, 40, 90])).split()
        for _ in range(rnd.randrange(1, 7)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randrange(1, 4)):
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[], [f"new{g}"], [words[k], "more"]])
            words = words or ["x"]
    rnd.shuffle(out)
    return list(enumerate(out, 1000))


@pytest.mark.parametrize("n", [2, 5])
def test_near_odd(spark, odd, odd_list, n):
    assert rows(near_dedup.near_dedup(odd, n)) == by_repr(brute.near(odd_list, n))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_chains(spark, seed):
    docs = chained(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_dedup.near_dedup(df, 2)) == by_repr(brute.near(docs, 2))


def test_near_large_group(spark):
    """One group of copies and one of near copies that hold most rows."""
    rnd = random.Random(4)
    base = prose(rnd, 80).split()
    docs = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 600):
        own = list(base)
        own[rnd.randrange(80)] = f"w{i}"
        docs.append((i, " ".join(own)))
    docs += [(i, prose(rnd, 60)) for i in range(600, 700)]
    got = rows(near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 2))
    assert got == by_repr(brute.near(docs, 2)) and sum(r[3] for r in got) == 101


def test_near_columns_and_empty(spark, odd, crowded, empty):
    assert rows(near_dedup.near_dedup(crowded, 2)) == rows(near_dedup.near_dedup(odd, 2))
    assert near_dedup.near_dedup(empty, 2).count() == 0


def test_near_sql(spark):
    same(near_dedup.op6_near_dedup(spark, SF), near_dedup.ORACLE, SF)


def test_hyperminhash_estimates():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n = 2000
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
            same_ = (near_dedup.registers(a) == near_dedup.registers(b)).mean()
            errors.append((same_ - near_dedup.COLLIDE) / (1 - near_dedup.COLLIDE) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(500, 560)]
    top = list(range(600))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    expected = {(i, root(i)) for e in edges if e[0] != e[1] for i in e}
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == expected
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_odd(spark, odd, odd_list):
    assert rows(substring_dedup.substring_dedup(odd)) == by_repr(brute.repeats(odd_list))


@pytest.mark.parametrize("window,anchor", [(3, 2), (6, 3), (12, 5)])
def test_substring_short_windows(spark, window, anchor):
    rnd = random.Random(window)
    docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    found = substring_dedup.deduplicate_texts(spark.createDataFrame(docs, "doc_id long, text string"), window, anchor)
    every = {r["kept_text"]: r["n_removed"] for r in found.collect()}
    assert sorted({x[3] for x in brute.repeats(docs, window)}) == sorted({brute.sha(t) for t in every})
    got = {(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    assert got == {x[1:] for x in brute.repeats(docs, window)}


def test_substring_columns_and_empty(spark, odd, crowded, empty):
    assert rows(substring_dedup.substring_dedup(crowded)) == rows(substring_dedup.substring_dedup(odd))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_sql(spark):
    same(substring_dedup.op7_substring_dedup(spark, SF), substring_dedup.ORACLE, SF)


def test_fingerprint_index(spark):
    """Runs are merged, compacted, found again from the folder, and deleted when replaced."""
    index, rnd = substring_dedup.FingerprintIndex(spark, max_runs=2), random.Random(2)
    counts: dict[int, int] = {}
    for k in range(5):
        part: dict[int, int] = {}
        for _ in range(30):
            h = rnd.randrange(60)
            part[h] = part.get(h, 0) + 1
        run = index.write(spark.createDataFrame(list(part.items()), "hash long, n long"))
        seen = index.seen(run)
        assert {r["hash"] for r in seen.collect()} == part.keys() & counts.keys() if k else seen is None
        for h, n in part.items():
            counts[h] = counts.get(h, 0) + n
        index.add(run)
        assert len(index.runs) <= 2
        for name, _ in index.runs:  # another job knows the folder only
            spark.sql(f"DROP TABLE {name}")
        index = substring_dedup.FingerprintIndex(spark, index.folder, max_runs=2)
        assert {r["hash"]: r["n"] for r in index.merged().collect()} == counts
        assert sum(x.startswith("run_") for x in listed(spark, index.folder)) == len(index.runs)
    assert substring_dedup.FingerprintIndex(spark).merged() is None


def test_substring_batches(spark):
    """Three batches, each by an index opened anew: judged against themselves and all earlier ones, the last as in one run."""
    rnd = random.Random(13)
    passages = [prose(rnd, n) for n in (36, 50, 90)]
    docs = []
    for i in range(60):
        words = [prose(rnd, rnd.randrange(0, 60)) for _ in range(3)]
        words.insert(rnd.randrange(3), rnd.choice([*passages, prose(rnd, 40)]))
        docs.append((i, " ".join(words)))
    docs += [(60 + i, docs[k][1]) for i, k in enumerate((3, 25, 25, 55))] + [(70, None), (71, ""), (72, docs[1][1] + " " + passages[0])]
    rnd.shuffle(docs)
    folder, before = substring_dedup.FingerprintIndex(spark).folder, []
    for k in range(3):
        batch = docs[k::3]
        index = substring_dedup.FingerprintIndex(spark, folder, max_runs=2)
        assert len(index.batches) == k
        frame = spark.createDataFrame(batch, "doc_id long, text string")
        found = substring_dedup.deduplicate_texts(frame, index=index)
        every = brute.repeats([*before, *batch])
        expected = {x[1:] for x in every[len(before) :]}
        assert {(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == expected
        for name, _ in index.runs:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        before += batch
    whole = {r["n_words"]: 0 for r in substring_dedup.deduplicate_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert whole.keys() == {x[1] for x in brute.repeats(docs)}


def test_spans_and_minimum():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 5, 200, dtype=np.uint64)
    s = Spans(w, substring_dedup.P)
    by = {}
    for i in range(190):
        by.setdefault(tuple(w[i : i + 3].tolist()), set()).add(int(s.of(np.array([i]), 3)[0]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    h = rng.integers(0, 9, 50, dtype=np.uint64)
    for k in (1, 2, 3, 7, 8, 50):
        assert leftmost_minimum(h, k).tolist() == [i + int(np.argmin(h[i : i + k])) for i in range(50 - k + 1)]


def test_one_row_per_text_keeps_hot_copies_apart(spark):
    """Copies of one text meet before the shuffle: what is shuffled is a row a task, not a row a copy."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(prose(random.Random(1), 50)).alias("text"))
    got = rows(substring_dedup.substring_dedup(docs))
    assert len(got) == 5000 and all(r[2] == 50 for r in got)
