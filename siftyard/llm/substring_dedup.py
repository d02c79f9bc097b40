"""Substring deduplication over a log-structured fingerprint index.

A window is `window` consecutive words; each word covered by a window whose word sequence also starts anywhere else is
removed. Every window has an anchor: the leftmost smallest of the hashes of the shorter word spans inside it. Equal
windows have equal anchors at the same place, so only anchors, one for some thirteen windows, enter the index. It
consists of sorted immutable runs, bucketed by hash, that are compacted into one when there are too many. A batch becomes a
sorted run, which is merge-joined with the runs of earlier batches before it is put in force beside them; the index lives in
a folder and can be opened by a later job. The query hands over its table as one batch, to an index without history. Anchors
that a batch has twice, or that an earlier one has, are only candidates; the windows behind them are then verified, those of
earlier batches from their texts, which the index refers to:

1. Windows next to each other that share an anchor are a group; 128 bits over the group's words confirm that it stands
   whole elsewhere. Inside a repeated passage that settles up to 26 windows with one row.
2. Of anchors that have a group without a partner, every window is confirmed by 128 bits over its own words.

A text that several rows have is handled once and counts as often as it occurs. Equality of word sequences is equality
of two independent 64-bit hashes beside the equal anchor.

Edge cases: null and empty texts have no words; texts shorter than a window keep all. Kept words are joined by one
space, whatever stood between. Repeated rows are copies of each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import distinct_texts, folder_of, listed, read, removed, shared_dir, text_id, utf8, written
from siftyard.llm.hashing import Spans, leftmost_minimum, mix, signed, word_hashes

WINDOW, ANCHOR = 35, 10
P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text whose windows are held at once.
STEP_BYTES = 4 << 20
MAX_RUNS = 4


class FingerprintIndex:
    """Sorted immutable runs of (hash, n) in one folder, and the batches that they come from. n is how often the texts of a
    run have the hash. A run is bucketed and sorted by hash, so a merge join with it shuffles and sorts only the other side.

    A manifest, written last and under a new number, lists the runs and batches in force: a job that dies leaves the index as
    it was, and what it wrote is not listed. `FingerprintIndex(spark, folder)` opens an index of an earlier job. Runs that a
    compaction has replaced are deleted once the new manifest is there."""

    def __init__(self, spark: SparkSession, folder: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs = spark, max_runs
        self.folder = folder or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.version, self.runs, self.batches, self.tables = 0, [], [], {}
        whole = [x for x in listed(spark, self.folder) if x.startswith("manifest-") and "_SUCCESS" in listed(spark, f"{self.folder}/{x}")]
        if whole:
            self.version = max(int(x.partition("-")[2]) for x in whole)
            rows = self.spark.read.schema("kind string, name string, buckets int, texts string").parquet(f"{self.folder}/manifest-{self.version}").collect()
            self.runs = sorted((r["name"], r["buckets"]) for r in rows if r["kind"] == "run")
            self.batches = sorted((r["name"], r["texts"]) for r in rows if r["kind"] == "batch")

    def write(self, counts: DataFrame) -> tuple[str, int]:
        """(hash, n) rows as a sorted run that is not yet in force."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run_{uuid.uuid4().hex}"
        (
            counts.repartition(buckets, "hash").write.option("compression", "zstd").option("path", f"{self.folder}/{name}")
            .bucketBy(buckets, "hash").sortBy("hash").format("parquet").saveAsTable(name)
        )
        self.tables[name] = True
        return name, buckets

    def read(self, run: tuple[str, int]) -> DataFrame:
        """A run by itself, with its buckets and its order."""
        name, buckets = run
        if name not in self.tables:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (hash BIGINT, n BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.tables[name] = True
        return self.spark.table(name)

    def merged(self) -> DataFrame | None:
        """hash, n over all runs."""
        if len(self.runs) < 2:
            return self.read(self.runs[0]) if self.runs else None
        # The files, not the tables: Spark 4.1 takes a union of bucketed scans for bucketed by the key, yet reads each
        # side unbucketed, and an aggregation over it then misses what the runs have in common.
        every = self.spark.read.schema("hash long, n long").parquet(*[f"{self.folder}/{name}" for name, _ in self.runs])
        return every.groupBy("hash").agg(F.sum("n").alias("n"))

    def seen(self, run: tuple[str, int]) -> DataFrame | None:
        """The hashes of a new run that the runs in force have too: a merge join with each of them."""
        found = [self.read(run).select("hash").join(self.read(x).select("hash").hint("merge"), "hash", "left_semi") for x in self.runs]
        if not found:
            return None
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out if len(found) == 1 else written(out, "seen").distinct()

    def add(self, run: tuple[str, int], batch: tuple[str, str] | None = None) -> None:
        """Puts a run in force, with the folders of its batch (anchors, texts); compacts beyond `max_runs`."""
        runs, old = [*self.runs, run], []
        if len(runs) > self.max_runs:
            self.runs, old = runs, runs
            runs = [self.write(self.merged())]
        self.runs = runs
        if batch:
            self.batches = [*self.batches, batch]
        self.version += 1
        rows = [("run", n, k, None) for n, k in self.runs] + [("batch", a, None, t) for a, t in self.batches]
        self.spark.createDataFrame(rows, "kind string, name string, buckets int, texts string").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version}")
        for name, _ in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{self.folder}/{name}")


class Windows:
    """All windows of several texts at once."""

    def __init__(self, texts: list[list[bytes]], window: int, anchor: int):
        self.n_words = np.array([len(x) for x in texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words)])
        w = word_hashes([word for words in texts for word in words])
        self.window = window
        self.p, self.q = Spans(w, P), Spans(w, Q)
        counts = np.maximum(0, self.n_words - window + 1)
        self.text = np.repeat(np.arange(len(texts)), counts)  # of each window
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.base[self.text]
        if len(self.start):
            spans = self.p.of(np.arange(len(w) - anchor + 1), anchor)
            at = leftmost_minimum(spans, window - anchor + 1)[self.start]
            self.anchor = spans[at]
            new = np.nonzero((np.diff(at, prepend=-1) != 0) | (np.diff(self.text, prepend=-1) != 0))[0]
            last = np.append(new[1:], len(at)) - 1
            self.group = np.repeat(np.arange(len(new)), last - new + 1)  # of each window
            self.first, self.last = new, last  # of each group
            begin, size = self.start[new], self.start[last] - self.start[new] + window
            place = (at[new] - begin).astype(np.uint64)
            self.g = [s.of(begin, size) + place for s in (self.p, self.q)]
        else:
            self.anchor, self.group, self.first, self.last = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
            self.g = [np.empty(0, np.uint64)] * 2

    def hashes(self, which: np.ndarray) -> list[np.ndarray]:
        return [s.of(self.start[which], self.window) for s in (self.p, self.q)]


def _once(text: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the distinct (text, *keys), in order, and how often each occurs."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((np.arange(len(text)), *keys, text))
    changed = np.any([np.diff(x[order].view(np.int64), prepend=x[order[:1]].view(np.int64) - 1) != 0 for x in (text, *keys)], axis=0)
    starts = np.nonzero(changed)[0]
    return order[starts], np.diff(np.append(starts, len(order)))


def _lists(columns: list[np.ndarray], text: np.ndarray, n: int, kinds) -> list[pa.Array]:
    """Arrow lists by text, from rows sorted by text."""
    ends = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, k)) for x, k in zip(columns, kinds, strict=True)]


def _chunks(batches, *names):
    """(tids, texts as words, further columns) of about STEP_BYTES of text each."""
    for batch in batches:
        texts, rest = utf8(batch, "text"), [batch.column(x).to_pylist() for x in names]
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k]) <= STEP_BYTES):
                size += len(texts[k])
                k += 1
            yield batch.column("tid").slice(i, k - i), [x.split() for x in texts[i:k]], [x[i:k] for x in rest]
            i = k


def _anchors(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """tid, hashes, ns: the distinct anchors of each text; n is 2 if it stands there twice or the text has copies."""

    def run(batches):
        for tids, words, (copies,) in _chunks(batches, "copies"):
            x = Windows(words, window, anchor)
            text, h = x.text[x.first], x.anchor[x.first]
            rows, n = _once(text, h)
            n = np.minimum(2, n * np.array(copies, np.int64)[text[rows]])
            lists = _lists([signed(h[rows]), n.astype(np.int8)], text[rows], len(words), (pa.int64(), pa.int8()))
            yield pa.RecordBatch.from_arrays([tids, *lists], ["tid", "hashes", "ns"])

    return texts.select("tid", "text", "copies").mapInArrow(run, "tid binary, hashes array<long>, ns array<tinyint>")


_CANDIDATES = "tid binary, anchors array<long>, h1 array<long>, h2 array<long>, ns array<tinyint>, places array<int>"


def _candidates(texts: DataFrame, whole: bool, window: int, anchor: int) -> DataFrame:
    """Of texts with `flagged` anchors: their distinct groups (`whole`) or windows with these anchors. A place is the
    number of the group or window in the text."""

    def run(batches):
        for tids, words, (copies, flagged) in _chunks(batches, "copies", "flagged"):
            x = Windows(words, window, anchor)
            text, h = x.text[x.first], x.anchor[x.first]
            known = np.unique(np.array([v for own in flagged for v in own], np.int64))
            chosen = np.nonzero(np.isin(signed(h), known))[0]
            chosen = chosen[_of_text(text[chosen], signed(h[chosen]), flagged)]
            if whole:
                text, h, keys, place = text[chosen], h[chosen], [g[chosen] for g in x.g], chosen - np.searchsorted(text, np.arange(len(words)))[text[chosen]]
            else:
                which = np.nonzero(np.isin(x.group, chosen))[0]
                place = which - np.searchsorted(x.text, np.arange(len(words)))[x.text[which]]
                text, h, keys = x.text[which], x.anchor[which], x.hashes(which)
            rows, n = _once(text, *keys, h)
            n = np.minimum(2, n * np.array(copies, np.int64)[text[rows]])
            columns = [signed(h[rows]), *(signed(k[rows]) for k in keys), n.astype(np.int8), place[rows].astype(np.int32)]
            lists = _lists(columns, text[rows], len(words), (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int32()))
            yield pa.RecordBatch.from_arrays([tids, *lists], ["tid", "anchors", "h1", "h2", "ns", "places"])

    return texts.select("tid", "text", "copies", "flagged").mapInArrow(run, _CANDIDATES)


def _of_text(text: np.ndarray, h: np.ndarray, flagged: list[list[int]]) -> np.ndarray:
    """Which of the (text, hash) rows are among the text's own flagged hashes."""
    out = np.zeros(len(text), bool)
    ends = np.searchsorted(text, np.arange(len(flagged) + 1))
    for i, own in enumerate(flagged):
        if own and ends[i] < ends[i + 1]:
            out[ends[i] : ends[i + 1]] = np.isin(h[ends[i] : ends[i + 1]], np.array(own, np.int64))
    return out


def _confirmed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From candidate rows: (tid, places) whose keys stand twice or more; the anchors with a key that does not."""
    row = found.select("tid", F.explode(F.arrays_zip("anchors", "h1", "h2", "ns", "places")).alias("x")).select("tid", "x.*")
    total = row.groupBy("anchors", "h1", "h2").agg(F.sum(F.col("ns").cast("long")).alias("n"))
    total = written(total, "totals")
    alone = total.filter("n < 2").select(F.col("anchors").alias("hash")).distinct()
    twice = row.join(total.filter("n >= 2").drop("n"), ["anchors", "h1", "h2"], "left_semi")
    return twice.groupBy("tid").agg(F.collect_list("places").alias("places")), alone


def _reassemble(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """tid, n_words, n_removed, kept_sha256 and, for callers that want it, the kept text."""

    def run(batches):
        for tids, words, (copies, groups, windows) in _chunks(batches, "copies", "groups", "windows"):
            some = [i for i in range(len(words)) if copies[i] < 2 and (groups[i] or windows[i])]
            masks = {}
            if some:
                x = Windows([words[i] for i in some], window, anchor)
                own = x.text[x.first]
                for k, i in enumerate(some):
                    a, b = np.searchsorted(own, [k, k + 1])
                    f, e = np.searchsorted(x.text, [k, k + 1])
                    hit = np.zeros(e - f, bool)
                    # the places stand for all groups and windows of the text with the same hashes
                    if groups[i]:
                        hit |= _same([x.anchor[x.first[a:b]], *(g[a:b] for g in x.g)], groups[i])[x.group[f:e] - a]
                    if windows[i]:
                        hit |= _same([x.anchor[f:e], *x.hashes(np.arange(f, e))], windows[i])
                    edge = np.zeros(len(words[i]) + 1, np.int64)
                    at = np.nonzero(hit)[0]
                    edge[at] += 1
                    edge[at + window] -= 1
                    masks[i] = np.cumsum(edge)[:-1] > 0
            n, removed, sha, kept_text = [], [], [], []
            for i, own in enumerate(words):
                kept = own
                if copies[i] >= 2 and len(own) >= window:
                    kept = []
                elif i in masks:
                    kept = [own[j] for j in np.nonzero(~masks[i])[0].tolist()]
                data = b" ".join(kept)
                n.append(len(own))
                removed.append(len(own) - len(kept))
                sha.append(hashlib.sha256(data).hexdigest())
                kept_text.append(data)
            yield pa.RecordBatch.from_arrays(
                [tids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                ["tid", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return texts.select("tid", "text", "copies", "groups", "windows").mapInArrow(
        run, "tid binary, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def _same(keys: list[np.ndarray], places: list[int]) -> np.ndarray:
    """Which rows of the parallel `keys` equal a row at one of `places`."""
    one = keys[0]
    for k in keys[1:]:
        one = mix(one) + k
    return np.isin(one, one[np.array(places, np.int64)])


def _exploded(anchors: DataFrame) -> DataFrame:
    return anchors.select("tid", F.explode("hashes").alias("hash"))


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tid").agg(F.collect_list("hash").alias("flagged"))


def deduplicate_texts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, index: FingerprintIndex | None = None) -> DataFrame:
    """tid, n_words, n_removed, kept_sha256, kept_text: one row per different text of `docs`.

    With an `index`, `docs` is a batch: windows count as repeated if they stand elsewhere in the batch or anywhere in an
    earlier one, and the batch is then part of the index. What earlier batches were given is not changed. One index is for
    one `window` and `anchor`."""
    texts = distinct_texts(docs, "substring_texts")
    found, path = written(_anchors(texts, window, anchor), "anchors", True)
    log = FingerprintIndex(docs.sparkSession) if index is None else index
    counts = found.select(F.explode(F.arrays_zip("hashes", "ns")).alias("x")).groupBy(F.col("x.hashes").alias("hash")).agg(F.sum(F.col("x.ns").cast("long")).alias("n"))
    run = log.write(counts)
    repeated, known = log.read(run).filter("n >= 2").select("hash"), log.seen(run)
    earlier = None
    if known is not None:
        known = written(known, "known")
        repeated = repeated.unionByName(known).distinct()
        spark = docs.sparkSession
        old = spark.read.schema(found.schema).parquet(*[a for a, _ in log.batches])
        flagged = _flagged(_exploded(old).join(known, "hash", "left_semi").distinct())
        stored = spark.read.schema(texts.schema).parquet(*[t for _, t in log.batches]).groupBy("tid").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
        earlier = stored.join(flagged, "tid").select("tid", "text", F.least("copies", F.lit(2)).alias("copies"), "flagged")

    def candidates(rows, again, whole, name):
        own = _candidates(texts.join(rows, "tid"), whole, window, anchor)
        if earlier is not None:
            own = own.unionByName(_candidates(again, whole, window, anchor))
        return written(own, name)

    groups = candidates(_flagged(_exploded(found).join(repeated.hint("merge"), "hash", "left_semi")), earlier, True, "groups")
    group_places, alone = _confirmed(groups)
    again = groups.select("tid", F.explode(F.array_distinct("anchors")).alias("hash")).join(alone, "hash", "left_semi")
    again = _flagged(again.distinct() if earlier is not None else again)
    old_again = earlier.drop("flagged").join(again, "tid") if earlier is not None else None
    singles = candidates(again, old_again, False, "windows")
    window_places, _ = _confirmed(singles)
    every = texts.join(group_places.withColumnRenamed("places", "groups"), "tid", "left").join(window_places.withColumnRenamed("places", "windows"), "tid", "left")
    if index is None:
        return _reassemble(every, window, anchor)
    out = written(_reassemble(every, window, anchor), "deduplicated")
    folder = folder_of(texts)
    index.add(run, (path, folder) if folder else None)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    found = deduplicate_texts(docs, window).drop("kept_text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"))
    return rows.join(found, "tid").drop("tid")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT uid, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
      FROM (SELECT uid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
k AS (SELECT DISTINCT uid, unnest(generate_series(i, i + {WINDOW - 1})) AS j FROM x JOIN r USING (h)),
g AS (SELECT uid, list(j) AS js FROM k GROUP BY uid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(js, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.uid = d.uid
"""
