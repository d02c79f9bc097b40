"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window by window.

A text's words, in lower case, are read in windows of `WINDOW_WORDS` consecutive words, one from every word on. A window
is compressed with the toxic and with the ordinary dictionary; what the toxic one saves is its distance. The dictionaries
are text of the labelled documents: both begin with the same ordinary text (`base`), so that common matter costs the same
in either, and end in passages of their own class, equally far from the end.

Ordinary text has toxic wording too, by chance, and a dictionary either has a stretch or has not. So the openings of words
(stretches of as many bytes as one of `GRAMS`, with the blank before them) are counted by texts, and the ones that toxic texts
have `TIMES` as often or more, `LEAN` standard deviations beyond chance, lean to the toxic side: the words they touch are left
out of the ordinary dictionary.

Which passages: each half of the texts is compressed with dictionaries of the other half. Windows of toxic text on which
the toxic dictionary saves enough, and that have a leaning opening, are kept (wording that other toxic texts have too); enough is
where ordinary text has `CHANCE` times as many such windows or fewer. Ordinary windows without one on which it saves
`LEAST_TELLING` bytes are kept for the ordinary dictionary, so that it stops doing so. That is done `ROUNDS` times, the first
time with all text of the class. Beyond `DICT_BYTES` those of smallest hash are taken.

Calibration: each half is compressed with the last dictionaries of the other half. For each of two thresholds a text has a
number of different windows that save so much and do not overlap (a word is one finding, not three), and an expected number by the
rate of ordinary texts; the root of the Poisson deviance between them says how far it is beyond chance, whatever the length. A
logistic curve over both turns that into a probability, each class counted for as many labelled documents as it has. The pair of
thresholds is the one of least log loss. All of it sees rows outside the held-out fold only; near copies count as one text.

A window counts only if it has a stretch of as many bytes as one of `GRAMS` that the toxic dictionary has and the ordinary one
has not (the short ones find words, the long one wording across words); others are not compressed. Wording of which toxic texts
have no opening `TIMES` as often as ordinary ones is not seen, nor wording in fewer than `LEAST_TEXTS` texts of a half.

Fitting reads a bounded sample: up to `SAMPLE_DOCS` labelled documents of each class (twice as many ordinary ones, half of
them for the base), chosen by a hash of the id, and of each up to `SAMPLE_STRETCHES` different stretches of `STRETCH_WORDS`
words, those of smallest hash, from all over the text. They are cut on the executors. Scoring covers every row and whole
texts.

Edge cases: null and empty texts and texts without a letter have no window and the score of none that saves. With fewer
than two different texts in either class every score is 0.5 (predicted 0). Repeated labels of a document count as toxic if
any says so; null labels are ignored; of rows that repeat an id one is learnt from. Repeated rows give a row each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import fold, fold_column, read, resident
from siftyard.llm.hashing import mix

FOLDS, HELD_OUT = 3, 1
#: Labelled documents of each class that are fitted on, and different stretches of STRETCH_WORDS words of each.
SAMPLE_DOCS, SAMPLE_STRETCHES, STRETCH_WORDS = 1000, 32, 12
WINDOW_WORDS, ROUNDS, GRAMS = 3, 2, (5, 7, 8, 12)
#: How much more often toxic texts have a stretch that ordinary dictionaries leave out; standard deviations beyond chance.
TIMES, LEAN, LEAST_TEXTS = 4, 3, 4
#: Bounds of the saving from which windows go into the dictionaries, and the chance windows among them.
LEAST_TELLING, MOST_TELLING, CHANCE = 3, 12, 0.1
BASE_BYTES, DICT_BYTES = 4 << 20, 16 << 10
#: Opens every window and ends every dictionary: without it short windows do not compress, and zstandard stores them as they are.
MARK = bytes(range(1, 32)) * 3
PAIRS = ((2, 3), (2, 4), (3, 4), (3, 5), (4, 6))
THRESHOLDS = tuple(range(2, 7))
#: Windows beyond chance: what is added to the expected number of windows that save.
LEAST_EXPECTED = 0.02
#: Texts are copies if this share of their sketches of SKETCH numbers agrees.
SKETCH, ALIKE = 64, 0.5
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_BITS = 22

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def spoken(text: str | None) -> bytes:
    """The words with one blank around each."""
    words = _WORD.findall(text.lower()) if text else []
    return f" {' '.join(words)} ".encode() if words else b""


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows start and end in what `spoken` gives."""
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    k = min(WINDOW_WORDS, max(0, len(blanks) - 1))
    start, end = (blanks[: len(blanks) - k], blanks[k:] + 1) if k else (blanks[:0], blanks[:0])
    if b"\n" in data:
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 10)])
        start, end = (x[ends[end] == ends[start]] for x in (start, end))
    return start, end


def joined(parts: list[bytes]) -> list[bytes]:
    """The same windows in few pieces: those of parts that have a whole one in one piece, with an end of line between."""
    whole = [x for x in parts if x.count(b" ") > WINDOW_WORDS]
    return [*([b"\n".join(whole)] if whole else []), *(x for x in parts if x.count(b" ") <= WINDOW_WORDS)]


def stretches(text: str | None, most: int) -> list[bytes]:
    """Up to `most` different stretches of STRETCH_WORDS words of a text, those of smallest hash, in the order of the text."""
    words = _WORD.findall(text.lower()) if text else []
    found = list(dict.fromkeys(" ".join(words[i : i + STRETCH_WORDS]).encode() for i in range(0, len(words), STRETCH_WORDS)))
    if len(found) <= most:
        return found
    chosen = set(sorted(found, key=lambda x: (zlib.crc32(x), x))[:most])
    return [x for x in found if x in chosen]


def grams(data: bytes, size: int) -> np.ndarray:
    """The stretches of `size` bytes, as hashes."""
    raw, n = np.frombuffer(data, np.uint8), max(0, len(data) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + raw[i : n + i]
    return mix(out)


def compressor(content: bytes):
    """The compressed size of a window with this dictionary: the whole of it is searched, for matches of three bytes on."""
    content += MARK
    log = max(10, (len(content) - 1).bit_length())
    params = zstandard.ZstdCompressionParameters(
        window_log=min(27, log + 1), chain_log=min(29, log + 1), hash_log=min(27, log), search_log=8, min_match=3, target_length=999,
        strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(compression_params=params, dict_data=own).compress
    return lambda window: len(compress(MARK + window))


class Distance:
    """What the toxic dictionary saves against the ordinary one."""

    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes):
        size = max(len(toxic), len(ordinary))
        self.toxic, self.ordinary = compressor(base + toxic.rjust(size)), compressor(base + ordinary.rjust(size))
        self.only = []
        for k in GRAMS:
            own, table = np.setdiff1d(grams(toxic, k), np.concatenate([grams(base, k), grams(ordinary, k)])), np.zeros(1 << _BITS, bool)
            table[own >> np.uint64(64 - _BITS)] = True
            self.only.append((k, own, table))

    def of(self, window: bytes) -> int:
        return self.ordinary(window) - self.toxic(window)

    def saved(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the windows of `data`, and what each saves."""
        start, end = places(data)
        out = np.zeros(len(start), np.int64)
        if len(start):
            at = np.flatnonzero(self.likely(data, start, end))
            out[at] = [self.of(data[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        return start, end, out

    def likely(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which windows have a stretch that only the toxic dictionary has."""
        out = np.zeros(len(start), bool)
        for k, own, table in self.only:
            h = grams(data, k)
            known = table[h >> np.uint64(64 - _BITS)]
            if len(own):
                at = np.flatnonzero(known)
                known[at] = own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]
            out |= within(known, k, start, end)
        return out


def within(known: np.ndarray, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows have one of the marked stretches whole."""
    known = np.concatenate([[0], np.cumsum(known)])
    return known[np.clip(end - size + 1, start, len(known) - 1)] > known[np.minimum(start, len(known) - 1)]


def beyond(count: int, n: int, rate: float) -> float:
    """How far `count` windows out of `n` are beyond what the rate of ordinary texts lets expect; 0 if they are not."""
    expected = n * rate + LEAST_EXPECTED
    return math.sqrt(2 * (count * math.log(count / expected) - count + expected)) if count > expected else 0.0


def counted(parts: list[bytes], distance: Distance, thresholds) -> tuple[int, list[int]]:
    """Windows, and for each threshold the different ones that save as much, from left to right without overlap: a word is in
    several windows, but it is one finding."""
    n, found = 0, [set() for _ in thresholds]
    for data in joined(parts):
        start, end, saved = distance.saved(data)
        n += len(start)
        for t, own in zip(thresholds, found, strict=True):
            free = 0
            for i in np.flatnonzero(saved >= t).tolist():
                if start[i] >= free:
                    own.add(data[start[i] : end[i]])
                    free = end[i] - 1
    return n, [len(own) for own in found]


class Toxicity:
    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes, thresholds, rates, weights):
        self.distance, self.thresholds, self.rates, self.weights = Distance(base, toxic, ordinary), thresholds, rates, weights

    def counts(self, text: str | None) -> tuple[int, list[int]]:
        """Windows; different ones that save as much as each threshold."""
        return counted([spoken(text)], self.distance, self.thresholds)

    def score(self, text: str | None) -> float:
        n, found = self.counts(text)
        return probability(self.weights, [beyond(k, n, r) for k, r in zip(found, self.rates, strict=True)])


def probability(weights, x) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] + sum(a * b for a, b in zip(weights[1:], x, strict=True))))))


def calibrate(x: np.ndarray, y: np.ndarray, parts: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic weights (intercept first) by Newton's method; each row counts `parts`."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        step = np.linalg.solve(a.T @ (a * (parts * p * (1 - p))[:, None]) + penalty, a.T @ (parts * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def different(texts: list[list[bytes]]) -> list[list[bytes]]:
    """The first text of every set of near copies, by sketches of their pairs of words."""
    rnd = np.random.default_rng(1)
    times, plus = rnd.integers(1, 1 << 62, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 62, SKETCH, np.uint64)
    texts = [x for x in texts if any(x)]
    sketches = np.zeros((len(texts), SKETCH), np.uint64)
    for i, own in enumerate(texts):
        words = [x for part in own for x in part.split()]
        pairs = {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or set(words)
        h = mix(np.fromiter(map(zlib.crc32, pairs), np.uint64, len(pairs)))
        sketches[i] = mix(h[:, None] * times + plus).min(axis=0)
    left, out = np.ones(len(texts), bool), []
    for i in range(len(texts)):
        if left[i]:
            out.append(texts[i])
            left &= (sketches == sketches[i]).mean(axis=1) < ALIKE
    return out


def openings(data: bytes, size: int) -> np.ndarray:
    """The different stretches that open a word (or several), with the blank before it, as sorted hashes."""
    h = grams(data, size)
    h = np.sort(h[np.frombuffer(data, np.uint8)[: len(h)] == 32])
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def leaning(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
    """For each size of `GRAMS` the openings (hashes, sorted) that toxic texts have far more often than ordinary ones: in
    `LEAST_TEXTS` texts, `TIMES` as often, and `LEAN` standard deviations beyond chance, by texts that have them."""
    out = []
    for k in GRAMS:
        (own, x), (plain, y) = (
            np.unique(np.concatenate([np.zeros(0, np.uint64), *(openings(b"\n".join(text), k) for text in texts)]), return_counts=True)
            for texts in (toxic, ordinary)
        )
        own, x = own[x >= LEAST_TEXTS], x[x >= LEAST_TEXTS]
        at = np.minimum(np.searchsorted(plain, own), max(0, len(plain) - 1))
        there = np.where(plain[at] == own, y[at], 0) if len(plain) else np.zeros(len(own))
        expected = len(toxic) * (there + 0.5) / (len(ordinary) + 1)
        far = np.sqrt(2 * np.maximum(0, x * np.log(x / expected) - x + expected))
        out.append((k, own[(x >= TIMES * expected) & (far >= LEAN)]))
    return out


def met(data: bytes, leans: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Whether such a stretch starts at each place, by their sizes."""
    out = []
    for k, own in leans:
        h = grams(data, k)
        out.append((k, own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h if len(own) else np.zeros(len(h), bool)))
    return out


def leant(data: bytes, leans: list[tuple[int, np.ndarray]]) -> bool:
    return any(known.any() for _, known in met(data, leans))


def cleared(parts: list[bytes], leans: list[tuple[int, np.ndarray]]) -> bytes:
    """Stretches of text without the words that such a stretch touches."""
    data = b"\n".join(parts)
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    gone = np.zeros(len(blanks) + 1, np.int64)
    for k, known in met(data, leans):
        at = np.flatnonzero(known)
        np.add.at(gone, np.searchsorted(blanks, at, "right") - 1, 1)
        np.add.at(gone, np.searchsorted(blanks, at + k - 1), -1)
    kept = np.flatnonzero(np.cumsum(gone)[: max(0, len(blanks) - 1)] == 0)
    return b" ".join([b"", *(data[blanks[i] + 1 : blanks[i + 1]] for i in kept.tolist()), b""]).replace(b"\n", b"")


def telling(texts: tuple, distance: Distance, leans: list[tuple[int, np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
    """Of both classes (lists of stretches) what saves enough, of the toxic one with, of the ordinary one without a leaning
    stretch, windows that overlap as one piece. Enough is the least saving of which ordinary text has at most CHANCE times
    as many windows with such a stretch as toxic text, relative to all windows of each."""
    found = [[] for _ in texts]
    for own, windows in zip(texts, found, strict=True):
        for data in joined(own):
            start, end, saved = distance.saved(data)
            holds = np.zeros(len(start), bool)
            for k, known in met(data, leans):
                holds |= within(known, k, start, end)
            windows.append((data, start, end, saved, holds))
    n = [max(1, sum(len(x[1]) for x in own)) for own in found]
    share = lambda k, t: sum(int(((x[3] >= t) & x[4]).sum()) for x in found[k]) / n[k]
    least = next((t for t in range(LEAST_TELLING, MOST_TELLING) if share(1, t) <= CHANCE * share(0, t)), MOST_TELLING)
    out = []
    for own, enough, wanted in zip(found, (least, LEAST_TELLING), (True, False), strict=True):
        pieces = []
        for data, start, end, saved, holds in own:
            last = -1
            for i in np.flatnonzero((saved >= enough) & (holds == wanted)).tolist():
                a = max(int(start[i]), last)
                pieces.append(data[a : end[i]])
                last = int(end[i])
        out.append(pieces)
    return tuple(out)


def bounded(pieces: list[bytes]) -> bytes:
    """As many of the pieces as DICT_BYTES hold, those of smallest hash."""
    size, out = 0, []
    for x in sorted(pieces, key=lambda x: (zlib.crc32(x), x)):
        size += len(x)
        if size > DICT_BYTES:
            break
        out.append(x)
    return b"".join(out)


def fit_stretches(toxic: list[list[bytes]], ordinary: list[list[bytes]], n_toxic: float = 1, n_ordinary: float = 1):
    """base, toxic and ordinary dictionary contents, thresholds, rates, weights; from the sampled stretches of each text and
    the labelled documents of each class."""
    toxic, ordinary = ([[b" " + x + b" " for x in text] for text in different(own)] for own in (toxic, ordinary))
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    half = len(ordinary) // 2
    usual, rest = [x for text in ordinary[:half] for x in text], ordinary[half:]
    texts = [(toxic[i::2], rest[i::2]) for i in (0, 1)]
    every = [tuple([x for text in own for x in text] for own in classes) for classes in texts]
    leans = [leaning(a, ordinary[:half] + b) for a, b in texts]
    bases = [cleared(usual, x)[:BASE_BYTES] for x in leans]
    made = [(b"".join(a), cleared(b, x)[: sum(map(len, a))]) for (a, b), x in zip(every, leans, strict=True)]
    for _ in range(ROUNDS):
        kept = [telling(every[i], Distance(bases[1 - i], *made[1 - i]), leans[i]) for i in (0, 1)]
        made = [tuple(map(bounded, x)) for x in kept]
    found, y = [], []
    for i, classes in enumerate(texts):
        distance = Distance(bases[1 - i], *made[1 - i])
        for kind, own in zip((1.0, 0.0), classes, strict=True):
            told = [counted(x, distance, THRESHOLDS) for x in own]
            found += [dict(zip((0, *THRESHOLDS), (n, *over), strict=True)) for n, over in told]
            y += [kind] * len(own)
    y = np.array(y)
    parts = np.where(y == 1, n_toxic / y.sum(), n_ordinary / max(1, len(y) - y.sum()))
    parts = parts * len(y) / parts.sum()
    best = None
    for thresholds in PAIRS:
        plain = [x for x, kind in zip(found, y, strict=True) if not kind]
        rates = tuple((float(sum(x[t] for x in plain)) + 0.5) / (sum(x[0] for x in plain) + 1) for t in thresholds)
        x = np.array([[beyond(v[t], v[0], r) for t, r in zip(thresholds, rates, strict=True)] for v in found])
        weights = calibrate(x, y, parts)
        p = np.array([probability(weights, v) for v in x])
        loss = float(-(parts * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())
        if best is None or loss < best[0]:
            best = loss, thresholds, rates, weights
    own = leaning(toxic, ordinary)
    ends = [x for x in kept[0][0] + kept[1][0] if leant(x, own)], [x for x in kept[0][1] + kept[1][1] if not leant(x, own)]
    return cleared(usual, own)[:BASE_BYTES], *map(bounded, ends), *best[1:]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = SAMPLE_STRETCHES):
    """The model from labelled rows outside the held-out fold."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_column(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    scale, wanted = 1 << 30, {1: sample_docs, 0: 2 * sample_docs}
    share = F.when(F.col("toxic") == 1, min(scale, math.ceil(scale * 1.2 * wanted[1] / counts[1]))).otherwise(min(scale, math.ceil(scale * 1.2 * wanted[0] / counts[0])))
    chosen = rows.withColumn("key", F.pmod(F.xxhash64("doc_id"), F.lit(scale))).filter(F.col("key") < share)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def cut(batches):
        for batch in batches:
            found = [stretches(x, most) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "key", "toxic")), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "key", "toxic", "stretches"])

    found = source.select("doc_id", "key", "toxic", "text").mapInArrow(cut, "doc_id long, key long, toxic int, stretches array<binary>")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("key", "toxic", "stretches"), F.xxhash64("stretches")).alias("x")).select("x.*", "doc_id")
    got = sorted((r["key"], r["doc_id"], r["toxic"], [bytes(w) for w in r["stretches"]]) for r in one.collect())
    own = [[w for _, _, y, w in got if y == k][: wanted[k]] for k in (1, 0)]
    return fit_stretches(*own, counts[1], counts[0])


def _model(value) -> Toxicity | None:
    return resident(("toxicity", hash(value)), lambda: Toxicity(*value)) if value else None


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _model(shared.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [scorer.score(x) if scorer else 0.5 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fold(x, FOLDS) == HELD_OUT for x in ids], pa.bool_()), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
