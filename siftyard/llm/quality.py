"""Quality rules: counts on words and lines, and the fertility of public tokenizers.

Words of a text are encoded with two public vocabularies, a piece vocabulary with byte fallback and a byte-level one
for many languages. Characters per token, the share of byte-fallback tokens and the entropy of tokens are held against
bands of the text's main script; outside them the text is rejected. The base rules come first: too few words, or too
many in repeated three-word windows.

The bands come in two layers. `BANDS` are wide and fixed: what no language in that script looks like, by the kinder
of the two vocabularies. `fit_bands` draws narrower ones from rows labelled as good, per script: characters per token in
each vocabulary, byte-fallback share and entropy must all be as in those rows, with a margin. Entropy has two bounds,
in bits and as a share of the most that so many tokens can have; the lower one counts, as short texts have few bits and
long ones a small share. They catch keyboard noise, encoded bytes and encodings gone wrong. They have no upper end for
characters per token: common words only raise it. A script with fewer than `LEAST_GOOD` different good rows is held against `BANDS` only.

Edge cases: null and empty texts have no words and fail the base rule. Tokens are counted word by word, white space
between words is not a token. Texts without a letter go by the band of `other`. Repeated rows give a row each.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import BLANKS, read, resident, utf8, written
from siftyard.llm.hashing import mix

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEPT_WORDS = 400_000
#: Script -> (least and most characters per token, most byte-fallback share, least entropy in bits).
BANDS = {
    "latin": (1.15, 9.0, 0.30, 2.0), "cyrillic": (0.9, 9.0, 0.30, 2.0), "greek": (0.6, 9.0, 0.60, 2.0),
    "arabic": (0.6, 9.0, 0.60, 2.0), "hebrew": (0.6, 9.0, 0.60, 2.0), "devanagari": (0.4, 9.0, 0.80, 2.0),
    "thai": (0.4, 9.0, 0.80, 2.0), "cjk": (0.3, 4.0, 0.97, 2.0), "hangul": (0.3, 4.0, 0.97, 2.0), "other": (0.25, 12.0, 1.0, 1.5),
}
#: Different good rows that a script needs for bands of its own; the share of them that may lie beyond a bound.
LEAST_GOOD, BEYOND = 30, 0.01
#: What a bound is moved outwards by: a factor for characters per token and entropy, a sum for the byte-fallback share.
SLACK, FALLBACK_SLACK = 0.95, 0.05
#: First code points of ranges and the scripts of their letters.
_RANGES = [(0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x3000, ""), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "cjk"), (0xFB00, "other"), (0xFE00, ""), (0x20000, "cjk"), (0x32000, "")]
_STARTS, _NAMES = np.array([a for a, _ in _RANGES], np.uint32), ["", *BANDS]
_CODE = np.array([_NAMES.index(b) for _, b in _RANGES], np.int64)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, chars_per_token_multi double, fallback_share double, token_entropy double"
)


class Fertility:
    """Tokens of words in the two vocabularies; a bounded number of words is remembered."""

    def __init__(self, pieces: str, ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            loaded = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=loaded, special_tokens={})
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.known: dict[bytes, int] = {}  # word -> its number here
        self.ids: list[bytes] = []
        self.n_multi: list[int] = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, by which words are equal and their tokens found. Valid until the next call."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.ids, self.n_multi = {}, [], []
        new = list(set(words).difference(self.known))
        text = [w.decode("utf-8", "replace") for w in new]
        self.known.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.ids += [array("I", x).tobytes() for x in self.sp.encode(text, num_threads=1)]
        count = self.multi.encode_ordinary  # its batch form makes a thread's task of every word
        self.n_multi += [len(count(f" {x}")) for x in text]
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def measure(self, numbers: np.ndarray) -> tuple[int, int, float, float]:
        """Tokens, tokens of the other vocabulary, byte-fallback share, entropy in bits."""
        if not len(numbers):
            return 0, 0, 0.0, 0.0
        each, times = np.unique(numbers, return_counts=True)
        each = each.tolist()
        found = [self.ids[i] for i in each]
        ids = np.frombuffer(b"".join(found), np.uint32)
        weight = np.repeat(times, [len(x) >> 2 for x in found])
        n = int(weight.sum())
        if not n:
            return 0, 0, 0.0, 0.0
        share = np.bincount(ids, weight)
        share = share[share > 0] / n
        multi = int(np.dot([self.n_multi[i] for i in each], times))
        return n, multi, float(weight[self.fallback[ids]].sum() / n), float(-(share * np.log2(share)).sum())


def script_of(data: bytes) -> str:
    """The script of most letters."""
    if data.isascii():
        return "latin" if any(x in data.lower() for x in b"etaoinshrdlucmfwypvbgkqjxz") else "other"
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    seen = np.bincount(_CODE[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_NAMES))
    seen[0] = 0
    return _NAMES[int(seen.argmax())] if seen.any() else "other"


def repeated_words(w: np.ndarray) -> int:
    """Words in three-word windows that stand twice or more, from numbers of the words."""
    if len(w) < 4:
        return 0
    w = w.astype(np.uint64)
    h = mix(mix(mix(w[:-2]) + w[1:-1]) + w[2:])
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    twice = n[inverse] > 1
    mask = np.zeros(len(w), bool)
    for k in range(3):
        mask[k : len(w) - 2 + k] |= twice
    return int(mask.sum())


_CONTINUED = bytes(range(0x80, 0xC0))


def judge(data: bytes, fertility: Fertility, bands=None) -> tuple:
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, BLANKS + _CONTINUED))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    numbers = fertility.numbers(words)
    repeat = repeated_words(numbers)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    script = script_of(data)
    tokens, multi, fallback, entropy = fertility.measure(numbers)
    per, per_multi = (chars / tokens, chars / multi) if tokens else (0.0, 0.0)
    low, high, most_fallback, least_entropy = (bands or BANDS)[script]
    in_band = low <= max(per, per_multi) and min(per, per_multi) <= high and fallback <= most_fallback and entropy >= least_entropy
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, failed, not failed and in_band, script, tokens, per, per_multi, fallback, entropy


def quality(docs: DataFrame, pieces: str, ranks: str, pattern: str, bands: dict | None = None) -> DataFrame:
    """Per document: base counts, verdicts by `BANDS` and the fertility measures. One narrow pass, no shuffle."""

    def run(batches):
        fertility = resident(("fertility", pieces, ranks), lambda: Fertility(pieces, ranks, pattern))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()] + [pa.float64()] * 4
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            out = list(zip(*(judge(x, fertility, bands) for x in utf8(batch, "text")), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _most_entropy():
    return F.log2(F.greatest(F.col("n_tokens"), F.lit(2)))


def fit_bands(measured: DataFrame, labels: DataFrame) -> dict[str, tuple[float, ...]]:
    """Script -> (least characters per token in each vocabulary, most byte-fallback share, least entropy in bits and as
    a share of log2 of the tokens) of the rows labelled good that pass the base rule. Copies, which have the same
    measures, count once. Any label 0 makes a document not good; null labels are ignored."""
    good = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.min("quality").alias("quality")).filter(F.col("quality") > 0).select("doc_id")
    names = ["script", "n_words", "word_chars", "n_tokens", "chars_per_token", "chars_per_token_multi", "fallback_share", "token_entropy"]
    rows = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi").select(*names).distinct()

    def bound(name, share):
        return F.percentile_approx(name, share, 10_000)

    found = rows.groupBy("script").agg(
        F.count(F.lit(1)), bound("chars_per_token", BEYOND), bound("chars_per_token_multi", BEYOND), bound("fallback_share", 1 - BEYOND),
        bound("token_entropy", BEYOND), bound(F.col("token_entropy") / _most_entropy(), BEYOND)
    )
    return {s: (SLACK * a, SLACK * b, c + FALLBACK_SLACK, SLACK * d, SLACK * e) for s, n, a, b, c, d, e in found.collect() if n >= LEAST_GOOD}


def within(measured: DataFrame, fitted: dict[str, tuple[float, ...]]) -> DataFrame:
    """`kept` only where the measures are also inside the script's fitted band, if it has one."""
    kept = F.col("kept")
    for script, (least, least_multi, most_fallback, least_entropy, least_share) in fitted.items():
        inside = (F.col("chars_per_token") >= least) & (F.col("chars_per_token_multi") >= least_multi)
        inside = inside & (F.col("fallback_share") <= most_fallback) & (F.col("token_entropy") >= F.least(F.lit(least_entropy), least_share * _most_entropy()))
        kept = kept & ((F.col("script") != script) | inside)
    return measured.withColumn("kept", kept)


def judged(docs: DataFrame, labels: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """`quality` with bands fitted on the labelled rows. The measures are written, so texts are encoded once."""
    measured = written(quality(docs, pieces, ranks, pattern), "quality")
    return within(measured, fit_bands(measured, labels))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return judged(docs, labels, public.path("piece_bpe_32k.model"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
