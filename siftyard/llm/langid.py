"""Language identification by compression: a raw-content zstandard dictionary for each language.

Every language's dictionary is text of that language, in lower case; a text, in lower case too, is cut in blocks, each block is compressed with each
dictionary, and the language with the smallest sum wins. The relative gap to the second is the margin; below
`min_margin`, or below the fitted least margin of texts as long as this one, the prediction is marked as rejected.

The least margins are fitted on text that the dictionaries do not hold, each half of the learning rows (by a hash of the text)
by dictionaries of the other half. A text with its own language's dictionary shows right margins, without it those of a language
not learned. The least margin is what 99 % of the latter stay below, but no more than 99.7 % of the former reach, of those that
`MIN_MARGIN` does not reject anyway: keeping clean texts comes first.

Fitting reads every learning row whole, nothing of it is a sample. Three passes: (1) in how many rows of a language each run of
`GRAM` bytes stands, in `BUCKETS` buckets by hash; (2) every stretch of `STRETCH` bytes of every text stands for election: its score
is the rows that its different runs stand in, and of the stretches with the same least bucket, and of those with the same
greatest (near copies of a text share a few), the highest score is a candidate; of the candidates the dictionary takes those whose runs not yet in it stand in most
rows, `PARTS` of them, which is the size of the model; (3) every text is cut in pieces of `LENGTHS`, the longest that fit
first, and each different piece has its margins counted, in steps of 1 / `GRID`. Only the last 63 bytes of a text, less than
the least length, have no margin. The driver gets counts and candidates, never rows. Texts of every length are compressed with the
same settings. Nearly all the time goes into compressing, so a worker keeps the sizes of the last blocks, and a block that it meets
again (copies, common openings) is not compressed again.

Edge cases: null text, empty text and text without a letter give `und` with score 0, marked as rejected. Ties go to
the language with more training rows, then by name. With no labelled row all is `und`. A null doc_id is in fold 0
when its crc32 of the empty text is 0 modulo the number of folds, as any id. Repeated rows give a row each.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import fold, fold_column, read, resident
from siftyard.llm.hashing import mix, signed

FOLDS = 5
#: Bytes of the runs that are counted, buckets of their hashes, bytes of a stretch and stretches of a dictionary.
GRAM, BUCKET_BITS, STRETCH, PARTS = 6, 18, 240, 480
BUCKETS = 1 << BUCKET_BITS
#: Stretches of a text whose runs are counted at once, parts that a table of counts travels in, and languages whose tables a worker
#: holds at once.
SCORED, CHUNKS, HELD = 4096, 64, 64
#: Stretches, of several texts, that are scored side by side: as many as stay in a core's cache.
SIDE_BY_SIDE = 256
#: Marks the dictionary of both halves (0 and 1).
WHOLE = 2
#: Blocks that go through one dictionary after the other: changing it for every block costs more than compressing.
TOGETHER = 4096
#: Sizes that a worker keeps, of blocks times languages (some 90 bytes each); it starts anew beyond them.
KNOWN = 1 << 18
#: Matches of three bytes are found, by a tree search of 2**SEARCH_LOG steps: short texts need them.
BLOCK_BYTES, MIN_MATCH, SEARCH_LOG = 4096, 3, 3
#: Opens every block and ends every dictionary: a block then always compresses, and small gains of short texts show.
MARK = bytes(range(1, 32)) * 2
MIN_MARGIN = 0.001
#: Lengths in bytes that least margins are fitted for (up to a whole block: a text in it is matched with itself too, which
#: narrows margins; a text goes by the lower bound of the lengths before and after its own), and the shares that may lie beyond a
#: bound: of texts of no learned language, and of texts in their own. Languages count alike but for those of few pieces: FEW
#: shared by the languages, LEAST_FEW of each at least.
LENGTHS, GRID, FEW, LEAST_FEW, BEYOND, LOST = (64, 128, 256, 512, 1024, 2048, 4096), 10_000, 400, 10, 0.01, 0.003

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
_LETTER = regex.compile(r"\p{L}")


class Model(list):
    """(language, dictionary content) of each language, and the least margin of each length."""

    margins: tuple[tuple[int, float], ...] = ()


def fit(docs: DataFrame) -> Model:
    """(language, dictionary content), the most frequent language first, and the least margins."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_column(F.col("doc_id"), FOLDS) != 0))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text")
    weights, counts = counted(rows)
    if not counts:
        return Model()
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    found = dictionaries(candidates(rows, shared), shared, len(counts))
    shared.destroy()
    names = sorted(counts, key=lambda k: (-counts[k], k))
    own = lambda kind: [(lang, found.get((lang, kind), b"")) for lang in names]
    out = Model(own(WHOLE))
    out.margins = calibrate(rows, [own(0), own(1)])
    return out


def learnt(text: str) -> tuple[bytes, int]:
    """What is learnt from a text, and the half that it is in, with all its copies."""
    data = text.lower().encode()
    return data, zlib.crc32(data) & 1


def grams(data: bytes, kind: type = np.int32) -> np.ndarray:
    """The bucket of the run of GRAM bytes at each place."""
    n = max(0, len(data) - GRAM + 1)
    x = np.ndarray(n, "<u8", data + bytes(8), strides=(1,)).astype(np.uint64)  # eight bytes from each place on
    x.byteswap(inplace=True)
    x >>= np.uint64(64 - 8 * GRAM)
    return (mix(x) >> np.uint64(64 - BUCKET_BITS)).astype(kind)


def frequencies(rows: DataFrame) -> dict[str, np.ndarray]:
    """Of each language, the rows that each bucket stands in; a last entry, 0, is for places without a run."""
    return counted(rows)[0]


def counted(rows: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """What `frequencies` gives, and the rows of each language, which travel as one part more."""
    step = BUCKETS // CHUNKS

    def told(tables):
        lang = [x for x in tables for _ in range(CHUNKS + 1)]
        parts = [t[i : i + step].tobytes() for t in tables.values() for i in range(0, BUCKETS + 1, step)]
        chunk = pa.array([*range(CHUNKS + 1)] * len(tables), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), chunk, pa.array(parts, pa.binary())], ["lang", "chunk", "counts"])

    def count(batches):
        tables = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in tables and len(tables) == HELD:
                    yield told(tables)
                    tables = {}
                if lang not in tables:
                    tables[lang] = np.zeros(BUCKETS + 1, np.uint32)
                tables[lang][BUCKETS] += 1
                data, size = text.lower().encode(), SCORED * STRETCH
                if len(data) <= size:
                    at = grams(data, np.intp)
                    tables[lang][at] = tables[lang].take(at, mode="clip") + np.uint32(1)  # once for places of one bucket
                    continue
                seen = np.zeros(BUCKETS + 1, bool)
                for i in range(0, len(data), size):
                    seen[grams(data[i : i + size + GRAM - 1])] = True
                tables[lang] += seen
        yield told(tables)

    def total(table: pa.Table) -> pa.Table:
        parts = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "chunk": table.column("chunk")[:1], "counts": pa.array([parts.tobytes()], pa.binary())})

    schema = "lang string, chunk int, counts binary"
    out: dict[str, np.ndarray] = {}
    size: dict[str, int] = {}
    for lang, chunk, counts in rows.mapInArrow(count, schema).groupBy("lang", "chunk").applyInArrow(total, schema).collect():
        if chunk == CHUNKS:
            (size[lang],) = np.frombuffer(counts, np.int64).tolist()
            continue
        out.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[chunk * step : (chunk + 1) * step] = np.frombuffer(counts, np.int64)
    return out, size


def sorted_runs(own: list[bytes]) -> np.ndarray:
    """A row for each stretch (none empty) with the buckets of its runs, sorted; BUCKETS fills the rows of shorter ones."""
    places = np.fromiter(map(len, own), np.intp, len(own)) - GRAM + 1
    short = np.flatnonzero(places < STRETCH - GRAM + 1)
    h = grams(b"".join(x.ljust(STRETCH, b"\0") for x in own) + bytes(GRAM - 1)).reshape(len(own), STRETCH)[:, : STRETCH - GRAM + 1]
    h[short] = np.where(np.arange(h.shape[1]) < places[short, None], h[short], BUCKETS)
    return np.sort(h, axis=1)


def scored(datas: bytes | list[bytes], weights: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
    """Stretch, least bucket (BUCKETS without a run), greatest bucket (-1), score of all stretches of a text, or of several."""
    datas = [datas] if isinstance(datas, bytes) else datas
    weights = weights.astype(np.uint32) if weights.max() < 1 << 32 else weights  # half the memory to look up in
    every = (data[k : k + STRETCH] for data in datas for k in range(0, len(data), STRETCH))
    while own := list(itertools.islice(every, SIDE_BY_SIDE)):
        h = sorted_runs(own)
        greatest = h[:, -1].copy()
        short = np.flatnonzero(greatest == BUCKETS)
        greatest[short] = np.where(h[short] < BUCKETS, h[short], -1).max(axis=1)
        worth = weights.take(h, mode="clip")
        worth[:, 1:] *= h[:, 1:] != h[:, :-1]
        yield from zip(own, h[:, 0].tolist(), greatest.tolist(), worth.sum(axis=1).tolist(), strict=True)


def candidates(rows: DataFrame, shared) -> DataFrame:
    """lang, half, part: of each language and half, the stretch of the highest score for each least and for each greatest bucket;
    the greater one of equals. `shared` is the broadcast of `frequencies`."""

    def elect(batches):
        best: dict[tuple, dict] = {}
        own = shared.value
        for batch in batches:
            asked: dict[tuple, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, half = learnt(text)
                asked.setdefault((lang, half), []).append(data)
            for key, datas in asked.items():
                slots = best.setdefault(key, {})
                for part, least, greatest, score in scored(datas, own[key[0]]):
                    found = (score, part)
                    for slot in (least, -2 - greatest):
                        if slots.get(slot, (-1,)) < found:
                            slots[slot] = found
        columns = list(zip(*((*key, slot, *x) for key, slots in best.items() for slot, x in slots.items()), strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["lang", "half", "slot", "score", "part"])

    found = rows.mapInArrow(elect, "lang string, half int, slot int, score long, part binary")
    return found.groupBy("lang", "half", "slot").agg(F.max(F.struct("score", "part")).alias("x")).select("lang", "half", "x.part").distinct()


def dictionaries(found: DataFrame, shared, languages: int) -> dict[tuple[str, int], bytes]:
    """The dictionary of each language and half, and of both (WHOLE); a task for each."""

    def build(table: pa.Table) -> pa.Table:
        lang, kind = (table.column(x)[:1] for x in ("lang", "kind"))
        content = content_of(table.column("part").to_pylist(), shared.value[lang[0].as_py()])
        return pa.table({"lang": lang, "kind": kind, "content": pa.array([content], pa.binary())})

    each = found.select("lang", F.explode(F.array("half", F.lit(WHOLE))).alias("kind"), "part").repartition(3 * languages, "lang", "kind")
    return {(r[0], r[1]): bytes(r[2]) for r in each.groupBy("lang", "kind").applyInArrow(build, "lang string, kind int, content binary").collect()}


def content_of(parts: list[bytes], weights: np.ndarray) -> bytes:
    """A dictionary of PARTS stretches: next is always the one whose runs not yet there stand in most rows, the smallest one of equals.
    The first stands last, where matches are cheapest."""
    left, out, parts = weights.copy(), [], sorted(set(parts))
    runs, worth = np.empty((len(parts), STRETCH - GRAM + 1), np.int32), np.empty(len(parts), np.int64)
    for i in range(0, len(parts), SIDE_BY_SIDE):
        some = slice(i, i + SIDE_BY_SIDE)
        h = sorted_runs(parts[some])
        runs[some] = h
        runs[some, 1:][h[:, 1:] == h[:, :-1]] = BUCKETS
        worth[some] = left.take(runs[some], mode="clip").sum(axis=1)
    # worth only falls, so what it was is an upper bound; `known` is for how many parts taken it was last found
    known, most = np.zeros(len(parts), np.int64), min(SIDE_BY_SIDE, len(parts))
    while len(out) < min(PARTS, len(parts)):
        first = int(worth.argmax())
        if known[first] == len(out):
            out.append(parts[first])
            left[runs[first]] = 0
            worth[first] = -1
            continue
        at = np.append(np.argpartition(worth, len(parts) - most)[-most:], first)
        at = at[worth[at] >= 0]
        worth[at], known[at] = left.take(runs[at], mode="clip").sum(axis=1), len(out)
    return b"\n".join(reversed(out))


def pieces(data: bytes) -> list[bytes]:
    """The text from start to end in different pieces of LENGTHS, the longest that fit first."""
    out, at = {}, 0
    for n in reversed(LENGTHS):
        while len(data) - at >= n:
            out[data[at : at + n]] = None
            at += n
    return list(out)


def calibrate(rows: DataFrame, halves: list[list[tuple[str, bytes]]]) -> tuple[tuple[int, float], ...]:
    """(length, least margin) from all learning rows, each half measured by the dictionaries of the other. With fewer than three
    languages, a text without its own has no second one, and there are none."""
    if len(halves[0]) < 3:
        return ()
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def measure(batches):
        models = resident(("halves", hash(tuple(map(tuple, shared.value)))), lambda: [Languages(x) for x in shared.value])
        for batch in batches:
            asked: tuple[list, list] = ([], [])
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, half = learnt(text)
                names = models[1 - half].names
                if lang in names and len(names) >= 3:
                    at = names.index(lang)
                    asked[1 - half].extend((at, x) for x in pieces(data) if _LETTER.search(x.decode(errors="ignore")))
            for languages, own in zip(models, asked, strict=True):
                if not own:
                    continue
                at, parts = np.array([k for k, _ in own]), [x for _, x in own]
                sizes = np.array([x for i in range(0, len(parts), TOGETHER) for x in languages.blocks(parts[i : i + TOGETHER])], np.int64)
                margin, best = gaps(sizes), sizes.argmin(axis=1)
                right = np.where((best == at) & (margin >= MIN_MARGIN), (margin * GRID).astype(np.int32), -1)
                sizes[np.arange(len(own)), at] = np.iinfo(np.int64).max
                n = np.fromiter(map(len, parts), np.int32, len(own))
                piece = signed(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(own)))
                columns = (pa.array(languages.names, pa.string()).take(pa.array(at)), n, piece, right.astype(np.int32), (gaps(sizes) * GRID).astype(np.int32))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["lang", "n", "piece", "right", "other"])

    every = rows.mapInArrow(measure, "lang string, n int, piece long, right int, other int").distinct()
    kinds = F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("step")) for x in ("right", "other")])
    found = every.select("lang", "n", F.explode(kinds).alias("x")).filter("x.step >= 0").groupBy("lang", "n", "x.kind", "x.step").count().collect()
    return least_margins([tuple(r) for r in found], max(LEAST_FEW, FEW // len(halves[0])))


def least_margins(found: list[tuple[str, int, str, int, int]], few: int) -> tuple[tuple[int, float], ...]:
    """(length, least margin) from (language, length, kind, step, pieces); a language of fewer than `few` pieces counts less."""
    every: dict[tuple, int] = {}
    for lang, n, kind, _, count in found:
        every[lang, n, kind] = every.get((lang, n, kind), 0) + count

    def bound(n, kind, share):
        steps = sorted((step, lang, count / max(few, every[lang, n, kind])) for lang, m, k, step, count in found if (m, k) == (n, kind))
        most, below = share * math.fsum(x for *_, x in steps), 0.0
        for step, _, x in steps:
            below += x
            if below > most:
                return step
        return steps[-1][0] if steps else None

    bounds = [(n, bound(n, "right", LOST), bound(n, "other", 1 - BEYOND)) for n in LENGTHS]
    return tuple((n, min(low, high) / GRID) for n, low, high in bounds if low is not None and high is not None)


def compressor(content: bytes):
    """The compress function of a raw-content dictionary, without the frame's optional fields."""
    params = zstandard.ZstdCompressionParameters.from_level(
        12, dict_size=len(content) + len(MARK), source_size=BLOCK_BYTES + len(MARK), strategy=zstandard.STRATEGY_BTLAZY2, min_match=MIN_MATCH,
        search_log=SEARCH_LOG, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=own).compress


def winner(sizes: list[int]) -> tuple[int, float]:
    """The place of the smallest size (two at least), and the relative gap to the second."""
    best = sizes.index(min(sizes))
    second = min(sizes[:best] + sizes[best + 1 :])
    return best, (second - sizes[best]) / second


def gaps(sizes: np.ndarray) -> np.ndarray:
    """The margin of `winner` for each row of sizes."""
    two = np.partition(sizes, 1, axis=1)
    return (two[:, 1] - two[:, 0]) / two[:, 1]


class Languages:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.margins = getattr(model, "margins", ())
        model = [(lang, content) for lang, content in model if len(content) >= 8]
        self.names = [lang for lang, _ in model]
        self.compress = [compressor(content) for _, content in model]
        self.known: dict[bytes, tuple[int, ...]] = {}

    def blocks(self, blocks: list[bytes]) -> list[tuple[int, ...]]:
        """Of each block the compressed size by each dictionary; blocks met before, by a 128-bit hash, are not compressed again."""
        if len(self.known) * len(self.compress) > KNOWN:
            self.known.clear()
        keys = [xxhash.xxh3_128_digest(x) for x in blocks]
        new = {k: MARK + x for k, x in zip(keys, blocks, strict=True) if k not in self.known}
        self.known.update(zip(new, zip(*([len(f(x)) for x in new.values()] for f in self.compress), strict=True)))
        return [self.known[k] for k in keys]

    def sizes(self, datas: list[bytes]) -> Iterator[list[int]]:
        """Of each of some texts (not empty), the compressed size by each dictionary."""
        blocks, ends = [], []
        for k, data in enumerate(datas):
            blocks += [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            ends.append(len(blocks))
            if len(blocks) >= TOGETHER or k == len(datas) - 1:
                found = self.blocks(blocks)
                yield from (list(found[i]) if j - i == 1 else [sum(x) for x in zip(*found[i:j], strict=True)] for i, j in zip([0, *ends], ends, strict=False))
                blocks, ends = [], []

    def least(self, size: int) -> float:
        """The least margin of texts of so many bytes; none (0) for texts shorter than all that were fitted."""
        before = [x for n, x in self.margins if n <= size]
        return min([before[-1], *[x for n, x in self.margins if n > size][:1]]) if before else 0.0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """Language, score, margin of each text, and the least margin of texts as long."""
        spoken = [bool(x and self.names and _LETTER.search(x)) for x in texts]
        datas = [t.lower().encode() if x else b"" for t, x in zip(texts, spoken, strict=True)]
        if len(self.names) == 1:
            return [(self.names[0], 1.0, 1.0, self.least(len(x))) if x else ("und", 0.0, 0.0, 0.0) for x in datas]
        sizes = self.sizes([x for x in datas if x])
        out = []
        for x in datas:
            best, margin = winner(next(sizes)) if x else (0, 0.0)
            out.append((self.names[best], 1 - math.exp(-30 * margin), margin, self.least(len(x))) if x else ("und", 0.0, 0.0, 0.0))
        return out


def _model(shared) -> Languages:
    return resident(("languages", hash((tuple(shared.value), getattr(shared.value, "margins", ())))), lambda: Languages(shared.value))


def identify(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN, keep: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, margin, rejected. With `keep`, all columns of `docs` and
    `lang_pred`, `rejected` as `__lang_pred`, `__rejected`: the form for filters, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        languages = _model(shared)
        for batch in batches:
            found = languages.predict(batch.column("text").to_pylist())
            pred = pa.array([x[0] for x in found], pa.string())
            rejected = pa.array([x[0] == "und" or x[2] < max(min_margin, x[3]) for x in found], pa.bool_())
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, pred, rejected], [*batch.schema.names, "__lang_pred", "__rejected"])
                continue
            out = [pa.array([fold(x, FOLDS) == 0 for x in batch.column("doc_id").to_pylist()], pa.bool_()), pred]
            out += [pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out, rejected], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    if not keep:
        return source.mapInArrow(run, SCHEMA)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__rejected", T.BooleanType())])
    return source.mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
