"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A text is split by the public pattern; in each piece the leaves of a segment tree hold rank and place of every
adjacent pair. The root is the leftmost pair of the lowest rank; merging it changes at most three leaves, each with
logarithmic work, until no mergeable pair is left. Pieces of up to 64 bytes are merged many at a time (one tree per
row of a matrix), longer ones one by one. What a piece encodes to is kept in a bounded table of the worker.

Edge cases: null is an empty text (0 tokens). Strings of special tokens in a text become that token, as in the
tokenizers library. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import read, resident

PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers before it starts anew, and the longest (characters) that it remembers.
KEPT_PIECES, KEPT_CHARS = 250_000, 64
NO_PAIR = np.int64(1) << 60

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab = spec["model"]["vocab"]
        to_char = byte_alphabet()
        to_byte = {c: b for b, c in to_char.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.first = np.array([vocab[to_char[b]] for b in range(256)], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.rank, self.made = (left << 20 | right)[order], order.astype(np.int64), made[order]
        self.pair = {(a, b): (i, m) for i, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.pieces = regex.compile(PIECES).findall
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NO_PAIR where none) and merged ids."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NO_PAIR), self.made[at]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encodes pieces of at most `width` bytes, a power of two, each row with its own tree."""
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.zeros((n, width), np.uint8)
        cell = np.arange(width)
        raw[cell < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(cell < lengths[:, None], self.first[raw], -1)
        after = np.where(cell + 1 < lengths[:, None], cell + 1, width)  # of each symbol: the next one's cell
        before = np.broadcast_to(cell - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NO_PAIR)
        ranks, _ = self._lookup(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(ranks < NO_PAIR, ranks * width + cell[:-1], NO_PAIR)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.nonzero(tree[:, 1] < NO_PAIR)[0]
        while len(rows):
            at = tree[rows, 1] % width
            gone = after[rows, at]
            left = ids[rows, at]
            ids[rows, at] = self._lookup(left, ids[rows, gone])[1]
            ids[rows, gone] = -1
            then = after[rows, gone]
            after[rows, at] = then
            inside = then < width
            before[rows[inside], then[inside]] = at[inside]
            self._put(tree, rows, gone, np.full(len(rows), NO_PAIR), width)
            ranks, _ = self._lookup(ids[rows, at], np.where(inside, ids[rows, np.minimum(then, width - 1)], -1))
            self._put(tree, rows, at, np.where(ranks < NO_PAIR, ranks * width + at, NO_PAIR), width)
            prior = before[rows, at]
            back, where = rows[prior >= 0], prior[prior >= 0]
            ranks, _ = self._lookup(ids[back, where], ids[back, at[prior >= 0]])
            self._put(tree, back, where, np.where(ranks < NO_PAIR, ranks * width + where, NO_PAIR), width)
            rows = rows[tree[rows, 1] < NO_PAIR]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = value
        while width > 1:
            width //= 2
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_one(self, piece: bytes) -> bytes:
        """A piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, after, before = self.first[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        none, pair = (1 << 60, 0), self.pair
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (got := pair.get((ids[i], ids[i + 1]))) is not None:
                tree[width + i] = (got[0], i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                best = min(tree[2 * i], tree[2 * i + 1])
                if best == tree[i]:
                    return
                tree[i] = best

        def rank(i: int) -> tuple[int, int]:
            got = pair.get((ids[i], ids[after[i]])) if after[i] < n else None
            return none if got is None else (got[0], i)

        while tree[1] is not none and tree[1] < none:
            at = tree[1][1]
            gone = after[at]
            ids[at] = pair[ids[at], ids[gone]][1]
            ids[gone] = -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, rank(at))
            if before[at] >= 0:
                put(before[at], rank(before[at]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, as little-endian unsigned 32-bit integers."""
        out, by_width = {}, {}
        for piece in pieces:
            data = piece.encode()
            if len(data) > 64:
                out[piece] = self.merge_one(data)
            else:
                by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for width, own in by_width.items():
            for i in range(0, len(own), 8192):
                part = own[i : i + 8192]
                out.update(zip((x for x, _ in part), self.merge_many([x for _, x in part], width), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            if self.special and self.special.search(text):
                parts: list = []
                for x in self.special.split(text):
                    parts += [self.added[x]] if x in self.added else self.pieces(x)
                split.append(parts)
            else:
                split.append(self.pieces(text))
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known = self.known
        new = {x for parts in split for x in parts if x not in known}
        learnt = {x: np.array([x], "<u4").tobytes() for x in new if isinstance(x, int)}
        learnt |= self.learn(new - learnt.keys())
        known.update(learnt)
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for x in learnt:
            if isinstance(x, str) and len(x) > KEPT_CHARS:
                del known[x]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> Bpe:
    return resident(("bpe", path), lambda: Bpe(path))


#: Characters of text whose pieces are handled at once.
STEP_CHARS = 4 << 20


def steps(texts: list[str]):
    """Runs of texts of about STEP_CHARS in all, so that a batch of long texts does not hold all its pieces at once."""
    own, size = [], 0
    for x in texts:
        own.append(x)
        size += len(x)
        if size >= STEP_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


def bpe_roundtrip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: tokens, digest of the ids, digest of the decoded text, and the ids if asked for. One narrow pass,
    no shuffle."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            n, ids_hash, text_hash, all_ids = [], [], [], []
            for texts in steps([x or "" for x in batch.column("text").to_pylist()]):
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<i4"))
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            out += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(read(spark, sf_dir, "documents"), default_path())
