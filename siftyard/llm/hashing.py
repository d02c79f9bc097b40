"""64-bit word hashes and what is built on them with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from siftyard.llm.common import resident

KEPT_WORDS = 300_000
_U = np.uint64


class Words(dict):
    """Word -> 64-bit hash, kept for the words seen; starts anew beyond KEPT_WORDS."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return resident("words", Words).hashes(words)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Spans:
    """Hashes of any span of a sequence of word hashes, from prefix sums of w[i] * p**i modulo 2**64."""

    def __init__(self, w: np.ndarray, p: int):
        n = len(w)
        up, down = np.full(n + 1, p, _U), np.full(n + 1, pow(p, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(w * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + mix(np.atleast_1d(size).astype(_U)))


def leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """For each i with i + w <= len(h): the place of the leftmost smallest of h[i : i + w]."""
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at = np.where(h[a] <= h[b], a, b)
        size *= 2
    if size < w:
        a, b = at[: len(h) - w + 1], at[w - size : w - size + len(h) - w + 1]
        at = np.where(h[a] <= h[b], a, b)
    return at[: max(0, len(h) - w + 1)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U, copy=False).view(np.int64)
