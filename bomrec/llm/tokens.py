"""Words of whole Arrow batches as numpy arrays: no Python object is made for a word or a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), STEP)
        for k, b in enumerate((BASE, UNBASE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Alphabet:
    """Which bytes make up words, and what a byte counts as once A-Z are lower-cased."""

    def __init__(self, word_bytes: np.ndarray, lower: bool = True) -> None:
        self.is_word = word_bytes
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.value = mixed(self.fold.astype(np.uint64) + np.uint64(1))


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Words between white space, and words of ASCII letters and digits and all characters beyond ASCII.
SPACED = Alphabet(~_bytes((0x20, 0x20), (0x09, 0x0D)))
ALPHANUMERIC = Alphabet(_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins and ends in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Cut texts into runs of at most ``most`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def pieces(offsets: np.ndarray, most: int = STEP, reach: int = 2) -> Iterator[tuple[int, int, int, int, int]]:
    """As ``blocks``, as (i, j, begin, stop, lead) in bytes; a longer text comes as several pieces, of which
    the first ``lead`` bytes repeat the end of the piece before."""
    for i, j in blocks(offsets, most):
        for begin in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), most):
            lead = min(reach, begin - int(offsets[i]))
            yield i, j, begin - lead, min(begin + most, int(offsets[j])), lead


class Words:
    """Words of some texts in order: ``first[i]`` to ``first[i+1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> None:
        self.data, self.alphabet = data, alphabet
        inside = alphabet.is_word[data]
        fresh, last = inside.copy(), inside.copy()
        if len(data):
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            same = np.ones(len(data), bool)
            same[0] = same[edges] = False
            fresh[1:] &= ~(inside[:-1] & same[1:])
            last[:-1] &= ~(inside[1:] & same[1:])
        self.start = np.flatnonzero(fresh)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit polynomial hash of each folded word, from running sums over pieces of bounded size."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            begin = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.start, begin + STEP)))
            piece = self.data[begin : self.end[j - 1]]
            up, down = powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.alphabet.value[piece] * up[: len(piece)], out=total[1:])
            a, b = self.start[i:j] - begin, self.end[i:j] - begin
            out[i:j] = (total[b] - total[a]) * down[a]
            i = j
        return mixed(out)

    def word(self, i: int) -> str:
        return self.alphabet.fold[self.data[self.start[i] : self.end[i]]].tobytes().decode("utf-8", "replace")


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (none near the end of the array)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mixed(out)


def inside_text(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-grams of ``grams`` lie within one text."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok
