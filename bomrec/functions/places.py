"""Where texts of a vocabulary may stand in other texts, over Arrow batches: no Python object for a token or a place."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 1 << 18
MOST = 1 << 22  # bytes of found text, and 64 for each place, that are handed on at a time
SPAN = 8  # texts of more tokens are looked for only where the first SPAN tokens of one may stand
PREFIX = 1 << 40  # in place of a token count, for these first tokens
LEAST_BITS, MOST_BITS = 13, 26
SHIFTS = (0, 19, 38)

_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (one to one), in place."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_IS_TOKEN = np.zeros(256, bool)
_powers: dict[int, np.ndarray] = {}
_IS_TOKEN[0x30:0x3A] = _IS_TOKEN[0x41:0x5B] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, and maybe more of them."""
    if n > len(_powers.get(int(base), ())):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[int(base)] = np.cumprod(p, dtype=np.uint64)
    return _powers[int(base)]


def _salt(tokens: int | np.ndarray) -> np.ndarray:
    return np.atleast_1d(tokens).astype(np.uint64) * _SALT


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each text begins and ends in them; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces data[begin:end] as one binary column."""
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]).cast(pa.binary())


class Tokens:
    """Runs of A-Z and 0-9 of some texts in order: ``first[i]`` to ``first[i+1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = _IS_TOKEN[data]
        fresh, last = inside.copy(), inside.copy()
        if len(data):
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            same = np.ones(len(data), bool)
            same[0] = same[edges] = False
            fresh[1:] &= ~(inside[:-1] & same[1:])
            last[:-1] &= ~(inside[1:] & same[1:])
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        # A long text is summed up in pieces, so that the powers stay as many as a piece has bytes.
        n = min(len(data), STEP) + 1
        up, self._total = powers(_BASE, n), np.zeros(len(data) + 1, np.uint64)
        self._down = powers(_UNBASE, n), powers(np.uint64(pow(int(_UNBASE), STEP, 1 << 64)), len(data) // STEP + 1)
        for i in range(0, len(data), STEP):
            piece = _VALUE[data[i : i + STEP]]
            piece *= up[: len(piece)]
            if i:
                piece *= np.uint64(pow(int(_BASE), i, 1 << 64))
                piece[:1] += self._total[i : i + 1]
            np.cumsum(piece, out=self._total[i + 1 : i + 1 + len(piece)])

    def heads(self, begin: np.ndarray, end: np.ndarray, tokens: int | np.ndarray) -> np.ndarray:
        """64-bit keys of the bytes from begin to end, which hold so many tokens."""
        return mixed((self._total[end] - self._total[begin]) * self._lowered(begin) + _salt(tokens))

    def _lowered(self, begin: np.ndarray) -> np.ndarray:
        near, far = self._down
        return near[begin] if len(self._total) <= STEP else near[begin % STEP] * far[begin // STEP]

    def runs(self, spans: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each number of tokens the keys of as many from each token on, also where they run into the next text."""
        begun, ended, down = self._total[self.start], self._total[self.end], self._lowered(self.start)
        for k in spans:
            x = ended[k - 1 :] - begun[: max(0, len(begun) - k + 1)]
            x *= down[: len(x)]
            x += _salt(k)
            yield k, mixed(x)


def core_heads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that begin and end with a token, or have none: number of tokens, key, and key of the first SPAN."""
    data, offsets = text_bytes(column)
    t = Tokens(data, offsets)
    head = t.heads(offsets[:-1], offsets[1:], t.counts)
    prefix, long = head.copy(), t.counts > SPAN
    prefix[long] = t.heads(t.start[t.first[:-1][long]], t.end[t.first[:-1][long] + SPAN - 1], PREFIX)
    return t.counts, head.view(np.int64), prefix.view(np.int64)


class Wanted:
    """What to look for. ``spans``: numbers of tokens; ``sizes`` and ``openings``: numbers of bytes and first bytes
    of texts without tokens; ``lead`` and ``tail``: most bytes before and behind the tokens; ``words``: a Bloom
    filter of the keys, which may say yes for a key that was not added, never no for one that was.
    """

    def __init__(self, spans: list[int], sizes: list[int], openings: list[int], lead: int, tail: int, words: np.ndarray) -> None:
        self.spans, self.sizes, self.lead, self.tail, self.words = sorted(spans), sorted(sizes), lead, tail, words
        self.opens = np.zeros(256, bool)
        self.opens[openings] = True

    def test(self, heads: np.ndarray) -> np.ndarray:
        """Numbers of the keys that may be wanted."""
        mask, left = np.uint64(64 * len(self.words) - 1), None
        for s in SHIFTS:
            p = ((heads if left is None else heads[left]) >> np.uint64(s)) & mask
            hit = np.flatnonzero((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1))
            left = hit if left is None else left[hit]
        return left


def log_bits(n: int) -> int:
    """Size of the filter for about ``n`` keys: 32 bits for each, at most 8 MB. With more keys it lets more pass."""
    return min(MOST_BITS, max(LEAST_BITS, int(max(1, n) * 32 - 1).bit_length()))


def _possible(data: np.ndarray, offsets: np.ndarray, t: Tokens, wanted: Wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where wanted texts may begin and end, each with their tokens only."""
    behind = np.repeat(t.first[1:], t.counts)  # for each token, the number of the first one of the next text
    for k, heads in t.runs([k for k in wanted.spans if k <= SPAN]):
        at = wanted.test(heads)
        at = at[at + k <= behind[at]]
        yield t.start[at], t.end[at + k - 1]
    if long := [k for k in wanted.spans if k > SPAN]:
        far = np.flatnonzero(np.arange(len(behind)) + SPAN <= behind)
        far = far[wanted.test(t.heads(t.start[far], t.end[far + SPAN - 1], PREFIX))]
        for k in long:
            at = far[far + k <= behind[far]]
            begin, end = t.start[at], t.end[at + k - 1]
            hit = wanted.test(t.heads(begin, end, k))
            yield begin[hit], end[hit]
    if wanted.sizes:
        at = np.flatnonzero(wanted.opens[data])
        token, text = np.searchsorted(t.start, at), np.searchsorted(offsets, at, "right")
        opens = np.maximum(offsets[text - 1], np.concatenate([[0], t.end])[token])
        ends = np.minimum(offsets[text], np.concatenate([t.start, [len(data)]])[token])
        # No letter or digit may stand next to them.
        left = (at > opens) | (at == offsets[text - 1])
        for size in wanted.sizes:
            end = at + size
            ok = np.flatnonzero(left & ((end < ends) | ((end == ends) & (end == offsets[text]))))
            hit = ok[wanted.test(t.heads(at[ok], end[ok], 0))]
            yield at[hit], end[hit]


def _places(data: np.ndarray, offsets: np.ndarray, wanted: Wanted) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    t = Tokens(data, offsets)
    found = list(_possible(data, offsets, t, wanted))
    begins, stops = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    tokens_before, tokens_behind = np.concatenate([[0], t.end]), np.concatenate([t.start, [len(data)]])
    rest = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that no character begins with
    sent = np.cumsum(stops - begins + wanted.lead + wanted.tail + 64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(sent, sent[i] + MOST)))
        begin, end = begins[i:j], stops[i:j]
        text = np.searchsorted(offsets, begin, "right") - 1
        low, high = offsets[text], offsets[text + 1]
        opens = np.maximum(low, tokens_before[np.searchsorted(t.start, begin)])
        ends = np.minimum(high, tokens_behind[np.searchsorted(t.start, end)])
        # The ends of a text count as one character more, which is no letter or digit.
        before, after = begin - opens + (opens == low), ends - end + (ends == high)
        chars = begin - low - np.searchsorted(rest, begin) + np.searchsorted(rest, low)
        yield text, [
            cut(data, begin, end), cut(data, np.maximum(opens, begin - wanted.lead), begin), cut(data, end, np.minimum(ends, end + wanted.tail)),
            *[pa.array(x.astype(np.int32)) for x in (before, after, chars)],
        ]
        i = j


def places(column: pa.Array, wanted: Wanted) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """For runs of texts: number of the text; and core, what stands before and behind it, how many bytes without a
    letter or digit stand there, and the character that the core begins at."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
        for text, found in _places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], wanted):
            yield i + text, found
        i = j


class Taken:
    """Which characters of a text are taken, over batches of spans that come text by text, longest first."""

    def __init__(self) -> None:
        self.marks = bytearray()

    def add(self, nth: list[int], start: list[int], end: list[int]) -> np.ndarray:
        """Which of the spans overlap none that was taken before; they are taken then. The first of a text has nth 1."""
        free = np.zeros(len(nth), bool)
        for i, (n, s, e) in enumerate(zip(nth, start, end, strict=True)):
            if n == 1:
                self.marks = bytearray(e)
            elif e > len(self.marks):
                self.marks.extend(bytes(e))
            if not (self.marks[s] or self.marks[e - 1]):
                self.marks[s:e] = b"\1" * (e - s)
                free[i] = True
        return free
