"""Array kernels that the text operators run inside their Spark tasks.

A column of texts is taken as one run of UTF-8 bytes with offsets (the Arrow
layout), and everything is computed for many documents at once with numpy:
word boundaries, 64-bit word hashes, word and byte k-gram hashes, sliding
minima.  Nothing here knows about Spark; memory is bounded by ``SLICE_BYTES``
(or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


BASE = _U(0x9E3779B97F4A7C15)
BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE_LOWER = BYTE_CODE[LOWER]

# word alphabets, on bytes: UTF-8 bytes of non-ASCII characters are >= 0x80
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached and grown on demand."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            step = np.full(size, base, dtype=_U)
            step[0] = 1
            have = np.cumprod(step, dtype=_U)
        _powers[key] = have
    return have[:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``max_bytes`` together (or one longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of a slice of texts: hashes, byte bounds and the index of their text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray):
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = data[lo:hi]
        offs = offsets - lo
        n = len(raw)
        self.n_texts = len(offs) - 1
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = alphabet[raw]
        left = inside[:-1].copy()
        right = inside[1:].copy()
        left[offs] = False   # a word never crosses texts
        start = np.flatnonzero(right[:n] & ~left[:n])
        stop_at = inside[1:-1].copy()
        nxt = np.zeros(n, dtype=bool)
        nxt[:-1] = inside[2:-1]
        cut = offs[(offs > 0) & (offs <= n)] - 1
        nxt[cut] = False
        end = np.flatnonzero(stop_at & ~nxt) + 1
        self.start, self.end = start, end
        with np.errstate(over="ignore"):
            acc = np.zeros(n + 1, dtype=_U)
            np.cumsum(BYTE_CODE_LOWER[raw] * _power_table(BASE, n), out=acc[1:])
            self.hash = mix((acc[end] - acc[start]) * _power_table(BASE_INV, n + 1)[start]
                            + (end - start).astype(_U))
        self._sums = acc
        # words per text, first word of each text, text of each word
        self.first = np.searchsorted(start, offs)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n_texts), self.count)

    def heads(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first k bytes, text) of the words longer than k bytes."""
        long = self.end - self.start > k
        at = self.start[long]
        with np.errstate(over="ignore"):
            return (mix((self._sums[at + k] - self._sums[at]) * _power_table(BASE_INV, len(self._sums))[at] - _U(k)),
                    self.text[long])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words that start at each word; valid: all in one text."""
        m = len(self.hash)
        valid = np.zeros(m, dtype=bool)
        out = np.zeros(m, dtype=_U)
        if m >= k:
            with np.errstate(over="ignore"):
                g = self.hash[:m - k + 1].copy()
                for j in range(1, k):
                    g = g * BASE + self.hash[j:m - k + 1 + j]
            out[:m - k + 1] = mix(g + _U(k))
            valid[:m - k + 1] = self.text[:m - k + 1] == self.text[k - 1:]
        return out, valid


def whole_gram(hashes: np.ndarray) -> np.uint64:
    """The gram hash of a whole (short) word sequence; equals ``Words.grams(len)`` of it."""
    with np.errstate(over="ignore"):
        g = hashes[:1].copy()
        for h in hashes[1:]:
            g = g * BASE + h
        return mix(g + _U(len(hashes)))[0]


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that start at each byte (length n-k+1; empty if shorter)."""
    n = len(raw)
    if n < k:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, dtype=_U)
        np.cumsum(BYTE_CODE[raw] * _power_table(BASE, n), out=acc[1:])
        return mix((acc[k:] - acc[:n - k + 1]) * _power_table(BASE_INV, n + 1)[:n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (length len(x)-w+1)."""
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    extra = w - have
    return np.minimum(m[:len(m) - extra], m[extra:]) if extra else m


def winnow(x: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of at least one run of w values.

    With fewer than w values the one (short) run is the whole array.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n < w:
        return np.flatnonzero(x == x.min())
    low = sliding_min(x, w)
    # a value is kept when the largest of the minima of the runs around it is itself
    pad = np.zeros(n + w - 1, dtype=_U)
    pad[w - 1:w - 1 + len(low)] = low
    best = ~sliding_min(~pad, w)
    return np.flatnonzero(best[:n] == x)
