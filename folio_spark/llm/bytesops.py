"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

Text never becomes Python strings here: a batch's bytes are cut into words and hashed with a
handful of numpy passes, which keeps the cost near ten nanoseconds a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_RNG = np.random.RandomState(20240607)
_BYTE = _RNG.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _ODD), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = (1 << 20) - 1):
    """Yield ``(first, last, bytes, offsets)`` for runs of rows of about ``limit`` bytes.

    Nulls read as empty.  A single row longer than the limit makes a chunk of its own.
    """
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a chunk: ``start``/``end`` byte positions, ``hash`` and ``first`` word of each row (plus the total)."""

    __slots__ = ("start", "end", "hash", "first", "data", "_cum")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True):
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        word = ~separators[data]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            before &= ~head[:-1]
            after[-1] = False
            after[:-1] = word[1:]
            after &= ~head[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        up, _ = _powers(n + 1)
        cum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=cum[1:])
        self._cum = cum
        self.hash = self.span(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of arbitrary byte spans, independent of where the span lies."""
        _, down = _powers(len(self._cum))
        return mix((self._cum[end] - self._cum[start]) * down[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; only positions with ``n`` words left in the array are given."""
        return gram_hashes(self.hash, n)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= _ODD
        out += h[k : k + m]
    return mix(out)
