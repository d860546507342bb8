"""Vectorised 64-bit hashes of the words, and of runs of words, of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import steps

#: Texts are taken apart into steps of about so many bytes.
STEP = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers = {b: np.ones(1, dtype=np.uint64) for b in (BASE, INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        some = np.full(max(n, STEP), base, dtype=np.uint64)
        some[0] = 1
        _powers[base] = np.cumprod(some)
    return _powers[base][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(BASE, len(values)))])


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the value sequences [begin, end), alike wherever they stand."""
    return mix((sums[end] - sums[begin]) * powers(INVERSE, len(sums))[begin] + (end - begin).astype(np.uint64))


class Words:
    """The words of several texts: data, begin and end bytes, the texts' first words (and the number of all), hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        full = ~BLANK[data]
        opens, closes = full.copy(), full.copy()
        opens[1:] &= ~full[:-1]
        closes[:-1] &= ~full[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = full[edges]
        closes[edges - 1] = full[edges - 1]
        self.data, self.begin, self.end = data, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hashes = range_hashes(prefix_sums(VALUE[data]), self.begin, self.end)
        self.sums = prefix_sums(self.hashes)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on; those near a text's end reach into the next text."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return range_hashes(self.sums, at, at + n)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, as they stand in the text."""
        return self.data[self.begin[a] : self.end[b - 1]].tobytes() if b > a else b""


def text_steps(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a column of texts with their words; null is the empty text."""
    texts = column.fill_null("").cast(pa.large_utf8())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    for a, b in steps(np.diff(offsets).tolist(), STEP):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
