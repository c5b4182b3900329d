"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; words never cross a document.
Texts are taken in blocks of bounded bytes, so memory follows the block or the longest text,
not the batch.  Hashes are 64-bit polynomial sums (odd base, random byte values) passed through
a finalising mixer, so they are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=U) * U(_BASE)) + U(seed))


_BYTES = stream(17, 256)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial sums of values[first..last], independent of where the run starts."""
    p, inverse = _power(len(values))
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * p, out=c[1:])
    return (c[last + 1] - c[first]) * inverse[first]


@dataclass
class Words:
    """The words of some texts: byte starts and ends in ``buf``, text number, hash."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def first(self) -> np.ndarray:
        """Where each text's words begin; one more entry than texts."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each position; the last k-1 positions are left out."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        at = np.arange(n)
        values = mix(self.hash + U(seed)) if seed else self.hash
        return mix(_sums(values, at, at + k - 1) + U(k + seed))

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first..last, which tells lengths apart."""
        return mix(_sums(self.hash, first, last) + (last - first + 1).astype(U))


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True


def split_words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, tails: bool = False) -> Words:
    """lower: A-Z hash as a-z.  tails: a point, comma or the like behind an ASCII letter or digit starts a new word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, offsets, none, none, none, np.zeros(0, U))
    space = _SPACE[buf]
    begins, ends = np.ones(n, bool), np.ones(n, bool)
    begins[1:], ends[:-1] = space[:-1], space[1:]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    if tails:
        at = np.flatnonzero(_TAIL[buf[1:]] & _ALNUM[buf[:-1]]) + 1
        begins[at] = ends[at - 1] = True
    start, end = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    h = np.zeros(0, U)
    if len(start):
        h = mix(_sums((_LOWER if lower else _BYTES)[buf], start, end - 1) + (end - start).astype(U))
    return Words(buf, offsets, start, end, text, h)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_blocks(texts: pa.Array, size: int = BLOCK, lower: bool = False, tails: bool = False) -> Iterator[tuple[int, int, Words]]:
    with np.errstate(over="ignore"):
        for lo, hi, buf, offsets in blocks(texts, size):
            yield lo, hi, split_words(buf, offsets, lower, tails)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def digit_order(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers below 2**32, by their 16-bit digits, which numpy sorts in linear time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if len(x) and high.max() else order


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes first[i] .. first[i]+count[i]-1, for all i in turn."""
    total = int(count.sum())
    step = np.ones(total, np.int64)
    full = count > 0
    f, c = first[full], count[full]
    if total:
        step[0] = f[0]
        at = np.cumsum(c)[:-1]
        step[at] = f[1:] - f[:-1] - c[:-1] + 1
    return np.cumsum(step)
