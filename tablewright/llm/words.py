"""Words of Arrow text columns as numpy arrays of 64-bit hashes, without Python loops over words.

A word is a run of characters other than space and the control characters 9 to
13; these are single bytes in UTF-8, so the bytes are scanned as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_draw = np.random.default_rng(20240607)
#: A random 64-bit number for each byte, an odd base and its inverse; the same in every process.
_BYTE = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Factors by which shingles combine their words, by place.
PLACE = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same for a second hash that does not depend on the first: both together have 128 bits.
_BYTE_2 = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_2 = 0xD1342543DE82EF95
PLACE_2 = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _small_table(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 65,535 of a base, and of its 65,536th power."""
    base = np.uint64(base)
    low = np.full(1 << 16, base, np.uint64)
    low[0] = 1
    low = np.cumprod(low)
    high = np.full(1 << 16, low[-1:] * base, np.uint64)
    high[0] = 1
    return low, np.cumprod(high)


#: Of each of the two hashes: numbers of the bytes, powers of the base and of its inverse, and what a span's length counts.
_KINDS = [(b, _small_table(base), _small_table(pow(base, -1, 1 << 64)), place[63:]) for b, base, place in ((_BYTE, _BASE, PLACE), (_BYTE_2, _BASE_2, PLACE_2))]


def _powers_between(table: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> np.ndarray:
    """Powers ``start`` to ``stop`` - 1, for ``stop`` up to 2 ** 32."""
    low, high = table
    cuts = [start, *range((start >> 16) + 1 << 16, stop, 1 << 16), stop]
    return np.concatenate([low[a & 0xFFFF : (a & 0xFFFF) + b - a] * high[a >> 16] for a, b in zip(cuts, cuts[1:])])


def _powers_at(table: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    low, high = table
    return high[places >> 16] * low[places & 0xFFFF]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's bounds in them; a null text is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def prefix_hash(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """Running sums by which :func:`span_hash` hashes any span of the bytes; ``kind`` is the first or the second hash."""
    sums = np.zeros(len(data) + 1, np.uint64)
    numbers, (low, high), _, _ = _KINDS[kind]
    for k in range(0, len(data), 1 << 16):  # pieces that fit the processor's cache
        terms = numbers[data[k : k + (1 << 16)]]
        terms *= low[: len(terms)]
        terms *= high[k >> 16]
        terms[:1] += sums[k : k + 1]
        np.cumsum(terms, out=sums[k + 1 : k + 1 + len(terms)])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes, equal hash, wherever they are."""
    _, _, down, size = _KINDS[kind]
    return mix((sums[ends] - sums[starts]) * _powers_at(down, starts) + (ends - starts).astype(np.uint64) * size)


def rolling_hash(sums: np.ndarray, length: int, start: int, stop: int) -> np.ndarray:
    """:func:`span_hash` of the spans of one length that begin from ``start`` up to ``stop``."""
    _, _, down, size = _KINDS[0]
    return mix((sums[start + length : stop + length] - sums[start:stop]) * _powers_between(down, start, stop) + np.array([length], np.uint64) * size)


def distinct_pairs(first: np.ndarray, second: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers of 128 bits in two halves: the place of each distinct one with the smallest keys, and which of them each place has."""
    order = np.lexsort((*keys[::-1], second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


@dataclass
class Words:
    """The words of several texts: hashes, bytes from ``starts`` to ``ends`` of ``data``, and the bounds of each text's words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def second_hashes(self) -> np.ndarray:
        """The second hash of each word; of words as they are written."""
        return span_hash(prefix_hash(self.data, 1), self.starts, self.ends, 1)


def words_of(texts: pa.Array, fold: bool) -> Words:
    """``fold`` lower-cases A-Z before hashing."""
    data, limits = text_bytes(texts)
    seen = _FOLD[data] if fold else data
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    # A word also ends where its text ends.
    turns = inside[1:] != inside[:-1]
    begin, end = turns & inside[1:], turns & inside[:-1]
    cuts = limits[1:-1]
    cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    begin[cuts] = end[cuts] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    hashes = span_hash(prefix_hash(seen), starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, limits), data)


def shingle_hashes(hashes: np.ndarray, n: int, place: np.ndarray = PLACE) -> np.ndarray:
    """Hash of each n consecutive words (as if the texts were one); n - 1 fewer than words."""
    if len(hashes) < n:
        return hashes[:0]
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * place[k]
    return mix(total + np.uint64(n))
