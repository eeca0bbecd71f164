"""Words and word hashes of whole Arrow columns of text, without a Python step per word.

A text's bytes are looked at in numpy: a table says which bytes belong to words, word
bounds are where that changes, and a word's 64-bit hash is a sum over its bytes of a
random value per byte times an odd power per place, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\r\x0b\x0c"
#: 1 for bytes of words; bytes of multi-byte characters are always part of one.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[list(SPACES)] = False
#: Words of letters, digits and non-ASCII characters only.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(256, _BASE, np.uint64))
#: Bytes of text that are looked at together; one longer text stands alone.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte bounds in ``data``, hashes, and each text's word range."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has words first[i]:first[i + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of a single row."""
    offsets = _buffers(texts)[1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets.astype(np.int64)


def words(texts: pa.Array, inside: np.ndarray = BLANK_SPLIT, lower: bool = True) -> Words:
    """Words of ``texts`` (null: none)."""
    raw, offsets = _buffers(texts)
    data = raw[offsets[0] : offsets[-1]] if len(offsets) > 1 else raw[:0]
    offsets = offsets - offsets[0]
    data = LOWER[data] if lower else data
    mask = inside[data]
    begins, ends = mask.copy(), mask.copy()
    if len(data):
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = mask[cuts]
        ends[cuts - 1] = mask[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, span_hashes(data, start, end, mask), np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the spans are all of ``mask``, in order."""
    global _powers
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    if (most := int(size.max())) > len(_powers):
        _powers = np.cumprod(np.full(most, _BASE, np.uint64))
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    part = _VALUE[data[mask]]
    part *= _powers[place]
    return mix(np.add.reduceat(part, at) + size.astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and each text's range in them. A text of fewer
    words has its whole sequence as one shingle, a text without words none."""
    n = np.diff(words.first)
    h = words.hash
    total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * _powers[j]
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], np.uint64)
    at = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    full = np.repeat(n >= k, count)
    out[full] = total[at[full]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[words.first[i] : words.first[i + 1]]
        out[first[i]] = (own * _powers[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), first
