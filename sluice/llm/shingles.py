"""Vectorised word and shingle hashing over batches of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z in lower case.  A word's hash
is its polynomial in a fixed odd base, read off prefix sums over the batch, then mixed;
a shingle's is a mixed combination of five consecutive word hashes.  All arithmetic is
modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the last steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(1 << 21, n + 1)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of about ``limit`` bytes of whole texts.

    Yields the first row, the bytes, and the texts' offsets in them (one more than texts).
    Null texts are empty.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and bounds[-1] else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[data]
    solid = ~_BLANK[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their offsets by text.

    A text of one to four words has one shingle, its whole sequence.
    """
    words, first = word_hashes(data, bounds)
    counts = np.diff(first)
    texts = np.repeat(np.arange(len(counts)), counts)
    m = len(words)
    if not m:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    combined = np.zeros(m, dtype=np.uint64)
    left = first[1:][texts] - np.arange(m)  # words of the text from here on
    for k in range(min(WORDS, m)):
        part = words[k:] * _MULTIPLIERS[k]
        part[left[: m - k] <= k] = 0
        combined[: m - k] += part
    keep = (left >= WORDS) | ((counts[texts] < WORDS) & (left == counts[texts]))
    s = mix(combined[keep] + np.minimum(left[keep], WORDS).astype(np.uint64))
    t = texts[keep]
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    s, t = s[new], t[new]
    return s, np.searchsorted(t, np.arange(len(bounds)))
