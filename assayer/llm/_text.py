"""Words, shingles and hashes of whole Arrow batches of texts, in numpy.

A batch is cut in runs of rows of about ``CHUNK`` bytes, so that the working
arrays stay small whatever the size of a batch; a single longer text makes a
run of its own.  Words are maximal runs of bytes other than space and
``\\t \\n \\v \\f \\r`` and only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: All ASCII characters but letters and digits.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (or of its inverse) modulo 2^64."""
    have = _powers[sign]
    if len(have) < n:
        size = max(n, 2 * len(have))
        steps = np.full(size, _BASE if sign > 0 else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK:
            _powers[sign] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * int(_ODD) + int(_ODD)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix_parts(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``mix`` with a seed for each number."""
    with np.errstate(over="ignore"):
        return mix(x + seeds.astype(np.uint64) * _ODD)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``hashes_from`` gets the hash of any segment of ``values``."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(1, len(values)), out=sums[1:])
        return sums


def hashes_from(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        hashed = (sums[ends] - sums[starts]) * _power(-1, len(sums))[starts]
        return mix(hashed + (ends - starts).astype(np.uint64) * _ODD)


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, all at once."""
    return hashes_from(prefix_sums(values), starts, ends)


def runs(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, upto
        at = upto


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each starts (null: empty)."""
    big = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = big.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~between[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = True
    starts = np.flatnonzero(word & first)
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~word[1:]
    last[inner - 1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    return segment_hashes(lower_values(raw), starts, ends)


def lower_values(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles in text order, and where each row's begin.

    A row with fewer words, but some, has its whole sequence as its one shingle.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begins = np.concatenate(([0], np.cumsum(count)))
    if not begins[-1]:
        return np.zeros(0, np.uint64), begins
    with np.errstate(over="ignore"):
        padded = np.concatenate((words, np.zeros(k, np.uint64)))
        total = np.zeros(len(words), np.uint64)
        for j in range(k):
            total += padded[j : j + len(words)] * _power(1, j + 2)[j + 1]
        at = np.arange(begins[-1]) + np.repeat(rows[:-1] - begins[:-1], count)
        out = mix(total[at], k)
        for r in np.flatnonzero((n > 0) & (n < k)):
            own = words[rows[r] : rows[r + 1]]
            out[begins[r]] = mix((own * _power(1, len(own) + 1)[1:]).sum(dtype=np.uint64, keepdims=True), len(own))[0]
    return out, begins


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for a, b in runs(texts):
        raw, offsets = buffer_of(texts.slice(a, b - a))
        starts, ends, rows = word_bounds(raw, offsets)
        found, begins = shingle_hashes(word_hashes(raw, starts, ends), rows, k)
        for r in range(b - a):
            yield a + r, np.unique(found[begins[r] : begins[r + 1]])


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array for each row."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
