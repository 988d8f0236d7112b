"""Vectorised byte kernels that run inside Arrow tasks.

A slice of an Arrow string column is one byte buffer with row offsets. Words are maximal runs of
bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never uses these bytes inside a longer character, so the
byte view and the code-point view agree. Work is cut into slices of about ``SLICE_BYTES`` so that
temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATORS = b" \t\n\x0b\x0c\r"

_rng = np.random.Generator(np.random.PCG64(20240607))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = int(_rng.integers(1, 2**63)) | 1
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MIN_SEED = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MIN_MULT = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Slice:
    """Rows ``first .. first + len(offsets) - 2`` of a batch; null rows are empty."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive row ranges of a string column, each of about ``limit`` bytes (a longer row stands alone)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield Slice(row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


@dataclass
class Words:
    """Words of a slice: byte spans, and per segment (a row, or a line) the range of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word index at which each segment begins; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return runs(_IS_WORD[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes that are ``inside``; none crosses an offset."""
    n = len(inside)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given spans of ``data`` (whole characters) as an Arrow string column."""
    sizes = end - start
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at]))


def word_hashes(data: np.ndarray, words: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by differences of a prefix polynomial over random byte values."""
    powers, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers[: len(data)], out=prefix[1:])
        span = (prefix[words.end] - prefix[words.start]) * inverse[words.start]
        return mix(span + (words.end - words.start).astype(np.uint64))


@dataclass
class Shingles:
    value: np.ndarray
    first: np.ndarray  # shingle index at which each segment begins; one more at the end


def shingle(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> Shingles:
    """Hashes of all windows of ``width`` words; a shorter, non-empty segment is one shingle as a whole."""
    counts = np.diff(first)
    n = len(hashes)
    with np.errstate(over="ignore"):
        full = np.full(max(n - width + 1, 0), width, np.uint64)
        for k in range(width):
            full += hashes[k : k + len(full)] * _SHINGLE[k]
        full = mix(full)
        many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        out_first = np.concatenate(([0], np.cumsum(many)))
        value = np.zeros(out_first[-1], np.uint64)
        within = np.arange(out_first[-1]) - np.repeat(out_first[:-1], many)
        at = np.repeat(first[:-1], many) + within
        long = np.repeat(counts >= width, many)
        value[long] = full[at[long]]
        for s in np.flatnonzero((counts > 0) & (counts < width)):
            w = hashes[first[s] : first[s + 1]]
            value[out_first[s]] = mix(np.array([(w * _SHINGLE[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    return Shingles(value, out_first)


def minhashes(shingles: Shingles, k: int) -> np.ndarray:
    """``k`` 32-bit minimum hashes of each segment; zeros for an empty one."""
    out = np.zeros((len(shingles.first) - 1, k), np.uint32)
    full = np.flatnonzero(np.diff(shingles.first))
    if len(full):
        at = shingles.first[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(k):
                v = ((shingles.value ^ _MIN_SEED[j]) * _MIN_MULT[j]) >> np.uint64(32)
                out[full, j] = np.minimum.reduceat(v.astype(np.uint32), at)
    return out


def distinct_sets(shingles: Shingles) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each segment's sorted distinct values, and a 128-bit name of the set as two 64-bit columns."""
    sets, a, b = [], np.zeros(len(shingles.first) - 1, np.uint64), np.zeros(len(shingles.first) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for s in range(len(a)):
            v = np.sort(shingles.value[shingles.first[s] : shingles.first[s + 1]])
            if len(v) > 1:
                v = v[np.concatenate(([True], v[1:] != v[:-1]))]
            sets.append(v)
            a[s] = (v * np.uint64(0x9E3779B97F4A7C15) ^ (v >> np.uint64(29))).sum()
            b[s] = np.bitwise_xor.reduce(v * _SHINGLE[7] + _SHINGLE[8]) if len(v) else 0
    return sets, a, b


def combine(columns: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key from the columns of a row-wise array of 32-bit values."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns), seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(columns.shape[1]):
            h = mix(h ^ columns[:, j].astype(np.uint64) * _SHINGLE[(j + 11) % 64])
    return h
