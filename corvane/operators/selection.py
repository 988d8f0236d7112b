"""Exact order statistics of values that are never stored: count, narrow, count again.

Doubles are read as 64-bit numbers of the same order. A round counts, for each place that is asked for, the
values that share its known leading bits by their next ``STEP`` bits; the bucket that holds the place adds
them to the known ones. After ``64 / STEP`` passes over the source the values are known exactly. Nothing is
sorted, frequent values are harmless, and what reaches the driver is one histogram for each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 16
_SIGN = np.uint64(1 << 63)


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def unordered(number: int) -> float:
    bits = np.array([number], np.uint64)
    return float(np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)[0])


def _histograms(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], np.ndarray], known: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(known), 1 << STEP), np.int64)
    for batch in batches:
        v = ordered(np.asarray(values(batch), np.float64))
        head, rest = (v >> np.uint64(64 - bits) if bits else np.zeros(len(v), np.uint64)), (v >> np.uint64(64 - bits - STEP)) & np.uint64((1 << STEP) - 1)
        for k, prefix in enumerate(known):
            counts[k] += np.bincount(rest[head == np.uint64(prefix)].astype(np.int64), minlength=1 << STEP)
    k, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(counts[k, bucket])], ["k", "bucket", "n"])


def at_places(source: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], places: Callable[[int], list[int]]) -> tuple[int, list[float]]:
    """The number of values that ``values`` makes of the batches of ``source`` (no NaN among them), and those at the given places (from 0) of their order.

    ``source`` is read once for each round: it should be a table. No values: no places are asked.
    """
    n, wanted, known, rank = None, [0], [0], [0]
    for bits in range(0, 64, STEP):
        prefixes = sorted(set(known))
        rows = source.mapInArrow(lambda it: _histograms(it, values, prefixes, bits), "k long, bucket long, n long")  # noqa: B023 (planned and run within the round)
        found = np.zeros((len(prefixes), 1 << STEP), np.int64)
        for r in rows.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            found[r["k"], r["bucket"]] = r["n"]
        if n is None:
            n = int(found.sum())
            if not n:
                return 0, []
            wanted = places(n)
            known, rank, prefixes = [0] * len(wanted), list(wanted), [0]
        for i, prefix in enumerate(known):
            below = np.cumsum(found[prefixes.index(prefix)])
            bucket = int(np.searchsorted(below, rank[i], "right"))
            rank[i] -= int(below[bucket - 1]) if bucket else 0
            known[i] = prefix << STEP | bucket
    return n, [unordered(x) for x in known]


def quantiles(source: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], shares: list[float]) -> tuple[int, list[float | None]]:
    """Quantiles that interpolate between the two neighbouring values; None if there are no values."""
    at = lambda n: [(n - 1) * q for q in shares]
    n, found = at_places(source, values, lambda n: [int(f(x)) for x in at(n) for f in (np.floor, np.ceil)])
    if not n:
        return 0, [None] * len(shares)
    return n, [float(low + (high - low) * (x - np.floor(x))) for x, low, high in zip(at(n), found[::2], found[1::2])]
