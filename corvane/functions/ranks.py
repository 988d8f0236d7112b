"""Rank statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, q: int) -> Column:
    """Nearest-rank percentile of an array: place round-half-even(q / 100 * n + 0.5), clamped to 1 .. n."""
    n = F.size(values)
    place = F.bround(F.lit(float(q)) / 100 * n + 0.5).cast("int")
    return F.get(F.array_sort(values), F.greatest(F.lit(1), F.least(n, place)) - 1)
