"""Vector functions as column expressions; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def parts(v: Column, width: int = 512) -> Column:
    """The vector as JSON arrays of ``width`` numbers."""
    last = F.floor((F.size(v) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.to_json(F.slice(v, i * width + 1, width)))
