"""Connected components of a link table: random star contraction, then one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import few, workspace, written

LAST_LINKS = 100_000


def joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, root)`` of every vertex of the links ``(a, b)`` of this task, by union-find."""
    pairs = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1) for b in batches if b.num_rows]
    ids, ends = np.unique(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ends.reshape(-1, 2).tolist():
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    roots = ids[np.array([root(x) for x in range(len(ids))], np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], ["id", "root"])


def components(links: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """``(id, label)`` for every vertex of ``links(a, b)``; ``label`` is the component's smallest id.

    While more than ``last`` links are left, a round sends every vertex to the neighbour (or itself) of
    smallest random priority and contracts the links, so that their number falls by a constant
    factor in expectation whatever the shape, long chains and hubs alike. The rest fits one
    task. The driver sees only a count per round. An empty table gives an empty result.
    """
    with workspace(links.sparkSession) as held:
        current = written(links.select("a", "b").where("a <> b").distinct(), "links", narrow=True)
        assigned = None
        for turn in range(100):
            if current.count() <= last:
                break
            both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("v"))
            stars = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["v"].alias("root"))
            stars = written(stars, "stars", narrow=True)
            moved = few(stars)
            assigned = _followed(assigned, stars.select(F.col("a").alias("id"), "root"))
            current = (
                current.join(moved.select("a", F.col("root").alias("ra")), "a")
                .join(moved.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b")
                .where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                .distinct()
            )
            current = written(current, "links", narrow=True)
        rest = current.coalesce(1).mapInArrow(joined_rows, "id long, root long")
        if assigned is None:  # roots are the smallest ids already
            return held.keep(written(rest.select("id", F.col("root").alias("label")), "labels"))
        assigned = _followed(assigned, written(rest, "roots"))
        names = assigned.groupBy("root").agg(F.min("id").alias("label"))
        return held.keep(written(assigned.join(names, "root").select("id", "label"), "labels", narrow=True))


def _followed(assigned: DataFrame | None, step: DataFrame) -> DataFrame:
    if assigned is None:
        return step
    assigned = assigned.join(few(step).select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
    return assigned.select("id", F.coalesce("next", "root").alias("root"))
