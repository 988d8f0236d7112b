"""Retrieval: exact dense search, reciprocal-rank fusion, and folding of finer hits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import md5_number
from corvane.operators.checks import in_order
from corvane.operators.lexical import bm25_ranking, bm25_scores
from corvane.operators.order import ranked
from corvane.operators.selection import quantiles

__all__ = ["bm25_ranking", "bm25_scores", "dense_topk", "finer_topk", "nearest_neighbour", "pair_spread", "peak_fold", "pool_size", "ranked", "rrf", "seeded_sample", "union_systems"]

SHARD, BLOCK, STRIP = 16_384, 8_192, 256
#: Fixed value: the constant of rank fusion.
RRF = 60
#: Scores are compared to so many decimals: below lies only the noise of the order of summation.
DENSE_DIGITS = 12


def _cell(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best index rows for every query of one (shard, block) cell: matrix products over strips of queries."""
    index, queries = rows[~rows["is_query"]], rows[rows["is_query"]]
    found = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "item_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]

    def unit(values: pd.Series) -> np.ndarray:
        m = np.stack(values.to_list()).astype(np.float64)
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)

    if len(index) and len(queries):
        ids, q_ids = index["id"].to_numpy(), queries["id"].to_numpy()
        every, asked = unit(index["vec"]), unit(queries["vec"])
        for at in range(0, len(q_ids), STRIP):
            own = q_ids[at : at + STRIP]
            scores = np.round(asked[at : at + STRIP] @ every.T, DENSE_DIGITS) + 0.0
            scores[own[:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
            q, i = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            order = np.lexsort((ids[i], -scores[q, i], q))
            q, i = q[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, i = q[place < k], i[place < k]
            found.append(pd.DataFrame({"query_id": own[q], "item_id": ids[i], "score": scores[q, i]}))
    return pd.concat(found)


def dense_topk(queries: DataFrame, index: DataFrame, k: int = 100, order: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, item_id, score)``: exact cosine top-k of ``(id, vec)`` tables, ties by id, a row never its own hit.

    A grid of bounded cells (index shard x query block): no side is broadcast or gathered whole, and
    per query only k rows of each shard meet in the final ranking. A row travels once for each block of
    the other side, which a cell's matrix product outweighs.

    With ``order(pos, id)`` the ranking itself fails if ``index(pos, id, vec)`` holds another id at a place, or
    more or fewer places: its ids, without the vectors, meet the order's in the same job.
    """
    shards, blocks = max(1, -(-index.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if order is not None:
        held = in_order(index.select("pos", "id"), order).agg(F.count("*").alias("_held"))  # one row
        index = index.crossJoin(F.broadcast(held)).where("_held >= 0")
    columns = (F.col("id").cast("long").alias("id"), "vec")
    left = index.where("vec is not null").select(place(shards).alias("shard"), every(blocks).alias("block"), *columns, F.lit(False).alias("is_query"))
    right = queries.where("vec is not null").select(every(shards).alias("shard"), place(blocks).alias("block"), *columns, F.lit(True).alias("is_query"))
    found = left.unionByName(right).groupBy("shard", "block").applyInPandas(lambda rows: _cell(rows, k), "query_id long, item_id long, score double")
    return ranked(found, k)


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF) -> DataFrame:
    """``(query_id, rank, item_id, score)`` by summed 1 / (k + rank), untruncated; ties as first met: dense order, then lexical.

    Queries are those of the dense ranking.
    """
    d = dense.select("query_id", "item_id", F.col("rank").alias("d"))
    lx = lexical.join(dense.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "item_id", F.col("rank").alias("l"))
    both = d.join(lx, ["query_id", "item_id"], "full")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("d") + part("l"), DENSE_DIGITS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("l")))
    return both.withColumn("rank", rank.cast("int")).select("query_id", "rank", "item_id", "score")


def pool_size(k: int, n: int) -> int:
    """How many finer items to rank before they are folded: 50 or k, whichever is more, but no more than there are."""
    return min(max(50, k), n)


def finer_topk(queries: DataFrame, items: DataFrame, parent: DataFrame, k: int = 5) -> DataFrame:
    """Search over finer items ``(id, vec)``, folded to their parents: see :func:`pool_size` and :func:`peak_fold`."""
    return peak_fold(dense_topk(queries, items, pool_size(k, items.count())), parent, k)


def peak_fold(pool: DataFrame, parent: DataFrame, k: int = 5) -> DataFrame:
    """Folds a ranking of finer items to their parents ``(item_id, parent_id)``: peak score, its item, and hits in the pool.

    Ties go to the parent met first in the pool. May give fewer than k parents.
    """
    joined = pool.join(parent, "item_id")
    folded = joined.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"), F.min_by("item_id", "rank").alias("best_item"), F.count("*").alias("n_hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank"))
    return folded.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "parent_id", "score", "best_item", "n_hits")


def nearest_neighbour(vectors: DataFrame) -> DataFrame:
    return dense_topk(vectors, vectors, 1)


def seeded_sample(vectors: DataFrame, sample: int = 2000, seed: int = 0) -> DataFrame:
    """``sample`` rows of ``(id, vec)`` by the hash of seed and id."""
    order = md5_number(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    return vectors.where("vec is not null").orderBy(order, "id").limit(sample)


def pair_spread(vectors: DataFrame, sample: int = 2000, seed: int = 0) -> DataFrame:
    """``(p01, p50, p99, n_pairs)`` of the cosines of a seeded sample of ``(id, vec)`` with all other vectors.

    The sample (its size is the feature) goes to all tasks; its cosines with each batch are counted there,
    never stored: see :mod:`corvane.operators.selection`.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    chosen = seeded_sample(vectors, sample, seed).toArrow()
    shape = lambda column, n: column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
    own = (chosen["id"].to_numpy(), unit(shape(chosen["vec"].combine_chunks(), len(chosen)))) if len(chosen) else (np.zeros(0, np.int64), np.zeros((0, 1)))
    shared = spark.sparkContext.broadcast(own)

    def cosines(batch: pa.RecordBatch) -> np.ndarray:
        ids, m = shared.value
        if not len(batch) or not len(ids):
            return np.zeros(0)
        found = np.round(unit(shape(batch.column("vec"), len(batch))) @ m.T, DENSE_DIGITS)
        return found[batch.column("id").to_numpy()[:, None] != ids[None, :]]

    n, (p01, p50, p99) = quantiles(vectors, cosines, [0.01, 0.5, 0.99])
    return spark.createDataFrame([(p01, p50, p99, n)], "p01 double, p50 double, p99 double, n_pairs long")


def union_systems(systems: dict[str, DataFrame]) -> DataFrame:
    named = [df.select(F.lit(name).alias("system"), "query_id", "rank", "item_id", "score") for name, df in systems.items()]
    return reduce(DataFrame.unionByName, named)
