"""Evaluation: per-query metrics, leaderboards, bootstrap intervals, comparisons and breakdowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.bootstrap import interval
from corvane.operators.order import numbered_within
from corvane.operators.retrieval import RRF
from corvane.storage import workspace

#: Ranks at which recall is taken.
CUTS = (1, 3, 5, 10, 20, 50, 100)
#: Ranks whose recall has a table of its own beside the primary metric.
REPORTED = (1, 5, 10, 50)
METRICS = (*(f"recall_{k}" for k in CUTS), "mrr_10", "ndcg_10")


def metrics(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall at the cuts, MRR@10 and nDCG@10 of every query ranked by a system and judged (``qrels(query_id, item_id)``), unrounded."""
    gold = qrels.dropDuplicates(["query_id", "item_id"])
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return scored(ranking.join(gold.withColumn("rel", F.lit(1)), ["query_id", "item_id"], "left"), sizes)


def scored(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from ``hits(system, query_id, rank, rel)`` and the number of relevant items ``sizes(query_id, n_gold)``, however relevance is told."""
    rows = hits.join(sizes, "query_id")
    rel, rank = F.coalesce("rel", F.lit(0)), F.col("rank")
    found = [F.sum(F.when(rank <= k, rel).otherwise(0)).alias(f"h{k}") for k in CUTS]
    gain = F.sum(F.when(rank <= 10, rel / F.log2(rank + 1.0)).otherwise(0.0)).alias("gain")
    first = F.min(F.when((rel == 1) & (rank <= 10), rank)).alias("first")
    out = rows.groupBy("system", "query_id", "n_gold").agg(*found, gain, first)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    recalls = [(F.col(f"h{k}") / F.col("n_gold")).alias(f"recall_{k}") for k in CUTS]
    return out.select("system", "query_id", *recalls, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_10"), (F.col("gain") / ideal).alias("ndcg_10"))


def numpy_interval(values: DataFrame, keys: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """The same with numpy's PCG64 draws, for exact agreement with numpy-based reports.

    numpy draws one sequence per group, so a group is one task: it holds eight bytes for each judged query
    of a system, and one replicate at a time. Beyond that use :func:`interval`.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("pos")["value"].to_numpy()
        rng = np.random.default_rng(seed)
        lo, hi = np.percentile([v[rng.integers(0, len(v), len(v))].mean() for _ in range(n)], [2.5, 97.5])
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), v.mean(), lo, hi]], columns=[*keys, "mean", "lo", "hi"])

    kinds = dict(values.dtypes)
    return values.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mean double, lo double, hi double")


def leaderboard(values: DataFrame, selected: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """``(place, system, mean, lo, hi, n_selected, n_scored)`` of ``values(system, query_id, value)``, best first by (mean, name).

    ``selected(query_id)`` are the queries of the report: a system shows how many there are and how many
    of them it has a value for. One without any value is left out. Few rows: one for each system.
    """
    return leaderboards(values, selected, ["value"], n, seed).drop("metric").orderBy("place")


def leaderboards(values: DataFrame, selected: DataFrame, metrics: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """``(metric, place, ...)``: the :func:`leaderboard` of each of ``metrics``, columns of ``values(system, query_id, ...)``.

    Every metric has the table that it would have alone, but values are read, ordered and drawn from once
    for all. A system without a value (null) has no row in that metric's table.
    """
    chosen = selected.select("query_id").distinct()
    rows = values.join(chosen, "query_id", "left_semi").unpivot(["system", "query_id"], metrics, "metric", "value").where("value is not null")
    with workspace(values.sparkSession) as held:
        placed = numbered_within(rows, ["metric", "system"], ["query_id"])
        found = held.keep(interval(placed.select("metric", "system", "pos", "value"), ["metric", "system"], n, seed))
    found = found.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("n_selected"))))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), F.desc("system")))
    columns = ("metric", place.alias("place"), "system", "mean", "lo", "hi", "n_selected", F.col("n").alias("n_scored"))
    return found.select(*columns).orderBy("metric", "place")


def best_system(values: DataFrame, but: str = "hybrid") -> DataFrame:
    """``(system)``: the one of the largest mean, ties to the larger name; fusions (named ``hybrid...``) are not eligible."""
    means = values.where(~F.startswith("system", F.lit(but))).groupBy("system").agg(F.avg("value").alias("m"))
    return means.orderBy(F.desc("m"), F.desc("system")).limit(1).select("system")


def robustness(values: DataFrame, variants: DataFrame) -> DataFrame:
    """``(system, variant, mean, delta_pct, n_queries)``: a metric per query form, and its change against the originals in per cent.

    ``values(system, query_id, value)``; ``variants(query_id, variant)`` has ``orig`` among its forms. The
    change is null where the system has no original, or a mean of zero. Systems come by falling original mean.
    """
    means = values.join(variants.select("query_id", "variant"), "query_id").groupBy("system", "variant").agg(F.avg("value").alias("mean"), F.count("*").alias("n_queries"))
    base = means.where("variant = 'orig'").select("system", F.col("mean").alias("base"))
    rows = means.join(base, "system", "left").withColumn("delta_pct", 100 * (F.try_divide("mean", "base") - 1))
    return rows.orderBy(F.desc_nulls_last("base"), "system", "variant").select("system", "variant", "mean", "delta_pct", "n_queries")


def breakdown(values: DataFrame, segments: DataFrame, metrics: list[str]) -> DataFrame:
    """``(segment, system, <mean of each metric>, n_queries)``: ``values`` by the segment ``(query_id, segment)`` of their query."""
    rows = values.join(segments.select("query_id", "segment"), "query_id")
    return rows.groupBy("segment", "system").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n_queries"))


def hybrids(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """A fused system ``hybrid(<name>+bm25)`` for each system of ``dense(system, query_id, rank, item_id, score)``."""
    d = dense.select("system", "query_id", "item_id", F.col("rank").alias("d"))
    lx = dense.select("system", "query_id").distinct().join(lexical.select("query_id", "item_id", F.col("rank").alias("l")), "query_id")
    both = d.join(lx, ["system", "query_id", "item_id"], "full")
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("d") + part("l"), 12))
    rank = F.row_number().over(Window.partitionBy("system", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("l")))
    return both.select(F.concat(F.lit("hybrid("), "system", F.lit("+bm25)")).alias("system"), "query_id", rank.cast("int").alias("rank"), "item_id", "score")


def paired(values: DataFrame, best: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Each system against the best on their common queries: interval of the mean difference and a verdict.

    ``values(system, query_id, value)``; ``best(system)`` has one row.
    """
    top = values.join(F.broadcast(best), "system").select("query_id", F.col("system").alias("best"), F.col("value").alias("top"))
    rows = values.join(top, "query_id").where("system <> best").select("system", "best", "query_id", (F.col("top") - F.col("value")).alias("value"))
    with workspace(values.sparkSession) as held:
        rows = numbered_within(rows, ["system", "best"], ["query_id"])
        found = held.keep(interval(rows.select("system", "best", "pos", "value"), ["system", "best"], n, seed))
    return found.select("system", "best", F.col("mean").alias("diff"), "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))
