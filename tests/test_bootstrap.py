"""Bootstrap draws in blocks against a plain replay, and against what draws with replacement must give."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import bootstrap as B
from corvane.operators.order import numbered_within


def number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def replay(values, n, seed, block):
    """Means of the replicates, and how often each was drawn from."""
    means, size = [], len(values)
    for r in range(n):
        drawn = []
        if size <= block:
            drawn = [values[number(seed, r, i) % size] for i in range(size)]
        else:
            for b, times in Counter(number(seed, r, i) % size // block for i in range(size)).items():
                held = values[b * block : (b + 1) * block]
                drawn += [held[number(seed, r, i, b) % len(held)] for i in range(times)]
        assert len(drawn) == size
        means.append(sum(drawn) / size)
    return means


def table(spark, groups):
    return spark.createDataFrame([(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, pos long, value double").repartition(5)


def test_blocks_give_the_replayed_draws(spark):
    rng = random.Random(5)
    groups = {"hot": [rng.random() for _ in range(203)], "same": [rng.random() for _ in range(203)], "edge": [rng.random() for _ in range(32)], "next": [rng.random() for _ in range(33)], "one": [4.0]}
    got = {g: {} for g in groups}
    for row in B.replicates(table(spark, groups), ["g"], 30, 7, block=32).collect():
        got[row.g][row.r] = row["mean"]
    for g, vs in groups.items():
        assert [got[g][r] for r in range(30)] == pytest.approx(replay(vs, 30, 7, 32), abs=1e-12)


def test_blocks_spread_like_single_draws(spark):
    """Means of means and their variance are those of draws with replacement, whatever the block."""
    rng = random.Random(9)
    values = [rng.gauss(0, 1) + (3 if i > 300 else 0) for i in range(400)]
    mean = sum(values) / 400
    variance = sum((v - mean) ** 2 for v in values) / 400 / 400
    for block in (16, 1000):
        found = B.replicates(table(spark, {"a": values}), ["g"], 600, 1, block).agg(F.avg("mean").alias("m"), F.var_pop("mean").alias("v")).first()
        assert abs(found.m - mean) < 4 * (variance / 600) ** 0.5 and 0.8 < found.v / variance < 1.25


def test_no_values_no_intervals(spark):
    assert B.interval(table(spark, {"a": [1.0]}).limit(0), ["g"], 10).count() == 0
    row = B.interval(table(spark, {"a": [2.0, 2.0]}), ["g"], 10).first()
    assert (row["mean"], row.lo, row.hi, row.n) == (2.0, 2.0, 2.0, 2)


def test_values_are_shuffled_once_a_row_not_once_a_draw(spark):
    """Rows between the stages: the values and a block's sums, never the draws."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = B.replicates(table(spark, {"a": [1.0] * 100}), ["g"], 50, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    explosions = [line for line in plan.splitlines() if "Generate" in line]
    assert any("posexplode" in line for line in explosions)
    above = plan[: plan.index("posexplode")]
    assert above.count("Exchange") == 1 and above.count("partial_sum") == 1  # sums are added up in the task before they leave it


def test_places_within_groups(spark):
    rows = spark.createDataFrame([(g, i) for g in ("x", "y") for i in (5, 3, 9)] + [("z", 1)], "g string, i int").repartition(3)
    got = sorted((r.g, r.i, r.pos) for r in numbered_within(rows, ["g"], ["i"]).collect())
    assert got == [("x", 3, 0), ("x", 5, 1), ("x", 9, 2), ("y", 3, 0), ("y", 5, 1), ("y", 9, 2), ("z", 1, 0)]
