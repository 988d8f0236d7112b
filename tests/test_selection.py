"""Order statistics by counting, hot values, and merged rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import order as O
from corvane.operators import reports as R
from corvane.operators import retrieval as X
from corvane.operators import selection as S


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_numbers_in_the_order_of_doubles(values):
    v = np.array(values) + 0.0
    numbers = S.ordered(v)
    assert np.array_equal(np.sort(v), v[np.argsort(numbers, kind="stable")])
    assert [S.unordered(int(x)) for x in numbers] == v.tolist()


def test_quantiles_of_values_that_are_made_in_tasks(spark):
    source = spark.range(0, 4000, 1, 5)
    made = lambda x: np.concatenate((np.sin(x.astype(float)) * 10.0 ** (x % 7 - 3), np.full(len(x), 0.25)))  # noqa: E731 (0.25 is half of all)
    n, found = S.quantiles(source, lambda batch: made(batch.column("id").to_numpy()), [0.0, 0.01, 0.5, 0.77, 1.0])
    want = np.quantile(made(np.arange(4000)), [0.0, 0.01, 0.5, 0.77, 1.0])
    assert n == 8000 and found == pytest.approx(want.tolist(), abs=0)
    assert S.quantiles(source.where("false"), lambda batch: made(batch.column("id").to_numpy()), [0.5]) == (0, [None])


def test_pair_spread_is_of_the_sample_with_all(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, vec array<double>")
    r = X.pair_spread(df, sample=7).first()
    own = [x.id for x in X.seeded_sample(df, 7).collect()]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = [u[i] @ u[j] for i in own for j in range(60) if i != j]
    assert r.n_pairs == len(c) == 7 * 59 and (r.p01, r.p50, r.p99) == pytest.approx(np.percentile(c, [1, 50, 99]).tolist(), abs=1e-9)
    assert X.pair_spread(df.where("false")).first().n_pairs == 0


def test_hot_values_and_groups(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' END AS k", "CASE WHEN id % 3 > 0 THEN 5 ELSE id END AS v")
    got = {r.k: (r.n, r.p1, r.p50, r.p99) for r in O.nearest_ranks(df, ["k"], "v", (1, 50, 99)).collect()}
    for k in ("hot", None):
        values = sorted(5 if i % 3 else i for i in range(3000) if (i % 10 < 9) == (k == "hot"))
        at = lambda q: values[max(1, min(len(values), round(q / 100 * len(values) + 0.5))) - 1]  # noqa: E731, B023
        assert got[k] == (len(values), at(1), at(50), at(99))
    whole = O.linear_quantiles(df.where("v = 5"), [], "v", {"m": 0.5}).first()
    assert (whole.n, whole.m) == (2000, 5)


def test_a_frequent_value_is_dealt_to_ranges(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("id", "CASE WHEN id % 100 = 0 THEN id ELSE 7 END AS v")
    placed = O.numbered(df, ["v"])
    assert sorted(r.pos for r in placed.collect()) == list(range(20_000))
    rows = placed.orderBy("pos").collect()
    assert all(a.v <= b.v for a, b in zip(rows, rows[1:]))


def test_merged_rows_keep_the_target_in_its_order(spark):
    schema = "model string, row_pos long, single boolean, value double"
    old = [("a", 1, False, 1.0), ("b", 2, False, 2.0), ("a", 3, True, 3.0), ("c", 4, True, 4.0), ("a", 5, False, 5.0), ("b", 6, False, 6.0)]
    new = [("z", 1, True, 10.0), ("a", 2, True, 11.0), ("y", 3, True, 12.0), ("a", 4, True, 13.0), ("b", 5, False, 14.0), ("z", 6, True, 15.0)]
    out = R.merged_single(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["model"])
    # a's last new row stands before its first row and replaces its single one; c and b stay; new groups follow as they came
    want = [("a", True, 13.0), ("a", False, 1.0), ("b", False, 2.0), ("c", True, 4.0), ("a", False, 5.0), ("b", False, 6.0), ("z", True, 15.0), ("y", True, 12.0)]
    assert [(r.model, r.single, r.value) for r in out.orderBy("pos").collect()] == want and math.isclose(out.count(), 8)
