"""Exact top-k search against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corvane.llm import topk_search


def brute(rows, queries, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = list({(i, tuple(v)) for i, v in usable})
    out = []
    for q, qv in usable:
        if q in queries:
            scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # many ties
    rows += [(2000, None), (2001, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (None, [1.0] * 6), (2004, [0.9, 0.9]), (2005, []), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    out = topk_search.top_k(df, df.where("vec_id % 50 = 0"), shard=200, block=10, per_pivot=90)  # several rounds, cells and blocks
    assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, {r[0] for r in rows if r[0] is not None and r[0] % 50 == 0}, 5)
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert topk_search.top_k(few, few.where("vec_id = 0")).count() == 2


def test_clusters_are_not_scored_whole(spark):
    """Of well separated clusters a query computes a small part; of isotropic vectors about all."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    tight = centers[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.02
    for points, share in ((tight, 0.2), (rng.normal(size=(3000, 16)), 1.2)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
        out = topk_search.top_k(df, df.where("vec_id % 400 = 0"), per_pivot=500)
        rows = [(i, v.tolist()) for i, v in enumerate(points)]
        grid = np.floor(256 * points).astype(np.int64)
        for q in {r[0] for r in rows if r[0] % 400 == 0}:
            scores = grid @ grid[q]
            scores[q] = -(2**60)
            want = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:5]
            got = out.where(F.col("query_id") == q).orderBy("rank").collect() if q == 0 else None
            if got is not None:
                assert [(r.vec_id, r.score) for r in got] == [(i, int(scores[i])) for i in want]
        assert out.agg(F.avg("computed")).first()[0] < share * len(points)


def test_op8_against_its_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(260)] + [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [math.nan] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk_search.op8_exact_topk(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(topk_search.OP8_SQL)
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def test_pages_bounds_and_round_trip():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-256, 256, (3000, 8))
    vectors[:900] = vectors[0]
    ids = rng.permutation(3000)
    most = float((vectors**2).sum(1).max())
    root = topk_search.build(ids, vectors, most)
    tree = topk_search.from_pages(topk_search.page_rows(root))

    def walk(node, above):
        points = topk_search.extended(node.vectors, most) if node.ids is not None else np.concatenate([walk(c, node) for c in node.children])
        assert np.sqrt(((points - node.center) ** 2).sum(1)).max() <= node.radius + 1e-6
        if node.ids is not None:
            assert len(node.ids) <= topk_search.PAGE
        if above is not None:
            assert abs(np.sqrt(((node.center - above.center) ** 2).sum()) - node.up) < 1e-9
        return points

    assert len(walk(tree, None)) == 3000
    for q in (0, 1, 950, 2999):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
        assert topk_search.Search(tree, most).best(int(ids[q]), vectors[q], 5) == [(-s, i) for s, i in want]
        least = -want[4][0]
        assert topk_search.Search(tree, most).best(int(ids[q]), vectors[q], 5, least) == [(-s, i) for s, i in want]


def test_large_components_stay_exact(spark):
    vectors = np.array([[2**31, 1], [2**31, 2], [2**31, 3]], np.int64)
    root = topk_search.build(np.arange(3), vectors, float((vectors.astype(float) ** 2).sum(1).max()))
    assert topk_search.Search(root, 2.0**62 + 9).best(0, vectors[0], 2) == [(2**62 + 3, 2), (2**62 + 2, 1)]
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]
