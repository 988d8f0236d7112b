"""The block-wise walk of BM25 against sums over all postings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import lexical as L
from corvane.operators.order import ranked


def every_score(item, term, part, query, asked, weight):
    out = {}
    for q, t, w in zip(query, asked, weight):
        for i, u, p in zip(item, term, part):
            if t == u:
                out[q, i] = out.get((q, i), 0.0) + w * p
    return {k: round(v, L.BM25_DIGITS) for k, v in out.items()}


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 9), st.integers(0, 60))
def test_walk_gives_the_best_of_all(seed, k, block, n):
    rng = random.Random(seed)
    item, term = ([rng.randrange(m) for _ in range(n)] for m in (25, 6))
    part = [rng.choice((0.5, 1.0, 1.5, rng.random())) for _ in range(n)]
    asked = [(q, t, rng.choice((0.1, 1.0, 5.0))) for q in range(4) for t in range(-1, 7) if rng.random() < 0.6]
    query, terms, weight = ([a[i] for a in asked] for i in range(3))
    walk = L.Walk.over(k, np.array(item, np.int64), np.array(term, np.int64), np.array(part, float), block)
    walk.run(np.array(query, np.int64), np.array(terms, np.int64), np.array(weight, float))
    want = every_score(item, term, part, query, terms, weight)
    for q in range(4):
        best = sorted((-s, i) for (p, i), s in want.items() if p == q)[:k]
        items, scores = walk.best.get(q, ([], []))
        assert [(i, pytest.approx(s, abs=1e-8)) for i, s in zip(items, scores)] == [(i, -s) for s, i in best]


def test_walk_leaves_most_postings_out():
    rng = np.random.default_rng(5)
    n_docs, block = 40_000, 1_000
    # one rare and telling term, two that nearly every document has
    rare = rng.choice(n_docs, 300, replace=False)
    item = np.concatenate((rare, np.arange(n_docs), np.arange(n_docs)))
    term = np.repeat([7, 8, 9], [300, n_docs, n_docs])
    part = np.concatenate((1 + rng.random(300), rng.random(2 * n_docs)))
    walk = L.Walk.over(10, item, term, part, block)
    walk.run(np.zeros(3, np.int64), np.array([7, 8, 9]), np.array([9.0, 0.2, 0.1]))
    assert walk.scored < 0.1 * len(item)
    sums = 9 * np.bincount(item[:300], part[:300], n_docs) + 0.2 * part[300 : 300 + n_docs] + 0.1 * part[300 + n_docs :]
    assert walk.best[0][0].tolist() == np.argsort(-sums)[:10].tolist()


def test_grid_of_cells_and_every_score_agree(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randrange(0, 40)))) for i in range(300)] + [(400, None), (401, "")], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(20)] + [(99, "unseen")], "id long, text string")
    for rows in (1 << 22, 500):
        monkeypatch.setattr(L, "SHARD_ROWS", rows)
        monkeypatch.setattr(L, "STRIP_ROWS", rows // 10)
        got = {(r.query_id, r["rank"]): (r.item_id, round(r.score, 8)) for r in L.bm25_ranking(asked, docs, 7, pad=False).collect()}
        want = {(r.query_id, r["rank"]): (r.item_id, round(r.score, 8)) for r in ranked(L.bm25_scores(asked, docs), 7).collect()}
        assert got == want and len(got) == 140


def test_words_may_be_given(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, None)], "id long, text string")
    given = docs.selectExpr("id", "split(text, ' ') AS words")
    asked = spark.createDataFrame([(1, "c b"), (2, None)], "id long, text string")
    rows = lambda d: sorted(map(tuple, L.bm25_ranking(asked, d, 5).collect()), key=str)
    assert rows(docs) == rows(given) and len(rows(docs)) == 6
