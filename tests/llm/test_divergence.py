"""The source divergence audit against plain loops, and its twin."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import divergence, queries

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    """rows: (text, lang, source)"""
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    terms = [TERM.findall(t.translate(LOWER)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, total, own = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
        for (_, a, s), w in zip(rows, terms):
            if a == lang:
                docs.update(set(w))
                total.update(w)
                own[s].update(w)
        kept = {w for w, n in docs.items() if n >= least}
        share = lambda counts, n: {w: 1 + 10**9 * (counts[w] + 5) // (n + 5 * len(kept)) for w in kept}
        p = {s: share(c, sum(c[w] for w in kept)) for s, c in own.items()}
        q = share(total, sum(total[w] for w in kept))
        for s in own:
            pairs = [(-sum(abs(p[s][w] - p[b][w]) for w in kept), b.encode(), b) for b in own if b != s]
            best = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if own[s][w] > 0 and p[s][w] > q[w])
            out += [(lang, s, "pair", b, -v, k + 1) for k, (v, _, b) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(best[:most])]
    return sorted(out)


def odd_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdeÉéz\U0001f600" for b in "rstßA"] + ["zz", "ab", "aB", "x-y", " nb"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for k in range(260):
        s = rng.choice(("s0", "s0", "s0", "s1", "é2", None, ""))
        rng.shuffle(vocabulary) if k % 40 == 0 else None
        text = " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))
        rows.append((text, rng.choice(("en", "en", "fr", None)), s))
    rows += [(None, "en", "s0"), ("", "en", "only empty"), ("12 34 !", "de", "no letters"), ("one", "de", "b"), ("y " * 50_000, "en", "s1")]
    return rows + rows[:30]


@pytest.mark.parametrize("least,most", [(8, 5), (3, 50), (1000, 50)])
def test_against_loops(spark, least, most):
    rows = odd_rows()
    schema = "text string, lang string, source string, n long, item string, value int, total string, rank int"
    docs = spark.createDataFrame([(*r, 1, "i", 2, "t", 3) for r in rows], schema)
    assert sorted(map(tuple, divergence.source_divergence(docs, least, most).collect())) == brute(rows, least, most)
    assert divergence.source_divergence(docs.where("false"), least, most).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 9)), max_size=60), st.integers(1, 5), st.lists(st.integers(0, 60), max_size=3))
def test_skyband_keeps_who_few_dominate(points, most, cuts):
    n, total = (np.array([p[k] for p in points], np.int64) for k in (0, 1))
    edges = [0, *sorted(min(c, len(points)) for c in cuts), len(points)]
    band = divergence.Skyband(most)
    kept = np.concatenate([band.add(n[a:b], total[a:b]) for a, b in zip(edges, edges[1:])])
    want = [sum(n[j] >= n[i] and total[j] <= total[i] for j in range(i)) < most for i in range(len(points))]
    assert kept.tolist() == want


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        whole = rng.randrange(10, 9 * 10**15)
        count = rng.randrange(0, whole - 4)
        assert divergence.shares(np.array([count]), whole)[0] == 1 + 10**9 * (count + 5) // whole


def test_share_columns_are_exact(spark):
    rows = [(0, 10), (7, 8_999_999_999_999_999), (8_999_999_999_999_000, 8_999_999_999_999_999), (123_456_789, 987_654_321_987)]
    df = spark.createDataFrame(rows, "n long, whole long").select("n", "whole", divergence.share("n", "whole").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 5) // r.whole for r in df.collect())


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.QUERIES["op11_source_divergence"](spark, DATA)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(con.execute(divergence.OP11_SQL).fetchall())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source").collect()
    assert got == brute([tuple(r) for r in docs], 30, 50)
