"""Hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.ranks import nearest_rank
from corvane.functions.text import abbreviate, containment, longest_common_ngram, looks_like_text, nfc, strip, strip_marks, tokens, typo
from corvane.operators import datasets as D
from corvane.operators import evaluation as E
from corvane.operators import reports as R
from corvane.operators import retrieval as X
from corvane.sources import tables as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def ranking(spark, *items, system="s", query=1):
    return spark.createDataFrame([(system, query, n + 1, i, 1.0 - n / 10) for n, i in enumerate(items)], "system string, query_id long, rank int, item_id long, score double")


@pytest.mark.parametrize("ranked,gold,recall1,recall3,mrr,ndcg", [((1, 2, 3), (2,), 0, 1, 0.5, 0.63093), ((1, 2, 3), (1, 3), 0.5, 1, 1, 0.91972), ((1,), (9,), 0, 0, 0, 0)])
def test_metrics(spark, ranked, gold, recall1, recall3, mrr, ndcg):
    qrels = spark.createDataFrame([(1, g) for g in gold], "query_id long, item_id long")
    r = E.metrics(ranking(spark, *ranked), qrels).first()
    assert (r.recall_1, r.recall_3, r.mrr_10) == (recall1, recall3, mrr) and abs(r.ndcg_10 - ndcg) < 1e-5


def test_bm25_pads_and_counts_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c")], "id long, text string")
    queries = spark.createDataFrame([(1, "c"), (2, "c c"), (3, "zzz")], "id long, text string")
    rows = {(r.query_id, r["rank"]): (r.item_id, round(r.score, 6)) for r in X.bm25_ranking(queries, docs, 10).collect()}
    assert rows[1, 1] == (2, 0.930399) and rows[1, 2] == (1, 0.0)
    assert rows[2, 1] == (2, 1.860797) or rows[2, 1] == (2, 1.860798)
    assert rows[3, 1] == (1, 0.0) and rows[3, 2] == (2, 0.0)


def test_rrf(spark):
    a, b = ranking(spark, 1, 2).drop("system"), ranking(spark, 2, 3).drop("system")
    rows = [(r.item_id, round(r.score, 6)) for r in X.rrf(a, b).orderBy("rank").collect()]
    assert rows == [(2, 0.032522), (1, 0.016393), (3, 0.016129)]
    assert [r.item_id for r in X.rrf(a, ranking(spark, 2, 1).drop("system")).orderBy("rank").collect()] == [1, 2]


def test_peak_fold(spark):
    pool = spark.createDataFrame([(1, 1, 11, 0.9), (1, 2, 21, 0.8), (1, 3, 12, 0.7)], "query_id long, rank int, item_id long, score double")
    parent = spark.createDataFrame([(11, 1), (12, 1), (21, 2)], "item_id long, parent_id long")
    rows = [(r.parent_id, r.score, r.best_item, r.n_hits) for r in X.peak_fold(pool, parent).orderBy("rank").collect()]
    assert rows == [(1, 0.9, 11, 2), (2, 0.8, 21, 1)]


@pytest.mark.parametrize("n,q,want", [(10, 50, 6), (10, 95, 10), (10, 99, 10), (100, 50, 50), (100, 95, 96), (100, 99, 100)])
def test_nearest_rank(spark, n, q, want):
    assert one(spark, x=nearest_rank(F.sequence(F.lit(1), F.lit(n)), q)).x == want


def test_overlap(spark):
    a, b, none = (tokens(F.lit(x)) for x in ("mot hai ba bon", "x hai ba y", ""))
    r = one(spark, c=containment(a, b), e=containment(none, b), n=longest_common_ngram(a, b), z=longest_common_ngram(a, none))
    assert (r.c, r.e, r.n, r.z) == (0.5, 1.0, 2, 0)


def test_text_functions(spark):
    r = one(spark, a=abbreviate(F.lit("Không biết như thế nào")), p=strip_marks(F.lit("Đàö không biết như thế nào, được Łódź ñ")), m=strip_marks(F.lit("Đặng ký")), n=nfc(F.lit(" é ")), s=strip(F.lit(" x ")),
            t=typo(F.lit("alpha  beta gamma"), F.lit("7")), y=looks_like_text(F.lit("plain words here")), j=looks_like_text(F.lit('["a", "b", "c"]')))
    assert (r.a, r.p, r.m, r.n, r.s, r.y, r.j) == ("ko biết ntn", "Dao khong biet nhu the nao, duoc Łodz n", "Dang ky", "é", "x", True, False)
    assert sorted(r.t.replace(" ", "")) == sorted("alphabetagamma") and r.t != "alpha beta gamma"


def test_prefixes(spark):
    rows = [("a", 0, 3, "p"), ("a", 1, 4, "q"), ("a", 2, 5, "r"), ("b", 0, 3, "p"), ("b", 1, 8, "q")]
    out = D.document_prefixes(spark.createDataFrame(rows, "doc string, idx int, n_tokens long, text string"), 6, 10).collect()
    assert [(r.doc, r.n_chunks, r.n_tokens, r.text) for r in out] == [("a", 2, 7, "p\n\nq")]


def test_fact_pool_and_lines(spark):
    rows = [("x" * 40, "asserted", None, None), ("x" * 39, "asserted", None, None), ("x" * 40, "asserted", "negative", None), ("x" * 40, "asserted", None, True), ("x" * 40, "open", None, None)]
    assert D.fact_pool(spark.createDataFrame(rows, "text string, certainty string, polarity string, conflict boolean")).count() == 1
    block = spark.createDataFrame([("20::0", "1. Foo\n   [t]\n\n2. Bar \n2x. no")], "chunk_id string, block string")
    lines = D.fact_lines(block)
    assert [(r.key, r.k, r.text) for r in lines.orderBy("k").collect()] == [("20::0#k1", 1, "Foo"), ("20::0#k2", 2, "Bar")]
    listed = spark.createDataFrame([("20::0", 1, "f1", "Foo"), ("20::0", 5, "f2", "Bar")], "chunk_id string, k int, fact_id string, text string")
    assert {r.k: r.fact_id for r in D.with_fact_ids(lines, listed).collect()} == {1: "f1", 2: "f2"}


def test_diagnostics(spark):
    t = R.SHORT
    rows = [("m", t["t1"], 0.9), ("m", t["t1"], 0.8), ("m", t["t2"], 0.7), ("m", t["t3"], 0.5), ("m", t["t4"], 0.1), ("m", t["t4"], math.nan)]
    r = R.diagnostics(spark.createDataFrame(rows, "system string, tier string, score double")).first()
    assert (r.gap_12, r.gap_14, r.ok_t2_t3, r.ok_t3_t4, r.ok_t5_t2, r.ladder, r.spread, r.gap_pct, r.warning) == (0.15, 0.75, True, True, None, True, 0.8, 18.75, False)


def test_rotation_and_oom(spark):
    assert [r.pos for r in D.rotating_batches(5, 2, 3, spark).where("run = 2").orderBy("i").collect()] == [4, 0]
    rows = [("m", b, "OOM" if b == 16 else "ok") for b in (1, 4, 16, 32, 64)]
    out = R.oom_propagated(spark.createDataFrame(rows, "model string, batch_size int, status string"), ["model"])
    assert {r.batch_size: r.status for r in out.collect()} == {1: "ok", 4: "ok", 16: "OOM", 32: "OOM", 64: "OOM"}


def test_round_robin_is_balanced(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 39, "short") for i in range(200)]
    out = D.round_robin(spark.createDataFrame(rows, "id long, source string, n_tokens long, length_group string"), 32).toPandas()
    sizes = out.groupby(["bin", "source"]).size()
    assert len(out) == 32 and sizes.max() - sizes.min() <= 1


def test_numpy_interval(spark):
    v = np.arange(20) / 20
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "system string, pos long, value double")
    r = E.numpy_interval(df, ["system"]).first()
    draws = np.random.default_rng(0).integers(0, 20, (1000, 20))
    lo, hi = np.percentile(v[draws].mean(1), [2.5, 97.5])
    assert np.allclose((r["mean"], r.lo, r.hi), (v.mean(), lo, hi))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("q1", "c1"), ("q1", "c2")], "query_id string, item_id string")
    S.write_qrels(df, f"{tmp_path}/q")
    assert sorted(S.read_qrels(spark, f"{tmp_path}/q").collect()) == sorted(df.collect())
    S.write_jsonl(df, f"{tmp_path}/j")
    assert S.read_jsonl(spark, f"{tmp_path}/j", "query_id string, item_id string").count() == 2
    (tmp_path / "c.csv").write_text('﻿id,text\n1,"a\nb"\n', encoding="utf-8")
    assert [tuple(r) for r in S.read_csv(spark, f"{tmp_path}/c.csv").collect()] == [("1", "a\nb")]
    (tmp_path / "ids.json").write_text('["x", "y"]')
    assert [tuple(r) for r in S.read_json_ids(spark, f"{tmp_path}/ids.json").collect()] == [(0, "x"), (1, "y")]
    sheet = spark.createDataFrame([(1, "t")], "` Doc_ID ` int, `all (f.text)` string")
    assert S.read_rows_with_header(sheet, {"doc": "doc_id"}, {"text": "f.text"}).columns == ["doc", "text"]
