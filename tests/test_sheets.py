"""Sheets of different headers, discovered inputs, stored versions, and checks that are part of a plan."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import checks as C
from corvane.operators import manifests as M
from corvane.operators import reports as R
from corvane.sources import sheets as S
from corvane.sources.versions import Conflict, Versions

KINDS = ({"question": ("question", "q"), "answer": ("answer",)}, {"chunk": "c.text"}, ("embedding",))


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿No, Question ,c.text embedding,Answer\n1,what is it that you ask,ignored text here,\"a long answer,\nin two lines\"\n2,short,,[not a text at all]\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("my C.TEXT,,Q\nchunk of text é,unnamed column text,\"another \"\"quoted\"\" question\"\n,,  \n", encoding="utf-8")
    for name in ("~$a.csv", "a.bak.csv"):
        (tmp_path / name).write_text("question\nnever read this text\n")
    (tmp_path / "empty.csv").write_text("question\n")
    rows = S.sheet_texts(S.read_sheets(spark, f"{tmp_path}/*.csv"), *KINDS).collect()
    assert sorted((r.sheet, r.row, r.column, r.kind, r.text) for r in rows) == [
        ("a", 1, 1, "question", "what is it that you ask"), ("a", 1, 3, "answer", "a long answer,\nin two lines"),
        ("b", 1, 0, "chunk", "chunk of text é"), ("b", 1, 2, "question", 'another "quoted" question'),
    ]
    with pytest.raises(Exception, match="more than 2 columns"):
        S.read_sheets(spark, f"{tmp_path}/a.csv", columns=2).collect()


def test_discovered_inputs(spark, tmp_path):
    rows = [{"chunk_id": f"d::{i}", "text": f" text é {i} "} for i in range(5)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "pairs.csv").write_text("﻿pair_id,text_a\np2,two\np1,one\n", encoding="utf-8")
    (tmp_path / "order.json").write_text(json.dumps(["d::3", "d::0"]))
    inputs = {
        "corpus": S.Input(f"{tmp_path}/corpus.jsonl", "doc", "chunk_id", "text", f"{tmp_path}/order.json"),
        "pairs": S.Input(f"{tmp_path}/pairs.csv", "query", "pair_id", "text_a"), "gone": S.Input(f"{tmp_path}/gone.jsonl", "doc", "id", "text"),
    }
    got = sorted((r.input, r.pos, r.kind, r.id, r.text) for r in S.discovered(spark, inputs).collect())
    assert got == [("corpus", 0, "doc", "d::3", "text é 3"), ("corpus", 1, "doc", "d::0", "text é 0"), ("pairs", 0, "query", "p1", "one"), ("pairs", 1, "query", "p2", "two")]
    (tmp_path / "order.json").write_text(json.dumps(["d::3", "missing"]))
    with pytest.raises(Exception, match="an id of the order without a row"):
        S.discovered(spark, inputs).collect()


def test_versions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "model string, mode string, n int")
    read = lambda v=None: sorted((r.ordinal, r.model, r.mode, r.n) for r in store.read(v).collect())
    store = Versions(spark, f"file://{tmp_path}/s", ["model", "mode"])
    assert store.read() is None
    store.upsert(rows(("b", "x", 1), ("a", "x", 2), ("a", None, 3), ("a", "x", 4)))
    assert read() == [(0, "a", None, 3), (1, "a", "x", 2), (1, "a", "x", 4), (2, "b", "x", 1)]
    folders = [c["folder"] for c in store.listed()]
    assert store.upsert(rows(("a", "x", 9), ("c", "x", 5))) == 2
    assert read() == [(0, "a", None, 3), (1, "b", "x", 1), (2, "a", "x", 9), (3, "c", "x", 5)]
    assert [c["folder"] for c in store.listed()][:2] == [folders[0], folders[2]]  # those that stay are not rewritten
    assert read(1)[-1] == (2, "b", "x", 1)  # an earlier version is still whole
    store.forget()
    assert read() == [(0, "a", None, 3), (1, "b", "x", 1), (2, "a", "x", 9), (3, "c", "x", 5)] and not (tmp_path / "s/version-1.json").exists()


def test_a_crash_between_data_and_list_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"{tmp_path}/s", ["model"])
    one = spark.createDataFrame([("a", 1)], "model string, n int")
    store.upsert(one)

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_list", crash)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(one.withColumn("n", F.lit(2)))
    assert [r.n for r in Versions(spark, f"{tmp_path}/s", ["model"]).read().collect()] == [1]
    monkeypatch.undo()
    assert store.upsert(one.withColumn("n", F.lit(3))) == 2 and store.read().first().n == 3
    with pytest.raises(Conflict):
        store._list(2, [])


def test_checks_within_the_plan(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, id string")
    assert C.in_order(df, df).count() == 3
    for other in ([(0, "a"), (1, "x"), (2, "c")], [(0, "a"), (1, "b")], [(0, "a"), (1, "b"), (2, "c"), (3, "d")]):
        with pytest.raises(Exception, match="are not in the same order|differ in number"):
            C.in_order(df, spark.createDataFrame(other, "pos long, id string")).collect()
    kept, seen = C.counted(df, "kept", late=F.col("pos") > 0)
    assert kept.where("id <> 'b'").count() == 2 and seen.get == {"rows": 3, "late": 2}
    a = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 1.0])], "pair_id string, vec array<double>")
    assert R.pair_cosines(a, a, complete=True).count() == 2
    with pytest.raises(Exception, match="one side lacks"):
        R.pair_cosines(a, a.where("pair_id = 'p'"), complete=True).collect()
    with pytest.raises(Exception, match="different sizes"):
        R.pair_cosines(a, a.selectExpr("pair_id", "slice(vec, 1, 1) AS vec")).collect()
    pairs = spark.createDataFrame([("p", "one "), ("q", "two")], "pair_id string, text string")
    outside = lambda *x: spark.createDataFrame(x, "pair_id string, seq int, score double, text string")
    good = R.with_external(pairs, outside(("p", 1, 0.5, "one"), ("p", 2, 0.7, None), ("zz", 1, 0.1, "?")), ("text",)).collect()
    assert {r.pair_id: r.score for r in good} == {"p": 0.7, "q": None}
    with pytest.raises(Exception, match="outside text"):
        R.with_external(pairs, outside(("q", 1, 0.5, "three")), ("text",)).collect()


def test_manifests_keep_all_their_values(spark):
    entry = f"map('instruct', map('corpus', CAST(NULL AS {M.ENTRY})))"
    old = spark.sql(f"SELECT 'm' AS model, 8 AS dim, 'h' AS hf_id, {entry} AS modes UNION ALL SELECT 'o', 4, 'i', {entry}")
    new = spark.sql(f"SELECT 'm' AS model, 9 AS dim, 1.5D AS load_seconds, {entry} AS modes")
    got = {r.model: (r.dim, r.hf_id, r.load_seconds) for r in M.merged_manifests(old, new).collect()}
    assert got == {"m": (9, None, 1.5), "o": (4, "i", None)}
