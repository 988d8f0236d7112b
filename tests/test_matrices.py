"""Matrices of vectors: row ranges, ids, and commits that happen whole or not at all."""

import json
import os

import numpy as np
import pytest

from corvane.operators.retrieval import dense_topk
from corvane.sources import matrices as M


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "m")


def rows_of(df):
    return sorted((r.row, r.id, tuple(r.vec)) for r in df.collect())


def test_round_trip_in_ranges(spark, folder, monkeypatch):
    df = spark.range(0, 1000, 1, 3).selectExpr("id", "array(float(id), float(id) / 2, float(-1)) AS vec")
    M.write_matrix(df, folder)
    for size in (M.RANGE_BYTES, 100):
        back = M.read_matrix(spark, folder, range_bytes=size)
        assert back.rdd.getNumPartitions() == (3 if size > 100 else 2 * 42 + 42)  # eight rows of twelve bytes
        got = rows_of(back)
        assert [r[0] for r in got] == list(range(1000)) and sorted((r[1], r[2]) for r in got) == [(i, (float(i), i / 2, -1.0)) for i in range(1000)]
    M.write_matrix(df.where("id < 5"), "file://" + folder, "append")
    assert M.read_matrix(spark, folder).count() == 1005
    M.write_matrix(df.where("id < 5"), folder)
    assert M.read_matrix(spark, folder).count() == 5
    assert len([f for f in os.listdir(folder) if f.endswith(".npy")]) == len(json.load(open(f"{folder}/{M.LISTED}"))["parts"])


def test_one_file_with_its_ids(spark, tmp_path):
    m = np.arange(12, dtype=np.float64).reshape(4, 3)
    np.save(tmp_path / "corpus.npy", m)
    (tmp_path / "ids.json").write_text(json.dumps(["a::0", "b::0", "b::1", "ñ"]))
    got = rows_of(M.read_matrix(spark, str(tmp_path / "corpus.npy"), range_bytes=48))
    assert got == [(i, x, tuple(m[i])) for i, x in enumerate(["a::0", "b::0", "b::1", "ñ"])]
    (tmp_path / "short.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="4 vectors, but 2 ids"):
        M.read_matrix(spark, str(tmp_path / "corpus.npy"), str(tmp_path / "short.json")).collect()


def test_what_does_not_fit_is_refused(spark, folder, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<float>")
    M.write_matrix(good, folder)
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        bad = spark.createDataFrame(rows, "id long, vec array<float>")
        with pytest.raises(Exception, match="numbers"):
            M.write_matrix(bad.repartition(1), folder)
    parts = spark.createDataFrame([(1, [1.0])], "id long, vec array<float>").unionByName(good)
    with pytest.raises(Exception, match="numbers"):  # each task's part is fine, together they are not
        M.write_matrix(parts, folder)
    assert rows_of(M.read_matrix(spark, folder)) == [(0, 1, (1.0, 2.0))]  # what was there is still listed
    np.save(tmp_path / "flat.npy", np.zeros(3))
    with pytest.raises(Exception, match="not a row-wise matrix"):
        M.read_matrix(spark, str(tmp_path / "flat.npy")).collect()


def test_a_crash_before_the_commit_leaves_the_old_matrix(spark, folder):
    M.write_matrix(spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<float>"), folder)
    writer = M.MatrixWriter(folder, True)
    import pyarrow as pa

    writer.write(iter([pa.RecordBatch.from_pylist([{"id": 9, "vec": [5.0, 6.0]}], pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32()))]))]))  # and no commit
    assert rows_of(M.read_matrix(spark, folder)) == [(0, 1, (1.0, 2.0))]


def test_an_empty_matrix(spark, folder):
    M.write_matrix(spark.createDataFrame([], "id long, vec array<float>"), folder)
    assert M.read_matrix(spark, folder).collect() == []


def test_ranking_fails_where_the_matrix_is_in_another_order(spark, folder):
    df = spark.range(0, 50, 1, 2).selectExpr("id", "array(float(id % 7), float(1)) AS vec")
    M.write_matrix(df, folder)
    rows = M.read_matrix(spark, folder).withColumnRenamed("row", "pos")
    asked, order = rows.where("id < 3"), df.selectExpr("id AS pos", "id")
    found = dense_topk(asked, rows, 5, order=order)
    assert found.collect() and sorted(found.collect()) == sorted(dense_topk(asked, df, 5).collect())
    for wrong, what in (
        (order.selectExpr("49 - pos AS pos", "id"), "not in the same order"),
        (order.where("pos <> 49"), "differ in number"),
        (order.union(spark.sql("SELECT 50L, 50L")), "differ in number"),
    ):
        with pytest.raises(Exception, match=what):
            dense_topk(asked, rows, 5, order=wrong).collect()
