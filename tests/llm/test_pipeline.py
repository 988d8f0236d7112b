"""The pipeline on the smallest data: what each stage may return, and that its decisions hold."""

import collections
import os
import re
import threading

import pytest

import corpus_pipeline
from corvane.llm.storage import written
from corvane.storage import shared_dir

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(df):
    return sum(len(WORD.findall(r.text or "")) for r in df.select("text").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, DATA), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.count() > 0
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    good = labels.count()
    assert seen["quality_rules"].join(labels, "doc_id", "left_semi").count() > 0.85 * good
    kept = [r.text for r in seen["near_dedup"].select("text").collect()]
    assert len(set(kept)) == len(kept)
    lines = collections.Counter(x for r in seen["substring_dedup"].select("text").collect() for x in r.text.split("\n") if len(WORD.findall(x)) >= 25)
    assert max(lines.values()) == 1
    assert abs(words(seen["source_mixing"]) - 1.5 * words(seen["substring_dedup"])) <= 20
    packed = seen["best_fit_packing"].collect()
    assert sum(r.words for r in packed) == words(seen["source_mixing"])
    fill = collections.Counter()
    for r in packed:
        fill[r.bin_id] += r.words
    assert max(fill.values()) <= 1024
    assert max(collections.Counter((r.bin_id, r.doc_id) for r in packed).values()) == 1


def test_nothing_in_nothing_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def tables(spark):
    home = shared_dir(spark).removeprefix("file:") + "/corvane"
    return set(os.listdir(home)) if os.path.isdir(home) else set()


def test_only_the_last_table_is_left_and_a_failed_run_leaves_none(spark, monkeypatch):
    def fails(spark, docs, sf_dir):
        written(docs, "lost")
        raise ZeroDivisionError

    copies = lambda spark, docs, sf_dir: corpus_pipeline._stage(lambda d: written(d.limit(5), "inner"), docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", copies), ("second", copies)])
    before = tables(spark)
    assert corpus_pipeline.run(spark, DATA).count() == 5
    assert [t.split("-")[0] for t in tables(spark) - before] == ["second"]
    before = tables(spark)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", copies), ("second", fails)])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, DATA)
    assert tables(spark) == before


def test_stages_of_other_threads_and_of_a_run_keep_their_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(7)
    stage = lambda d: corpus_pipeline._stage(lambda x: written(x, "mine"), d)
    mine = stage(docs)
    other = threading.Thread(target=lambda: stage(docs))
    other.start()
    other.join()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("only", lambda spark, docs, sf_dir: stage(docs.limit(3)))])
    assert corpus_pipeline.run(spark, DATA).count() == 3
    assert mine.count() == 7
    assert stage(mine).count() == 7
