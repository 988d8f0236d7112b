"""The corpus pipeline: raw documents to packed training bins, each stage an operator of ``corvane.llm``."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.mixing import mix_documents
from corvane.llm.near_dedup import one_of_each_group
from corvane.llm.packing import pack
from corvane.llm.quality_rules import keep_good
from corvane.llm.storage import remove, workspace, written
from corvane.llm.substring_dedup import remove_repeats


class _Left(threading.local):
    """Tables that the stages called in this thread left behind: their results, evaluated later, read them."""

    def __init__(self):
        self.paths: list[str] = []


_left = _Left()


def _clear(spark: SparkSession, but_for: Iterable[str] = ()) -> None:
    """Deletes what is left, but for the tables that hold one of the files ``but_for``."""
    read = {folder for file in but_for for folder in file.split("/")}
    stay = [p for p in _left.paths if p.rpartition("/")[2] in read]
    for path in set(_left.paths).difference(stay):
        remove(spark, path)
    _left.paths = stay


def _stage(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """Applies ``operator``, and deletes the tables that the stage before left: its result is written by now.

    Tables that ``docs`` still reads stay, and so do those of other threads.
    """
    spark = docs.sparkSession
    _clear(spark, docs.inputFiles() if _left.paths else [])
    with workspace(spark) as held:
        out = operator(docs)
        _left.paths.extend(held.release())
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the label model rejects, among them null, empty and word-less ones; equal rows share a verdict.

    An empty table gives an empty one; extra columns go along, whatever their names.
    """
    return _stage(keep_good, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (from a similarity of 0.80), the one with the smallest doc_id.

    Word-less texts and null doc_ids are in no group and stay; of rows that repeat doc_id and text one
    stays. An empty table gives an empty one; extra columns go along.
    """
    return _stage(one_of_each_group, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes paragraphs and passages that repeat earlier ones; documents of which nothing is left go.

    Null and word-less texts stay as they are. An empty table gives an empty one; extra columns go along.
    """
    return _stage(remove_repeats, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix of sources; a document taken twice gives two rows, one that no slot takes none.

    A null source is a source of its own; null and word-less texts have size 0 and give nothing. An empty
    table gives an empty one; extra columns go along.
    """
    return _stage(mix_documents, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every word of the mix in a bin; texts without words are in none. An empty table gives an empty one."""
    return _stage(pack, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The label model, the components and the packing are iterative: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written and read again as the next one's input, which is then deleted.

    What stages called before it left stays as it is; if a stage fails, all tables of this run go.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    outside, _left.paths = _left.paths, []
    try:
        for name, stage in STAGES:
            with workspace(spark) as held:
                docs = written(stage(spark, docs, sf_dir), name)
                made = held.release()
            _clear(spark)
            for path in before:
                remove(spark, path)
            before = made
    except BaseException:
        _clear(spark)
        for path in before:
            remove(spark, path)
        raise
    finally:
        _left.paths = outside
    return docs
