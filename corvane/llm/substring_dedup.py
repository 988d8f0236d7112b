"""Removal of passages that repeat across documents: paragraph MinHash banding.

A paragraph is a line with at least ``LEAST_WORDS`` words (a parameter: shorter lines, such as headings and
list items, repeat in clean texts). Equal paragraphs (same shingle set)
collapse to one vertex; ``BANDS`` bands of ``ROWS`` minhashes find those that are similar (a pair at
the threshold is missed with probability below 1e-4), candidates are verified by exact Jaccard
similarity of five-word shingles, and each connected component keeps its first occurrence.
Then runs of 50 words that repeat in what is left, inside longer lines or over several short ones, are
cut (``passages``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.passages import cut_passages
from corvane.llm.similar import colliding, similar_components
from corvane.llm.storage import dealt, few, workspace, written

WIDTH, BANDS, ROWS, LEAST_WORDS = 5, 14, 3, 25
OCCURRENCES = "doc_id long, ka long, kb long, line int, n_words long, n long, name_a long, name_b long, sketch binary"


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each line starts, and per row the index of its first line (one more at the end)."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate(([0], np.cumsum(per_row)))
    start = np.empty(first[-1], np.int64)
    opening = np.zeros(first[-1], bool)
    opening[first[:-1]] = True
    start[opening] = offsets[:-1]
    start[~opening] = breaks + 1
    return start, first


def _paragraphs(part: K.Slice, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, K.Shingles]:
    """(row, line within the row, words) of each paragraph, and their shingles."""
    words = K.find_words(part.data, part.offsets)
    start, first = line_starts(part.data, part.offsets)
    at = np.concatenate((np.searchsorted(words.start, start), [len(words.start)]))
    counts = np.diff(at)
    long = counts >= least
    hashes = K.word_hashes(part.data, words)[np.repeat(long, counts)]
    row = np.repeat(np.arange(part.rows), np.diff(first))
    line = np.arange(len(start)) - first[:-1][row]
    return row[long], line[long], counts[long], K.shingle(hashes, np.concatenate(([0], np.cumsum(counts[long]))), WIDTH)


def occurrence_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per paragraph."""
    for batch in batches:
        for part in K.slices(batch.column("text")):
            row, line, count, sh = _paragraphs(part, least)
            sets, a, b = K.distinct_sets(sh)
            sketch = [bytes(r) for r in K.minhashes(sh, BANDS * ROWS)]
            ids = [batch.column(c).slice(part.first, part.rows).take(pa.array(row)) for c in ("doc_id", "ka", "kb")]
            numbers = [line.astype(np.int32), count.astype(np.int64), np.array([len(s) for s in sets], np.int64), a.view(np.int64), b.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*ids, *map(pa.array, numbers), pa.array(sketch, pa.binary())],
                OCCURRENCES.replace(",", "").split()[::2],
            )


def paragraph_sets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the wanted lines of each document."""
    for batch in batches:
        lines, ids = batch.column("lines").to_pylist(), batch.column("ids").to_pylist()
        for part in K.slices(batch.column("text")):
            row, line, _, sh = _paragraphs(part, least)
            sets, _, _ = K.distinct_sets(sh)
            at = {(r, n): k for k, (r, n) in enumerate(zip(row.tolist(), line.tolist()))}
            out_ids, out = [], []
            for r in range(part.rows):
                for n, i in zip(lines[part.first + r], ids[part.first + r]):
                    out_ids.append(i)
                    out.append(sets[at[r, n]])
            ends = np.concatenate(([0], np.cumsum([len(s) for s in out]))).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.ListArray.from_arrays(ends, flat.view(np.int64))], ["id", "members"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a 128-bit name of (doc_id, text); the whole input row is in ``d``."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.struct("*").alias("d"), doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("ka"), F.xxhash64(text, F.lit(1), doc_id).alias("kb"))


def repeated_paragraphs(docs: DataFrame, num: int = 80, den: int = 100, least: int = LEAST_WORDS) -> DataFrame:
    """``(ka, kb, removed, words_removed)`` of each document with removals; lines of fewer than ``least`` words are no paragraphs.

    ``removed`` holds the numbers (from 0) of the lines that go: all occurrences of a component of
    similar paragraphs but the first by (doc_id, line). Rows equal in doc_id and text are one
    document. Null doc_ids sort first. Empty tables give empty results.
    """
    with workspace(docs.sparkSession) as held:
        keyed = _keyed(docs).select("doc_id", "ka", "kb", "text")
        seen = written(keyed.mapInArrow(lambda it: occurrence_rows(it, least), OCCURRENCES), "paragraphs")
        place = F.struct("doc_id", "ka", "kb", "line")
        items = seen.groupBy("name_a", "name_b").agg(F.min(place).alias("place"), F.max(place).alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        items = written(items.withColumn("id", F.monotonically_increasing_id()), "items")
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", F.lit(1) + i * 4 * ROWS, 4 * ROWS)))
        keys = colliding(items.select("id", F.posexplode(bands).alias("t", "key")).select("key", "t", "id"))

        def sets_of(ids: DataFrame) -> DataFrame:
            wanted = items.join(few(ids), "id").select("place.ka", "place.kb", "place.line", "id")
            wanted = written(wanted.groupBy("ka", "kb").agg(F.collect_list("line").alias("lines"), F.collect_list("id").alias("ids")), "wanted", narrow=True)
            texts = keyed.select("ka", "kb", "text").join(few(wanted, 100), ["ka", "kb"]).dropDuplicates(["ka", "kb"])
            return texts.mapInArrow(lambda it: paragraph_sets(it, least), "id long, members array<long>")

        found = similar_components(items, keys, sets_of, num, den, (BANDS, ROWS))
        named = items.select("id", "name_a", "name_b", "place", "last").join(few(found), "id", "left").where("label is not null or place <> last")
        named = written(named.select("name_a", "name_b", "place", F.coalesce("label", "id").alias("label")), "named", narrow=True)
        keeper = named.groupBy("label").agg(F.min("place").alias("keep"))
        named = written(named.join(keeper, "label").select("name_a", "name_b", "keep"), "named", narrow=True)
        gone = seen.select("name_a", "name_b", "n_words", place.alias("at")).join(few(named, 64), ["name_a", "name_b"]).where("not (at <=> keep)")
        gone = gone.select("at.ka", "at.kb", "at.line", "n_words").dropDuplicates(["ka", "kb", "line"])
        removed = gone.groupBy("ka", "kb").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.sum("n_words").alias("words_removed"))
        return held.keep(written(removed, "removed", narrow=True))


def without_lines() -> Column:
    """The text without the lines numbered in ``removed``."""
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)


def shortened(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``(d, doc_id, text, cut_text, removed, words_removed, n_lines, passages, passage_words)`` for each row of ``docs``.

    ``d`` has the row without its text, ``text`` the text without its removed lines, and ``cut_text`` what is
    left after passages are cut, null where none is. The texts are shuffled once, into buckets by their
    name; what is found about them joins them there.
    """
    with workspace(docs.sparkSession) as held:
        removed = repeated_paragraphs(docs, least=least)
        texts = _keyed(docs).join(few(removed, 200), ["ka", "kb"], "left")
        n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
        texts = texts.select(F.col("d").dropFields("text").alias("d"), "doc_id", "ka", "kb", without_lines().alias("text"), "removed", "words_removed", n_lines.alias("n_lines"))
        texts = held.keep(dealt(texts, "texts", "ka", "kb"))
        cut = held.keep(cut_passages(texts.select("doc_id", "ka", "kb", "text")))
    return texts.join(cut, ["ka", "kb"], "left")


def remove_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without repeated paragraphs and passages; a document of which no word is left goes, others stay.

    All columns are kept; ``n_chars``, where there is one, follows the new text. A null or word-less text
    stays as it is. Rows equal in doc_id and text are one document: none of them repeats the other. An
    empty table gives an empty result.
    """
    rows = shortened(docs, least).withColumn("new", F.coalesce("cut_text", "text"))
    same = F.col("removed").isNull() & F.col("cut_text").isNull()
    rows = rows.where(same | F.regexp_like("new", F.lit(K.WORD_PATTERN)))
    columns = []
    for c in docs.columns:
        value = F.col("new") if c == "text" else F.col("d")[c]
        if c == "n_chars":
            value = F.when(same, value).otherwise(F.length("new")).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return rows.select(*columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, changed, n_lines, n_removed, words_removed, removed, passages)`` for each row of documents.

    ``text`` is what is left, null for a null text. ``removed`` numbers the lines (from 0) that repeat an
    earlier paragraph; ``passages`` are runs of words cut from the text without these lines;
    ``words_removed`` counts both. Rows equal in doc_id and text have equal results.
    """
    rows = shortened(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", F.coalesce("cut_text", "text").alias("text"), (F.col("removed").isNotNull() | F.col("cut_text").isNotNull()).alias("changed"), "n_lines",
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        (F.coalesce("words_removed", F.lit(0)) + F.coalesce("passage_words", F.lit(0))).cast("long").alias("words_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("passages", F.array().cast("array<struct<first:int,last:int>>")).alias("passages"),
    )
