"""Runs of words that repeat in full, wherever they lie in their lines.

A passage is a window of ``RUN`` words, over line breaks. Of its 25-word windows one is chosen by the
least hash among ``RUN - ANCHOR + 1`` in a row, so equal passages share a chosen one: chosen windows that
occur twice lead to every repeated passage. Each passage keeps its first occurrence by (doc_id, word);
words that lie in a later one are cut. A cut word's model may lie in a later occurrence of another passage
and be cut as well, but going back from first to first ends at one that stays, so one copy of every word
is left. Only where a passage overlaps its own repeat (a text that runs in a circle) the words of the
first one are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.storage import few, workspace, written

RUN, ANCHOR = 50, 25
PLACES = "key long, doc_id long, ka long, kb long, at int"


def _windows(part: K.Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with at least RUN words, the hashes of their windows, and where each row's begin."""
    words = K.find_words(part.data, part.offsets)
    long = words.counts >= RUN
    counts = words.counts[long]
    hashes = K.word_hashes(part.data, words)[np.repeat(long, words.counts)]
    sh = K.shingle(hashes, np.concatenate(([0], np.cumsum(counts))).astype(np.int64), width)
    return np.flatnonzero(long), sh.value, sh.first


def _places(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    ids = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "ka", "kb")]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *ids, pa.array(at.astype(np.int32))], ["key", "doc_id", "ka", "kb", "at"])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = RUN - ANCHOR + 1
    for batch in batches:
        for part in K.slices(batch.column("text")):
            rows, value, first = _windows(part, ANCHOR)
            if not len(rows):
                continue
            row = np.repeat(np.arange(len(rows)), np.diff(first))
            chosen = np.arange(len(value) - span + 1) + np.lib.stride_tricks.sliding_window_view(value, span).argmin(1)
            chosen = np.unique(chosen[row[: len(chosen)] == row[span - 1 :]])
            yield _places(batch, part.first + rows[row[chosen]], value[chosen], chosen - first[:-1][row[chosen]])


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passages that hold one of the wanted windows of their text."""
    for batch in batches:
        wanted = batch.column("wanted")
        for part in K.slices(batch.column("text")):
            rows, value, first = _windows(part, RUN)
            out = []
            for k, r in enumerate(rows):
                at = np.asarray(wanted[part.first + int(r)].as_py(), np.int64)
                near = (at[:, None] - np.arange(RUN - ANCHOR + 1)).ravel()
                out.append(np.unique(near[(near >= 0) & (near < first[k + 1] - first[k])]))
            if out:
                at, row = np.concatenate(out), np.repeat(np.arange(len(rows)), [len(x) for x in out])
                yield _places(batch, part.first + rows[row], value[first[:-1][row] + at], at)


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that lie in a later occurrence and are not held; line breaks stay."""
    for batch in batches:
        later, kept = batch.column("later"), batch.column("kept")
        for part in K.slices(batch.column("text")):
            words = K.find_words(part.data, part.offsets)
            texts, spans, cut = [], [], []
            for r in range(part.rows):
                n, base = int(words.counts[r]), int(words.first[r])
                cover = []
                for places in (later, kept):
                    at = np.asarray(places[part.first + r].as_py() or [], np.int64)
                    cover.append(np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + RUN, minlength=n + 1))[:n] > 0)
                gone = np.concatenate(([False], cover[0] & ~cover[1], [False]))
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                end = int(part.offsets[r + 1])
                keep = np.ones(end - int(part.offsets[r]), bool)
                for a, b in edges:
                    stop = int(words.start[base + b]) if b < n else end
                    keep[int(words.start[base + a]) - int(part.offsets[r]) : stop - int(part.offsets[r])] = False
                data = part.data[part.offsets[r] : end]
                texts.append(data[keep | (data == 10)].tobytes().decode())
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edges])
                cut.append(int(gone.sum()))
            ids = [batch.column(c).slice(part.first, part.rows) for c in ("ka", "kb")]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(cut, pa.int64())], ["ka", "kb", "cut_text", "passages", "passage_words"])


def cut_passages(texts: DataFrame) -> DataFrame:
    """``(ka, kb, cut_text, passages, passage_words)`` of the texts that lose words, from ``texts(doc_id, ka, kb, text)`` dealt by ka and kb.

    ``passages`` has the first and last cut word of each run, counted from 0 in ``text``. Rows equal in (ka, kb) are one text.
    """
    with workspace(texts.sparkSession) as held:
        seen = written(texts.mapInArrow(anchor_rows, PLACES), "anchors").dropDuplicates(["ka", "kb", "at"])
        often = written(seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often", narrow=True)
        wanted = seen.join(few(often), "key").groupBy("ka", "kb").agg(F.collect_list("at").alias("wanted"))
        wanted = written(wanted, "wanted", narrow=True)
        found = texts.join(few(wanted, 200), ["ka", "kb"]).dropDuplicates(["ka", "kb"]).select("doc_id", "ka", "kb", "text", "wanted")
        found = written(found.mapInArrow(passage_rows, PLACES), "passages")
        place = F.struct("doc_id", "ka", "kb", "at")
        firsts = written(found.groupBy("key").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").select("key", "keep"), "firsts", narrow=True)
        ruled = found.join(few(firsts, 64), "key").where(~place.eqNullSafe(F.col("keep")))
        own = (F.col("keep.ka") == F.col("ka")) & (F.col("keep.kb") == F.col("kb")) & (F.col("at") - F.col("keep.at") < RUN)
        ruled = ruled.groupBy("ka", "kb").agg(F.collect_list("at").alias("later"), F.collect_set(F.when(own, F.col("keep.at"))).alias("kept"))
        ruled = written(ruled, "ruled", narrow=True)
        cut = texts.join(few(ruled, 400), ["ka", "kb"]).dropDuplicates(["ka", "kb"]).select("ka", "kb", "text", "later", "kept")
        cut = cut.mapInArrow(cut_rows, "ka long, kb long, cut_text string, passages array<struct<first:int,last:int>>, passage_words long")
        return held.keep(written(cut.where("passage_words > 0"), "cut"))
