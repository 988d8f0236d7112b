"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent n-grams (one to three letters, words padded with a blank) of a
language, in order. A document's own most frequent n-grams, ranked likewise, are compared with each
profile by out-of-place distance: the difference of ranks, or ``PROFILE`` for an n-gram that the profile
lacks. Counts come from all training rows; what reaches the driver is ``PROFILE`` rows per language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import kernels as K

PROFILE = 300
UNKNOWN = "und"
LETTER = 21


@cache
def _folded() -> np.ndarray:
    """Lower-cased letter for each code point; 0 for anything that is not a letter."""
    table = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def _end_of_letters() -> int:
    return int(_folded().max()) + 1


def _code_points(part: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a slice, and the offsets of its rows in them; bytes that are no UTF-8 are no letters."""
    data = part.data.tobytes()
    try:
        text = data.decode("utf-8")
        offsets = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))[part.offsets]
    except UnicodeDecodeError:
        rows = [data[a:b].decode("utf-8", "replace") for a, b in zip(part.offsets, part.offsets[1:])]
        text, offsets = "".join(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], offsets


def _renamed(grams: np.ndarray, bits: int, to: int, names: np.ndarray) -> np.ndarray:
    """N-grams whose letters take ``bits`` bits, with each letter's name of ``to`` bits; negative where a name is."""
    letters = [names[grams >> k * bits & (1 << min(bits, 20)) - 1] << k * to for k in range(3)]
    return letters[0] | letters[1] | letters[2] | grams >> min(3 * bits, 62) << min(3 * to, 62)


@dataclass
class Grams:
    """(row, n-gram) of every occurrence in a slice.

    An n-gram packs up to three letters, 0 being the blank, and above them a bit that marks pairs. Letters are
    numbered in order among those of the slice, so that an n-gram takes few bits; code points are ``LETTER`` bits wide.
    Both packings have the same order.
    """

    row: np.ndarray
    gram: np.ndarray
    alphabet: np.ndarray  # code point of each number
    number: np.ndarray  # of each code point; -1 for those that the slice lacks
    bits: int  # of a number

    def numbered(self, grams: np.ndarray) -> np.ndarray:
        return _renamed(grams, LETTER, self.bits, self.number)

    def spelled(self, grams: np.ndarray) -> np.ndarray:
        return _renamed(grams, self.bits, LETTER, self.alphabet)

    def counted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, n-gram, count) in this order; ``group`` has a small number for each occurrence."""
        return _runs(group, self.gram, 3 * self.bits + 1)


def _fits(highest: int, *widths: int) -> bool:
    """Whether a number up to ``highest`` and others of so many bits pack into one of 63."""
    return highest.bit_length() + sum(widths) <= 63


def _runs(group: np.ndarray, gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, n-gram), sorted, and how often each occurs; n-grams have ``width`` bits."""
    if not len(gram):
        return group, gram, group
    if _fits(int(group.max()), width):
        both = np.sort(group << width | gram)
        new = both[1:] != both[:-1]
        first = np.flatnonzero(np.concatenate(([True], new)))
        group, gram = both[first] >> width, both[first] & (1 << width) - 1
    else:
        order = np.lexsort((gram, group))
        group, gram = group[order], gram[order]
        new = (group[1:] != group[:-1]) | (gram[1:] != gram[:-1])
        first = np.flatnonzero(np.concatenate(([True], new)))
        group, gram = group[first], gram[first]
    return group, gram, np.diff(np.append(first, len(new) + 1))


def ngrams(part: K.Slice) -> Grams:
    """N-grams of a slice: letters run together to words, each word is padded with one blank on either side."""
    points, offsets = _code_points(part)
    seen = np.zeros(_end_of_letters(), bool)
    seen[points] = True
    seen[0] = True
    alphabet, number = np.flatnonzero(seen), np.where(seen, np.cumsum(seen) - 1, -1)
    bits = max((len(alphabet) - 1).bit_length(), 1)
    letters = number[points]
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    edges = offsets[(offsets > 0) & (offsets < len(letters))]
    before[edges], after[edges - 1] = 0, 0
    at = np.flatnonzero(letters)
    row = np.repeat(np.arange(part.rows), np.diff(offsets))[at]
    before, here, after = before[at], letters[at], after[at]
    last = np.flatnonzero(after == 0)
    pair = 1 << 3 * bits
    grams = here, before << 2 * bits | here << bits | after, pair | before << bits | here, pair | here[last] << bits
    return Grams(np.concatenate((row, row, row, row[last])), np.concatenate(grams), alphabet, number, bits)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) over a whole partition; the table is bounded by the n-grams of the languages' letters."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, names: np.ndarray, counts: np.ndarray) -> None:
        if lang in total:
            names, counts = np.concatenate((total[lang][0], names)), np.concatenate((total[lang][1], counts))
            names, inverse = np.unique(names, return_inverse=True)
            counts = np.bincount(inverse, counts, len(names)).astype(np.int64)
        total[lang] = names, counts

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for part in K.slices(batch.column("text")):
            here = np.array(langs[part.first : part.first + part.rows], object)
            known, lang_of = np.unique(here, return_inverse=True)
            grams = ngrams(part)
            lang, gram, count = grams.counted(lang_of[grams.row])
            for k, name in enumerate(known):
                own = lang == k
                add(name, grams.spelled(gram[own]), count[own])
    for lang, (names, counts) in total.items():
        for k in range(0, len(names), 50_000):
            some = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names[some]), pa.string()), pa.array(names[some]), pa.array(counts[some])], ["lang", "gram", "n"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from all rows of ``docs(text, lang)``; rows with a null lang or text teach nothing."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "rank").collect():
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(p)], np.int64) for lang, p in sorted(profiles.items())}


def _by_count(row: np.ndarray, gram: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and n-grams, by row, falling count and n-gram; they come sorted by row and n-gram."""
    if not len(row):
        return row, gram
    most = int(count.max())
    if _fits(int(row[-1]), most.bit_length(), width):
        key = np.sort((row << most.bit_length() | most - count) << width | gram)
        return key >> most.bit_length() + width, key & (1 << width) - 1
    order = np.lexsort((-count, row))
    return row[order], gram[order]


def predictor(profiles: dict[str, np.ndarray]):
    """A task function: adds ``lang_pred`` and ``score`` to batches with ``text``."""
    languages = list(profiles)
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
    # each language's rank of the known n-grams, and of any other; from 2 * PROFILE on, every distance is PROFILE
    places = np.full((len(languages), len(known) + 1), 2 * PROFILE)
    for k, p in enumerate(profiles.values()):
        places[k, np.searchsorted(known, p)] = np.arange(len(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted, scores = [], []
            for part in K.slices(batch.column("text")):
                best, score = _closest(part)
                predicted += [languages[k] if k >= 0 else UNKNOWN for k in best]
                scores += score.tolist()
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    def _closest(part: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        grams = ngrams(part)
        row, gram, count = grams.counted(grams.row)
        row, gram = _by_count(row, gram, count, 3 * grams.bits + 1)
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(part.rows))[row]
        top = rank < PROFILE
        row, gram, rank = row[top], gram[top], rank[top]
        n = np.bincount(row, minlength=part.rows)
        numbers = grams.numbered(known)
        here = np.flatnonzero(numbers >= 0)  # the n-grams whose letters the slice has, in the same order
        at = np.searchsorted(numbers[here], gram)
        place = np.append(here, len(known))[at]
        place[np.append(numbers[here], -1)[at] != gram] = len(known)
        distance = np.zeros((len(languages), part.rows))
        for k in range(len(languages)):
            distance[k] = np.bincount(row, np.minimum(np.abs(places[k, place] - rank), PROFILE), part.rows)
        if not languages:
            return np.full(part.rows, -1), np.zeros(part.rows)
        best = distance.argmin(0)
        score = np.where(n > 0, 1 - distance.min(0) / (PROFILE * np.maximum(n, 1)), 0.0)
        return np.where(n > 0, best, -1), np.clip(score, 0.0, 1.0)

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``.

    The nearest profile wins, the first by name on equal distance; ``score`` is one minus its distance
    over the largest possible. A text that is null or has no letter gets ``und`` and 0, as does
    every text if nothing was learned. Other columns are ignored. Empty tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predictor(profiles), "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; a null doc_id is in no fold and is learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    profiles = learn(docs.where(~held_out("doc_id")))
    return identify(docs, profiles).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
