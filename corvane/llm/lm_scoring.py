"""Language-model scores: a word-unigram base and context-tree weighting over bytes.

A text is its lower-cased words, each followed by a blank, and one end byte. Every bit of a byte, given the
bits before it, has its own context tree over the up to ``DEPTH`` bytes before; Krichevsky-Trofimov
estimates at all depths are mixed with the weights ``1/2 P_e : 1/2 prod P_w(children)`` that the
training text gives them (contexts of a node that are not in the tree count together as one more
child). The probability of a text is the product over its bits, a proper distribution.

The query keeps every context of the training texts (``learn_full``, in ``context_trees``). ``learn`` gives
a model in memory that is bounded by ``nodes``: its first pass finds the tree (each partition reports
contexts above a quarter of the threshold, so every context seen at least ``N / nodes`` times is in, and
at most ``4/3 nodes`` per depth can be), its second counts every training byte at its deepest context.
Word counts are exact and stay distributed; only the ``HEAD`` most frequent words are broadcast,
the rest meet the documents in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.context_trees import FREQUENT, Frequent, learn_pairs, pair_names
from corvane.llm.storage import written

DEPTH, NODES, HEAD = 6, 1 << 16, 1 << 17
BLANK, END = 32, 10
EMPTY = np.uint64(2**64 - 1)


def byte_stream(part: K.Slice, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The model's bytes of a slice, and the offsets of its rows in them."""
    sizes = words.end - words.start
    row = np.repeat(np.arange(part.rows), words.counts)
    inside = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(K._IS_WORD[part.data])
    out = np.full(len(at) + len(sizes) + part.rows, BLANK, np.uint8)
    out[np.arange(len(at)) + inside + row[inside]] = K.LOWER[part.data[at]]
    ends = np.cumsum(np.bincount(row, sizes + 1, part.rows).astype(np.int64) + 1)
    out[ends - 1] = END
    return out, np.concatenate(([0], ends))


def contexts(stream: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before each byte as one number, the nearest lowest; before a text stand end bytes."""
    code = np.zeros(len(stream), np.uint64)
    for k in range(1, depth + 1):
        before = np.full(len(stream), END, np.uint8)
        before[k:] = stream[:-k]
        for j in range(min(k, int(np.diff(offsets).max(initial=0)))):
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = END
        code |= before.astype(np.uint64) << np.uint64(8 * (k - 1))
    return code


def _merge(total: tuple[np.ndarray, np.ndarray] | None, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if total is not None:
        keys, counts = [total[0], *keys], [total[1], *counts]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts of 64-bit keys over a partition, merged whenever enough new keys have come together."""

    def __init__(self, room: int = 4_000_000):
        self.total: tuple[np.ndarray, np.ndarray] | None = None
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.room = 0, room

    def add(self, keys: np.ndarray) -> None:
        names = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
        self.keys.append(names[first])
        self.counts.append(np.diff(np.concatenate((first, [len(names)]))))
        self.held += len(first)
        if self.held > self.room:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys or self.total is None:
            empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            self.total = _merge(self.total, self.keys or empty[0], self.counts or empty[1])
            self.keys, self.counts, self.held = [], [], 0
        return self.total


WORDS, BYTES, TEXTS = 0, 100, 101  # kinds of gathered counts; 1 .. DEPTH are contexts of that depth


def gathered_rows(batches: Iterator[pa.RecordBatch], depth: int, nodes: int) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's words, and of its contexts that reach a quarter of the threshold here."""
    words_seen, deepest, n_bytes, n_texts = Tally(), Tally(), 0, 0
    for batch in batches:
        n_texts += batch.num_rows
        for part in K.slices(batch.column("text")):
            words = K.find_words(part.data, part.offsets)
            words_seen.add(K.word_hashes(part.data, words))
            stream, offsets = byte_stream(part, words)
            n_bytes += len(stream)
            deepest.add(contexts(stream, offsets, depth))
    tables = [(WORDS, *words_seen.result())]
    keys, counts = deepest.result()
    for d in range(depth, 0, -1):
        keys, counts = _merge(None, [keys & np.uint64(2 ** (8 * d) - 1)], [counts])
        often = counts * 4 * nodes >= n_bytes
        tables.append((d, keys[often], counts[often]))
    tables += [(BYTES, np.zeros(1, np.uint64), np.array([n_bytes])), (TEXTS, np.zeros(1, np.uint64), np.array([n_texts]))]
    for kind, keys, counts in tables:
        for k in range(0, len(keys), 100_000):
            some = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[some]), kind, np.int32)), pa.array(keys[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["kind", "key", "n"])


@dataclass
class Tree:
    """Context numbers by hashing (linear probing); a context's parent drops its oldest byte."""

    depth: int
    levels: list[np.ndarray]

    def __post_init__(self) -> None:
        self.base = np.cumsum([0, *(len(x) for x in self.levels)])
        keys = np.concatenate([x | np.uint64(d << 56) for d, x in enumerate(self.levels)])
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.table, self.number = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.table[slot[left]] == EMPTY)
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free[first]]
            self.table[slot[put]], self.number[slot[put]] = keys[put], put
            left = left[self.number[slot[left]] != left] if len(put) else left
            left = left[self.table[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Number of the deepest context in the tree of each position."""
        out = np.zeros(len(code), np.int32)
        left = np.arange(len(code))
        for d in range(self.depth, 0, -1):
            if not len(left):
                break
            keys = (code[left] & np.uint64(2 ** (8 * d) - 1)) | np.uint64(d << 56)
            slot, ask = self._slot(keys), np.arange(len(left))
            hit = np.zeros(len(left), bool)
            while len(ask):
                seen = self.table[slot[ask]]
                same = seen == keys[ask]
                hit[ask[same]] = True
                ask = ask[~same & (seen != EMPTY)]
                slot[ask] = (slot[ask] + 1) & ((1 << self.bits) - 1)
            out[left[hit]] = self.number[slot[hit]]
            left = left[~hit]
        return out

    def parents(self) -> np.ndarray:
        out = np.zeros(self.base[-1], np.int64)
        for d in range(1, self.depth + 1):
            out[self.base[d] : self.base[d + 1]] = self.base[d - 1] + np.searchsorted(self.levels[d - 1], self.levels[d] & np.uint64(2 ** (8 * (d - 1)) - 1))
        return out


def counted_rows(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """(context * 256 + byte, count) of a partition, every byte at its deepest context."""
    seen = Tally()
    for batch in batches:
        for part in K.slices(batch.column("text")):
            stream, offsets = byte_stream(part, K.find_words(part.data, part.offsets))
            seen.add(tree.find(contexts(stream, offsets, tree.depth)).astype(np.uint64) * np.uint64(256) + stream)
    keys, counts = seen.result()
    for k in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000].astype(np.int64))], ["key", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(6):
        shift += np.log(x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def log_probabilities(tree: Tree, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log2 p(byte | deepest context), for every context and byte, from counts at deepest contexts.

    One bit node (a prefix of the byte) at a time, over all contexts: upwards for the weights, downwards for the mixture.
    """
    size, parent, base = int(tree.base[-1]), tree.parents(), tree.base
    context, byte = np.divmod(keys, 256)
    out = np.zeros((size, 256), np.float32)
    below = np.zeros(size, bool)
    below[parent[1:]] = True
    half = math.log(2)
    values = np.arange(256)
    for level in range(8):
        for prefix in range(1 << level):
            span = (values >> (8 - level)) == prefix
            at = (byte >> (8 - level)) == prefix
            if not at.any():  # no such byte anywhere: an even bet
                out[:, span] -= 1
                continue
            bit = (byte[at] >> (7 - level)) & 1
            own = [np.bincount(context[at][bit == b], counts[at][bit == b], size).astype(np.float64) for b in (0, 1)]
            every = [x.copy() for x in own]
            for d in range(tree.depth, 0, -1):
                s = slice(base[d], base[d + 1])
                for x in every:
                    x += np.bincount(parent[s], x[s], size)
            estimate, children = _log_kt(*every), _log_kt(*own)
            stop = np.ones(size)
            for d in range(tree.depth, -1, -1):
                s = slice(base[d], base[d + 1])
                mixed = np.where(below[s], np.logaddexp(estimate[s], children[s]) - half, estimate[s])
                stop[s] = np.where(below[s], np.exp(np.minimum(estimate[s] - half - mixed, 0.0)), 1.0)
                if d:
                    children += np.bincount(parent[s], mixed, size)
            one, one_own = (every[1] + 0.5) / (every[0] + every[1] + 1), (own[1] + 0.5) / (own[0] + own[1] + 1)
            so_far, left, p = np.zeros(size), np.ones(size), np.zeros(size)
            for d in range(tree.depth + 1):
                s = slice(base[d], base[d + 1])
                if d:
                    so_far[s], left[s] = so_far[parent[s]], left[parent[s]]
                p[s] = so_far[s] + left[s] * (stop[s] * one[s] + (1 - stop[s]) * one_own[s])
                so_far[s] += left[s] * stop[s] * one[s]
                left[s] *= 1 - stop[s]
            is_one = span & (((values >> (7 - level)) & 1) == 1)
            out[:, is_one] += np.log2(p)[:, None].astype(np.float32)
            out[:, span & ~is_one] += np.log2(1 - p)[:, None].astype(np.float32)
    return out


@dataclass
class Base:
    """Totals and the most frequent words of the base."""

    tokens: int
    distinct: int
    texts: int
    head: np.ndarray
    head_counts: np.ndarray

    def base_log(self, counts: np.ndarray | float) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


@dataclass
class Model(Base):
    """The base, and a bounded tree with its log2 probabilities."""

    tree: Tree
    table: np.ndarray

    def bits(self, stream: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table[self.tree.find(code), stream].astype(np.float64), np.zeros(0, np.int64)


@dataclass
class FullModel(Base):
    """The base, and the most frequent of all pairs; the bits of the others are in a table."""

    frequent: Frequent

    def bits(self, stream: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each byte (0 where they are in the table), and where that is."""
        bits, here = self.frequent.find(pair_names(code, stream))
        return bits, np.flatnonzero(~here)


def _gathered(texts: DataFrame, depth: int, nodes: int) -> tuple[DataFrame, dict]:
    gathered = texts.mapInArrow(lambda it: gathered_rows(it, depth, nodes), "kind int, key long, n long")
    gathered = written(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n")), "gathered")
    return gathered, {r["kind"]: r for r in gathered.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}


def _base(gathered: DataFrame, totals: dict, head: int) -> tuple[dict, DataFrame]:
    of = lambda kind, what: totals[kind][what] if kind in totals else 0
    words = gathered.where(F.col("kind") == WORDS).select("key", "n")
    top = words.orderBy(F.desc("n"), "key").limit(head).toPandas().sort_values("key")
    found = {"tokens": of(WORDS, "n") + of(TEXTS, "n"), "distinct": of(WORDS, "rows") + (of(TEXTS, "n") > 0), "texts": of(TEXTS, "n")}
    return found | {"head": top["key"].to_numpy(np.int64), "head_counts": top["n"].to_numpy(np.float64)}, words


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def learn(docs: DataFrame, depth: int = DEPTH, nodes: int = NODES, head: int = HEAD) -> tuple[Model, DataFrame]:
    """A model bounded by ``nodes`` of all rows of ``docs(text)``, and the word counts ``(key, n)`` as a written table."""
    texts = _texts(docs)
    gathered, totals = _gathered(texts, depth, nodes)
    kept = gathered.where(F.col("kind").between(1, depth)).where(F.col("n") * (4 * nodes) >= 3 * (totals[BYTES]["n"] if BYTES in totals else 0))
    kept = kept.select("kind", "key").toPandas()  # at most 4/3 nodes per depth
    levels = [np.zeros(1, np.uint64)]
    for d in range(1, depth + 1):
        levels.append(np.sort(kept["key"].to_numpy(np.int64)[kept["kind"].to_numpy() == d].view(np.uint64)))
    tree = Tree(depth, levels)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    counted = texts.mapInArrow(lambda it: counted_rows(it, shared.value), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    table = log_probabilities(tree, counted["key"].to_numpy(np.int64), counted["n"].to_numpy(np.float64))
    base, words = _base(gathered, totals, head)
    return Model(**base, tree=tree, table=table), words


def _streams(part: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stream, offsets = byte_stream(part, K.find_words(part.data, part.offsets))
    return stream, offsets, contexts(stream, offsets, DEPTH)


def learn_full(docs: DataFrame, head: int = HEAD, frequent: int = FREQUENT) -> tuple[FullModel, DataFrame, DataFrame]:
    """The model with all contexts of the rows of ``docs(text, held_out)`` that are not held out, the word counts, and the bits of the other pairs.

    The held-out rows give pairs to look up, and nothing to the model.
    """
    base, words = _base(*_gathered(_texts(docs.where("not held_out")), 0, 1), head)
    found, pairs = learn_pairs(_texts(docs, "held_out").select("text", F.expr("not held_out").alias("learned")), _streams, frequent)
    return FullModel(**base, frequent=found), words, pairs


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, bits double, tail array<long>, pairs array<long>"


def scored_rows(batches: Iterator[pa.RecordBatch], model: Model | FullModel) -> Iterator[pa.RecordBatch]:
    """Scores of the texts: the part of end tokens, frequent words and the model's pairs, and the other words and pairs."""
    rid = TaskContext.get().partitionId() << 40
    head_log = model.base_log(model.head_counts)
    end_log = float(model.base_log(model.texts))
    for batch in batches:
        for part in K.slices(batch.column("text")):
            words = K.find_words(part.data, part.offsets)
            hashes = K.word_hashes(part.data, words).view(np.int64)
            row = np.repeat(np.arange(part.rows), words.counts)
            base, known = np.full(part.rows, end_log), np.full(part.rows, int(model.texts > 0))
            tail = np.ones(len(hashes), bool)
            if len(model.head):
                at = np.minimum(np.searchsorted(model.head, hashes), len(model.head) - 1)
                tail = model.head[at] != hashes
                base += np.bincount(row[~tail], head_log[at[~tail]], part.rows)
                known = known + np.bincount(row[~tail], minlength=part.rows)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[tail], minlength=part.rows)))).astype(np.int32)
            stream, offsets = byte_stream(part, words)
            code = contexts(stream, offsets, DEPTH if isinstance(model, FullModel) else model.tree.depth)
            bits, other = model.bits(stream, code)
            names = pair_names(code[other], stream[other]).view(np.int64) if len(other) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(part.rows)), *(batch.column(c).slice(part.first, part.rows) for c in ("doc_id", "held_out")),
                    pa.array(words.counts.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(base),
                    pa.array(np.add.reduceat(bits, offsets[:-1])), pa.ListArray.from_arrays(ends, hashes[tail]),
                    pa.ListArray.from_arrays(np.searchsorted(other, offsets).astype(np.int32), names),
                ],
                SCORED.replace(",", "").split()[::2],
            )
            rid += part.rows


def score(docs: DataFrame, model: Model | FullModel, words: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for each row of ``docs(doc_id, held_out, text)``.

    A null text is empty: its only token is the end. Equal rows score alike. With a full model, ``docs``
    are those it was given, held out or not, and ``pairs`` has the bits that the model does not hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = written(_texts(docs, "doc_id", "held_out").mapInArrow(lambda it: scored_rows(it, shared.value), SCORED), "scored")
    scale = math.log10(model.tokens + 0.1 * (model.distinct + 1))
    tail = scored.select("rid", F.explode("tail").alias("key")).join(words, "key")
    tail = tail.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 0.1)).alias("logs"))
    rows = scored.withColumn("unseen", F.size("tail")).drop("tail", "pairs").join(tail, "rid", "left")
    bits = F.col("bits")
    if pairs is not None:
        rest = scored.select("rid", F.explode("pairs").alias("pair")).join(pairs.select("pair", F.col("bits").alias("of_pair")), "pair")
        rows = rows.join(rest.groupBy("rid").agg(F.sum("of_pair").alias("of_pairs")), "rid", "left")
        bits = bits + F.coalesce("of_pairs", F.lit(0.0))
    more = F.coalesce("more", F.lit(0))
    base = F.col("base_score") + F.coalesce("logs", F.lit(0.0)) + (F.col("unseen") - more) * math.log10(0.1) - F.col("unseen") * scale
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (bits * math.log10(2)).alias("score"), (-bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the texts outside the held-out fold; a null doc_id is in no fold and is learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
    model, words, pairs = learn_full(docs)
    return score(docs, model, words, pairs)
