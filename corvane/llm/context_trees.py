"""Context-tree weighting with every context of the training texts, as a distributed table.

A pair is a byte with the ``DEPTH`` bytes before it, nearest first, as one 56-bit number, so that all
pairs below a context are one range of numbers. Its count is that of the training texts; pairs that
only other texts have are in the table with count 0, which changes no weight and gives their exact
probability too. A text's score then needs nothing but the table.

The bit nodes of a context of ``SPLIT`` bytes and all below it are worked out in one task (a chunk has
whole subtrees). The contexts above, at most 65,536 whatever the corpus, are summed per bit node and
mixed on the driver; a second pass over the chunks carries the mixture down. The ``FREQUENT`` most
frequent pairs are broadcast to the scoring tasks, the rest meet the texts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.storage import written

DEPTH, SPLIT, BUCKETS, FREQUENT, ROOM = 6, 3, 1024, 1 << 20, 1_000_000
HALF = math.log(2)
_U = np.uint64


def starts(names: np.ndarray) -> np.ndarray:
    """Where each run of equal names begins."""
    return np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)


def pair_names(code: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Numbers of the pairs, from contexts with the nearest byte lowest."""
    return (code.byteswap() >> _U(8)) | stream


def _log_gammas(shift: float, n: int = 1 << 12) -> np.ndarray:
    return np.array([math.lgamma(k + shift) for k in range(n)])


_HALVES, _WHOLES = _log_gammas(0.5), _log_gammas(1.0)


def _log_gamma(counts: np.ndarray, shift: float, known: np.ndarray) -> np.ndarray:
    """log Gamma(counts + shift) of whole counts: from a table, and by Stirling's series above it."""
    out = known[np.minimum(counts, len(known) - 1)]
    large = np.flatnonzero(counts >= len(known))
    if len(large):
        x = counts[large] + shift
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros, 0.5, _HALVES) + _log_gamma(ones, 0.5, _HALVES) - _log_gamma(zeros + ones, 1.0, _WHOLES) - math.log(math.pi)


class Nodes:
    """The nodes of one bit (the ``level`` bits before it given) over the contexts of some depths, from the longest up."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None, deepest: int, highest: int):
        self.depths, depth = [], deepest
        while True:
            estimate = log_kt(zeros, ones)
            weight = estimate if children is None else np.logaddexp(estimate, children) - HALF
            stop = np.ones(len(names)) if children is None else np.exp(np.minimum(estimate - HALF - weight, 0.0))
            up = names >> _U(8)
            first = starts(up)
            self.depths.append((names, stop, (ones + 0.5) / (zeros + ones + 1), np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(up)]))))))
            if depth == highest:
                break
            self._above(up, first, zeros, ones, weight)
            names, zeros, ones, children = self.above
            depth -= 1
        if highest:
            self._above(up, first, zeros, ones, weight)

    def _above(self, up: np.ndarray, first: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> None:
        total = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        self.above = up[first], total(zeros), total(ones), total(weight)

    def down(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed probability of a one, and the weight left for longer contexts, at the deepest nodes, from those of the contexts above."""
        for _, stop, one, parent in reversed(self.depths):
            so_far, left = so_far[parent], left[parent]
            so_far, left = so_far + left * stop * one, left * (1 - stop)
        return so_far, left


def chunk_nodes(pairs: np.ndarray, counts: np.ndarray, level: int) -> tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes at depths SPLIT .. DEPTH of whole subtrees; the order of the pairs by node, the node of each, and its bit."""
    byte = pairs & _U(255)
    names = ((byte >> _U(8 - level)) << _U(8 * DEPTH)) | (pairs >> _U(8))
    order = np.argsort(names, kind="stable")
    names, n, bit = names[order], counts[order], ((byte[order] >> _U(7 - level)) & _U(1)) == 1
    first = starts(names)
    node = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(names)]))))
    return Nodes(names[first], np.add.reduceat(np.where(bit, 0, n), first), np.add.reduceat(np.where(bit, n, 0), first), None, DEPTH, SPLIT), order, node, bit


def _binaries(values: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


class _Seen:
    """Distinct sorted names with their counts."""

    def __init__(self) -> None:
        self.names, self.counts, self.held = [], [], 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.names.append(names)
        self.counts.append(counts)
        self.held += len(names)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        names, counts = np.concatenate(self.names), np.concatenate(self.counts)
        order = np.argsort(names, kind="stable")
        names, counts = names[order], counts[order]
        first = starts(names)
        self.names, self.counts, self.held = [names[first]], [np.add.reduceat(counts, first)], len(first)
        return self.names[0], self.counts[0]


def gathered_pairs(batches: Iterator[pa.RecordBatch], streams) -> Iterator[pa.RecordBatch]:
    """(bucket, names, counts) of a partition; the lowest bit of a name says whether the text is learned from."""

    def out(seen: _Seen) -> pa.RecordBatch:
        names, counts = seen.merge()
        bucket = (K.mix(names >> _U(33)) % _U(BUCKETS)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        names, counts, bucket = names[order], counts[order], bucket[order]
        first = starts(bucket)
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), _binaries(np.split(names, first[1:])), _binaries(np.split(counts, first[1:]))], ["bucket", "names", "counts"])

    seen, limit = _Seen(), ROOM
    for batch in batches:
        learned = batch.column("learned").to_numpy(zero_copy_only=False)
        for part in K.slices(batch.column("text")):
            stream, offsets, code = streams(part)
            names = pair_names(code, stream) << _U(1) | np.repeat(learned[part.first : part.first + part.rows], np.diff(offsets)).astype(np.uint64)
            names = np.sort(names)
            first = starts(names)
            seen.add(names[first], np.diff(np.concatenate((first, [len(names)]))))
            if seen.held > limit:
                seen.merge()
                limit = 2 * seen.held
                if seen.held > 2 * ROOM:
                    yield out(seen)
                    seen, limit = _Seen(), ROOM
    if seen.held:
        yield out(seen)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets (their rows come one after the other) as chunks: pairs, counts learned from, all counts, and sums of the nodes above."""

    def out(seen: _Seen) -> pa.RecordBatch:
        names, counts = seen.merge()
        pairs = names >> _U(1)
        first = starts(pairs)
        pairs, learned, every = pairs[first], np.add.reduceat(np.where(names & _U(1) == 1, counts, 0), first), np.add.reduceat(counts, first)
        above = []
        for level in range(8):
            up, *sums = chunk_nodes(pairs, learned, level)[0].above
            above.append((up | _U(level << 32), np.stack(sums, 1).astype(np.float64)))
        values = [pairs, learned, every, np.concatenate([a for a, _ in above]), np.concatenate([b for _, b in above])]
        return pa.RecordBatch.from_arrays([_binaries([v]) for v in values], ["pairs", "learned", "every", "above", "sums"])

    seen, last = _Seen(), -1
    for batch in batches:
        for bucket, names, counts in zip(batch.column("bucket").to_pylist(), batch.column("names"), batch.column("counts")):
            if bucket != last and seen.held > ROOM // 2:
                yield out(seen)
                seen = _Seen()
            last = bucket
            seen.add(np.frombuffer(names.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64))
            if seen.held > 4 * ROOM and len(seen.names) > 64:
                seen.merge()
    if seen.held:
        yield out(seen)


def above_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for above, sums in zip(batch.column("above"), batch.column("sums")):
            sums = np.frombuffer(sums.as_buffer(), np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(above.as_buffer(), np.int64)), *(pa.array(sums[:, k].copy()) for k in range(3))], ["node", "zeros", "ones", "children"])


def mixed_above(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: nodes of the contexts of SPLIT - 1 bytes, their mixed probability and the weight left."""
    out, order = [], np.argsort(node, kind="stable")
    node, zeros, ones, children = node[order].astype(np.uint64), zeros[order].astype(np.int64), ones[order].astype(np.int64), children[order]
    for level in range(8):
        at = (node >> _U(32)) == level
        names = node[at] & _U(2**32 - 1)
        nodes = Nodes(names, zeros[at], ones[at], children[at], SPLIT - 1, 0)
        roots = len(nodes.depths[-1][0])
        # a root's parent index counts runs of its name without the (absent) last byte: one entry for each root
        nodes.depths[-1] = (*nodes.depths[-1][:3], np.arange(roots))
        out.append((names, *nodes.down(np.zeros(roots), np.ones(roots))))
    return out


def pair_rows(batches: Iterator[pa.RecordBatch], above: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(pair, log2 of its probability, its count in all texts)."""
    for batch in batches:
        for row in range(batch.num_rows):
            pairs, learned, every = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("pairs", np.uint64), ("learned", np.int64), ("every", np.int64)))
            bits = np.zeros(len(pairs))
            for level in range(8):
                nodes, order, node, bit = chunk_nodes(pairs, learned, level)
                names, so_far, left = above[level]
                at = np.searchsorted(names, nodes.above[0])
                one = nodes.down(so_far[at], left[at])[0][node]
                bits[order] += np.log2(np.where(bit, one, 1 - one))
            for k in range(0, len(pairs), 100_000):
                some = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[some].view(np.int64)), pa.array(bits[some].astype(np.float32)), pa.array(every[some])], ["pair", "bits", "n"])


class Frequent:
    """Bits of the most frequent pairs, found by the leading bits of a hash and a short walk."""

    def __init__(self, pairs: np.ndarray, bits: np.ndarray):
        hashed = K.mix(pairs.view(np.uint64))
        order = np.argsort(hashed)
        self.hashed, self.bits = np.concatenate((hashed[order], [_U(2**64 - 1)])), bits[order]
        self.shift = 64 - max(4, len(pairs).bit_length())
        self.first = np.searchsorted(self.hashed[:-1], np.arange(1 << (64 - self.shift), dtype=np.uint64) << _U(self.shift)).astype(np.int32)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each name (0 where it is not here), and whether it is here."""
        hashed = K.mix(names)
        at = self.first[hashed >> _U(self.shift)]
        left = np.flatnonzero(self.hashed[at] < hashed)
        while len(left):
            at[left] += 1
            left = left[self.hashed[at[left]] < hashed[left]]
        here = (self.hashed[at] == hashed) & (at < len(self.bits))
        out = np.zeros(len(names))
        out[here] = self.bits[at[here]]
        return out, here


def learn_pairs(docs: DataFrame, streams, frequent: int = FREQUENT) -> tuple[Frequent, DataFrame]:
    """Bits of all pairs in ``docs(text, learned)``: the most frequent, and the rest as a written table ``(pair, bits, n)``.

    ``streams`` gives the bytes, the row offsets and the contexts of a slice.
    """
    gathered = docs.mapInArrow(lambda it: gathered_pairs(it, streams), "bucket int, names binary, counts binary")
    gathered = gathered.repartition("bucket").sortWithinPartitions("bucket")
    chunks = written(gathered.mapInArrow(chunk_rows, "pairs binary, learned binary, every binary, above binary, sums binary"), "chunks")
    top = chunks.select("above", "sums").mapInArrow(above_rows, "node long, zeros double, ones double, children double")
    top = top.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children"))).toPandas()
    above = docs.sparkSession.sparkContext.broadcast(mixed_above(*(top[c].to_numpy() for c in ("node", "zeros", "ones", "children"))))
    pairs = chunks.select("pairs", "learned", "every").mapInArrow(lambda it: pair_rows(it, above.value), "pair long, bits float, n long")
    pairs = written(pairs, "pairs")
    size = F.floor(F.log2("n") * 8).cast("int")
    least, room = 1 << 30, frequent
    for r in sorted(pairs.groupBy(size.alias("size")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    head = pairs.where(size >= least).select("pair", "bits").toArrow()
    return Frequent(head["pair"].to_numpy(), head["bits"].to_numpy()), pairs.where(size < least)
