"""Exact similarity links between sets that collide in hash tables, without pairing whole buckets.

The caller supplies sketches and table keys (their layout is the method: tensored tables for
documents, bands for paragraphs). From the colliding rows this module finds links
``den * |A & B| >= num * |A | B|`` that together connect exactly what all colliding pairs would:

1. star rounds over more and more tables: in each bucket, members are tested against one randomly
   ranked representative, but only where their component labels still differ, and verified links
   merge components; large groups thus merge in work proportional to their size;
2. a residual round tests what is left in all tables, pairs of *different* components in one bucket,
   inside tasks over blocks of bounded size (rows of the component that most of a bucket belongs to
   meet only the other rows): first by sketch, which drops every row without a possible link, then on full sets. Only verified links that join something are emitted.

Every candidate is confirmed on full sets. Nothing is capped: a bucket of any size is covered,
large ones as a grid of blocks. Tables here hold hashes and ids only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.storage import few, workspace, written

BLOCK = 512
STAR_TABLES = 4


def least_matches(size: int, num: int, den: int) -> int:
    """Sketch matches below which a link is out of the question: five standard deviations under the mean."""
    j = num / den
    return max(1, math.floor(size * j - 5 * math.sqrt(size * j * (1 - j))))


def colliding(keys: DataFrame) -> DataFrame:
    """Rows of ``keys(key, t, id)`` whose key has more than one row, with their number in ``rows``.

    The counts are written, so that the join has a plain shuffle on either side and adaptive
    execution can split a key with very many rows.
    """
    often = written(keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "often", narrow=True)
    return keys.join(often, "key")


def _per_chunk(df: DataFrame) -> DataFrame:
    """One row for each chunk ``c`` of a key, from one row for each key."""
    return df.withColumn("c", F.explode(F.expr("sequence(0, chunks - 1)")))


def _first_table(equal: np.ndarray, tables: tuple[int, ...]) -> np.ndarray:
    """Index of the first table in which a pair collides. ``tables`` is (bands, rows) or (m, m, rows)."""
    if len(tables) == 2:
        return equal.reshape(-1, *tables).all(2).argmax(1)
    m, _, rows = tables
    halves = equal.reshape(-1, 2, m, rows).all(3)
    return halves[:, 0].argmax(1) * m + halves[:, 1].argmax(1)


GROUP = ("key", "lo", "hi")
NUMBERS = ("key", "t", "lo", "hi", "c", "id", "label", "n")
BLOCK_ROWS = "key long, t int, lo int, hi int, c int, id long, label long, n long, sketch binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks (key, lo, hi), as many as a batch completes, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in GROUP]
        change = np.flatnonzero(sum((x[1:] != x[:-1]).astype(int) for x in ids)) + 1
        if len(held) > 1 and any(x[0] != held[-2].column(c)[held[-2].num_rows - 1].as_py() for c, x in zip(GROUP, ids)):
            yield pa.Table.from_batches(held[:-1])
            held = held[-1:]
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class Pairing:
    """Which pairs of a block could be links, and are this block's to test."""

    def __init__(self, rows: pa.Table, tables: tuple[int, ...], need: int, num: int, den: int):
        self.col = {c: rows.column(c).to_numpy() for c in NUMBERS}
        width = 2 * tables[0] * tables[2] if len(tables) == 3 else tables[0] * tables[1]
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(-1, width)
        self.tables, self.need, self.num, self.den = tables, need, num, den
        ids = [self.col[c] for c in GROUP]
        change = np.flatnonzero(sum((x[1:] != x[:-1]).astype(int) for x in ids)) + 1
        self.first = np.concatenate(([0], change))
        self.sizes = np.diff(np.concatenate((self.first, [rows.num_rows])))

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the pairs of rows (x, y): different labels, sizes and sketches that allow a link, and no earlier common table."""
        g = self.col
        ok = (g["label"][x] != g["label"][y]) & (self.den * np.minimum(g["n"][x], g["n"][y]) >= self.num * np.maximum(g["n"][x], g["n"][y]))
        ok &= (g["lo"][x] == g["hi"][x]) | (g["c"][x] != g["c"][y])
        at = np.flatnonzero(ok)
        equal = self.sketch[x[at]] == self.sketch[y[at]]
        ok[at] = (equal.sum(1) >= self.need) & (_first_table(equal, self.tables) == g["t"][x[at]])
        return ok


def promising_rows(batches: Iterator[pa.RecordBatch], tables: tuple[int, ...], need: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block that have a possible link in it; never more than came in."""
    for rows in _blocks(batches):
        pairing = Pairing(rows, tables, need, num, den)
        marked = np.zeros(rows.num_rows, bool)
        for s in np.unique(pairing.sizes[pairing.sizes > 1]):
            at = pairing.first[pairing.sizes == s]
            step = max(1, 200_000 // int(s))
            for k in range(0, len(at), step):
                members = (at[k : k + step, None] + np.arange(s)[None, :]).ravel()
                for d in range(1, int(s)):  # all pairs at distance d, of all blocks of this size at once
                    i, j = _at_distance(len(members) // int(s), int(s), d)
                    x, y = members[i.ravel()], members[j.ravel()]
                    ok = pairing.possible(x, y)
                    marked[x[ok]] = marked[y[ok]] = True
        if marked.any():
            yield from rows.filter(pa.array(marked)).to_batches()


def linked_rows(batches: Iterator[pa.RecordBatch], tables: tuple[int, ...], need: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Verified links of each block, of which only those that join what was apart; sets are compared in full."""
    for rows in _blocks(batches):
        pairing = Pairing(rows, tables, need, num, den)
        g, out = pairing.col, []
        sets = rows.column("members").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
        values = sets.flatten().to_numpy()
        for first, size in zip(pairing.first, pairing.sizes):
            low, high = ends[first], ends[first + size]
            names, code = np.unique(values[low:high], return_inverse=True)
            ours = np.zeros(len(names), bool)
            label = g["label"][first : first + size].copy()
            for i in range(size - 1):
                others = np.arange(i + 1, size)
                others = others[label[others] != label[i]]
                others = others[pairing.possible(np.full(len(others), first + i), first + others)]
                if not len(others):
                    continue
                own = code[ends[first + i] - low : ends[first + i + 1] - low]
                ours[own] = True
                for j in others:
                    if label[j] == label[i]:
                        continue
                    common = int(ours[code[ends[first + j] - low : ends[first + j + 1] - low]].sum())
                    if den * common >= num * int(g["n"][first + i] + g["n"][first + j] - common):
                        out.append((int(g["id"][first + i]), int(g["id"][first + j])))
                        label[label == label[j]] = label[i]
                ours[own] = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])


def _at_distance(groups: int, size: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    left = (np.arange(groups)[:, None] * size + np.arange(size - d)[None, :])
    return left, left + d


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("label", F.col("id"))
    return keys.join(few(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))


def similar_components(items: DataFrame, keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, tables: tuple[int, ...]) -> DataFrame:
    """``(id, label)`` for every item that has a link, labels as of :func:`components`.

    ``items(id, n, sketch)``; ``keys(key, t, id)`` are the colliding rows; ``sets_of(ids)`` gives
    ``(id, members)`` for the ids asked for. ``t`` numbers the tables from 0.
    """
    with workspace(items.sparkSession) as held:
        size = 2 * tables[0] * tables[2] if len(tables) == 3 else tables[0] * tables[1]
        need = least_matches(size, num, den)
        # a key with many rows is dealt to tasks in chunks of about BLOCK rows
        chunks = F.ceil(F.col("rows") / BLOCK).cast("int")
        keys = keys.select("key", "t", "id", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("c"))
        keys = written(keys, "keys")
        ids = written(keys.select("id").distinct(), "ids", narrow=True)
        near = written(items.select("id", "n", "sketch").join(few(ids), "id"), "near")
        sets = written(sets_of(ids), "sets")

        def sketches(side: str) -> DataFrame:
            return few(near, 4 * size + 100).select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))

        def values(c: str):
            return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring(c, F.lit(1) + i * 4, 4))

        def possible(pairs: DataFrame) -> DataFrame:
            joined = pairs.join(sketches("a"), "a").join(sketches("b"), "b")
            joined = joined.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
            return joined.where(F.size(F.filter(F.zip_with(values("s_a"), values("s_b"), lambda x, y: x == y), lambda x: x)) >= need).select("a", "b")

        def confirmed(pairs: DataFrame) -> DataFrame:
            side = lambda s: sets.select(F.col("id").alias(s), F.col("members").alias(f"m_{s}"))
            both = F.size(F.array_intersect("m_a", "m_b"))
            joined = pairs.join(side("a"), "a").join(side("b"), "b")
            return joined.where(den * both >= num * (F.size("m_a") + F.size("m_b") - both)).select("a", "b")

        labels = links = None
        total = tables[0] ** 2 if len(tables) == 3 else tables[0]
        turn = F.pmod(F.col("t") * 37, F.lit(total))  # 37 is prime to both: spreads a turn's tables over the collections
        best = F.min(F.struct(F.xxhash64("id", "key").alias("p"), F.col("id").alias("rep"), F.col("label").alias("rep_label")))
        low, high = 0, STAR_TABLES
        while low < total:
            chosen = _labelled(keys.where((turn >= low) & (turn < high)), labels)
            heads = chosen.groupBy("key", "chunks", "c").agg(best.alias("r")).groupBy("key", "chunks").agg(F.min("r").alias("r"))
            edges = chosen.join(_per_chunk(heads).select("key", "c", "r.rep", "r.rep_label"), ["key", "c"]).where("label <> rep_label")
            edges = edges.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
            edges = written(possible(edges), "pairs", narrow=True)
            if labels is None or not edges.isEmpty():
                found = written(confirmed(edges), "links", narrow=True)
                links = found if links is None else links.unionByName(found)
                labels = components(links)
            low, high = high, 4 * high
        rows = _labelled(keys, labels)
        # after the star rounds one label has most rows of a large bucket: these need no pairs among themselves
        names = rows.groupBy("key", "chunks", "label").agg(F.count("*").alias("n")).groupBy("key", "chunks")
        apart = names.agg(F.count("*").alias("names"), F.sum("n").alias("rows"), F.max(F.struct("n", "label")).alias("top")).where("names > 1")
        in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        apart = apart.select("key", "chunks", F.col("top.label").alias("most"), in_blocks(F.col("top.n")).alias("ours"), in_blocks(F.col("rows") - F.col("top.n")).alias("others"))
        rows = rows.drop("chunks").join(_per_chunk(apart).drop("chunks"), ["key", "c"])
        # chunks 0 .. ours - 1 hold the label of most rows and meet only the chunks of other labels behind them
        mine, place = F.col("label") == F.col("most"), F.xxhash64("id", F.lit(1))
        rows = rows.withColumn("c", F.when(mine, F.pmod(place, F.col("ours"))).otherwise(F.col("ours") + F.pmod(place, F.col("others"))).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.when(mine, F.col("ours")).otherwise(0), F.col("ours") + F.col("others") - 1)))
        rows = rows.join(few(near, 4 * size + 100), "id").select("key", "t", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c", "id", "label", F.col("n").cast("long").alias("n"), "sketch")
        rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
        rows = written(rows.mapInArrow(lambda it: promising_rows(it, tables, need, num, den), BLOCK_ROWS), "promising", narrow=True)
        if rows.isEmpty():
            return held.keep(labels)
        rows = rows.join(sets, "id").repartition(*GROUP).sortWithinPartitions(*GROUP)
        found = rows.mapInArrow(lambda it: linked_rows(it, tables, need, num, den), "a long, b long")
        return held.keep(components(links.unionByName(written(found, "links", narrow=True))))
