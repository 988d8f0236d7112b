"""BM25: postings from one pass over the texts, and a walk over blocks of documents that leaves out what cannot rank."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.order import ranked
from corvane.storage import few, workspace, written

#: Saturation and length weights.
K1, B = 1.5, 0.75
#: Scores are compared to so many decimals: below lies only the noise of the order of summation.
BM25_DIGITS = 9
#: Postings of a shard, query terms of a strip, documents of a block.
SHARD_ROWS, STRIP_ROWS, BLOCK = 1 << 22, 1 << 20, 8_192
#: Postings for which a task of its own pays, and what bounds are given for the rounding of scores.
LEAST_ROWS, SLACK = 50_000, 1e-8


@dataclass
class Walk:
    """Queries against one shard of postings, block by block, each query with its running k-th best score.

    A block knows every term's largest contribution in it. A query whose sum of largest contributions stays
    below its k-th score skips the block. Otherwise its lists are added, the most promising first, until
    the lists that are left cannot lift a new document to the k-th score; these are then looked up only
    for the documents that can still get there.
    """

    k: int
    items: np.ndarray  # of the shard, ascending
    terms: np.ndarray
    lists: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # first item, then by term: start, end, largest; postings: item, part
    scored: int = 0
    best: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def over(cls, k: int, item: np.ndarray, term: np.ndarray, part: np.ndarray, block: int = BLOCK) -> Walk:
        items, place = np.unique(item, return_inverse=True)
        terms, number = np.unique(term, return_inverse=True)
        key = (place // block * max(len(terms), 1) + number) * block + place % block
        key, inverse = np.unique(key, return_inverse=True)
        part = np.bincount(inverse, part, len(key))  # of one item and term there is one posting
        lists = []
        for b in range(-(-len(items) // block)):
            low, high = np.searchsorted(key, (b * len(terms) * block, (b + 1) * len(terms) * block))
            number, place = np.divmod(key[low:high] - b * len(terms) * block, block)
            edges = np.searchsorted(number, np.arange(len(terms) + 1))
            largest, there = np.zeros(len(terms)), np.flatnonzero(np.diff(edges))
            largest[there] = np.maximum.reduceat(part[low:high], edges[there])
            lists.append((b * block, edges[:-1], edges[1:], largest, place, part[low:high]))
        return cls(k, items, terms, lists)

    def run(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Adds to ``best`` for the queries whose weighted terms these are."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        there = self.terms[at] == term
        order = np.argsort(query[there], kind="stable")
        query, at, weight = query[there][order], at[there][order], weight[there][order]
        names, first = np.unique(query, return_index=True)
        number = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(query))))
        ends = np.append(first[1:], len(query))
        least = np.full(len(names), -np.inf)
        for base, start, end, largest, place, part in self.lists:
            size = int(place.max(initial=-1)) + 1
            most = weight * largest[at]
            bound = np.bincount(number, most, len(names))
            for q in np.flatnonzero((bound > 0) & (bound + SLACK >= least)):
                own = np.arange(first[q], ends[q])
                own = own[most[own] > 0]
                own = own[np.argsort(-most[own], kind="stable")]
                found, scores = self._block(size, least[q], [(start[at[t]], end[at[t]], weight[t]) for t in own], np.cumsum(most[own][::-1])[::-1], place, part)
                items, scores = self.items[base + found], np.round(scores, BM25_DIGITS)
                if names[q] in self.best:
                    items, scores = np.append(self.best[names[q]][0], items), np.append(self.best[names[q]][1], scores)
                top = np.lexsort((items, -scores))[: self.k]
                self.best[names[q]] = items[top], scores[top]
                if len(top) == self.k:
                    least[q] = scores[top[-1]]

    def _block(self, size: int, least: float, lists: list[tuple[int, int, float]], rest: np.ndarray, place: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block that can be among the k best, with their scores; ``rest`` bounds a list and those after it."""
        sums, n = np.zeros(size), 0
        while n < len(lists) and rest[n] + SLACK >= least:
            a, b, weight = lists[n]
            sums[place[a:b]] += weight * part[a:b]
            self.scored += b - a
            n += 1
            if size > self.k and n % 4 == 0:
                least = max(least, np.partition(sums, -self.k)[-self.k])
        if n == len(lists):
            found = np.flatnonzero(sums)
            return found, sums[found]
        found = np.flatnonzero(sums + rest[n] + SLACK >= least)
        for a, b, weight in lists[n:]:
            at = a + np.minimum(np.searchsorted(place[a:b], found), b - a - 1)
            hit = place[at] == found
            sums[found[hit]] += weight * part[at[hit]]
            self.scored += int(hit.sum())
        found = found[sums[found] > 0]
        return found, sums[found]


def _cell(rows: pa.Table, k: int) -> pa.Table:
    asked = rows["is_query"].to_numpy()
    of, term, weight = (rows[c].to_numpy() for c in ("id", "term", "weight"))
    walk = Walk.over(k, of[~asked], term[~asked], weight[~asked])
    walk.run(of[asked], term[asked], weight[asked])
    sizes = [len(i) for i, _ in walk.best.values()]
    gather = lambda n, kind: np.concatenate([b[n] for b in walk.best.values()]) if walk.best else np.zeros(0, kind)
    return pa.table({"query_id": np.repeat(np.array(list(walk.best), np.int64), sizes), "item_id": gather(0, np.int64), "score": gather(1, np.float64)})


class Postings:
    """What BM25 needs of the documents ``(id, text)`` for the queries ``(id, text)``, from one pass over the texts.

    The postings are written cut to the queries' terms, with one row of no term for each document that
    carries its length. Words, not texts, are shuffled. Where ``docs`` has a column ``words``, these are taken.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame):
        self.spark = queries.sparkSession
        words = F.col("words") if "words" in docs.columns else tokens(F.col("text"))
        asked = queries.select(F.col("id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
        asked = written(asked, "asked_words", narrow=True)
        used = asked.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
        used = written(used.unionByName(self.spark.sql("select '' as word, -1L as term")), "used", narrow=True)
        self.terms = written(asked.join(few(used, 40), "word").select("query_id", "term", "times"), "terms", narrow=True)
        words = docs.select(F.col("id").cast("long").alias("item_id"), words.alias("words"))
        words = words.select("item_id", F.size("words").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("words", F.array().cast("array<string>")))).alias("word"))
        rows = words.join(few(used, 40), "word").groupBy("item_id", "len", "term").agg(F.count("*").alias("tf"))
        rows = written(rows, "postings")
        self.lengths = rows.where("term < 0").select("item_id", F.greatest("len", F.lit(0)).alias("len"))
        self.rows = rows.where("term >= 0")

    def _weighted(self) -> tuple[DataFrame, DataFrame]:
        """``(query_id, term, weight)``, and ``(item_id, term, part)``: a score is the sum of weight times part."""
        total = self.lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
        df = self.rows.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = self.terms.join(df, "term").crossJoin(F.broadcast(total)).select("query_id", "term", (idf * F.col("times")).alias("weight"))  # one row of totals
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        return weighted, self.rows.crossJoin(F.broadcast(total)).select("item_id", "term", part.alias("part"))

    def scores(self) -> DataFrame:
        """``(query_id, item_id, score)`` for every document that shares a term with the query: all pairs, untruncated."""
        weighted, parts = self._weighted()
        return parts.join(weighted, "term").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), BM25_DIGITS).alias("score"))

    def best(self, k: int) -> DataFrame:
        """``(query_id, item_id, score)``: at least the k best of each query.

        A grid of bounded cells (shard of postings x strip of queries), each walked in one task; k rows of
        a query leave it.
        """
        postings, asked = self.rows.count(), self.terms.count()
        shards = max(-(-postings // SHARD_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-postings // LEAST_ROWS)), 1)
        strips = max(1, -(-asked // STRIP_ROWS))
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        weighted, parts = self._weighted()
        left = parts.select(place("item_id", shards).alias("shard"), every(strips).alias("strip"), F.col("item_id").alias("id"), "term", F.col("part").alias("weight"), F.lit(False).alias("is_query"))
        right = weighted.select(every(shards).alias("shard"), place("query_id", strips).alias("strip"), F.col("query_id").cast("long").alias("id"), "term", "weight", F.lit(True).alias("is_query"))
        # as many partitions as keep cells apart: by their bytes alone several would share a task
        return left.unionByName(right).repartition(2 * shards * strips, "shard", "strip").groupBy("shard", "strip").applyInArrow(lambda rows: _cell(rows, k), "query_id long, item_id long, score double")

    def matching(self, items: DataFrame) -> DataFrame:
        """``(query_id, item_id)`` with a term in common, for ``items(item_id)`` of a known small number."""
        return self.rows.join(F.broadcast(items), "item_id", "left_semi").select("item_id", "term").join(self.terms, "term").select("query_id", "item_id").distinct()


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, item_id, score)`` for every document ``(id, text)`` that shares a term with the query ``(id, text)``.

    Repeated query terms count repeatedly.
    """
    return Postings(queries, docs).scores()


def bm25_ranking(queries: DataFrame, docs: DataFrame, k: int = 100, pad: bool = True) -> DataFrame:
    """Always min(k, N) documents per query if ``pad``: those without a common term follow with score 0, by id.

    The first k ids are enough to pad from: with m < k matches, at least k - m of them are unmatched.
    """
    with workspace(queries.sparkSession) as held:
        postings = Postings(queries, docs)
        best = written(ranked(postings.best(k), k), "bm25")
        return held.keep(written(_padded(queries, postings, best, k), "padded") if pad else best)


def _padded(queries: DataFrame, postings: Postings, best: DataFrame, k: int) -> DataFrame:
    first = postings.lengths.select("item_id").distinct().orderBy("item_id").limit(k)  # k rows
    short = queries.select(F.col("id").alias("query_id")).join(best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    fill = short.crossJoin(F.broadcast(first)).join(postings.matching(first), ["query_id", "item_id"], "left_anti")
    return ranked(best.select("query_id", "item_id", "score").unionByName(fill.withColumn("score", F.lit(0.0))), k)
