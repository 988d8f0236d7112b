"""Exact top-k inner-product search by best-first traversal of an M-tree whose upper level is spread over the cluster.

Vectors become integers ``floor(256 * x)``. One more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm,
turns the order of inner products with a query into the order of Euclidean distances from it, so a
metric tree applies. Scores are integers, ties are never pruned, so the result is exact.

* The root holds up to ``PIVOTS`` routing vectors, drawn by hash. Every vector goes to its nearest one and
  stores that distance; a routing vector's largest distance is its covering radius. A routing vector
  with many rows (a dense cluster) is cut into cells of about ``SHARD`` rows.
* Each cell's subtree is built once and written as a table of pages: a routing vector, its covering radius and
  the distance to its parent's; a leaf also has up to ``PAGE`` entries with their distances to its vector.
* A query visits routing vectors in the order of their lower bounds, in rounds of growing length: the
  first alone, then the next 4, 16, and so on, but only those that can still beat its k-th score. In a
  cell it expands the page of smallest lower bound first, and skips pages and entries by stored distances
  and the triangle inequality without computing theirs.

The driver holds the routing vectors and a row of sizes for each (``PIVOTS`` at most, whatever the table's size);
visits, pages and results are tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.storage import few, workspace, written

SCALE, K, PAGE, FANOUT, SHARD, QUERIES, PIVOTS, PER_PIVOT = 256, 5, 128, 16, 16_384, 4_096, 1_024, 2_048
#: Components beyond are clipped, so that they fit a long; scores beyond a long take its end.
MOST = 2.0**55


@dataclass
class Node:
    """A page: routing vector, covering radius, distance to the parent's vector, and either children or entries."""

    center: np.ndarray
    radius: float
    up: float = 0.0
    ids: np.ndarray | None = None  # of a leaf, with vectors and distances to the center
    vectors: np.ndarray | None = None
    to_center: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None  # of the children, filled when the tree is complete


def extended(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes their norms ``sqrt(most)``."""
    v = vectors.astype(np.float64)
    return np.concatenate((v, np.sqrt(np.maximum(most - (v * v).sum(1), 0.0))[:, None]), 1)


def build(ids: np.ndarray, vectors: np.ndarray, most: float, page: int = PAGE) -> Node:
    points, rng = extended(vectors, most), np.random.default_rng(7)

    def grow(rows: np.ndarray, parent: np.ndarray | None) -> Node:
        center = points[rows].mean(0)
        from_center = np.sqrt(((points[rows] - center) ** 2).sum(1))
        up = 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))
        node = Node(center, float(from_center.max()) if len(rows) else 0.0, up)
        if len(rows) <= page:
            node.ids, node.vectors, node.to_center = ids[rows], vectors[rows], from_center
            return node
        n = min(FANOUT, -(-len(rows) // page))
        seeds = points[rng.choice(rows, n, replace=False)]
        near = (-2 * points[rows] @ seeds.T + (seeds**2).sum(1)).argmin(1)
        parts = [rows[near == k] for k in range(n) if (near == k).any()]
        if len(parts) < 2:  # equal vectors: any cut is as good
            parts = np.array_split(rows, n)
        node.children = [grow(p, center) for p in parts]
        return node

    return complete(grow(np.arange(len(ids)), None))


def complete(node: Node) -> Node:
    if node.children:
        node.centers = np.stack([c.center for c in node.children])
        for c in node.children:
            complete(c)
    return node


PAGES = "node int, parent int, center binary, radius double, up double, ids binary, vectors binary, to_center binary"


def page_rows(root: Node) -> pd.DataFrame:
    """A row for each page, parents before children."""
    rows, queue = [], [(root, -1)]
    while queue:
        node, parent = queue.pop(0)
        leaf = [None] * 3 if node.ids is None else [node.ids.astype(np.int64).tobytes(), node.vectors.astype(np.int64).tobytes(), node.to_center.tobytes()]
        queue += [(c, len(rows)) for c in node.children]
        rows.append([len(rows), parent, node.center.tobytes(), node.radius, node.up, *leaf])
    return pd.DataFrame(rows, columns=PAGES.replace(",", "").split()[::2])


def from_pages(rows: pd.DataFrame) -> Node:
    nodes: dict[int, Node] = {}
    for r in rows.sort_values("node").itertuples():
        node = Node(np.frombuffer(r.center), r.radius, r.up)
        if r.ids is not None:
            node.ids = np.frombuffer(r.ids, np.int64)
            node.vectors = np.frombuffer(r.vectors, np.int64).reshape(len(node.ids), -1)
            node.to_center = np.frombuffer(r.to_center)
        nodes[r.node] = node
        if r.parent >= 0:
            nodes[r.parent].children.append(node)
    return complete(nodes[0])


class Search:
    """Best-first search of one tree; ``computed`` counts distances and scores."""

    def __init__(self, root: Node, most: float):
        self.root, self.most, self.computed = root, most, 0
        self.plain = 4 * most < 2.0**52  # sums of products are exact in double precision

    def best(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """``(score, id)`` of the k best rows but the query's own, best first; those under ``least`` (a k-th score so far) may lack."""
        q = np.append(query.astype(np.float64), 0.0)
        norm = float((q * q).sum())
        slack = 1e-6 * (1 + norm + self.most)  # covers rounding; ties are never pruned
        plain = self.plain and 4 * norm < 2.0**52
        weights = query.astype(np.float64) if plain else query.astype(object)
        found: list[tuple[int, int]] = []  # (score, -id), a heap of the k best
        square = lambda score: max(norm + self.most - 2.0 * score, 0.0)
        limit = np.inf if least is None else square(least)  # squared distance of the k-th
        distance = float(np.sqrt(((q - self.root.center) ** 2).sum()))
        self.computed += 1
        queue = [(max(distance - self.root.radius, 0.0), 0, distance, self.root)]
        turn = 0
        while queue:
            bound, _, distance, node = heapq.heappop(queue)
            if bound * bound > limit + slack:
                break
            reach = float(np.sqrt(limit + slack)) if limit < np.inf else np.inf
            if node.ids is None:
                near = [j for j, c in enumerate(node.children) if abs(distance - c.up) - c.radius <= reach]
                self.computed += len(near)
                apart = np.sqrt(((node.centers[near] - q) ** 2).sum(1)) if near else []
                for j, d in zip(near, apart):
                    low = max(float(d) - node.children[j].radius, 0.0)
                    if low * low <= limit + slack:
                        turn += 1
                        heapq.heappush(queue, (low, turn, float(d), node.children[j]))
                continue
            rows = np.flatnonzero((np.abs(distance - node.to_center) <= reach) & (node.ids != own))
            self.computed += len(rows)
            vectors = node.vectors[rows]
            scores = (vectors.astype(np.float64) if plain else vectors.astype(object)) @ weights
            if len(found) == k:
                good = scores >= found[0][0]
                rows, scores = rows[good], scores[good]
            if len(rows) > k:  # only the k best of a page can matter
                top = np.lexsort((node.ids[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
            for s, i in zip(scores.tolist(), node.ids[rows].tolist()):
                entry = (int(s), -i)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            if len(found) == k:
                limit = min(limit, square(found[0][0]))
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def integer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, floor(256 * x) as bytes of 64-bit integers)."""
    for batch in batches:
        vectors = batch.column("embedding")
        flat = np.floor(np.clip(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -MOST, MOST)).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))))
        out = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        norms = [float((flat[a:b].astype(np.float64) ** 2).sum()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, np.int64)[:width]
        out[i, : len(row)] = row
    return out


def _apart(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


class Root:
    """The upper level: routing vectors and, once all vectors are assigned, their covering radii."""

    def __init__(self, pivots: np.ndarray, most: float, width: int):
        self.pivots, self.most, self.width = pivots, most, width
        self.low = self.high = np.zeros(0)

    def assigned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each vector's routing vector and the distance to it."""
        for batch in batches:
            if batch.num_rows:
                apart = _apart(extended(_matrix(batch.column("v").to_pylist(), self.width), self.most), self.pivots)
                near = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(apart[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "apart"])

    def visits(self, batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
        """The routing vectors at places ``first`` to ``last`` of each query's order that can beat its k-th score."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v").to_pylist(), self.width).astype(np.float64)
            apart = _apart(np.concatenate((q, np.zeros((len(q), 1))), 1), self.pivots)
            # a computed distance is off by the rounding of squares as large as norms
            off = 1e-6 * np.sqrt(1 + (q * q).sum(1) + self.most)[:, None]
            bound = np.maximum(np.maximum(apart - self.high, self.low - apart) - off, 0.0)
            order = np.lexsort((apart, bound), axis=1)[:, first:last]
            norm = (q * q).sum(1)
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            limit = np.where(np.isnan(kth), np.inf, norm + self.most - 2 * kth + 1e-6 * (1 + norm + self.most))
            chosen = np.take_along_axis(bound, order, 1) ** 2 <= limit[:, None]
            row, at = np.nonzero(chosen)
            at = pa.array(order[row, at].astype(np.int32))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("query_id", "v", "kth")), at], ["query_id", "v", "kth", "pivot"])


def _saturated(score: int) -> int:
    return min(max(score, -(2**63)), 2**63 - 1)


FOUND = "query_id long, vec_id long, score long, computed long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = QUERIES, per_pivot: int = PER_PIVOT) -> DataFrame:
    """``(query_id, rank, vec_id, score, computed)``: the k rows of ``vectors`` with the largest integer inner product, ties to the smaller vec_id.

    ``computed`` is the number of distances and scores that the query's search needed in the cells.
    Both inputs have ``(vec_id, embedding)``. Rows with a null id, a null vector, or a null or non-finite
    component take no part; a shorter vector counts as padded with zeros. A candidate with the query's
    id is the query itself. Rows that repeat id and vector count once; a query id with several vectors is
    one query, scored by the best of them. Components beyond 2^55 / 256 are clipped, scores beyond a long
    take its end. With fewer than k candidates all are returned; without queries or candidates nothing is.
    """

    def usable(df: DataFrame) -> DataFrame:
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.where("vec_id is not null and embedding is not null").where(~bad).mapInArrow(integer_rows, "vec_id long, v binary, norm double").distinct()

    with workspace(vectors.sparkSession) as held:
        data, asked = written(usable(vectors), "vectors"), written(usable(queries), "queries")
        size = data.agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.max(F.length("v")).alias("width")).first()
        seeds = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(PIVOTS, max(1, -(-size["n"] // per_pivot)))).select("v").collect()
        width = (size["width"] or 0) // 8
        width = max(width, 1)
        root = Root(extended(_matrix([r.v for r in seeds], width), size["most"] or 0.0), size["most"] or 0.0, width)

        routed = written(data.select("vec_id", "v").mapInArrow(root.assigned, "vec_id long, v binary, pivot int, apart double"), "routed")
        sizes = {r.pivot: r for r in routed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high")).collect()}
        root.low = np.array([sizes[p]["low"] if p in sizes else np.inf for p in range(len(seeds))])
        root.high = np.array([sizes[p]["high"] if p in sizes else -np.inf for p in range(len(seeds))])
        cells = vectors.sparkSession.createDataFrame([(p, max(1, -(-r["n"] // shard))) for p, r in sizes.items()], "pivot int, chunks int")
        cells = F.broadcast(cells)  # a row for each routing vector
        chunk = F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int")
        most = root.most

        def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            pages = page_rows(build(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"].tolist(), width), most))
            pages.insert(0, "pivot", np.int32(key[0]))
            pages.insert(1, "chunk", np.int32(key[1]))
            return pages

        pages = routed.join(cells, "pivot").withColumn("chunk", chunk).groupBy("pivot", "chunk").applyInPandas(built, f"pivot int, chunk int, {PAGES}")
        pages = written(pages, "pages")

        def searched(tree: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int, int | None, int]] = []
            if len(tree) and len(visits):
                search = Search(from_pages(tree), most)
                for own, v, kth in zip(visits["query_id"].tolist(), _matrix(visits["v"].tolist(), width), visits["kth"]):
                    search.computed = 0
                    best = search.best(own, v, k, None if pd.isna(kth) else int(kth))
                    out += [(own, i, _saturated(s), 0) for s, i in best] + [(own, -1, None, search.computed)]
            # whole numbers column by column: a frame of tuples would make scores beside nulls floats
            return pd.DataFrame({c: pd.array([x[n] for x in out], dtype="Int64") for n, c in enumerate(("query_id", "vec_id", "score", "computed"))})

        best, first, last = None, 0, 1
        while first < len(seeds):
            state = asked.select(F.col("vec_id").alias("query_id"), "v")
            if best is None:
                state = state.withColumn("kth", F.lit(None).cast("long"))
            else:
                ends = best.where("score is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
                state = state.join(few(written(ends.select("query_id", "kth"), "ends", narrow=True)), "query_id", "left")
            visits = written(state.mapInArrow(lambda it, a=first, b=last: root.visits(it, a, b), "query_id long, v binary, kth long, pivot int"), "visits")
            blocks = visits.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(cells, "pivot")
            blocks = written(blocks, "blocks", narrow=True)  # a row for each routing vector at most
            if blocks.isEmpty() and best is not None:
                break
            every = lambda c: F.explode(F.expr(f"sequence(0, {c} - 1)"))
            left = pages.join(F.broadcast(blocks), "pivot").withColumn("block", every("blocks")).drop("blocks", "chunks")
            right = visits.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int"))
            right = right.withColumn("chunk", every("chunks")).select("pivot", "chunk", "block", "query_id", "v", "kth")
            keys = ("pivot", "chunk", "block")
            found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(searched, FOUND)
            found = found if best is None else found.unionByName(best)
            hits = found.where("score is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.lit(0).cast("long").alias("computed"))
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            counts = found.where("score is null").groupBy("query_id").agg(F.lit(-1).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("score"), F.sum("computed").alias("computed"))
            best = written(hits.withColumn("_n", place).where(F.col("_n") <= k).drop("_n").unionByName(counts), "best")
            first, last = last, 5 * last
        if best is None:
            best = written(vectors.sparkSession.createDataFrame([], FOUND), "best")
        held.keep(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    counts = best.where("score is null").select("query_id", "computed")
    return best.where("score is not null").drop("computed").withColumn("rank", rank).join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "computed")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the 5 best of all embeddings for those whose id is divisible by 50; see :func:`top_k` for odd rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 5"""
