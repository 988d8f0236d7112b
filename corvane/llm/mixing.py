"""Mixing sources to target weights, block by block.

Each source's words, documents one after another in a fixed pseudorandom order, are cut into blocks
of ``BLOCK`` words. Output shards draw multinomial counts per source from what each source still has
to give; slot k of a source takes block ``perm(k mod n)`` of it, where ``perm`` is a keyed
permutation of the source's n block numbers; slots and blocks meet in a join by block number.
A source thus repeats no block before all have been used, and none more than ``MAX_PASSES`` times.

Only per-source totals and the shard counts (at most sources x ``MAX_SHARDS`` numbers) reach the
driver. Documents are never gathered by source: offsets come from sums over (source, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import kernels as K
from corvane.llm.storage import written

BLOCK, LEAST_BUCKETS, BUCKET_ROWS, SHARD_SLOTS, MAX_SHARDS, MAX_PASSES = 512, 512, 50_000, 4096, 4096, 2
SPACE = r"[\x20\x09-\x0D]+"
SEED = 20240607


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")).cast("long")


def targets(sizes: list[float], weights: list[float], share: float = 1.5, most: float = MAX_PASSES) -> list[float]:
    """Shares of ``share`` times all words by weight, none above ``most`` times its size, the excess reshared by weight."""
    result = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                result[i] = left * weights[i] / total
            break
        for i in full:
            result[i] = most * sizes[i]
        left -= sum(result[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return result


def _plan(sizes: list[int], goals: list[float]) -> tuple[np.ndarray, list[int]]:
    """Slots per (shard, source), and the words that each source's last slot gives."""
    quota = np.zeros(len(sizes), np.int64)
    last = []
    for i, (size, goal) in enumerate(zip(sizes, goals)):
        want = min(round(goal), MAX_PASSES * size)
        n = -(-size // BLOCK)
        short = size - (n - 1) * BLOCK if n else 0  # words of the last, partial block
        at = int(permute(np.array([n - 1]), n, i, back=True)[0]) if n else 0
        passes, rest = divmod(want, size) if size else (0, 0)
        # within a pass: slots before ``at`` hold BLOCK words each, slot ``at`` holds ``short``
        if rest <= at * BLOCK:
            used = -(-rest // BLOCK)
            given = rest - (used - 1) * BLOCK if used else 0
        elif rest <= at * BLOCK + short:
            used, given = at + 1, rest - at * BLOCK
        else:
            beyond = rest - at * BLOCK - short
            used = at + 1 + -(-beyond // BLOCK)
            given = beyond - (used - at - 2) * BLOCK
        quota[i] = passes * n + used
        last.append(given if used else BLOCK)
    total = int(quota.sum())
    shards = min(MAX_SHARDS, max(1, math.ceil(total / SHARD_SLOTS)))
    rng = np.random.Generator(np.random.PCG64(SEED))
    left, counts = quota.copy(), np.zeros((shards, len(sizes)), np.int64)
    for h in range(shards):
        room = -(-int(left.sum()) // (shards - h))
        while room > 0 and left.sum() > 0:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            counts[h] += drawn
            left -= drawn
            room -= int(drawn.sum())
    return counts, last


def _feistel(x: np.ndarray, half: int, source: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    turns = range(4)
    for turn in reversed(turns) if back else turns:
        key = np.uint64((SEED * 2654435761 + source * 40503 + turn * 65599) % 2**64)
        if back:
            left, right = right ^ (K.mix(left + key) & mask), left
        else:
            left, right = right, left ^ (K.mix(right + key) & mask)
    return left << np.uint64(half) | right


def permute(x: np.ndarray, n: int, source: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 (or its inverse): a Feistel network, walked until it lands below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        y = _feistel(x.astype(np.uint64), half, source, back)
        while len(out := np.flatnonzero(y >= n)):
            y[out] = _feistel(y[out], half, source, back)
    return y.astype(np.int64)


def slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of each (shard, source): which block each takes, in which pass, and how many words of it."""
    for batch in batches:
        for r in batch.to_pylist():
            k = r["first"] + np.arange(r["slots"])
            passes, at = np.divmod(k, r["n"])
            cut = np.full(len(k), BLOCK)
            cut[k == r["last"]] = r["last_words"]
            fixed = [np.full(len(k), r[c], np.int32) for c in ("source_no", "shard")]
            columns = [fixed[0], permute(at, r["n"], r["source_no"]), fixed[1], np.arange(len(k), dtype=np.int32), passes.astype(np.int32), cut.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source_no", "block", "shard", "slot", "pass", "cut"])


def source_weight(place: int) -> float:
    """Weights 3, 1, 2, repeating, by the source's place in code-point order (null last)."""
    return (3.0, 1.0, 2.0)[place % 3]


def mixed(docs: DataFrame, share: float = 1.5, weight=source_weight) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(placed, sources, spans)`` of the mix of all rows of ``docs(doc_id, text, source)``.

    ``placed(doc_id, ka, kb, source_no, bucket, rn, size, offset)`` has one row per input row;
    ``sources(source_no, source, source_size, target)``; ``spans(source_no, bucket, rn, pass, shard, slot, start, words)``
    says which words of which row each slot takes. A source's words come to its rounded target
    exactly, as the last of its slots takes a part of its block.

    A null source is a source of its own, after the others. A null text has size 0 and gives nothing.
    Equal rows are separate documents. The order within a source is by hash of the row, so reruns
    agree however the input is split. An empty table gives empty results.
    """
    spark = docs.sparkSession
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    sizes = docs.select(doc_id.alias("doc_id"), source.alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(doc_id, source, text).alias("ka"), F.xxhash64(text, F.lit(1), doc_id, source).alias("kb"))
    sizes = written(sizes, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy(F.asc_nulls_last("source")).collect()
    goals = targets([r["size"] for r in totals], [weight(i) for i in range(len(totals))], share)
    sources = spark.createDataFrame([(i, r["source"], r["size"], float(g)) for i, (r, g) in enumerate(zip(totals, goals))], "source_no int, source string, source_size long, target double")
    buckets = max(LEAST_BUCKETS, sum(r["rows"] for r in totals) // BUCKET_ROWS)
    numbers = F.broadcast(sources.select(F.col("source").alias("name"), "source_no"))  # one row for each source, collected above
    placed = sizes.join(numbers, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source").withColumn("bucket", F.pmod("ka", F.lit(buckets)).cast("int"))
    starts = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("begin", F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("words")).drop("words")
    within = Window.partitionBy("source_no", "bucket").orderBy("ka", "kb", "doc_id")
    placed = placed.withColumn("rn", F.row_number().over(within)).withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(starts, ["source_no", "bucket"]).withColumn("offset", F.col("begin") + F.col("before")).drop("begin", "before")
    placed = written(placed, "placed")

    counts, last_words = _plan([r["size"] for r in totals], goals)
    before = np.concatenate((np.zeros((1, len(totals)), np.int64), np.cumsum(counts, 0)))
    plan = [
        (i, h, int(before[h, i]), int(counts[h, i]), -(-totals[i]["size"] // BLOCK), int(before[-1, i]) - 1, int(last_words[i]))
        for h in range(len(counts)) for i in range(len(totals)) if counts[h, i]
    ]
    plan = spark.createDataFrame(plan, "source_no int, shard int, first long, slots long, n long, last long, last_words int")
    slots = plan.mapInArrow(slot_rows, "source_no int, block long, shard int, slot int, pass int, cut int")
    block = F.col("block")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {BLOCK}, (offset + size - 1) div {BLOCK})")))
    pieces = pieces.select(
        "source_no", "bucket", "rn", "block",
        F.greatest(block * BLOCK - F.col("offset"), F.lit(0)).alias("start"),
        F.greatest(F.col("offset") - block * BLOCK, F.lit(0)).alias("in_block"),
        (F.least(F.col("offset") + F.col("size"), (block + 1) * BLOCK) - F.greatest("offset", block * BLOCK)).alias("piece"),
    )
    spans = pieces.join(slots, ["source_no", "block"]).withColumn("words", F.least("piece", F.col("cut") - F.col("in_block"))).where("words > 0")
    return placed, sources, spans.select("source_no", "bucket", "rn", "pass", "shard", "slot", "start", "words")


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts reduced to their spans of words, white space within a span as it was."""
    for batch in batches:
        spans, out = batch.column("spans").to_pylist(), []
        for part in K.slices(batch.column("text")):
            words = K.find_words(part.data, part.offsets)
            for r in range(part.rows):
                first, parts = words.first[r], []
                for s in spans[part.first + r]:
                    a, b = first + s["start"], first + s["start"] + s["words"]
                    parts.append(bytes(part.data[words.start[a] : words.end[b - 1]]).decode("utf-8", "replace"))
                out.append("\n".join(parts))
        names = [n for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: one row for each document and pass, its text cut to the words taken.

    A document that a pass takes as a whole keeps its text unchanged; one that no slot takes gives no
    row. All columns are kept; ``n_chars``, where there is one, follows the new text. Null and word-less
    texts have size 0 and give nothing; a null source is one of its own. Of rows equal in doc_id, text and
    source, which the mix takes together, the first by the JSON of the whole row stands for all. An empty
    table gives an empty one.
    """
    placed, _, spans = mixed(docs)
    row = ["source_no", "bucket", "rn"]
    spans = spans.groupBy(*row, "pass").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("s"))
    joined = placed.select(*row, "ka", "kb", "size").join(spans, row)
    taken = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    # neighbouring spans run together
    merge = F.aggregate("s", F.array().cast("array<struct<start:bigint,words:bigint>>"), lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["start"] + F.element_at(a, -1)["words"] == x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), (F.element_at(a, -1)["words"] + x["words"]).alias("words"))))).otherwise(F.concat(a, F.array(F.struct(x["start"].cast("long").alias("start"), x["words"].cast("long").alias("words"))))))
    joined = joined.select("ka", "kb", "rn", "pass", (taken == F.col("size")).alias("whole"), merge.alias("spans"))
    joined = joined.groupBy("ka", "kb").agg(F.collect_list(F.struct("whole", "spans")).alias("parts"))
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select(F.struct("*").alias("d"), F.xxhash64(doc_id, source, text).alias("ka"), F.xxhash64(text, F.lit(1), doc_id, source).alias("kb"))
    rows = rows.join(joined, ["ka", "kb"])
    # equal rows share their name and all its parts: the first by the JSON of the whole row stands for all
    several = F.count("*").over(Window.partitionBy("ka", "kb")) > 1
    whole = F.when(F.col("several"), F.to_json("d"))
    rows = rows.withColumn("several", several).withColumn("at", F.row_number().over(Window.partitionBy("ka", "kb").orderBy(whole))).where("at = 1")
    rows = rows.select("d", F.explode("parts").alias("part"))
    texts = rows.select("d", F.col("d")["text"].cast("string").alias("text"), "part.spans", "part.whole")
    cut = texts.where("not whole").select(F.col("d").dropFields("text").alias("d"), "text", "spans").mapInArrow(cut_rows, texts.select(F.col("d").dropFields("text").alias("d"), "text").schema)
    both = texts.where("whole").select(F.col("d").dropFields("text").alias("d"), "text").unionByName(cut)
    columns = []
    for c in docs.columns:
        value = F.col("d")[c] if c != "text" else F.col("text")
        if c == "n_chars":
            value = F.length("text").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return both.select(*columns)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of documents."""
    placed, sources, spans = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    row = ["source_no", "bucket", "rn"]
    taken = spans.groupBy(*row).agg(F.sum("words").cast("long").alias("taken"))
    rows = placed.join(F.broadcast(sources.drop("source")), "source_no").join(taken, row, "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
