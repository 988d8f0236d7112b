"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin is cut into full pieces and a rest. A bin takes at most one piece of
each source and of each duplicate cluster (near copies where the caller has their groups, else equal
texts; and pieces of one doc_id). Bins stand in an index ordered by the room they have left and carry a bitmap of their sources and one of their
clusters; a piece goes to the first compatible bin found by walking that order upwards from its own
size, which is the tightest compatible bin there is. Pieces come largest first.

Packing is sequential by nature, so pieces are dealt at random into groups of about ``GROUP`` and
each group is packed on its own: groups grow in number, not in size, with the corpus, a hot source
or cluster is spread over all of them, and the loss is less than one open bin per source and group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.mixing import n_words
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.storage import written

CAPACITY, GROUP = 1024, 4096
PIECES = "doc_id long, ka long, kb long, source string, by_text long, by_id long, piece int, start long, words long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[tuple[int, ...]], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item, in the order given; no bin holds a source or a cluster twice."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    for i in order:
        size = sizes[i]
        source = 1 << sources[i]
        cluster = 0
        for c in clusters[i]:
            cluster |= 1 << c
        chosen = -1
        above = rooms >> size
        room = size
        while above:
            step = (above & -above).bit_length() - 1
            room += step
            for at, b in enumerate(by_room[room]):
                if not (source_bits[b] & source or cluster_bits[b] & cluster):
                    chosen = b
                    del by_room[room][at]
                    break
            if chosen >= 0:
                break
            above >>= step + 1
            room += 1
        if chosen < 0:
            chosen, room = len(source_bits), capacity
            source_bits.append(0)
            cluster_bits.append(0)
        elif not by_room[room]:
            rooms &= ~(1 << room)
        placed[i] = (chosen, capacity - room)
        source_bits[chosen] |= source
        cluster_bits[chosen] |= cluster
        if size < room:
            by_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return placed


def _numbers(values: list) -> list[int]:
    seen: dict = {}
    return [seen.setdefault(v, len(seen)) for v in values]


def _pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["ka", "kb", "piece"], kind="stable")
    # only clusters met twice need a bit
    keys = list(zip(("t",) * len(pieces), pieces["by_text"])), list(zip(("d",) * len(pieces), pieces["by_id"]))
    counts = pd.Series(keys[0] + keys[1]).value_counts()
    bits = {k: n for n, k in enumerate(counts.index[counts.to_numpy() > 1])}
    clusters = [tuple(bits[k] for k in pair if k in bits) for pair in zip(*keys)]
    sources = _numbers([None if pd.isna(s) else s for s in pieces["source"]])
    placed = best_fit(pieces["words"].tolist(), sources, clusters, capacity)
    out = pieces[["doc_id", "piece", "start", "words"]].copy()
    out["bin_id"] = [int(g) << 32 | b for g, (b, _) in zip(pieces["g"], placed)]
    out["position"] = [p for _, p in placed]
    return out[["doc_id", "piece", "start", "words", "bin_id", "position"]]


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, clusters: DataFrame | None = None) -> DataFrame:
    """``(doc_id, piece, start, words, bin_id, position)`` for every piece of every row of ``docs(doc_id, text, source)``.

    ``clusters(doc_id, component_id)`` names the duplicate cluster of documents; one that it lacks, or that
    has no doc_id, is a cluster of the rows with its text.

    ``start`` counts words of the document, ``position`` words of the bin; each word of the input is
    in exactly one bin. A row without words (null, empty, white space) gives one piece of 0 words with
    null ``bin_id`` and ``position``. A null source counts as one source, a null doc_id as no cluster. Equal rows
    are separate pieces of one cluster. Ties in size are broken by a hash of the row. An empty table gives an empty result.
    """
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, source, text).alias("ka"), F.xxhash64(text, F.lit(1), doc_id, source).alias("kb"), source.alias("source"), F.xxhash64(text).alias("by_text"), F.coalesce(doc_id, F.xxhash64(text, F.lit(2))).alias("by_id"), n_words(F.col("text")).alias("n"))
    if clusters is not None:
        # text hashes and component ids are numbers of two kinds: a component counts by its hash with a mark
        named = clusters.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.min("component_id").alias("_component"))
        rows = rows.join(named, F.col("doc_id") == F.col("_doc"), "left").withColumn("by_text", F.when(F.col("_component").isNotNull(), F.xxhash64("_component", F.lit("component"))).otherwise(F.col("by_text"))).drop("_doc", "_component")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))))
    start = F.col("piece").cast("long") * capacity
    pieces = rows.select("doc_id", "ka", "kb", "source", "by_text", "by_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("words"))
    pieces = written(pieces, "pieces")
    groups = pieces.count() // group + 1
    some = pieces.where("words > 0").withColumn("g", F.pmod(F.xxhash64("ka", "kb", "piece"), F.lit(groups)))
    packed = some.groupBy("g").applyInPandas(lambda g: _pack_group(g, capacity), "doc_id long, piece int, start long, words long, bin_id long, position long")
    nothing = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("words = 0").select("doc_id", "piece", "start", "words", nothing.alias("bin_id"), nothing.alias("position")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents; duplicate clusters are the near-duplicate groups of similarity 0.85 and more. See :func:`pack` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, clusters=near_duplicates(docs).select("doc_id", "component_id"))
