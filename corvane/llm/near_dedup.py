"""MinHash near-deduplication of documents with tensored banding.

Two collections of ``M`` small hashes (each over ``ROWS`` minhashes) are computed per document;
every pair (i, j) of one from each forms a table key. ``M * M`` tables thus cost ``2 * M * ROWS``
minhashes instead of ``M * M * 2 * ROWS``: about a square root of the work. A pair of similarity
0.85 shares at least one key with probability above 0.9999; all candidates are verified on full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import kernels as K
from corvane.llm.components import components
from corvane.llm.similar import colliding, similar_components
from corvane.llm.storage import few, workspace, written

WIDTH, M, ROWS = 5, 8, 2


def _shingles(part: K.Slice) -> K.Shingles:
    words = K.find_words(part.data, part.offsets)
    return K.shingle(K.word_hashes(part.data, words), words.first, WIDTH)


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_shingles, set name, sketch, both collections of small hashes) of each (row, text)."""
    for batch in batches:
        for part in K.slices(batch.column("text")):
            sh = _shingles(part)
            sets, a, b = K.distinct_sets(sh)
            sketch = K.minhashes(sh, 2 * M * ROWS)
            small = [np.stack([K.combine(sketch[:, (h * M + i) * ROWS : (h * M + i + 1) * ROWS], h * M + i + 1) for i in range(M)], 1) for h in (0, 1)]
            fixed = lambda m: pa.array([bytes(r) for r in m], pa.binary())
            lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, M, dtype=np.int32), m.astype(np.int64).ravel())
            rows = batch.column("row").slice(part.first, part.rows)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), fixed(sketch), lists(small[0].view(np.int64)), lists(small[1].view(np.int64))],
                ["row", "n_shingles", "name_a", "name_b", "sketch", "left", "right"],
            )


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text, ...)``.

    Words are runs outside white space after lower-casing A-Z; a document's set holds its distinct
    five-word shingles, or the whole sequence if it has fewer words. Two documents are linked if
    ``den * |A & B| >= num * |A | B|``. ``component_id`` is the smallest doc_id of the component and
    ``kept`` says whether the row has that id.

    Null or word-less texts have an empty set, no link, and stay. Identical sets are one vertex.
    Rows that repeat a doc_id count as one document: each row is returned, with the component of
    everything that carries the id. A null doc_id keeps a null component and is kept; it neither
    links nor bridges. Other columns are ignored, so their names cannot clash. An empty table gives
    an empty result.
    """
    with workspace(docs.sparkSession) as held:
        texts = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
        schema = "row long, n_shingles long, name_a long, name_b long, sketch binary, left array<long>, right array<long>"
        rows = written(texts.mapInArrow(sketch_rows, schema), "sketches")
        usable = rows.where("row is not null and n_shingles > 0")
        # one vertex for each distinct set; ``doc`` is the smallest doc_id with that set
        items = usable.groupBy("name_a", "name_b").agg(F.min("row").alias("doc"), F.max("row").alias("last"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("left").alias("left"), F.first("right").alias("right"))
        items = written(items.withColumn("id", F.monotonically_increasing_id()), "items")
        # a pair that shares a table shares a hash of the left collection: most documents end here
        lefts = items.select("id", F.posexplode("left").alias("t", "v")).select(F.xxhash64("t", "v").alias("key"), "t", "id")
        alive = written(colliding(lefts).select("id").distinct(), "alive", narrow=True)
        tables = items.join(few(alive), "id").select("id", F.posexplode("left").alias("i", "x"), "right").select("id", "i", "x", F.posexplode("right").alias("j", "y"))
        keys = colliding(tables.select(F.xxhash64("i", "j", "x", "y").alias("key"), (F.col("i") * M + F.col("j")).alias("t"), "id"))

        def sets_of(ids: DataFrame) -> DataFrame:
            wanted = written(items.join(few(ids), "id").select(F.col("doc").alias("row"), "id", "name_a", "name_b"), "wanted", narrow=True)
            return _sets(texts, wanted)

        found = similar_components(items, keys, sets_of, num, den, (M, M, ROWS))
        # a doc_id that carries several sets (rows that repeat it with other texts) ties them together
        name = F.struct("name_a", "name_b")
        several = usable.groupBy("row").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("row")
        several = written(several, "several", narrow=True)
        if not several.isEmpty():
            vertex = items.select("id", "name_a", "name_b")
            tied = usable.join(few(several), "row").join(vertex, ["name_a", "name_b"]).select("row", "id").distinct()
            tied = tied.join(tied.groupBy("row").agg(F.min("id").alias("a")), "row").select("a", F.col("id").alias("b"))
            found = components(found.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(tied))
        # sets of one row and without links stand for themselves
        shared = items.select("id", "doc", "last", "name_a", "name_b").join(few(found), "id", "left").where("label is not null or doc <> last")
        shared = written(shared.select("name_a", "name_b", "doc", F.coalesce("label", "id").alias("label")), "shared", narrow=True)
        smallest = shared.groupBy("label").agg(F.min("doc").alias("component_id"))
        shared = held.keep(written(shared.join(smallest, "label").select("name_a", "name_b", "component_id"), "shared", narrow=True))
        rows = held.keep(written(rows.select("row", "n_shingles", "name_a", "name_b"), "rows"))
    joined = rows.join(few(shared, 32), ["name_a", "name_b"], "left")
    component = F.when(F.col("row").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component_id", "row")).otherwise(F.col("row"))
    joined = joined.select(F.col("row").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted documents only; of rows that repeat an id, the one whose set has the wanted name."""
    found = texts.join(few(wanted, 40), "row").select("id", "name_a", "name_b", "text")
    return found.mapInArrow(named_set_rows, "id long, members array<long>").dropDuplicates(["id"])


def named_set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("name_a", "name_b"))
        for part in K.slices(batch.column("text")):
            sets, sa, sb = K.distinct_sets(_shingles(part))
            here = slice(part.first, part.first + part.rows)
            right = np.flatnonzero((sa.view(np.int64) == a[here]) & (sb.view(np.int64) == b[here]))
            sets = [sets[k] for k in right]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            ids = batch.column("id").slice(part.first, part.rows).take(pa.array(right))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, flat.view(np.int64))], ["id", "members"])


def one_of_each_group(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose document stands for its near-duplicate group, all columns kept.

    Links start at a similarity of 0.80: a corpus stage would rather lose a paraphrase than keep a copy.
    Rows without words are in no group and stay. Rows that repeat a kept doc_id (null ones included) with
    the same text count as copies: the first by the JSON of the whole row stays, so reruns agree.
    Extra columns go along. An empty table gives an empty result.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    with workspace(docs.sparkSession) as held:
        gone = near_duplicates(docs, num, den).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
        gone = held.keep(written(gone, "gone", narrow=True))
        repeated = docs.groupBy(doc_id.alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again")
        repeated = held.keep(written(repeated, "repeated", narrow=True))
    kept = docs.join(few(gone), doc_id == gone["_gone"], "left_anti")
    if repeated.isEmpty():
        return kept
    again = doc_id.eqNullSafe(repeated["_again"])
    several = kept.join(few(repeated), again, "left_semi").select(F.struct("*").alias("d"), doc_id.alias("doc_id"), text.alias("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.to_json("d")))
    return kept.join(few(repeated), again, "left_anti").unionByName(several.withColumn("_n", first).where("_n = 1").select("d.*"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of documents, links from a similarity of 0.85; see :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
