"""The abstractions of the engine over the standard tables, and readers and writers of its file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.storage import few, written

#: Dense systems: how many leading dimensions each uses.
SYSTEMS = {"full": 64, "half": 32, "quarter": 16}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, dims).alias("vec"), "label")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def containing(items: DataFrame, docs: DataFrame, width: int = 5) -> DataFrame:
    """``(query_id, item_id)``: documents ``(id, text)`` whose text contains the whole text of an item ``(id, text)``.

    An equi-join on hashes of word windows finds candidates: the item's words from its second to its last
    but one (the outer ones may be part of longer words in the document) hold a window of up to ``width``
    words. Items of fewer than three words are found by their first three characters. Only ids and
    hashes are shuffled; texts are read again for the candidates, which are verified in full.
    An empty item is contained in every text and gives no rows.
    """
    words = lambda c: F.array_remove(F.split(c, r"[\s\x0B]+"), "")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    window = lambda size, at: F.xxhash64(F.lit(size), *(F.get("h", at + k) for k in range(size)))
    keyed = items.where("text <> ''").select(F.col("id").alias("query_id"), F.col("text").alias("item"), words("text").alias("w"))
    keyed = keyed.withColumn("size", F.least(F.lit(width), F.size("w") - 2)).withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(-F.least(F.lit(3), F.length("item"))))
    keyed = keyed.withColumn("h", hashes("w"))
    key = F.xxhash64("size", F.substring("item", F.lit(1), -F.col("size")))
    for size in range(1, width + 1):
        key = F.when(F.col("size") == size, window(size, F.lit(1))).otherwise(key)
    keyed = written(keyed.select("query_id", "item", "size", key.alias("key")), "items", narrow=True)
    sizes = [r.size for r in keyed.select("size").distinct().collect()]  # at most width + 3
    texts = docs.select(F.col("id").alias("item_id"), "text", hashes(words("text")).alias("h"))

    def windows(size: int):
        last = F.size("h") - size if size > 0 else F.length("text") + size
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        one = (lambda i: window(size, i)) if size > 0 else (lambda i: F.xxhash64(F.lit(size), F.substring("text", i + 1, F.lit(-size))))
        return F.when(last >= 0, F.transform(at, one)).otherwise(F.array().cast("array<long>"))

    every = F.array_distinct(F.concat(*(windows(n) for n in sizes))) if sizes else F.array().cast("array<long>")
    found = texts.select("item_id", F.explode(every).alias("key")).join(few(keyed.select("query_id", "key"), 24), "key").select("query_id", "item_id").distinct()
    found = written(found, "candidates", narrow=True)
    checked = docs.select(F.col("id").alias("item_id"), "text").join(few(found, 24), "item_id").join(few(keyed.select("query_id", "item"), 1000), "query_id")
    return checked.where(F.contains("text", F.col("item"))).select("query_id", "item_id").distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document (one row), or an array of them (a row for each), over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids as ``(pos, id)``."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "id"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements with a positive grade, once each."""
    rows = spark.read.csv(path, sep="\t", schema="query_id string, item_id string, rel int")
    return rows.where("rel > 0").select("query_id", "item_id").distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, quoted line breaks and possibly a byte-order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_rows_with_header(df: DataFrame, exact: dict[str, str], contains: dict[str, str] | None = None) -> DataFrame:
    """Columns of a sheet chosen by header: equal after trimming and lower-casing, or containing a text."""
    names = {c: c.strip().lower() for c in df.columns}
    chosen = {}
    for to, wanted in exact.items():
        chosen[to] = next((c for c, n in names.items() if n == wanted), None)
    for to, wanted in (contains or {}).items():
        chosen[to] = next((c for c, n in names.items() if wanted in n), None)
    lacking = [to for to, c in chosen.items() if c is None]
    if lacking:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    return df.select(*(F.col(f"`{c}`").alias(to) for to, c in chosen.items()))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select("query_id", "item_id", F.lit(1).alias("rel")).write.csv(path, sep="\t")


def write_csv(df: DataFrame, path: str, by: str | None = None, mark: bool = True) -> None:
    """CSV with header; with ``mark`` each file starts with a byte-order mark, as spreadsheets want it."""
    if mark:
        first = next(c for c in df.columns if c != by)
        df = df.withColumnRenamed(first, "\ufeff" + first)
        df = df.select("\ufeff" + first, *(c for c in df.columns if c != "\ufeff" + first))
    writer = df.write.option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file with a header at exactly this path: a sheet, of which one task writes all."""
    spark, folder = df.sparkSession, f"{path}._writing"
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(folder)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("part-"))
    store.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    store.delete(at, True)


def write_per_query(metrics: DataFrame, path: str) -> None:
    """Metrics per system and query, one folder for each system."""
    metrics.write.partitionBy("system").json(path)


def vector_pair(vectors: DataFrame, model: str, mode: str, questions: str, index: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """Index and question vectors ``(id, vec)`` of a model and mode from ``vectors(model, mode, input, item_id, vec)``.

    The filter reaches the partitions. No vectors, or vectors of more than one size, are an error.
    """
    chosen = vectors.where((F.col("model") == model) & (F.col("mode") == mode))
    sides = [chosen.where(F.col("input") == i).select(F.col("item_id").alias("id"), "vec") for i in (index, questions)]
    sizes = sides[0].unionByName(sides[1]).agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).first()
    lacking = [name for name, side in zip((index, questions), sides) if side.isEmpty()]
    if lacking or sizes["low"] != sizes["high"]:
        raise ValueError(f"{model}/{mode}: " + (f"no vectors of {', '.join(lacking)}" if lacking else f"vectors of {sizes['low']} to {sizes['high']} numbers"))
    return sides[0], sides[1]


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors ``(model, mode, input, pos, item_id, vec)`` partitioned so that one configuration prunes to its files."""
    df.write.partitionBy("model", "mode", "input").parquet(path)


def n_tokens(column: str = "text"):
    return F.size(tokens(F.col(column)))
