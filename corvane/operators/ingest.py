"""From sheets, files and exports to tables with keys and one canonical order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.functions.text import md5_number, nfc
from corvane.operators.checks import require_none
from corvane.operators.order import numbered, numbered_within


def _named(df: DataFrame, wanted: tuple[str, ...]) -> dict[str, str]:
    """Columns of a sheet by header, trimmed and lower-cased; the first of equal ones."""
    found: dict[str, str] = {}
    for c in df.columns:
        found.setdefault(c.strip().lower(), c)
    lacking = [w for w in wanted if w not in found]
    if lacking:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    return {w: found[w] for w in wanted}


def _cell(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def coverage_cases(sheet: DataFrame, pos: str = "pos") -> DataFrame:
    """``(pos, case_id, question, expected)`` of a sheet with columns Case, Question and Expected and its row order in ``pos``.

    Rows with either text empty go. Texts are NFC and stripped. A row without a case is named ``row<n>``,
    n being the number of rows kept before it.
    """
    at = _named(sheet, ("case", "question", "expected"))
    rows = sheet.select(F.col(pos).alias("pos"), F.trim(_cell(at["case"])).alias("case"), nfc(_cell(at["question"])).alias("question"), nfc(_cell(at["expected"])).alias("expected"))
    rows = numbered(rows.where("question <> '' and expected <> ''"), ["pos"], "n")
    return rows.select("pos", F.when(F.col("case") != "", F.col("case")).otherwise(F.concat(F.lit("row"), F.col("n").cast("string"))).alias("case_id"), "question", "expected")


def question_lookup(sheet: DataFrame, pos: str = "pos") -> DataFrame:
    """``(case_id, question)`` of a sheet with Case and Question: blank cases go, of equal ones the last wins."""
    at = _named(sheet, ("case", "question"))
    rows = sheet.select(F.col(pos).alias("pos"), F.trim(_cell(at["case"])).alias("case_id"), F.trim(_cell(at["question"])).alias("question")).where("case_id <> ''")
    return rows.groupBy("case_id").agg(F.max_by("question", "pos").alias("question"))


def question_set(sheet: DataFrame, number: str = "stt", text: str = "cau_hoi") -> DataFrame:
    """``(id, text)`` of a numbered question sheet; rows without number or text go, a repeated number is an error."""
    at = _named(sheet, (number, text))
    rows = sheet.where(F.col(f"`{at[number]}`").isNotNull()).select(F.trim(_cell(at[number])).alias("id"), nfc(_cell(at[text])).alias("text")).where("text <> ''")
    require_none(rows.groupBy("id").count().where("count > 1").select("id"), "repeated question numbers")
    return rows


def text_columns(sheet: DataFrame, kinds: dict[str, tuple[str, ...]], contains: dict[str, str], blocked: tuple[str, ...] = ()) -> DataFrame:
    """``(text, kind)``: the columns of a sheet that hold texts, one row for each non-empty cell.

    A column is of a kind if its header is one of the kind's names, or has the kind's part in it; a
    header with a blocked part is of none.
    """
    pairs = []
    for c in sheet.columns:
        name = c.strip().lower()
        if any(b in name for b in blocked):
            continue
        kind = next((k for k, names in kinds.items() if name in names), None) or next((k for k, part in contains.items() if part in name), None)
        if kind:
            pairs.append(F.struct(_cell(c).alias("text"), F.lit(kind).alias("kind")))
    if not pairs:
        return sheet.sparkSession.createDataFrame([], "text string, kind string")
    return sheet.select(F.explode(F.array(*pairs)).alias("x")).select("x.text", "x.kind").where(F.trim("text") != "")


def dataset_rows(datasets: dict[str, DataFrame], seed: int | None = None) -> DataFrame:
    """``(dataset, pos, id, text)`` of data sets ``(id, text)``: empty texts go; with a seed the order is by MD5 of seed, name and id."""
    parts = [df.select(F.lit(name).alias("dataset"), F.col("id").cast("string").alias("id"), "text") for name, df in datasets.items()]
    rows = reduce(DataFrame.unionByName, parts).where("text is not null and text <> ''")
    key = F.lit(0) if seed is None else md5_number(F.concat_ws(":", F.lit(str(seed)), "dataset", "id"))
    rows = numbered(rows.withColumn("_h", key), ["dataset", "_h", "id"], "_n")
    first = rows.groupBy("dataset").agg(F.min("_n").alias("_first"))
    return rows.join(F.broadcast(first), "dataset").select("dataset", (F.col("_n") - F.col("_first")).alias("pos"), "id", "text")  # a row for each data set


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Those of the named paths that are there, in their order."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {name: p for name, p in paths.items() if path(p).getFileSystem(conf).exists(path(p))}


def normalised(df: DataFrame) -> DataFrame:
    """Dates and times as ISO strings, also inside arrays, structs and map values; other columns as they are.

    Times have nine digits of a second; those that name an instant end in the session's offset from UTC.
    """

    def timed(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(timed(f.dataType) for f in kind.fields)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return timed(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)
        return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))

    def one(c: Column, kind: T.DataType) -> Column:
        if not timed(kind):
            return c
        if isinstance(kind, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSxxx")
        if isinstance(kind, T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: one(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: one(x, kind.valueType))
        return F.when(c.isNotNull(), F.struct(*(one(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))

    return df.select(*(one(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def over_edges(sources: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """A pattern of two nodes and an edge: ``sources(source, ...)``, ``edges(source, target, ...)`` and ``targets(target, ...)`` joined.

    Every edge with both ends gives a row, parallel ones too. Predicates on a node's columns reach its scan.
    """
    return edges.join(sources, "source").join(targets, "target")


def in_all(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    return reduce(DataFrame.intersect, (t.select(key) for t in tables))


def canonical_order(chunks: DataFrame, doc: str, index: str, *more: str) -> DataFrame:
    """Adds ``pos``, the place (from 0) by document number and chunk number; ``more`` columns break ties."""
    return numbered(chunks, [F.col(doc).cast("long"), F.col(index).cast("long"), *more], "pos")


def in_canonical_order(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``pos`` of ``order(key, pos)``; an id of the order without a row is an error."""
    require_none(order.select(key).join(rows.select(key).distinct(), key, "left_anti"), "ids of the order without a row")
    return rows.join(order.select(key, "pos"), key)


def ordered_facts(facts: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of known chunks with ``pos`` by (place of the chunk, k), and ``(chunk_id, n)`` of the unknown chunks whose facts go."""
    known = facts.join(order.select("chunk_id", F.col("pos").alias("_chunk_pos")), "chunk_id")
    unknown = facts.join(order.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.count("*").alias("n"))
    return numbered(known, ["_chunk_pos", "k"], "pos").drop("_chunk_pos"), unknown


def restricted(facts: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Facts whose key is among ``ids``, and ``(n_kept, n_skipped)``."""
    known = ids.select(key).distinct().withColumn("_known", F.lit(True))
    counts = facts.select(key).join(known, key, "left").agg(F.count("_known").alias("n_kept"), (F.count("*") - F.count("_known")).alias("n_skipped"))
    return facts.join(known.drop("_known"), key, "left_semi"), counts


def with_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with their chunk's columns; a fact of no chunk is an error."""
    require_none(facts.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "facts of unknown chunks")
    return facts.join(chunks, "chunk_id")


def group_ids(rows: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Adds ``sample_id``: the group's name and a running number of four digits (more if needed) in the order ``by``.

    A group of any size: places come from one global order, less the group's first.
    """
    number = (F.col("_n") + 1).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered_within(rows, [group], by, "_n").withColumn("sample_id", F.concat_ws("-", group, padded)).drop("_n")


def first_appearance(rows: DataFrame, key: str, seq: str, name: str = "ordinal") -> DataFrame:
    """Adds the place (from 0) of the row's key among the keys by first appearance in ``seq``; keys are few (models, configurations)."""
    firsts = rows.groupBy(key).agg(F.min(seq).alias("_first"))
    places = firsts.select(key, (F.row_number().over(Window.orderBy("_first", key)) - 1).cast("int").alias(name))
    return rows.join(places, key)
