"""Many sheets as one table: CSV files of different headers, each with its own, and a registry of named inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import looks_like_text, nfc
from corvane.operators.checks import asserted
from corvane.operators.ingest import canonical_order, existing
from corvane.sources.tables import read_csv
from corvane.storage import few, written

#: Columns that a sheet may have; one with more is an error.
COLUMNS = 128


def read_sheets(spark: SparkSession, paths: str | list[str], columns: int = COLUMNS) -> DataFrame:
    """``(file, sheet, row, header, cells)`` of CSV files: every row after the first with its own file's header.

    ``sheet`` is the file's name without its ending, ``row`` counts from 1 in the file's order. Lock files
    (``~$...``) and backups (``....bak....``) are not read. Cells may hold line breaks, so that a file, not a
    part of one, is a task's; all files are read in one job.
    """
    wide = ", ".join(f"`{k}` string" for k in range(columns + 1))
    rows = spark.read.schema(wide).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(paths)
    name = F.col("_metadata.file_name")
    rows = rows.where(~F.startswith(name, F.lit("~$")) & ~F.contains(name, F.lit(".bak.")))
    cells = F.array(*(F.col(f"`{k}`") for k in range(columns)))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("sheet"), F.monotonically_increasing_id().alias("at"), F.col(f"`{columns}`").alias("over"), cells.alias("cells"))
    rows = written(asserted(rows, {f"a sheet with more than {columns} columns": F.col("over").isNull()}).drop("over"), "sheets")
    headers = rows.groupBy("file").agg(F.min("at").alias("first"), F.min_by("cells", "at").alias("header"))  # a row for each file
    header = F.transform("header", lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", ""))))
    return rows.join(few(written(headers.select("file", "first", header.alias("header")), "headers", narrow=True), 8 * columns), "file").where("at > first").select("file", "sheet", (F.col("at") - F.col("first")).alias("row"), "header", "cells")


def column_kind(name: Column, kinds: dict[str, tuple[str, ...]], contains: dict[str, str], blocked: tuple[str, ...]) -> Column:
    """The kind of a column by its lower-cased header: one of a kind's names, or with its part in it; null if it has a blocked part."""
    kind = F.lit(None).cast("string")
    for k, part in reversed(contains.items()):
        kind = F.when(F.contains(name, F.lit(part)), k).otherwise(kind)
    for k, names in reversed(kinds.items()):
        kind = F.when(name.isin(*names), k).otherwise(kind)
    for part in blocked:
        kind = F.when(F.contains(name, F.lit(part)), None).otherwise(kind)
    return F.when(name != "", kind)


def sheet_texts(sheets: DataFrame, kinds: dict[str, tuple[str, ...]], contains: dict[str, str], blocked: tuple[str, ...] = ()) -> DataFrame:
    """``(file, sheet, row, column, kind, text)``: the cells of :func:`read_sheets` that hold texts, in columns that each file's header names."""
    named = F.transform("header", lambda h: column_kind(h, kinds, contains, blocked))
    rows = sheets.select("file", "sheet", "row", F.posexplode(F.arrays_zip(named.alias("kind"), F.col("cells").alias("text"))).alias("column", "x"))
    rows = rows.where("x.kind IS NOT NULL AND x.text IS NOT NULL").select("file", "sheet", "row", "column", "x.kind", nfc(F.col("x.text")).alias("text"))
    return rows.where(looks_like_text(F.col("text")))


@dataclass
class Input:
    """A named input: a JSONL or CSV file with an id and a text column. ``kind`` decides whether a prompt applies.

    ``order`` is a JSON list of ids that fixes the canonical order of the rows; without it they stand by id.
    """

    path: str
    kind: str
    id: str
    text: str
    order: str | None = None


def discovered(spark: SparkSession, inputs: dict[str, Input]) -> DataFrame:
    """``(input, kind, pos, id, text)`` of those inputs whose files are there; an id of an order that its file lacks is an error."""
    there = existing(spark, {n: i.path for n, i in inputs.items()})
    orders = existing(spark, {n: i.order for n, i in inputs.items() if n in there and i.order})
    parts = []
    for name, path in there.items():
        i = inputs[name]
        rows = read_csv(spark, path) if path.endswith(".csv") else spark.read.json(path)
        rows = rows.select(F.col(i.id).cast("string").alias("id"), nfc(F.col(i.text)).alias("text"))
        if name in orders:
            ids = spark.read.text(orders[name], wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "id"))
            rows = asserted(ids.join(rows.withColumn("_there", F.lit(True)), "id", "left"), {f"{name}: an id of the order without a row": F.col("_there")})
        else:
            rows = canonical_order(rows.withColumn("_one", F.lit(0)), "_one", "_one", "id")
        parts.append(rows.select(F.lit(name).alias("input"), F.lit(i.kind).alias("kind"), F.col("pos").cast("long").alias("pos"), "id", "text"))
    out = spark.createDataFrame([], "input string, kind string, pos long, id string, text string")
    for part in parts:
        out = out.unionByName(part)
    return out
