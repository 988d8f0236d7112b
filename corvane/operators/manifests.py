"""Manifests of encoding runs, prompts, configurations, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest entry; ``modes`` of a manifest is a map from mode to a map from input to entry.
ENTRY = (
    "struct<n: long, kind: string, prompt: string, max_seq_length: int, batch_size: int, tokens_total: long, tokens_max: long, tokens_truncated: long, "
    "encode_seconds: double, items_per_second: double, tokens_per_second: double, batch_seconds: struct<p50: double, p95: double, first: double>, "
    "single_item_latency_ms: struct<p50: double, p95: double>, identical_to_mode: string>"
)
MODES = f"map<string, map<string, {ENTRY}>>"
#: What runs used before the manifest recorded window and batch, and the notes of a row.
LEGACY_WINDOW, LEGACY_BATCH = 2048, 32


def model_and_mode(name: Column) -> tuple[Column, Column]:
    """``model[/mode]``, the mode being ``no_instruct`` if none is given."""
    parts = F.split(name, "/", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("no_instruct"))


def first_or(values: Column, default: str = "<none>") -> Column:
    """The first element; the default for a null or empty array."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))


def clipped(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def prompt_rows(inputs: DataFrame, models: DataFrame, modes: tuple[str, ...] = ("no_instruct", "instruct")) -> DataFrame:
    """``(model, input, kind, mode, prompt)`` for ``inputs(input, kind)`` and ``models(model, query_instruction, doc_instruction)``.

    Without instruction there is no prompt; with it the one of the input's kind. Models that have none skip the mode.
    """
    rows = models.crossJoin(F.broadcast(inputs)).withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes))))  # configurations, a few
    rows = rows.where("mode <> 'instruct' or query_instruction is not null or doc_instruction is not null")
    prompt = F.when(F.col("mode") == "instruct", F.when(F.col("kind") == "query", F.col("query_instruction")).otherwise(F.col("doc_instruction")))
    return rows.select("model", "input", "kind", "mode", prompt.alias("prompt"))


def window_and_batch(configs: DataFrame, long_window: int = 4096) -> DataFrame:
    """Adds ``window`` (the asked one up to the model's cap) and ``batch`` (a quarter, 1 at least, for long windows)."""
    window = F.least(F.coalesce("asked", "max_seq_length"), F.coalesce("cap", "max_seq_length"))
    batch = F.when(window > long_window, F.greatest(F.lit(1), F.floor(F.col("batch_size") / 4))).otherwise(F.col("batch_size"))
    return configs.withColumn("window", window).withColumn("batch", batch.cast("int"))


def benchmark_grid(models: DataFrame, datasets: DataFrame, modes: list[str]) -> DataFrame:
    """``(model, dataset, max_length, mode, status, error)``: every model, data set and mode; lengths beyond a model's ``cap`` are unsupported."""
    rows = models.crossJoin(F.broadcast(datasets)).withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes))))  # configurations, a few
    beyond = F.col("max_length") > F.col("cap")
    error = F.when(beyond, F.concat(F.lit("max_length "), F.col("max_length").cast("string"), F.lit(" > model cap "), F.col("cap").cast("string"))).otherwise("")
    return rows.select("model", "dataset", "max_length", "mode", F.when(beyond, "unsupported").otherwise("ok").alias("status"), error.alias("error"))


def excluded(rows: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, str] = ("model", "mode")) -> DataFrame:
    """``rows`` without the listed pairs."""
    skip = rows.sparkSession.createDataFrame(pairs, f"{keys[0]} string, {keys[1]} string")
    return rows.join(F.broadcast(skip), list(keys), "left_anti")  # the list given


def display_names(rows: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of the configurations ``(model, mode, name)`` with their ``config`` name; others go."""
    table = rows.sparkSession.createDataFrame(names, "model string, mode string, config string")
    return rows.join(F.broadcast(table), ["model", "mode"])  # the list given


def merged_modes(old: Column, new: Column) -> Column:
    """Nested maps mode -> input -> entry: per mode and input the new entry wins, entries of one side only stay."""
    inner = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_zip_with(old, new, lambda _, a, b: inner(a, b)))


def merged_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(model, modes, ...)``: manifests of both runs. Entries are merged; all other values are the new run's, for models that it has.

    A value that only the old runs know goes with them, as a manifest is written anew.
    """
    others = list(dict.fromkeys(c for c in (*new.columns, *old.columns) if c not in ("model", "modes")))
    n = new.select("model", F.struct(*new.columns).alias("_n"))
    both = old.select("model", F.struct(*old.columns).alias("_o")).join(n, "model", "full")
    value = lambda side, df, c: F.col(f"{side}.{c}") if c in df.columns else F.lit(None)
    is_new = F.col("_n").isNotNull()
    return both.select("model", *(F.when(is_new, value("_n", new, c)).otherwise(value("_o", old, c)).alias(c) for c in others), merged_modes(F.col("_o.modes"), F.col("_n.modes")).alias("modes"))


def manifest_for(pairs: DataFrame, of_model: DataFrame, of_mode: DataFrame) -> DataFrame:
    """``pairs(model, mode)`` with the model's manifest ``(model, path, modes)``, or else the mode's ``(model, mode, path, modes)``."""
    a = of_model.select("model", F.col("path").alias("_path"), F.col("modes").alias("_modes"))
    b = of_mode.select("model", "mode", F.col("path").alias("_mode_path"), F.col("modes").alias("_mode_modes"))
    rows = pairs.join(a, "model", "left").join(b, ["model", "mode"], "left")
    return rows.select("model", "mode", F.coalesce("_path", "_mode_path").alias("manifest_path"), F.when(F.col("_path").isNotNull(), F.col("_modes")).otherwise(F.col("_mode_modes")).alias("modes"))


def timing(modes: Column, mode: Column, questions: Column, corpus: str = "corpus") -> dict[str, Column]:
    """Timings of the corpus and of the questions in a manifest, null where there are none."""
    entry = lambda name: F.try_element_at(F.try_element_at(modes, mode), name)
    c, q = entry(F.lit(corpus)), entry(questions)
    return {
        "embedding_corpus_seconds": c["encode_seconds"], "embedding_questions_seconds": q["encode_seconds"],
        "embedding_corpus_items_per_second": c["items_per_second"], "embedding_questions_items_per_second": q["items_per_second"],
        "embedding_question_prompt": q["prompt"],
    }


def statistics_rows(manifests: DataFrame, skip: list[tuple[str, str]] = (), windows: dict[str, int] | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """One row for each model, mode and input of ``manifests(model, dim, modes[, peak_vram_gb, load_seconds])`` that has items, with defaults and notes.

    Missing windows and batches get what runs used before they were recorded; ``windows`` says which window
    a model had then. ``labels`` names models. Notes say that, which mode the vectors were copied from, and
    how many items were cut. Memory and loading time are those of the model's last run.
    """
    named = lambda names: F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("model")) if names else F.lit(None)
    of_run = [c if c in manifests.columns else F.lit(None).cast("double").alias(c) for c in ("peak_vram_gb", "load_seconds")]
    rows = manifests.select("model", "dim", *of_run, F.explode("modes").alias("mode", "inputs")).select("model", "dim", "peak_vram_gb", "load_seconds", "mode", F.explode("inputs").alias("input", "e"))
    rows = rows.where("coalesce(e.n, 0) <> 0")
    rows = excluded(rows, list(skip)) if skip else rows
    notes = F.concat_ws(
        "; ", F.when(F.col("e.max_seq_length").isNull(), "window not recorded"),
        F.when(F.col("e.identical_to_mode").isNotNull(), F.concat(F.lit("same as "), F.col("e.identical_to_mode"))),
        F.when(F.col("e.tokens_truncated") > 0, F.concat(F.col("e.tokens_truncated").cast("string"), F.lit(" cut"))),
    )
    return rows.select(
        "input", "model", F.coalesce(named(labels), F.col("model")).alias("label"), "mode", "dim", "e.n", "e.kind", F.coalesce("e.prompt", F.lit("")).alias("prompt"),
        F.coalesce(F.col("e.max_seq_length"), named(windows).cast("int"), F.lit(LEGACY_WINDOW)).alias("window"), F.coalesce("e.batch_size", F.lit(LEGACY_BATCH)).alias("batch_size"),
        "e.tokens_total", "e.tokens_max", "e.tokens_truncated", "e.encode_seconds", "e.items_per_second", "e.tokens_per_second",
        F.col("e.batch_seconds.p50").alias("batch_p50"), F.col("e.batch_seconds.p95").alias("batch_p95"), F.col("e.batch_seconds.first").alias("batch_first"),
        F.col("e.single_item_latency_ms.p50").alias("latency_p50"), F.col("e.single_item_latency_ms.p95").alias("latency_p95"), "peak_vram_gb", "load_seconds", notes.alias("notes"),
    )


def coverage_report(hits: DataFrame, questions: DataFrame, chunks: DataFrame, facts: DataFrame, manifests: DataFrame, index: str, input_name: str, device: str, seconds: float) -> DataFrame:
    """Ranked hits with all that a reader needs, 24 columns, one row for each model, mode, question and rank.

    ``hits(model, mode, question_id, rank, chunk_id, score[, fact_key, n_facts])``; ``questions(question_id,
    question)``; ``chunks(chunk_id, title, text, doc_id, chunk_index, businesses)``; ``facts(fact_key, fact_id,
    fact_text)``; ``manifests(model, mode, manifest_path, modes)``. What is not found is an empty text, the
    question's own id, or null for numbers. Timings are those of the corpus also for the fact index.
    """
    fact = index == "fact"
    if not fact:
        hits = hits.withColumn("fact_key", F.lit(None).cast("string")).withColumn("n_facts", F.lit(None).cast("long"))
    rows = hits.join(questions, "question_id", "left").join(chunks, "chunk_id", "left").join(facts, "fact_key", "left").join(manifests, ["model", "mode"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        "model", "mode", "question_id", F.coalesce("question", F.col("question_id").cast("string")).alias("question"), "rank", F.lit(index).alias("index"), "chunk_id",
        F.round("score", 8).alias("score"), text("fact_id"), text("fact_text"), F.col("n_facts").alias("n_facts_top50"), text("title"), text("text"), "doc_id", "chunk_index",
        F.to_json(F.coalesce("businesses", F.array().cast("array<string>"))).alias("businesses"), F.coalesce("manifest_path", F.lit("")).alias("embedding_manifest"),
        *(c.alias(n) for n, c in timing(F.col("modes"), F.col("mode"), F.lit(input_name)).items()),
        F.lit(device).alias("retrieval_device"), F.lit(round(seconds, 6)).alias("retrieval_seconds"),
    )


def report_name(topk: int, coverage: str = "coverage", index: str = "corpus") -> str:
    """A name for each kind of run, so that none overwrites another."""
    return "_".join([f"coverage_top{topk}", *([] if coverage == "coverage" else [coverage]), *([] if index == "corpus" else [index])])


def run_row(spark: SparkSession, **values: str | int | float | bool) -> DataFrame:
    """One row of facts about a run, to be written as JSON beside its results."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
