"""Reports: similarity calibration, corpus profile, throughput rows, manifests, upserts, and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import is_nfc
from corvane.functions.vectors import cosine
from corvane.operators.checks import asserted
from corvane.operators.order import at_places, linear_quantiles, nearest_ranks, numbered

#: Calibration tiers in ladder order.
TIERS = ("0_sanity", "1_paraphrase", "5_vocab_gap", "2_same_entity_DANGER", "3_same_topic", "4_unrelated")
SHORT = {"t0": TIERS[0], "t1": TIERS[1], "t5": TIERS[2], "t2": TIERS[3], "t3": TIERS[4], "t4": TIERS[5]}


def tier_means(scores: DataFrame) -> DataFrame:
    """Mean score per system and tier; missing scores (null or NaN) do not count."""
    return scores.groupBy("system", "tier").agg(F.avg(F.nanvl("score", F.lit(None).cast("double"))).alias("mean"))


def tier_table(scores: DataFrame) -> DataFrame:
    """``(place, tier, system, mean, n)``: tier means in ladder order, unknown tiers last by name; few rows."""
    order = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    n = scores.groupBy("system", "tier").agg(F.count("*").alias("n"))
    rows = tier_means(scores).join(n, ["system", "tier"])
    place = F.dense_rank().over(Window.orderBy((order == 0), order, "tier"))
    return rows.select(place.alias("place"), "tier", "system", "mean", "n").orderBy("place", "system")


def cosine_columns(pairs: DataFrame, scores: DataFrame, systems: list[str]) -> DataFrame:
    """The columns of ``pairs(pair_id, ...)`` with one column ``cos_<system>`` for each system, null where a score is missing."""
    score = F.nanvl("score", F.lit(None).cast("double"))
    wide = scores.groupBy("pair_id").agg(*(F.max(F.when(F.col("system") == s, score)).alias(f"cos_{s.replace('/', '_')}") for s in systems))
    return pairs.join(wide, "pair_id", "left")


def diagnostics(scores: DataFrame) -> DataFrame:
    """One row per system: tier means, strict order checks (null if a side is missing), gaps, ladder, spread and a warning."""
    score = F.nanvl("score", F.lit(None).cast("double"))
    means = [F.avg(F.when(F.col("tier") == name, score)).alias(t) for t, name in SHORT.items()]
    df = scores.groupBy("system").agg(*means, F.min(score).alias("low"), F.max(score).alias("high"))
    for a, b in (("t1", "t2"), ("t5", "t2"), ("t2", "t3"), ("t3", "t4")):
        df = df.withColumn(f"ok_{a}_{b}", F.col(a) > F.col(b))
    ladder = F.filter(F.array(*SHORT), lambda x: x.isNotNull())
    df = df.withColumn("_l", ladder)
    steps = F.zip_with("_l", F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda a, b: F.coalesce(a >= b, F.lit(True)))
    df = df.withColumn("ladder", F.forall(steps, lambda x: x)).drop("_l")
    df = df.withColumn("gap_12", F.col("t1") - F.col("t2")).withColumn("gap_14", F.col("t1") - F.col("t4")).withColumn("spread", F.col("high") - F.col("low"))
    df = df.withColumn("gap_pct", F.when(F.col("spread") > 0, 100 * F.col("gap_12") / F.col("spread")))
    bad = [F.coalesce(~F.col(c), F.lit(False)) for c in ("ok_t1_t2", "ok_t5_t2", "ok_t2_t3", "ok_t3_t4", "ladder")]
    warn = reduce(lambda a, b: a | b, bad, F.coalesce(F.col("gap_12") < 0.05, F.lit(False)))
    numbers = (*SHORT, "gap_12", "gap_14", "low", "high", "spread", "gap_pct")
    return df.withColumn("warning", warn).select("system", *(F.round(c, 6).alias(c) for c in numbers), "ok_t1_t2", "ok_t5_t2", "ok_t2_t3", "ok_t3_t4", "ladder", "warning")


def pair_cosines(a: DataFrame, b: DataFrame, complete: bool = False) -> DataFrame:
    """``(pair_id, score)``: cosine of the two vectors ``(pair_id, vec)`` of each pair that both sides have.

    ``complete``: a pair that one side lacks is an error. Vectors of different sizes are always one.
    """
    rows = a.join(b.select("pair_id", F.col("vec").alias("_other")), "pair_id", "full" if complete else "inner")
    rules = {"a pair of vectors of different sizes": F.size("vec") == F.size("_other")}
    if complete:
        rules = {"a pair that one side lacks": F.col("vec").isNotNull() & F.col("_other").isNotNull()} | rules
    return asserted(rows, rules).select("pair_id", cosine(F.col("vec"), F.col("_other")).alias("score"))


def instruct_effect(scores: DataFrame) -> DataFrame:
    """``(model, pair_id, effect)``: instruct minus no_instruct where both exist."""
    side = lambda m: scores.where(F.col("mode") == m).select("model", "pair_id", F.col("score").alias(m))
    return side("instruct").join(side("no_instruct"), ["model", "pair_id"]).select("model", "pair_id", F.round(F.col("instruct") - F.col("no_instruct"), 6).alias("effect"))


def instruct_means(effects: DataFrame) -> DataFrame:
    """``(model, mean)``: the plain mean of the effects, NaN if one of them is."""
    return effects.groupBy("model").agg(F.avg("effect").alias("mean"))


def with_external(pairs: DataFrame, external: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with outside scores ``(pair_id, seq, score)``: unknown ids ignored, the last duplicate wins, missing is null.

    ``texts`` are columns of both sides: an outside row whose text, trimmed, is another than the pair's is an
    error; one without text is none.
    """
    def same(c: str) -> Column:
        return F.col(f"x.{c}").isNull() | F.trim(F.col(f"x.{c}")).eqNullSafe(F.trim(F.col(f"p.{c}")))

    if texts:
        known = external.alias("x").join(pairs.alias("p"), F.col("x.pair_id") == F.col("p.pair_id"))
        external = asserted(known, {f"the outside {c} of a pair is another": same(c) for c in texts}).select("x.*")
    last = external.groupBy("pair_id").agg(F.max_by("score", "seq").alias("score"))
    return pairs.join(last, "pair_id", "left")


def nfc_count(docs: DataFrame) -> DataFrame:
    """``(n, n_nfc)``: texts, and how many are in Unicode's composed form already."""
    return docs.agg(F.count("*").alias("n"), F.count_if(is_nfc(F.coalesce("text", F.lit("")))).alias("n_nfc"))


def norm_stats(norms: DataFrame, tolerance: float = 0.00101) -> DataFrame:
    """``(min_norm, max_norm, normalised, n_vectors)`` of ``norms(n)``; all within the tolerance of 1."""
    return norms.agg(F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.bool_and(F.abs(F.col("n") - 1) <= tolerance).alias("normalised"), F.count("*").alias("n_vectors"))


def cost(tokens: DataFrame, prices: dict[str, float], most: int) -> DataFrame:
    """``(model, price, cost)`` of embedding texts ``(n_tokens)`` cut at ``most`` tokens, at prices per million tokens."""
    rows = tokens.agg(F.sum(F.least("n_tokens", F.lit(most))).alias("s"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("price")) for m, p in prices.items())))
    return rows.withColumn("x", each).select("x.model", "x.price", (F.col("s") / 1e6 * F.col("x.price")).alias("cost"))


def status_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def corpus_profile(docs: DataFrame, n_tokens: Column, short: tuple[int, int] = (20, 50)) -> DataFrame:
    """One row over ``docs(text)``: totals, percentiles, characters per token, and junk counts. Distinct texts are counted by 128-bit names."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(text.alias("text"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n"), F.length(text).cast("long").alias("chars"))
    p = F.percentile("n", F.array(*(F.lit(q) for q in (0.5, 0.9, 0.99))))
    out = df.agg(
        F.count("*").alias("docs"), F.count_distinct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("texts"), F.sum("n").alias("tokens"), F.sum("chars").alias("chars"), p.alias("p"), F.max("n").alias("max_tokens"),
        F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.col("chars") < short[0]).alias("under_20"), F.count_if(F.col("chars") < short[1]).alias("under_50"), F.count_if(F.col("n") < 10).alias("under_10_tokens"),
    )
    return out.select("docs", "texts", "tokens", "chars", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p90"), F.round(F.col("p")[2], 6).alias("p99"), "max_tokens", F.round(F.try_divide("chars", "tokens"), 6).alias("chars_per_token"), "empty", "under_20", "under_50", "under_10_tokens")


def over_limits(df: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """``(limit, n_over, pct_over, tokens_cut)`` for every limit, over ``df(n_tokens)``."""
    rows = df.select("n_tokens", F.explode(F.array(*(F.lit(x) for x in limits))).alias("limit"))
    over = F.count_if(F.col("n_tokens") > F.col("limit"))
    return rows.groupBy("limit").agg(over.alias("n_over"), F.round(100.0 * over / F.count("*"), 6).alias("pct_over"), F.sum(F.greatest(F.col("n_tokens") - F.col("limit"), F.lit(0))).cast("long").alias("tokens_cut"))


def latency_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and nearest-rank percentiles of ``ms`` per configuration, rates from totals, and mean token counts.

    ``rows(*keys, ms, samples, real_tokens, padded_tokens)``, one for each timed run. Percentiles come from
    places in one global order, so a configuration may have any number of runs.
    """
    total = F.sum("ms")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.avg("ms").alias("mean"), F.try_divide(1000.0 * F.sum("samples"), total).alias("samples_per_sec"),
        F.try_divide(1000.0 * F.sum("real_tokens"), total).alias("tokens_per_sec"), F.avg("real_tokens").alias("real_tokens"), F.avg("padded_tokens").alias("padded_tokens"),
    )
    places = nearest_ranks(rows, keys, "ms", (50, 95, 99)).drop("n")
    r = lambda c: F.round(c, 6).alias(c)
    return out.join(places, keys, "left").select(*keys, "runs", *map(r, ("mean", "p50", "p95", "p99", "samples_per_sec", "tokens_per_sec", "real_tokens", "padded_tokens")))


def encode_summary(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Batch timings ``(*keys, batch, seconds, items)`` of encoding runs: mean, interpolated percentiles, the first batch, totals and rate."""
    g = batches.groupBy(*keys).agg(F.count("*").alias("n_batches"), F.avg("seconds").alias("mean"), F.min_by("seconds", "batch").alias("first"), F.sum("seconds").alias("total"), F.try_divide(F.sum("items"), F.sum("seconds")).alias("items_per_second"))
    return g.join(linear_quantiles(batches, keys, "seconds", {"p50": 0.5, "p95": 0.95}).drop("n"), keys, "left")


def batch_tokens(tokens: DataFrame, by: list[str], limit: int) -> DataFrame:
    """``(*by, real_tokens, padded_tokens)`` of batches of texts ``(*by, n_tokens)`` cut at ``limit``: all pad to the longest."""
    n = F.least("n_tokens", F.lit(limit))
    return tokens.groupBy(*by).agg(F.sum(n).alias("real_tokens"), (F.max(n) * F.count("*")).alias("padded_tokens"))


def length_summary(rows: DataFrame, group: str, n: str, source: str) -> DataFrame:
    """Count, smallest, middle (place n // 2 from 0) and largest ``n`` per group, and its sources with their counts."""
    middle = at_places(rows, [group], n, {"middle": F.floor(F.col("n") / 2) + 1}).select(group, "middle")
    ends = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))
    sources = rows.groupBy(group, source).agg(F.count("*").alias("_c")).groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "_c"))))).alias("sources"))
    return ends.join(middle, group, "left").join(sources, group)


def oom_propagated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batches larger than one that ran out of memory count as out of memory."""
    before = Window.partitionBy(*keys).orderBy("batch_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.max(F.when(F.col("status") == "OOM", 1).otherwise(0)).over(before)
    return rows.withColumn("status", F.when(hit == 1, "OOM").otherwise(F.col("status")))


def best_throughput(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The fastest batch size per configuration, the first row on a tie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("samples_per_sec"), "row_pos"))
    return rows.where("status = 'ok'").withColumn("_n", rank).where("_n = 1").select(*keys, "batch_size", "samples_per_sec")


def merged_single(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(pos, *keys, single, value)``: single-item rows of ``new`` put into ``old(*keys, row_pos, single, value)``, which keeps its order.

    A group's last new row counts; it stands before the group's first old row and replaces the group's
    old single rows. New rows of groups that ``old`` lacks follow at the end, in the order in which the groups came.
    """
    groups = old.groupBy(*keys).agg(F.min("row_pos").alias("_place"))
    came = new.where("single").groupBy(*keys).agg(F.min("row_pos").alias("_came"), F.max_by("value", "row_pos").alias("value"))
    fresh = came.join(groups, keys, "left").withColumns({"single": F.lit(True), "_fresh": F.lit(0)})
    replaced = came.select(*keys, F.lit(True).alias("single"))
    kept = old.join(replaced, [*keys, "single"], "left_anti").select(*keys, "single", "value", F.col("row_pos").alias("_place"), F.lit(None).cast("long").alias("_came"), F.lit(1).alias("_fresh"))
    placed = numbered(kept.unionByName(fresh), [F.asc_nulls_last("_place"), "_fresh", "_came"], "pos")
    return placed.select((F.col("pos") + 1).alias("pos"), *keys, "single", "value")


def upsert(old: DataFrame, new: DataFrame, managed: list[str]) -> DataFrame:
    """Rows of configurations that ``new`` manages are replaced; all others stay."""
    return old.join(new.select(*managed).distinct(), managed, "left_anti").unionByName(new)


def merged_manifest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per mode and input the new entry wins; entries of one side only stay."""
    values = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in values)), keys, "full")
    return both.select(*keys, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def identical_prompts(configs: DataFrame) -> DataFrame:
    """Encode each (model, input, prompt) once: ``encode`` marks the first mode, ``identical_to_mode`` names it for the others."""
    first = F.first("mode").over(Window.partitionBy("model", "input", "prompt").orderBy("mode"))
    df = configs.withColumn("_first", first)
    return df.withColumn("encode", F.col("mode") == F.col("_first")).withColumn("identical_to_mode", F.when(F.col("mode") != F.col("_first"), F.col("_first"))).drop("_first")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``(check, n)``: rows that break each check."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()))
