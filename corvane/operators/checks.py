"""Validation: tables of rows that break a rule, and errors raised from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def require_none(broken: DataFrame, what: str, shown: int = 5) -> None:
    """Raises if ``broken`` has a row; names the first few."""
    some = broken.limit(shown).collect()
    if some:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in some)}")


def asserted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, whose evaluation fails at a row that breaks a rule, with the name of the first that it breaks: a check without a pass of its own."""
    holds = F.lit(True)
    for what, rule in reversed(rules.items()):
        holds = F.when(F.coalesce(rule, F.lit(False)), holds).otherwise(F.raise_error(F.lit(what)).cast("boolean"))
    return df.where(holds)


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df``, and what its evaluation counts on the way: its rows (``rows``) and the rows for which each of ``counts`` holds."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items())), seen


def in_order(vectors: DataFrame, order: DataFrame, what: str = "vectors and ids") -> DataFrame:
    """``vectors(pos, id, ...)``, whose evaluation fails if a place does not hold the id that ``order(pos, id)`` says, or either side has more places."""
    both = vectors.withColumn("_here", F.lit(True)).join(order.select("pos", F.col("id").alias("_id"), F.lit(True).alias("_there")), "pos", "full")
    rules = {f"{what} differ in number": F.col("_here") & F.col("_there"), f"{what} are not in the same order": F.col("id").eqNullSafe(F.col("_id"))}
    return asserted(both, rules).drop("_here", "_id", "_there")


def misplaced(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(pos, left_id, right_id)`` where two id lists ``(pos, id)`` differ, either side null if it has no such place."""
    both = left.select("pos", F.col("id").alias("left_id")).join(right.select("pos", F.col("id").alias("right_id")), "pos", "full")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def unpaired(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """``(pair_id, problem)``: pairs that one side lacks, or whose vectors (``vec``) differ in size."""
    left = a.select(key, F.size("vec").alias("_a"))
    right = b.select(key, F.size("vec").alias("_b"))
    problem = F.when(F.col("_a").isNull(), "only in b").when(F.col("_b").isNull(), "only in a").when(F.col("_a") != F.col("_b"), "sizes differ")
    return left.join(right, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def differing_texts(pairs: DataFrame, external: DataFrame, columns: list[str], key: str = "pair_id") -> DataFrame:
    """Keys of outside rows whose texts, trimmed, are not those of the pair; a text that the outside row lacks does not count."""
    other = external.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    wrong = " or ".join(f"(_{c} is not null and not (trim(_{c}) <=> trim({c})))" for c in columns)
    return pairs.join(other, key).where(wrong).select(key).distinct()


def wrong_dimensions(vectors: DataFrame, dims: DataFrame) -> DataFrame:
    """``(model, n, n_wrong)`` of models with a vector of other size than ``dims(model, dim)`` says."""
    rows = vectors.join(dims, "model").groupBy("model").agg(F.count("*").alias("n"), F.count_if(~F.size("vec").eqNullSafe(F.col("dim"))).alias("n_wrong"))
    return rows.where("n_wrong > 0")


def count_mismatch(ids: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, n_ids, n_vectors)`` of inputs with other numbers of ids and vectors."""
    left = ids.groupBy(*by).agg(F.count("*").alias("n_ids"))
    right = vectors.groupBy(*by).agg(F.count("*").alias("n_vectors"))
    both = left.join(right, by, "full").select(*by, F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))
    return both.where("n_ids <> n_vectors")


def without_vector(questions: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    return questions.select(key).distinct().join(vectors.select(key), key, "left_anti")


def too_many_parts(parts: DataFrame, columns: int) -> DataFrame:
    """Rows ``(id, n_parts)`` that a sheet with so many part columns cannot hold."""
    return parts.where(F.col("n_parts") > columns)


def truncated(rows: DataFrame) -> DataFrame:
    """``(input, n, n_truncated, tokens_max)`` of inputs with texts longer than their window, over ``(input, n_tokens, window)``."""
    out = rows.groupBy("input").agg(F.count("*").alias("n"), F.count_if(F.col("n_tokens") > F.col("window")).alias("n_truncated"), F.max("n_tokens").alias("tokens_max"))
    return out.where("n_truncated > 0")


def underfilled(picked: DataFrame, groups: tuple[str, ...], want: int) -> DataFrame:
    """``(length_group, n)`` of the groups with fewer rows than wanted, those without any included."""
    every = picked.sparkSession.createDataFrame([(g,) for g in groups], "length_group string")
    counts = picked.groupBy("length_group").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "length_group", "left").select("length_group", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < want)


def drifted(texts: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys of ``texts(key, text)`` whose SHA-256 is not the recorded one ``(key, sha256)``, or is not recorded."""
    return texts.select(key, F.sha2("text", 256).alias("_now")).join(recorded, key, "left").where(~F.col("_now").eqNullSafe(F.col("sha256"))).select(key)
