"""Document quality by weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of vote
patterns (at most ``3 ** len(RULES)`` rows whatever the corpus) estimates each rule's accuracy and
the share of good documents; a document's verdict is the posterior probability that it is good,
so one dissenting rule no longer rejects it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import written

SPACE = r"[\x20\x09-\x0D]+"
#: A word without a letter; the blank after it stays for the next one.
BARE = r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters", "n_bare")
FEW = 32


def measure(docs: DataFrame) -> DataFrame:
    """``(d, n_words, ...)``: the whole input row in ``d``, and the measures of its text.

    Words are runs outside white space. A null text counts as empty: all measures 0.
    Long texts cost n log n; nothing is cut.
    """
    n = F.col("n_words")
    df = docs.select(F.struct("*").alias("d"))
    df = df.withColumn("t", F.coalesce(F.col("d")["text"].cast("string"), F.lit("")))
    df = df.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.select(
        "d",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(BARE)).cast("long").alias("n_bare"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.regexp_like(x, F.lit(r"[.!?:;\"'”»…)]\s*$")))).cast("long").alias("n_ended"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # 64-bit hashes of the three-word windows, in order
    df = df.withColumn("g", F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)).cast("int") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).otherwise(F.array().cast("array<bigint>"))).drop("h")
    df = df.withColumn("s", F.sort_array("g"))
    again = F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.when(a == b, a))
    df = df.withColumn("r", F.array_distinct(F.filter(again, lambda x: x.isNotNull()))).drop("s")
    # places of repeated windows: by looking them up if few are repeated, else by one sort of all
    places = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains("r", x), i)), lambda x: x.isNotNull())
    ordered = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("o", F.when(F.size("r") > FEW, ordered))
    near = lambda i: F.coalesce(F.get("o", i)["x"] == F.get("o", i - 1)["x"], F.lit(False)) | F.coalesce(F.get("o", i)["x"] == F.get("o", i + 1)["x"], F.lit(False))
    sorted_places = F.array_sort(F.filter(F.transform("o", lambda x, i: F.when(near(i), x["i"])), lambda x: x.isNotNull()))
    df = df.withColumn("p", F.when(F.size("r") == 0, F.array().cast("array<int>")).when(F.size("r") <= FEW, places).otherwise(sorted_places)).drop("g", "r", "o")
    gaps = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(3), lambda a, x: a + x)).otherwise(0).cast("long")
    return df.withColumn("n_repeat_words", covered).select("d", *MEASURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the measures; a document without words gets only the length rule's vote."""
    words = F.col("n_words")
    some = words > 0
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    size = share("word_chars", "n_words")
    return {
        "length": _vote((words >= 50) & (words <= 200_000), words < 20),
        "word_size": _vote(some & size.between(3, 10), some & ~size.between(2, 14)),
        "symbols": _vote(some & (share("n_symbols", "n_words") <= 0.02), share("n_symbols", "n_words") > 0.1),
        "same_lines": _vote(some & (share("n_dup_lines", "n_lines") <= 0.1), share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(some & (share("n_repeat_words", "n_words") <= 0.2), share("n_repeat_words", "n_words") > 0.5),
        "endings": _vote(some & (share("n_ended", "n_lines") >= 0.6), some & (share("n_ended", "n_lines") < 0.1)),
        "letters": _vote(some & (share("n_letters", "word_chars") >= 0.8), some & (share("n_letters", "word_chars") < 0.65)),
        "bare_words": _vote(some & (share("n_bare", "n_words") <= 0.1), share("n_bare", "n_words") > 0.2),
        "glued_symbols": _vote(some & (share("n_symbols", "word_chars") <= 0.005), share("n_symbols", "word_chars") > 0.05),
    }


RULES = ("length", "word_size", "symbols", "same_lines", "repeats", "endings", "letters", "bare_words", "glued_symbols")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule how often it votes each way on good and on bad ones."""

    prior: float
    good: dict[str, dict[int, float]]
    bad: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        # steps stand in constant arrays, so that every round of the fit runs the same generated code
        score = f"get(array({math.log(self.prior / (1 - self.prior))!r}D), 0)"
        for r in RULES:
            steps = ", ".join(f"{math.log(self.good[r][v] / self.bad[r][v])!r}D" for v in VOTES)
            score += f" + get(array({steps}), {r} + 1)"
        return F.expr(f"1 / (1 + exp(-({score})))")


VOTES = (-1, 0, 1)
#: Before the first round: a rule that votes is right four times in five.
START = LabelModel(0.8, {r: {-1: 0.1, 0: 0.5, 1: 0.4} for r in RULES}, {r: {-1: 0.4, 0: 0.5, 1: 0.1} for r in RULES})


def fit(votes: DataFrame, rounds: int = 30, tolerance: float = 1e-3) -> LabelModel:
    """EM over all rows of ``votes``; each round is one aggregate over the pattern table, by rule and vote.

    One added count per vote keeps every probability positive. A rule never counts a bad vote as a
    sign of good (nor a good vote as a sign of bad), so the classes keep their meaning; the prior
    stays in [0.05, 0.98]. An empty table leaves the starting values.
    """
    patterns = votes.groupBy(*RULES).agg(F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in RULES))
    # at most 9 * 3 ** 9 rows, whatever the corpus: one task sums them without a shuffle
    patterns = written(patterns.select("*", F.inline(each)).repartition(1), "patterns").coalesce(1)
    counts = {(x["rule"], x["vote"]): x["n"] for x in patterns.groupBy("rule", "vote").agg(F.sum("n").alias("n")).collect()}
    everything = sum(counts.get((RULES[0], v), 0) for v in VOTES)
    model = START
    for _ in range(rounds if everything else 0):
        found = patterns.groupBy("rule", "vote").agg(F.sum(model.posterior() * F.col("n")).alias("good")).collect()
        good = {(x["rule"], x["vote"]): x["good"] for x in found}
        good_sum = sum(good.get((RULES[0], v), 0.0) for v in VOTES)
        share = good_sum / everything
        sides: dict[str, dict[str, dict[int, float]]] = {"good": {}, "bad": {}}
        for r in RULES:
            g = {v: good.get((r, v), 0.0) for v in VOTES}
            sides["good"][r] = {v: (g[v] + 1) / (good_sum + 3) for v in VOTES}
            sides["bad"][r] = {v: (max(counts.get((r, v), 0) - g[v], 0.0) + 1) / (everything - good_sum + 3) for v in VOTES}
            g, b = sides["good"][r], sides["bad"][r]
            for v, wrong in ((-1, g[-1] > b[-1]), (1, b[1] > g[1])):
                if wrong:
                    g[v] = b[v] = share * g[v] + (1 - share) * b[v]
        new = LabelModel(min(max(share, 0.05), 0.98), sides["good"], sides["bad"])
        change = max(abs(getattr(new, s)[r][v] - getattr(model, s)[r][v]) for s in ("good", "bad") for r in RULES for v in VOTES)
        model = new
        if change < tolerance:
            break
    return model


def with_votes(measured: DataFrame) -> DataFrame:
    votes = rules()
    return measured.select("*", *(votes[r].alias(r) for r in RULES))


def judged(voted: DataFrame, model: LabelModel) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", model.posterior())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever these are.

    Null, empty and word-less texts go. Equal rows share a verdict. An empty table gives an empty one.
    """
    # written once: counting a document's words costs far more than writing it, and both the fit and the filter read the votes
    voted = written(with_votes(measure(docs)), "votes")
    return judged(voted, fit(voted)).where("kept").select("d.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior)`` for each row of documents.

    Null, empty and word-less texts have all measures 0 and fail the base rule. Equal rows are judged alike.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    voted = written(with_votes(measure(docs)).withColumn("doc_id", F.col("d")["doc_id"]).drop("d"), "votes")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged(voted, fit(voted)).select(*columns)
