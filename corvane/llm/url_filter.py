"""URL filtering: host and path rules, then a weighted vocabulary searched with Aho-Corasick.

One strict term rejects a URL; soft terms reject it when several distinct ones add up to ``SOFT_LIMIT``.
A hit counts only between characters that are neither ASCII letters nor digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default vocabulary. Each soft weight is below SOFT_LIMIT, so one alone never rejects.
STRICT = ("camgirls", "casino", "cialis", "escorts", "hentai", "payday-loans", "porn", "porno", "viagra", "warez", "xxx")
SOFT = {"adult": 1.0, "bet": 1.0, "bonus": 1.0, "cheap": 1.0, "crack": 1.0, "dating": 1.0, "download": 1.0, "free": 1.0, "loans": 1.0, "nude": 1.5, "pharmacy": 1.0, "pills": 1.0, "poker": 1.5, "replica": 1.0, "sex": 1.5, "slots": 1.0, "win": 1.0}
SOFT_LIMIT = 2.0
#: A vocabulary table is held by every task: more terms than this are an error.
MOST_TERMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path`` (of equal ones, that with the longer host)."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def counter(strict: tuple[str, ...], soft: dict[str, float]):
    """A task function: replaces ``url`` by the distinct strict and soft hits and the soft weight."""
    terms = [*strict, *soft]

    def inside(c: str) -> bool:
        return c.isascii() and c.isalnum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            automaton.add_word(t, k)
        automaton.make_automaton()
        fold = str.maketrans(UPPER, LOWER)
        for batch in batches:
            n_strict, n_soft, weight = [], [], []
            for url in batch.column("url").to_pylist():
                url = (url or "").translate(fold)
                hits = set()
                for end, k in automaton.iter(url):
                    start = end + 1 - len(terms[k])
                    if not (start and inside(url[start - 1])) and not (end + 1 < len(url) and inside(url[end + 1])):
                        hits.add(k)
                n_strict.append(sum(k < len(strict) for k in hits))
                n_soft.append(len(hits) - n_strict[-1])
                weight.append(float(sum(soft[terms[k]] for k in hits if k >= len(strict))))
            names = [n for n in batch.schema.names if n != "url"]
            columns = [*(batch.column(n) for n in names), pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "strict_hits", "soft_hits", "soft_weight"])

    return run


def vocabulary_of(table: DataFrame) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict and soft terms of ``table(term, weight, strict)``, of at most ``MOST_TERMS`` rows.

    Terms are lower-cased (A-Z); null and empty ones go. Of equal terms a strict one wins, else the largest weight.
    """
    term = F.translate(F.col("term").cast("string"), UPPER, LOWER)
    rows = table.where(F.length("term") > 0).groupBy(term.alias("term")).agg(F.max("weight").cast("double").alias("weight"), F.bool_or(F.coalesce("strict", F.lit(False))).alias("strict"))
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms")
    found.sort(key=lambda r: r.term)
    return tuple(r.term for r in found if r.strict), {r.term: r.weight or 0.0 for r in found if not r.strict}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] = SOFT, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight)`` for each row of ``pages(page_id, url)``.

    The longest fitting rule decides; without one, the vocabulary over the whole url. A null or empty
    url is allowed. Equal rows are judged alike; other columns are ignored; no rows give no rows.
    ``vocabulary(term, weight, strict)`` replaces the default terms, see :func:`vocabulary_of`.
    """
    if vocabulary is not None:
        strict, soft = vocabulary_of(vocabulary)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), *(c.alias(n) for n, c in zip(("host", "path"), host_and_path(url))))
    name, verdict = longest_rule(rules)
    rows = rows.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    schema = "page_id long, host string, path string, rule string, ruled string, strict_hits long, soft_hits long, soft_weight double"
    rows = rows.mapInArrow(counter(strict, soft), schema)
    rejected = (F.col("strict_hits") > 0) | ((F.col("soft_hits") > 1) & (F.col("soft_weight") >= SOFT_LIMIT))
    rows = rows.withColumn("verdict", F.coalesce("ruled", F.when(rejected, "block").otherwise("allow")))
    return rows.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules and the default vocabulary; see :func:`judge_urls` for odd rows."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    hit = "regexp_matches(u, '(^|[^a-z0-9]){}($|[^a-z0-9])')::BIGINT"
    strict = " + ".join(hit.format(t) for t in STRICT)
    soft = " + ".join(hit.format(t) for t in SOFT)
    weight = " + ".join(f"{hit.format(t)} * {w}::DOUBLE" for t, w in SOFT.items())
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)
    ruled = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    return f"""
    WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
    c AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u, translate(h, '{UPPER}', '{LOWER}') AS host,
          regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
          {strict} AS strict_hits, {soft} AS soft_hits, {weight} AS soft_weight FROM c)
    SELECT page_id, host, path, rule,
           coalesce(ruled, CASE WHEN strict_hits > 0 OR (soft_hits > 1 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
           strict_hits, soft_hits, soft_weight
    FROM d"""


OP5_SQL = _sql()
