"""The golden set: questions in six forms with their judgements, text systems that rank documents for them, and the reports."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import md5_number, tokens
from corvane.operators import datasets as D
from corvane.operators import evaluation as E
from corvane.operators import retrieval as X
from corvane.plans.catalog import ABBREV_SQL, PLAIN_SQL, interval_sql, metrics_sql, rounded
from corvane.plans.registry import HASH, WORDS, query, rounded_sql
from corvane.sources.tables import containing, documents, questions
from corvane.storage import workspace, written


# --- lexical retrieval --------------------------------------------------------------------------

def _bm25_sql(source: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS nd, avg(len(w)) AS al FROM d),
    q AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT query_id, unnest({WORDS.format('text')}) AS t FROM ({source})) GROUP BY 1, 2),
    p AS (SELECT doc_id, len(w) AS l, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT query_id, doc_id AS item_id, round(sum(times * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))), 9) AS score
    FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2"""


def _ranked_sql(scores: str, k: int) -> str:
    return f"SELECT query_id, rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM ({scores})) WHERE rank <= {k}"


def _padded_sql(source: str, k: int = 100) -> str:
    return _ranked_sql(f"""
    WITH m AS MATERIALIZED ({_bm25_sql(source)}) SELECT * FROM m
    UNION ALL SELECT b.query_id, d.doc_id, 0 FROM ({source}) b, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {k}) d
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = b.query_id AND m.item_id = d.doc_id)""", k)


@query(rounded_sql(_ranked_sql(_bm25_sql(), 10), "score"))
def bm25_top10(spark, sf_dir):
    return rounded(X.bm25_ranking(questions(spark, sf_dir), documents(spark, sf_dir), 10, pad=False), "score")


@query(rounded_sql(_padded_sql("SELECT item_id AS query_id, text FROM benchmark"), "score"))
def bm25_padded(spark, sf_dir):
    return rounded(X.bm25_ranking(questions(spark, sf_dir), documents(spark, sf_dir), 100), "score")


_QRELS_SQL = "SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(_QRELS_SQL)
def golden_qrels(spark, sf_dir):
    """Relevance judgements: documents that contain the question's text."""
    return containing(questions(spark, sf_dir), documents(spark, sf_dir))


# --- systems --------------------------------------------------------------------------------------

#: A dense text system that SQL can replay: token counts hashed to 32 buckets.
def _hashed_vectors(df: DataFrame, dims: int = 32) -> DataFrame:
    """``(id, vec)`` of ``df(id, words)``; texts without words have none. A batch's distinct words are hashed once."""

    def run(batches):
        for batch in batches:
            rows = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("words")), 0), 0))
            words = rows.column("words")
            named = words.flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:12], 16) % dims for w in named.dictionary.to_pylist()], np.int64)
            at = pc.list_parent_indices(words).to_numpy() * dims + bucket[named.indices.to_numpy()]
            counts = np.bincount(at, minlength=len(rows) * dims).astype(np.float64)
            ends = np.arange(0, len(counts) + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(ends, counts)], ["id", "vec"])

    return df.select(F.col("id").cast("long").alias("id"), "words").mapInArrow(run, "id long, vec array<double>")


_ENCODED_SQL = """SELECT id, list_transform(range(32), lambda i: coalesce(m[i], 0)::DOUBLE) AS e FROM (
  SELECT id, map_from_entries(list((b, n))) AS m FROM (SELECT id, ({h} % 32) AS b, count(*) AS n FROM (SELECT id, unnest({w}) AS t FROM ({src})) GROUP BY 1, 2) GROUP BY 1)"""


def _hashed_sql(source: str) -> str:
    unit = lambda src: f"SELECT id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12::DOUBLE)) AS u FROM ({_ENCODED_SQL.format(h=HASH.format('t'), w=WORDS.format('text'), src=src)})"
    return f"""SELECT q.id AS query_id, d.id AS item_id, round(list_dot_product(q.u, d.u), 12) AS score
      FROM ({unit(f"SELECT query_id AS id, text FROM ({source})")}) q JOIN ({unit("SELECT doc_id AS id, text FROM documents")}) d ON q.id <> d.id"""


def _systems(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Rankings of a hashed dense system, BM25 and their fusion.

    Texts are cut into words once, in a table that both systems read; the two rankings are written, as the
    fusion reads them again.
    """
    with workspace(docs.sparkSession) as held:
        docs = written(docs.select("id", tokens(F.col("text")).alias("words")), "words")
        dense = held.keep(written(X.union_systems({"hashed": X.dense_topk(_hashed_vectors(asked.select("id", tokens(F.col("text")).alias("words"))), _hashed_vectors(docs), 100)}), "dense"))
        lexical = X.union_systems({"bm25": held.keep(X.bm25_ranking(asked, docs, 100))})
    return dense.unionByName(lexical).unionByName(E.hybrids(dense, lexical))


def _systems_sql(source: str) -> str:
    return f"""
    WITH src AS MATERIALIZED ({source}), h AS MATERIALIZED ({_ranked_sql(_hashed_sql("SELECT * FROM src"), 100)}), b AS MATERIALIZED ({_padded_sql("SELECT * FROM src")}),
    f AS (SELECT query_id, item_id, h.rank AS dr, b.rank AS lr, round(coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS score
          FROM h FULL JOIN (SELECT b.* FROM b SEMI JOIN h USING (query_id)) b USING (query_id, item_id))
    SELECT 'hashed' AS system, query_id, rank, item_id FROM h UNION ALL SELECT 'bm25', query_id, rank, item_id FROM b
    UNION ALL SELECT 'hybrid(hashed+bm25)', query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr ASC NULLS LAST, lr ASC NULLS LAST)::INTEGER, item_id FROM f"""


@query(rounded_sql(metrics_sql(_systems_sql("SELECT item_id AS query_id, text FROM benchmark"), _QRELS_SQL), *E.METRICS))
def hybrid_metrics(spark, sf_dir):
    """Golden-set metrics of a hashed dense system, BM25 and their fusion, per query."""
    asked = questions(spark, sf_dir)
    with workspace(spark) as held:
        found = held.keep(written(E.metrics(_systems(asked, documents(spark, sf_dir)), golden_qrels(spark, sf_dir)), "metrics"))
    return rounded(found, *E.METRICS)


# --- variants --------------------------------------------------------------------------------------

def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with a business, as a golden set lists them."""
    return questions(spark, sf_dir).select(F.col("id").alias("base"), F.col("id").cast("string").alias("query_id"), "text", F.concat(F.lit("b"), (F.col("id") % 4).cast("string")).alias("business"))


#: Two words of more than four letters, the first by hash, each with two neighbouring letters swapped.
_TYPO_SQL = f"""SELECT base, array_to_string(list_transform(parts, lambda w, i: CASE WHEN list_contains(chosen, i - 1) THEN
    substr(w, 1, j[i] - 1) || substr(w, j[i] + 1, 1) || substr(w, j[i], 1) || substr(w, j[i] + 2) ELSE w END), ' ') AS text
  FROM (SELECT base, parts, list_slice(list_transform(list_sort(list_transform(list_filter(range(len(parts)), lambda i: length(parts[i + 1]) > 4), lambda i: {{'h': {HASH.format("base || '|' || i")}, 'i': i}})), lambda x: x.i), 1, 2) AS chosen,
    list_transform(parts, lambda w, i: CASE WHEN length(w) > 4 THEN {HASH.format("base || '|' || (i - 1) || '|at'")} % (length(w) - 1) + 1 END) AS j
  FROM (SELECT item_id AS base, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS parts FROM benchmark))"""
_FORMS_SQL = {
    "orig": "text", "nodiacritic": PLAIN_SQL.format("text"), "lowercase": "lower(text)", "abbrev": ABBREV_SQL.format("text"),
    "nodiacritic_abbrev": PLAIN_SQL.format(ABBREV_SQL.format("text")), "typo": "typo.text",
}
_VARIANTS_SQL = " UNION ALL ".join(
    f"SELECT item_id AS base, item_id || '__{n}' AS query_id, {t} AS text, 'b' || (item_id % 4) AS business, item_id::VARCHAR AS base_query_id, '{n}' AS variant FROM benchmark"
    + (f" JOIN ({_TYPO_SQL}) typo ON typo.base = item_id" if n == "typo" else "") + ("" if n == "orig" else f" WHERE {t} <> benchmark.text")
    for n, t in _FORMS_SQL.items()
)


@query(_VARIANTS_SQL)
def query_variants(spark, sf_dir):
    """All six forms of every question."""
    return D.variants(_base(spark, sf_dir))


@query(f"SELECT * FROM ({_VARIANTS_SQL}) WHERE variant = 'typo'")
def query_typos(spark, sf_dir):
    return D.variants(_base(spark, sf_dir)).where("variant = 'typo'")


@query(f"SELECT DISTINCT v.query_id, q.item_id FROM ({_VARIANTS_SQL}) v JOIN ({_QRELS_SQL}) q ON q.query_id = v.base")
def variant_qrels(spark, sf_dir):
    return D.variant_qrels(query_variants(spark, sf_dir), golden_qrels(spark, sf_dir))


_NUMBER_SQL = "base * 6 + CASE variant " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(D.VARIANTS)) + " END"
_GOLDEN_SQL = metrics_sql(
    _systems_sql(f"SELECT {_NUMBER_SQL} AS query_id, text FROM ({_VARIANTS_SQL})"),
    f"SELECT {_NUMBER_SQL} AS query_id, q.item_id FROM ({_VARIANTS_SQL}) v JOIN ({_QRELS_SQL}) q ON q.query_id = v.base",
)


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(number, query_id, variant, business)`` of the questions in their forms, and the metrics of the systems by that number."""
    number = F.col("base") * len(D.VARIANTS) + F.array_position(F.array(*(F.lit(v) for v in D.VARIANTS)), F.col("variant")) - 1
    with workspace(spark) as held:
        asked = held.keep(written(query_variants(spark, sf_dir).withColumn("number", number.cast("long")), "asked", narrow=True))
        qrels = asked.select(F.col("number").alias("query_id"), "base").join(golden_qrels(spark, sf_dir).withColumnRenamed("query_id", "base"), "base").select("query_id", "item_id")
        ranking = _systems(asked.select(F.col("number").alias("id"), "text"), documents(spark, sf_dir))
        return asked, held.keep(written(E.metrics(ranking, qrels), "metrics", narrow=True))


@query(f"""
WITH m AS MATERIALIZED ({_GOLDEN_SQL}), v AS (SELECT system, variant, avg(ndcg_10) AS mean, count(*) AS n_queries FROM m JOIN (SELECT {_NUMBER_SQL} AS query_id, variant FROM ({_VARIANTS_SQL})) USING (query_id) GROUP BY 1, 2)
SELECT system, variant, round(mean, 6) AS mean, round(100 * (mean / base - 1), 6) + 0 AS delta_pct, n_queries FROM v LEFT JOIN (SELECT system, mean AS base FROM v WHERE variant = 'orig') USING (system)""")
def robustness(spark, sf_dir):
    """nDCG@10 of every system on every query form, and its change against the original questions in per cent."""
    asked, metrics = _golden(spark, sf_dir)
    rows = E.robustness(metrics.select("system", "query_id", F.col("ndcg_10").alias("value")), asked.select(F.col("number").alias("query_id"), "variant"))
    return rounded(rows, "mean", "delta_pct")


@query(f"""
SELECT business AS segment, system, round(avg(ndcg_10), 6) AS ndcg_10, count(*) AS n_queries
FROM ({_GOLDEN_SQL}) JOIN (SELECT {_NUMBER_SQL} AS query_id, business FROM ({_VARIANTS_SQL}) WHERE variant = 'orig') USING (query_id) GROUP BY 1, 2""")
def business_breakdown(spark, sf_dir):
    """Means per business over the original questions."""
    asked, metrics = _golden(spark, sf_dir)
    segments = asked.where("variant = 'orig'").select(F.col("number").alias("query_id"), F.col("business").alias("segment"))
    return rounded(E.breakdown(metrics, segments, ["ndcg_10"]), "ndcg_10")


_ORIG_SQL = f"""SELECT system, query_id, ndcg_10 AS value, row_number() OVER (PARTITION BY system ORDER BY query_id) - 1 AS pos
FROM ({_GOLDEN_SQL}) WHERE query_id % 6 = 0"""


@query(f"""
SELECT row_number() OVER (ORDER BY mean DESC, system DESC)::INTEGER AS place, system, mean, lo, hi, (SELECT count(*) FROM benchmark) AS n_selected, n AS n_scored FROM ({interval_sql(_ORIG_SQL, "system")})""")
def golden_leaderboard(spark, sf_dir):
    """Systems by nDCG@10 on the original questions; questions that no document answers are selected but not scored."""
    with workspace(spark) as held:
        asked, metrics = _golden(spark, sf_dir)
        selected = asked.where("variant = 'orig'").select(F.col("number").alias("query_id"))
        found = E.leaderboard(metrics.select("system", "query_id", F.col("ndcg_10").alias("value")), selected)
        found = held.keep(written(rounded(found, "mean", "lo", "hi"), "leaderboard", narrow=True))
    return found.orderBy("place")


_TABLES = ("ndcg_10", *(f"recall_{k}" for k in E.REPORTED))
_TABLES_SQL = f"""SELECT metric, system, query_id, value, row_number() OVER (PARTITION BY metric, system ORDER BY query_id) - 1 AS pos
FROM (UNPIVOT (SELECT system, query_id, {", ".join(f"{m}::DOUBLE AS {m}" for m in _TABLES)} FROM ({_GOLDEN_SQL}) WHERE query_id % 6 = 0) ON {", ".join(_TABLES)} INTO NAME metric VALUE value)"""


@query(f"""
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, system DESC)::INTEGER AS place, system, mean, lo, hi, (SELECT count(*) FROM benchmark) AS n_selected, n AS n_scored FROM ({interval_sql(_TABLES_SQL, "metric, system")})""")
def golden_leaderboards(spark, sf_dir):
    """The tables of the report on the original questions: the primary metric, and recall at several ranks."""
    with workspace(spark) as held:
        asked, metrics = _golden(spark, sf_dir)
        selected = asked.where("variant = 'orig'").select(F.col("number").alias("query_id"))
        found = E.leaderboards(metrics.select("system", "query_id", *_TABLES), selected, list(_TABLES))
        found = held.keep(written(rounded(found, "mean", "lo", "hi"), "leaderboards", narrow=True))
    return found.orderBy("metric", "place")
