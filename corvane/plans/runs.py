"""Queries over timed runs, manifests, configurations, sheets and validation, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import chunk_key
from corvane.functions.vectors import parts
from corvane.operators import checks as C
from corvane.operators import datasets as D
from corvane.operators import ingest as G
from corvane.operators import manifests as M
from corvane.operators import reports as R
from corvane.operators import retrieval as X
from corvane.plans.catalog import _BANDED_SQL, _banded, _dense_sql, _facts, _FACTS_SQL, rounded
from corvane.plans.registry import DOCS_SQL, HASH, WORDS, query
from corvane.sources import sheets as S
from corvane.sources.tables import documents, n_tokens, questions, table, vectors, write_sheet
from corvane.sources.versions import Versions
from corvane.storage import new_path


# --- throughput rows, manifests, validation ---------------------------------------------------

def _timings(spark, sf_dir):
    """Events as timed runs; a run's tokens come from its user, padded to a multiple of eight."""
    e = table(spark, sf_dir, "events")
    real = F.col("user_id") % 23 + 1
    return e.select(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("batch_size"), F.col("value").alias("ms"), F.lit(1).alias("samples"), real.alias("real_tokens"), (F.ceil(real / 8) * 8).alias("padded_tokens"), "event_id")


_NEAREST = lambda q: f"round(list_sort(v)[greatest(1, least(len(v), round_even({q} / 100.0::DOUBLE * len(v) + 0.5::DOUBLE, 0)::INTEGER))], 6) AS p{q}"


@query(f"""
SELECT model, batch_size, len(v)::BIGINT AS runs, round(list_avg(v), 6) AS mean, {_NEAREST(50)}, {_NEAREST(95)}, {_NEAREST(99)}, round(1000.0::DOUBLE * len(v) / list_sum(v), 6) AS samples_per_sec,
  round(1000.0::DOUBLE * t / list_sum(v), 6) AS tokens_per_sec, round(t / len(v)::DOUBLE, 6) AS real_tokens, round(p, 6) AS padded_tokens
FROM (SELECT event_type AS model, (user_id % 5)::INTEGER AS batch_size, list(value) AS v, sum(user_id % 23 + 1)::DOUBLE AS t, avg(ceil((user_id % 23 + 1) / 8.0::DOUBLE) * 8) AS p FROM events GROUP BY 1, 2)""")
def bench_percentiles(spark, sf_dir):
    return R.latency_report(_timings(spark, sf_dir), ["model", "batch_size"])


def _status_rows(spark, sf_dir):
    t = R.latency_report(_timings(spark, sf_dir), ["model", "batch_size"])
    status = F.when((F.col("batch_size") == 3) & (F.length("model") % 2 == 0), "OOM").otherwise("ok")
    return t.select("model", "batch_size", F.col("batch_size").alias("row_pos"), status.alias("status"), "samples_per_sec")


_STATUS_SQL = "SELECT model, batch_size, CASE WHEN batch_size = 3 AND length(model) % 2 = 0 THEN 'OOM' ELSE 'ok' END AS status, round(1000.0::DOUBLE * n / s, 6) AS samples_per_sec FROM (SELECT event_type AS model, (user_id % 5)::INTEGER AS batch_size, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2)"
_OOM_SQL = f"SELECT model, batch_size, CASE WHEN max(CASE WHEN status = 'OOM' THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY batch_size) = 1 THEN 'OOM' ELSE status END AS status, samples_per_sec FROM ({_STATUS_SQL})"


@query(_OOM_SQL)
def oom_propagation(spark, sf_dir):
    return R.oom_propagated(_status_rows(spark, sf_dir), ["model"]).select("model", "batch_size", "status", "samples_per_sec")


@query(f"SELECT model, batch_size, samples_per_sec FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY samples_per_sec DESC, batch_size) AS k FROM ({_OOM_SQL}) WHERE status = 'ok') WHERE k = 1")
def best_throughput(spark, sf_dir):
    return R.best_throughput(R.oom_propagated(_status_rows(spark, sf_dir), ["model"]), ["model"])


@query("""
WITH o AS (SELECT o_orderpriority AS model, o_orderkey AS row_pos, o_orderkey % 4 = 0 AS single, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH'),
n AS (SELECT o_orderpriority AS model, min(o_orderkey) AS came, arg_max(o_totalprice, o_orderkey) AS value FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' GROUP BY 1),
b AS (SELECT model, row_pos AS place, 1 AS fresh, NULL AS came, single, value FROM o WHERE NOT (single AND model IN (SELECT model FROM n))
  UNION ALL SELECT model, (SELECT min(row_pos) FROM o WHERE o.model = n.model), 0, came, true, value FROM n)
SELECT row_number() OVER (ORDER BY place ASC NULLS LAST, fresh, came) AS pos, model, single, value FROM b""")
def merge_single(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH'").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("row_pos"), (F.col("o_orderkey") % 4 == 0).alias("single"), F.col("o_totalprice").alias("value"))
    new = o.where("o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("row_pos"), F.lit(True).alias("single"), F.col("o_totalprice").alias("value"))
    return R.merged_single(old, new, ["model"])


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1) UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal + 1 FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1)")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.join(c.where("c_custkey = 1").select("c_mktsegment"), "c_mktsegment", "left_semi").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return R.upsert(c, new, ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT coalesce(n.s, o.s) AS supplier, coalesce(n.v, o.v) AS value FROM (SELECT s_suppkey AS s, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0) o FULL JOIN (SELECT s_suppkey AS s, s_acctbal + 100 AS v FROM supplier WHERE s_suppkey % 2 = 0) n ON o.s = n.s")
def manifest_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("value"))
    return R.merged_manifest(s.where("supplier % 3 <> 0"), s.where("supplier % 2 = 0").withColumn("value", F.col("value") + 100), ["supplier"])


@query("""
SELECT p_brand AS model, p_type AS input, p_size AS mode, p_size % 3 AS prompt, p_size = f AS encode, CASE WHEN p_size <> f THEN f END AS identical_to_mode
FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand, p_type, p_size % 3) AS f FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part))""")
def prompt_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("input"), F.col("p_size").alias("mode"), (F.col("p_size") % 3).alias("prompt")).distinct()
    return R.identical_prompts(p)


@query("SELECT r::INTEGER AS run, i::INTEGER AS i, (r * 32 + i) % n AS pos, c_custkey FROM (SELECT count(*) AS n FROM customer), range(40) a(r), range(32) b(i) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) ON p = (r * 32 + i) % n")
def rotating_batches(spark, sf_dir):
    return D.batches_of(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 32, 40).select("run", "i", "pos", "c_custkey")


@query("""
SELECT r::INTEGER AS run, sum(least(length(p_name), 24))::BIGINT AS real_tokens, max(least(length(p_name), 24)) * count(*) AS padded_tokens
FROM range(10) a(r), range(64) b(i) JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part) ON p = i GROUP BY 1""")
def fixed_batch_tokens(spark, sf_dir):
    """Tokens (here letters) of the first batch, run ten times: what is in the texts, and what is computed after padding."""
    rows = D.batches_of(table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").cast("long").alias("n_tokens")), ["p_partkey"], 64, 10, rotate=False)
    return R.batch_tokens(rows, ["run"], 24)


@query("""
SELECT 'duplicate_text' AS "check", count(*) AS n FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'unknown_label', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'dimension', count(*) FROM embeddings WHERE len(embedding) <> 64
UNION ALL SELECT 'length_drift', count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)""")
def violations(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return R.violations({
        "duplicate_text": R.duplicates(d.select(F.sha2("text", 256).alias("sha256")), "sha256"), "unlabelled": R.missing(d, lab, "doc_id"), "unknown_label": R.missing(lab, d, "doc_id"),
        "dimension": vectors(spark, sf_dir).where(F.size("vec") != 64), "length_drift": d.where(~F.col("n_chars").eqNullSafe(F.length("text"))),
    })


# --- ingest, configuration and run rows -------------------------------------------------------

@query("""
SELECT o_custkey::VARCHAR || '::' || o_orderkey AS chunk_id, l_linenumber AS fact_no, p_name AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'""")
def graph_pattern(spark, sf_dir):
    """Chunks joined to their facts over an edge table; the predicate on chunks reaches their scan."""
    o, e, f = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    chunks = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source"), chunk_key(F.col("o_custkey"), F.col("o_orderkey")).alias("chunk_id"))
    edges = e.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("fact_no"))
    return G.over_edges(chunks, edges, f.select(F.col("p_partkey").alias("target"), F.col("p_name").alias("text"))).select("chunk_id", "fact_no", "text")


@query("""
WITH m AS (SELECT r_name AS model, CASE WHEN r_regionkey % 3 <> 1 THEN 'Find: ' || r_name END AS q, CASE WHEN r_regionkey % 3 = 2 THEN 'Doc: ' || r_name END AS d FROM region),
i AS (SELECT n_name AS input, CASE WHEN n_nationkey % 2 = 0 THEN 'query' ELSE 'doc' END AS kind FROM nation)
SELECT model, input, kind, mode, CASE WHEN mode = 'instruct' THEN CASE WHEN kind = 'query' THEN q ELSE d END END AS prompt
FROM m, i, (VALUES ('instruct'), ('no_instruct')) t(mode) WHERE mode <> 'instruct' OR q IS NOT NULL OR d IS NOT NULL""")
def prompt_resolution(spark, sf_dir):
    """The prompt of every model, input and mode: none without instruction, else the one of the input's kind."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    k = F.col("r_regionkey") % 3
    models = r.select(F.col("r_name").alias("model"), F.when(k != 1, F.concat(F.lit("Find: "), "r_name")).alias("query_instruction"), F.when(k == 2, F.concat(F.lit("Doc: "), "r_name")).alias("doc_instruction"))
    return M.prompt_rows(n.select(F.col("n_name").alias("input"), F.when(F.col("n_nationkey") % 2 == 0, "query").otherwise("doc").alias("kind")), models)


@query("""
SELECT r_name AS model, dataset, max_length, mode, CASE WHEN max_length > cap THEN 'unsupported' ELSE 'ok' END AS status, CASE WHEN max_length > cap THEN 'max_length ' || max_length || ' > model cap ' || cap ELSE '' END AS error
FROM (SELECT r_name, (2048 * (r_regionkey + 1))::INTEGER AS cap FROM region), (SELECT DISTINCT p_brand AS dataset, 128 * p_size AS max_length FROM part), (VALUES ('single'), ('4'), ('16')) t(mode)""")
def benchmark_grid(spark, sf_dir):
    """Every model, data set and mode of a throughput run, with the lengths that a model cannot take."""
    models = table(spark, sf_dir, "region").select(F.col("r_name").alias("model"), (2048 * (F.col("r_regionkey") + 1)).cast("int").alias("cap"))
    datasets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), (128 * F.col("p_size")).alias("max_length")).distinct()
    return M.benchmark_grid(models, datasets, ["single", "4", "16"])


@query("""
WITH e AS (SELECT user_id % 97 AS pair_id, event_id AS seq, value AS score FROM events), l AS (SELECT pair_id, arg_max(score, seq) AS score FROM e GROUP BY 1)
SELECT p_partkey AS pair_id, p_name AS text, score, score IS NULL AS missing FROM part LEFT JOIN l ON pair_id = p_partkey""")
def external_scores(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("text"))
    outside = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("pair_id"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return R.with_external(pairs, outside).withColumn("missing", F.col("score").isNull())


@query("""
SELECT p_partkey AS pair_id FROM part WHERE p_partkey % 11 = 0 AND trim(p_name) <> trim(CASE WHEN p_size % 2 = 0 THEN ' ' || p_name || ' ' ELSE p_name || '!' END)""")
def external_mismatch(spark, sf_dir):
    """Outside scores that were computed on another text: blanks around it do not count."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("text_a"), "p_size")
    outside = p.where("pair_id % 11 = 0").select("pair_id", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "text_a", F.lit(" "))).otherwise(F.concat("text_a", F.lit("!"))).alias("text_a"))
    return C.differing_texts(p, outside, ["text_a"])


#: Prices per million tokens, and the most tokens a text may have.
PRICES, MOST = {"ada002": 0.1, "3small": 0.02, "3large": 0.13}, 8191


@query(f"SELECT model, price, round(sum(least(n, {MOST})) / 1e6::DOUBLE * price, 6) AS cost FROM ({DOCS_SQL}), (VALUES {', '.join(f"('{m}', {p}::DOUBLE)" for m, p in PRICES.items())}) p(model, price) GROUP BY 1, 2")
def cost_estimate(spark, sf_dir):
    """Cost of embedding all documents at a price per million tokens, texts cut at 8191 tokens."""
    return rounded(R.cost(documents(spark, sf_dir).select(n_tokens().alias("n_tokens")), PRICES, MOST), "cost")


@query("SELECT count(*) AS n, count(*) FILTER (nfc_normalize(text) = text) AS n_nfc FROM documents")
def nfc_count(spark, sf_dir):
    return R.nfc_count(documents(spark, sf_dir))


@query("""
SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 AND text <> lang""")
def sha_drift(spark, sf_dir):
    """Documents whose text is not the recorded one, missing records included (every fifth has none, every seventh a wrong one)."""
    d = table(spark, sf_dir, "documents")
    recorded = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("text")), 256).alias("sha256"))
    return C.drifted(d.select("doc_id", "text"), recorded, "doc_id")


@query("SELECT model, status, count(*) AS n FROM (" + _OOM_SQL + ") GROUP BY 1, 2")
def status_histogram(spark, sf_dir):
    return R.status_histogram(R.oom_propagated(_status_rows(spark, sf_dir), ["model"]), ["model"])


@query(f"""
SELECT length_group, count(*) AS n, min(n_tokens) AS least, list_sort(list(n_tokens))[len(list(n_tokens)) // 2 + 1] AS middle, max(n_tokens) AS most,
  (SELECT '{{' || string_agg('"' || source || '":' || c, ',' ORDER BY source) || '}}' FROM (SELECT source, count(*) AS c FROM ({_BANDED_SQL}) x WHERE x.length_group = b.length_group GROUP BY 1)) AS sources FROM ({_BANDED_SQL}) b GROUP BY 1""")
def dataset_summary(spark, sf_dir):
    """Smallest, middle (index n // 2) and largest token count per band, and its sources."""
    return R.length_summary(_banded(spark, sf_dir), "length_group", "n_tokens", "source")


@query(f"SELECT id, length_group || '-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS sample_id FROM (SELECT id, length_group, row_number() OVER (PARTITION BY length_group ORDER BY n_tokens, id) AS k FROM ({_BANDED_SQL}))")
def sample_ids(spark, sf_dir):
    return G.group_ids(_banded(spark, sf_dir), "length_group", ["n_tokens", "id"]).select("id", "sample_id")


@query("""
SELECT event_type AS model, count(*) AS n_batches, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, arg_min(value, event_id) AS first, round(sum(value), 6) AS total, round(count(*) / sum(value), 6) AS items_per_second FROM events GROUP BY 1""")
def encode_summary(spark, sf_dir):
    """Batch timings of an encoding run: mean, percentiles, the first batch, and the overall rate."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("batch"), F.col("value").alias("seconds"), F.lit(1).alias("items"))
    return rounded(R.encode_summary(e, ["model"]), "mean", "p50", "p95", "total", "items_per_second")


def _manifests(spark, sf_dir) -> DataFrame:
    """Suppliers as manifests: nations are models, and each supplier is an entry of a mode and an input."""
    s = F.col("s_suppkey")
    entry = F.struct(
        F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal")).alias("n"), F.when(s % 2 == 0, "query").otherwise("doc").alias("kind"), F.when(s % 5 == 0, F.col("s_name")).alias("prompt"),
        F.when(s % 3 != 0, (s % 7 * 1024).cast("int")).alias("max_seq_length"), F.when(s % 3 == 1, F.lit(64)).alias("batch_size"), (s * 100).alias("tokens_total"), (s % 50).alias("tokens_max"), (s % 4).alias("tokens_truncated"),
        (s / 8).alias("encode_seconds"), (s / 4).alias("items_per_second"), (s / 2).alias("tokens_per_second"),
        F.struct((s / 16).alias("p50"), (s / 32).alias("p95"), (s / 64).alias("first")).alias("batch_seconds"), F.struct((s * 1.0).alias("p50"), (s * 2.0).alias("p95")).alias("single_item_latency_ms"),
        F.when(s % 6 == 0, "no_instruct").alias("identical_to_mode"),
    ).cast(M.ENTRY)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("model"), F.when(s % 2 == 0, "instruct").otherwise("no_instruct").alias("mode"), F.concat(F.lit("in"), s.cast("string")).alias("input"), entry.alias("e"))
    modes = rows.groupBy("model", "mode").agg(F.map_from_entries(F.collect_list(F.struct("input", "e"))).alias("inputs"))
    out = modes.groupBy("model").agg(F.lit(64).alias("dim"), F.map_from_entries(F.collect_list(F.struct("mode", "inputs"))).alias("modes"))
    return out.withColumns({"peak_vram_gb": F.col("model").cast("int") / 4, "load_seconds": F.col("model").cast("int") * 1.5})


@query("""
SELECT 'in' || s AS input, m AS model, CASE WHEN m = '7' THEN 'seven' ELSE m END AS label, mode, 64 AS dim, n, kind, CASE WHEN s % 5 = 0 THEN s_name ELSE '' END AS prompt, CASE WHEN s % 3 <> 0 THEN (s % 7 * 1024)::INTEGER WHEN m = '5' THEN 512 ELSE 2048 END AS "window", CASE WHEN s % 3 = 1 THEN 64 ELSE 32 END AS batch_size,
  s * 100 AS tokens_total, s % 50 AS tokens_max, s % 4 AS tokens_truncated, s / 8.0::DOUBLE AS encode_seconds, s / 4.0::DOUBLE AS items_per_second, s / 2.0::DOUBLE AS tokens_per_second, s / 16.0::DOUBLE AS batch_p50, s / 32.0::DOUBLE AS batch_p95, s / 64.0::DOUBLE AS batch_first,
  s::DOUBLE AS latency_p50, s * 2.0::DOUBLE AS latency_p95, m::INTEGER / 4.0::DOUBLE AS peak_vram_gb, m::INTEGER * 1.5::DOUBLE AS load_seconds, concat_ws('; ', CASE WHEN s % 3 = 0 THEN 'window not recorded' END, CASE WHEN s % 6 = 0 THEN 'same as no_instruct' END, CASE WHEN s % 4 > 0 THEN (s % 4) || ' cut' END) AS notes
FROM (SELECT s_suppkey AS s, s_name, s_nationkey::VARCHAR AS m, CASE WHEN s_suppkey % 2 = 0 THEN 'instruct' ELSE 'no_instruct' END AS mode, CASE WHEN s_suppkey % 2 = 0 THEN 'query' ELSE 'doc' END AS kind, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal)::BIGINT END AS n FROM supplier)
WHERE coalesce(n, 0) <> 0 AND NOT (m = '3' AND mode = 'instruct')""")
def manifest_rows(spark, sf_dir):
    """Nested manifests as flat rows with defaults and notes; empty entries and an excluded pair give none."""
    return M.statistics_rows(_manifests(spark, sf_dir), [("3", "instruct")], {"5": 512}, {"7": "seven"})


@query("""
WITH e AS (SELECT s_nationkey::VARCHAR AS model, CASE WHEN s_suppkey % 2 = 0 THEN 'instruct' ELSE 'no_instruct' END AS mode, s_suppkey AS s, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal)::BIGINT END AS n FROM supplier),
o AS (SELECT * FROM e WHERE s % 3 <> 0), w AS (SELECT model, mode, s, n + 7 AS n FROM e WHERE s % 2 = 0 OR s % 5 = 0)
SELECT coalesce(w.model, o.model) AS model, coalesce(w.mode, o.mode) AS mode, 'in' || coalesce(w.s, o.s) AS input, CASE WHEN w.s IS NOT NULL THEN w.n ELSE o.n END AS n FROM o FULL JOIN w USING (s)""")
def manifest_nested_merge(spark, sf_dir):
    """Two runs' manifests merged per mode and input, the newer entry winning."""
    every = _manifests(spark, sf_dir)
    number = lambda k: F.substring(k, F.lit(3), F.lit(20)).cast("long")
    old = every.withColumn("modes", F.transform_values("modes", lambda _, v: F.map_filter(v, lambda k, __: number(k) % 3 != 0)))
    new = every.withColumn("modes", F.transform_values("modes", lambda _, v: F.transform_values(F.map_filter(v, lambda k, __: (number(k) % 2 == 0) | (number(k) % 5 == 0)), lambda __, e: e.withField("n", e["n"] + 7))))
    rows = M.merged_manifests(old, new).select("model", F.explode("modes").alias("mode", "inputs"))
    return rows.select("model", "mode", F.explode("inputs").alias("input", "e")).select("model", "mode", "input", "e.n")


# --- coverage report ----------------------------------------------------------------------------------

def _report_parts(spark, sf_dir):
    v = vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    asked = questions(spark, sf_dir).select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "lang", "source").alias("title"), F.substring("text", 1, 40).alias("text"), "doc_id", F.lit(0).alias("chunk_index"), F.when(F.col("source").isNotNull(), F.array("source")).alias("businesses"))
    manifests = spark.range(1).select(F.lit("m").alias("model"), F.lit("no_instruct").alias("mode"), F.lit("m/manifest.json").alias("manifest_path"))
    entry = lambda s, p: F.struct(F.lit(10).cast("long").alias("n"), F.lit("doc").alias("kind"), F.lit(p).cast("string").alias("prompt"), F.lit(s).alias("encode_seconds"), (10 / F.lit(s)).alias("items_per_second"))
    both = F.create_map(F.lit("corpus"), entry(2.0, None), F.lit("coverage_questions"), entry(4.0, "Find"))
    return v, asked, chunks, manifests.withColumn("modes", F.create_map(F.lit("no_instruct"), both))


_REPORT_SQL = """
SELECT 'm' AS model, 'no_instruct' AS mode, query_id AS question_id, coalesce(b.text, query_id::VARCHAR) AS question, rank, '{index}' AS "index", {chunk} AS chunk_id, round(score, 8) AS score, {fact_id} AS fact_id, {fact_text} AS fact_text, {n} AS n_facts_top50,
  coalesce(concat_ws('/', lang, source), '') AS title, coalesce(substr(d.text, 1, 40), '') AS text, d.doc_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE 0 END AS chunk_index, CASE WHEN source IS NULL THEN '[]' ELSE '["' || source || '"]' END AS businesses, 'm/manifest.json' AS embedding_manifest,
  2.0::DOUBLE AS embedding_corpus_seconds, 4.0::DOUBLE AS embedding_questions_seconds, 5.0::DOUBLE AS embedding_corpus_items_per_second, 2.5::DOUBLE AS embedding_questions_items_per_second, 'Find' AS embedding_question_prompt, 'cpu' AS retrieval_device, 0.5::DOUBLE AS retrieval_seconds
FROM ({hits}) r LEFT JOIN benchmark b ON b.item_id = query_id LEFT JOIN documents d ON d.doc_id = {chunk}"""


@query(_REPORT_SQL.format(index="corpus", chunk="r.item_id", fact_id="''", fact_text="''", n="NULL::BIGINT", hits=_dense_sql(64, 5)))
def coverage_report(spark, sf_dir):
    """The 24 columns of the coverage report over the chunk index; questions and chunks without metadata get defaults."""
    v, asked, chunks, manifests = _report_parts(spark, sf_dir)
    hits = X.dense_topk(v.where("id % 50 = 0"), v, 5).select(F.lit("m").alias("model"), F.lit("no_instruct").alias("mode"), F.col("query_id").alias("question_id"), "rank", F.col("item_id").alias("chunk_id"), "score")
    none = spark.createDataFrame([], "fact_key string, fact_id string, fact_text string")
    return M.coverage_report(hits, asked, chunks, none, manifests, "corpus", "coverage_questions", "cpu", 0.5)


@query(_REPORT_SQL.format(index="fact", chunk="r.parent_id", fact_id="'f' || r.best_item", fact_text="'fact ' || r.best_item", n="r.n_hits", hits=f"""
WITH pool AS ({_dense_sql(64, 50)})
SELECT query_id, rank, parent_id, score, best_item, n_hits FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank)::INTEGER AS rank FROM (
    SELECT query_id, item_id // 7 AS parent_id, max(score) AS score, min(rank) AS first_rank, arg_min(item_id, rank) AS best_item, count(*) AS n_hits FROM pool GROUP BY 1, 2)) WHERE rank <= 5"""))
def coverage_report_facts(spark, sf_dir):
    """The same over the fact index: seven consecutive vectors are the facts of a chunk."""
    v, asked, chunks, manifests = _report_parts(spark, sf_dir)
    parent = v.select(F.col("id").alias("item_id"), F.floor(F.col("id") / 7).alias("parent_id"))
    hits = X.finer_topk(v.where("id % 50 = 0"), v, parent)
    hits = hits.select(F.lit("m").alias("model"), F.lit("no_instruct").alias("mode"), F.col("query_id").alias("question_id"), "rank", F.col("parent_id").alias("chunk_id"), "score", F.col("best_item").cast("string").alias("fact_key"), F.col("n_hits").alias("n_facts"))
    facts = v.select(F.col("id").cast("string").alias("fact_key"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("fact_id"), F.concat(F.lit("fact "), F.col("id").cast("string")).alias("fact_text"))
    return M.coverage_report(hits, asked, chunks, facts, manifests, "fact", "coverage_questions", "cpu", 0.5)


# --- sheets, keys and order ------------------------------------------------------------------------------

@query(f"""
WITH s AS (SELECT p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'c' || p_size END AS c, trim(p_name) AS q, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS e FROM part)
SELECT pos, CASE WHEN c <> '' THEN c ELSE 'row' || (row_number() OVER (ORDER BY pos) - 1) END AS case_id, q AS question, e AS expected FROM s WHERE q <> '' AND e <> ''""")
def coverage_cases(spark, sf_dir):
    """Cases of a sheet: rows with both texts, named by case or by place."""
    p = table(spark, sf_dir, "part")
    sheet = p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("c"), F.col("p_size").cast("string"))).alias(" Case"), F.col("p_name").alias("QUESTION"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("Expected "))
    return G.coverage_cases(sheet)


@query("SELECT 'c' || p_size AS case_id, arg_max(trim(p_name), p_partkey) AS question FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def question_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sheet = p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("c"), F.col("p_size").cast("string"))).alias("case"), F.col("p_name").alias("Question"))
    return G.question_lookup(sheet)


@query("SELECT s_suppkey::VARCHAR AS id, trim(s_name) AS text FROM supplier WHERE s_suppkey % 4 <> 0")
def question_set(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return G.question_set(s.select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey")).alias("STT"), F.col("s_name").alias("cau_hoi")))


@query("SELECT p_name AS text, 'question' AS kind FROM part WHERE trim(p_name) <> '' UNION ALL SELECT p_type, 'answer' FROM part WHERE trim(p_type) <> '' UNION ALL SELECT p_brand, 'chunk' FROM part WHERE trim(p_brand) <> ''")
def text_columns(spark, sf_dir):
    """The text columns of a sheet, chosen by their headers, as rows."""
    sheet = table(spark, sf_dir, "part").select(F.col("p_name").alias("Question"), F.col("p_type").alias("answer "), F.col("p_brand").alias("c.text"), F.col("p_retailprice").alias("c.text embedding"))
    return G.text_columns(sheet, {"question": ("question",), "answer": ("answer",)}, {"chunk": "c.text"}, ("embedding",))


@query(f"""
WITH r AS (SELECT 'q' AS dataset, item_id AS id, text FROM benchmark UNION ALL SELECT 'c', p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END FROM part)
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY {HASH.format("'20260917:' || dataset || ':' || id")}, id::VARCHAR) - 1 AS pos, id::VARCHAR AS id, text FROM r WHERE text <> ''""")
def dataset_rows(spark, sf_dir):
    """Data sets without empty texts in a seeded order."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).otherwise("").alias("text"))
    return G.dataset_rows({"q": questions(spark, sf_dir), "c": p}, 20260917)


_ORDER_SQL = "SELECT doc_id || '::0' AS chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id % 3 <> 0"


@query(f"SELECT fact_id, row_number() OVER (ORDER BY o.pos, f.k) - 1 AS pos FROM (SELECT *, split_part(fact_id, '#', 2)::INTEGER AS k FROM ({_FACTS_SQL})) f JOIN ({_ORDER_SQL}) o USING (chunk_id)")
def fact_order(spark, sf_dir):
    """Facts of known chunks in the chunks' canonical order."""
    facts, order = _facts_and_order(spark, sf_dir)
    return G.ordered_facts(facts, order)[0].select("fact_id", "pos")


@query(f"SELECT chunk_id, count(*) AS n FROM ({_FACTS_SQL}) WHERE chunk_id NOT IN (SELECT chunk_id FROM ({_ORDER_SQL})) GROUP BY 1")
def unknown_chunks(spark, sf_dir):
    facts, order = _facts_and_order(spark, sf_dir)
    return G.ordered_facts(facts, order)[1]


@query(f"SELECT count(*) FILTER (chunk_id IN (SELECT chunk_id FROM ({_ORDER_SQL}))) AS n_kept, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM ({_ORDER_SQL}))) AS n_skipped FROM ({_FACTS_SQL})")
def restricted_facts(spark, sf_dir):
    facts, order = _facts_and_order(spark, sf_dir)
    return G.restricted(facts, order)[1]


def _facts_and_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = _facts(spark, sf_dir).select("fact_id", "chunk_id", F.substring_index("fact_id", "#", -1).cast("int").alias("k"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.lit(0).alias("i"), chunk_key(F.col("doc_id"), F.lit(0)).alias("chunk_id"))
    return facts, G.canonical_order(docs, "doc_id", "i").select("chunk_id", "pos")


@query(f"SELECT fact_id, source, d.text[1:20] AS head FROM ({_FACTS_SQL}) f JOIN documents d ON d.doc_id || '::0' = f.chunk_id".replace("SELECT fact_id, source,", "SELECT fact_id, d.source,"))
def facts_with_chunks(spark, sf_dir):
    """Every fact with its chunk's columns; a fact without a chunk is an error."""
    d = table(spark, sf_dir, "documents").select(chunk_key(F.col("doc_id"), F.lit(0)).alias("chunk_id"), "source", F.substring("text", 1, 20).alias("head"))
    return G.with_chunks(_facts(spark, sf_dir).select("fact_id", "chunk_id"), d).select("fact_id", "source", "head")


@query("SELECT o_orderkey, o_custkey, (dense_rank() OVER (ORDER BY f, o_custkey) - 1)::INTEGER AS ordinal FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)")
def first_appearance(spark, sf_dir):
    return G.first_appearance(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("""
SELECT c_custkey, split_part(n, '/', 1) AS model, CASE WHEN contains(n, '/') THEN split_part(n, '/', 2) ELSE 'no_instruct' END AS mode, CASE WHEN c_custkey % 3 = 0 THEN '<none>' ELSE c_mktsegment END AS business, substr(c_name, 1, 5) AS short
FROM (SELECT *, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/instruct' ELSE '' END AS n FROM customer)""")
def configuration_names(spark, sf_dir):
    """Names of models and modes taken apart, first or default elements, and clipped texts."""
    c = table(spark, sf_dir, "customer")
    model, mode = M.model_and_mode(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "/instruct").otherwise("")))
    businesses = F.when(F.col("c_custkey") % 3 != 0, F.array("c_mktsegment", F.lit("x")))
    return c.select("c_custkey", model.alias("model"), mode.alias("mode"), M.first_or(businesses).alias("business"), M.clipped(F.col("c_name"), 5).alias("short"))


@query("""
SELECT p_partkey, least(p_size * 256, 8192)::INTEGER AS "window", CASE WHEN least(p_size * 256, 8192) > 4096 THEN greatest(1, (p_size % 9) // 4) ELSE p_size % 9 END::INTEGER AS batch FROM part""")
def window_and_batch(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 256).cast("int").alias("asked"), F.lit(8192).alias("cap"), F.lit(2048).alias("max_seq_length"), (F.col("p_size") % 9).cast("int").alias("batch_size"))
    return M.window_and_batch(p).select("p_partkey", "window", "batch")


@query("""SELECT user_id, strftime(max(event_time), '%Y-%m-%dT%H:%M:%S.%n') AS last, CASE WHEN count(*) > 1 THEN '[' || strftime(min(event_time), '%Y-%m-%dT%H:%M:%S.%n') || ', ' || strftime(max(event_time), '%Y-%m-%dT%H:%M:%S.%n') || ']' ELSE '[]' END AS ends FROM (SELECT user_id, ts AS event_time FROM events) GROUP BY 1""")
def normalised_times(spark, sf_dir):
    """Times as ISO strings, single and in lists."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.min("ts").alias("first"), F.count("*").alias("n"))
    e = e.select("user_id", "last", F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array()).alias("ends"))
    return G.normalised(e).select("user_id", "last", F.concat(F.lit("["), F.array_join("ends", ", "), F.lit("]")).alias("ends"))


# --- validation of runs -----------------------------------------------------------------------------------

@query("""
SELECT 'misplaced' AS "check", count(*) AS n FROM (SELECT vec_id AS pos, vec_id AS id FROM embeddings) a FULL JOIN (SELECT vec_id AS pos, CASE WHEN label = 3 THEN -1 ELSE vec_id END AS id FROM embeddings WHERE vec_id % 10 <> 1) b USING (pos) WHERE a.id IS DISTINCT FROM b.id
UNION ALL SELECT 'unpaired', count(*) FROM (SELECT vec_id AS i FROM embeddings) a FULL JOIN (SELECT vec_id + 1 AS i FROM embeddings) b USING (i) WHERE (i = 0 OR i = (SELECT max(vec_id) + 1 FROM embeddings) OR i % 7 = 0)
UNION ALL SELECT 'wrong_dimensions', count(*) FROM (SELECT label FROM embeddings WHERE label % 2 = 0 GROUP BY 1)
UNION ALL SELECT 'count_mismatch', count(*) FROM (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) <> count(*) FILTER (vec_id % 10 <> 1))
UNION ALL SELECT 'without_vector', count(*) FROM embeddings WHERE vec_id % 10 = 1
UNION ALL SELECT 'too_many_parts', count(*) FROM embeddings WHERE (len(embedding) + 15) // 16 > 3
UNION ALL SELECT 'truncated', count(*) FROM (SELECT source FROM (SELECT source, len({words}) AS n FROM documents) WHERE n > 2048 GROUP BY 1)
UNION ALL SELECT 'fact_keys', count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 1)""".replace("{words}", WORDS.format("text")))
def run_violations(spark, sf_dir):
    """Alignment, pairing, sizes, counts and windows, each check as the number of what breaks it."""
    v, d = vectors(spark, sf_dir), documents(spark, sf_dir)
    some = v.where("id % 10 <> 1")
    every = v.select(F.col("id").alias("pos"), "id")
    other = some.select(F.col("id").alias("pos"), F.when(F.col("label") == 3, -1).otherwise(F.col("id")).alias("id"))
    a = v.select(F.col("id").alias("pair_id"), "vec")
    b = v.select((F.col("id") + 1).alias("pair_id"), F.when((F.col("id") + 1) % 7 == 0, F.slice("vec", 1, 8)).otherwise(F.col("vec")).alias("vec"))
    models = v.select(F.col("label").alias("model"), "vec")
    dims = models.select("model").distinct().withColumn("dim", F.when(F.col("model") % 2 == 0, 32).otherwise(64))
    n_parts = v.select("id", F.size(parts(F.col("vec"), 16)).alias("n_parts"))
    return R.violations({
        "misplaced": C.misplaced(every, other), "unpaired": C.unpaired(a, b), "wrong_dimensions": C.wrong_dimensions(models, dims),
        "count_mismatch": C.count_mismatch(v, some, ["label"]), "without_vector": C.without_vector(v, some), "too_many_parts": C.too_many_parts(n_parts, 3),
        "truncated": C.truncated(d.select(F.col("source").alias("input"), n_tokens().alias("n_tokens"), F.lit(2048).alias("window"))), "fact_keys": R.duplicates(d, "source"),
    })


# --- sheets and stored versions -------------------------------------------------------------------

_TEXTLIKE_SQL = r"length({0}) >= 8 AND length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= greatest(4, 0.3 * length({0}))"


@query(f"""
WITH c AS (SELECT 'facts' AS sheet, p_partkey AS k, p_name AS text, 'question' AS kind FROM part UNION ALL SELECT 'facts', p_partkey, p_type, 'answer' FROM part
  UNION ALL SELECT 'notes', item_id, text, 'chunk' FROM benchmark UNION ALL SELECT 'notes', item_id, reverse(text), 'question' FROM benchmark)
SELECT sheet, kind, count(*) AS n, count(DISTINCT trim(text)) AS n_texts FROM c WHERE {_TEXTLIKE_SQL.format("trim(text)")} GROUP BY 1, 2""")
def sheet_texts(spark, sf_dir):
    """Texts of several CSV sheets with different headers, beside a lock file and a backup that are not read."""
    folder = new_path(spark, "sheets")
    p, b = table(spark, sf_dir, "part"), table(spark, sf_dir, "benchmark")
    sheets = {
        "facts.csv": p.select(F.col("p_partkey").alias("No"), F.col("p_name").alias(" Question"), F.col("p_type").alias("ANSWER"), F.col("p_brand").alias("c.text embedding")),
        "notes.csv": b.select(F.col("text").alias("the c.text"), F.col("item_id").alias("other"), F.reverse("text").alias("question")),
        "~$facts.csv": p.select(F.col("p_name").alias("question")), "notes.bak.csv": b.select(F.col("text").alias("question")),
    }
    for name, df in sheets.items():
        write_sheet(df, f"{folder}/{name}")
    texts = S.sheet_texts(S.read_sheets(spark, f"{folder}/*.csv"), {"question": ("question",), "answer": ("answer",)}, {"chunk": "c.text"}, ("embedding",))
    return texts.groupBy("sheet", "kind").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@query("""
WITH o AS (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM customer),
u AS (SELECT c_custkey, c_mktsegment, CASE WHEN seg IN (1, 3) THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, seg, seg IN (1, 3) AS fresh FROM o)
SELECT c_custkey, c_mktsegment, c_acctbal, (dense_rank() OVER (ORDER BY fresh, seg) - 1)::INTEGER AS ordinal FROM u""")
def stored_upsert(spark, sf_dir):
    """Customers by segment in a store of versions: two segments are replaced, the others are not rewritten; ordinals follow first appearance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    store = Versions(spark, new_path(spark, "versions"), ["c_mktsegment"])
    store.upsert(c)
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    store.upsert(c.where(F.col("c_mktsegment").isin(names[1::2])).withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return store.read()
