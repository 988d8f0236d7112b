"""Source divergence audit: how far each source of a language is from the others, and by which terms.

A term's share in a group is ``1 + floor(10^9 (count + 5) / (N + 5 V))``, over the V terms that occur in at
least ``LEAST_DOCS`` documents of the language. A source differs from another by the sum of the absolute
differences of all shares, and from its language by the terms whose share is larger in it.

The terms to report are found before any N is known: with more occurrences in the group, fewer in the
language and an earlier name, a term comes first whatever the totals are. Each partition keeps of a group
the terms that fewer than ``MOST`` others dominate in this way (its skyband); skybands are merged by
another pass of the same kind, and what is left is ranked exactly. Partitions are sorted by term, so
that a term is only dominated by terms before it: the pass streams, and holds two numbers a kept term.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import kernels as K
from corvane.llm.storage import few, workspace, written

LEAST_DOCS = 30
MOST = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Distinct (group, term) rows that a task holds before it hands them on, and cells of a dense block of shares.
HELD = 1 << 18
CELLS = 1 << 20
BLOCK = 256

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition, each seldom more than once a task."""
    groups: dict[tuple[str, str], int] = {}
    held, rows = [], 0

    def merged(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["g", "term", "n_sum", "docs_sum"]).rename_columns(["g", "term", "n", "docs"])

    def given(table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        for batch in table.combine_chunks().to_batches(50_000):
            g = batch.column("g")
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), *(batch.column(c) for c in ("term", "n", "docs"))], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        named = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([groups.setdefault(g, len(groups)) for g in named], np.int64)
        for part in K.slices(batch.column("text"), 2 * K.SLICE_BYTES):
            lowered = K.LOWER[part.data]
            found = K.runs(_IS_LETTER[lowered], part.offsets)
            names, first, code = np.unique(K.word_hashes(lowered, found, lower=False), return_index=True, return_inverse=True)
            row = np.repeat(np.arange(part.rows), found.counts)
            pair, times = np.unique(row * max(len(names), 1) + code, return_counts=True)
            row, code = np.divmod(pair, max(len(names), 1))
            pair, inverse = np.unique(group[part.first + row] * max(len(names), 1) + code, return_inverse=True)
            g, code = np.divmod(pair, max(len(names), 1))
            held.append(pa.table({
                "g": g, "term": K.texts(lowered, found.start[first], found.end[first]).take(pa.array(code)),
                "n": np.bincount(inverse, times, len(pair)).astype(np.int64), "docs": np.bincount(inverse, minlength=len(pair)),
            }))
            rows += len(pair)
            if rows > 2 * HELD:
                held = [merged(held)]
                rows = len(held[0])
                if rows > HELD:
                    yield from given(held[0])
                    held, rows = [], 0
    if held:
        yield from given(merged(held))


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (count + PRIOR) / whole)`` in three exact steps of long division (whole below 9.2 * 10^15)."""
    rest, quotient = count + PRIOR, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // whole
        rest = rest % whole
    return 1 + quotient


def share(count: str, whole: str) -> Column:
    """:func:`shares` as a column expression."""
    rest, quotient = f"({count} + {PRIOR})", "0L"
    for _ in range(3):
        rest, quotient = f"({rest} * 1000)", f"({quotient} * 1000 + {rest} * 1000 div {whole})"
        rest = f"({rest} % {whole})"
    return F.expr(f"1 + {quotient}")


class Skyband:
    """Of a group's terms, given in order of name, those that fewer than ``most`` earlier ones dominate."""

    def __init__(self, most: int):
        self.most, self.n, self.total = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which of the terms that come next are kept.

        Who is dominated by ``most`` terms is dominated by as many kept ones, as dominance is transitive.
        """
        kept = np.zeros(len(n), bool)
        for k in range(0, len(n), BLOCK):
            a, b = n[k : k + BLOCK], total[k : k + BLOCK]
            above = ((self.n >= a[:, None]) & (self.total <= b[:, None])).sum(1)
            above += np.tril((a >= a[:, None]) & (b <= b[:, None]), -1).sum(1)
            here = above < self.most
            kept[k : k + BLOCK] = here
            self.n, self.total = np.append(self.n, a[here]), np.append(self.total, b[here])
        return kept


def skyband_rows(batch: pa.RecordBatch, bands: dict[tuple[str, str], Skyband], most: int) -> np.ndarray:
    """Row numbers of a batch (sorted by term within each group) that stay in their group's skyband."""
    table = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "at": np.arange(len(batch))}).group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
    n, total = batch.column("n").to_numpy(), batch.column("total").to_numpy()
    kept = []
    for lang, source, at in zip(table["lang"].to_pylist(), table["source"].to_pylist(), table["at_list"].combine_chunks()):
        at = at.values.to_numpy()
        band = bands.setdefault((lang, source), Skyband(most))
        kept.append(at[band.add(n[at], total[at])])
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


class Differences:
    """Sums of absolute differences of shares between the sources of one language, over terms in order."""

    def __init__(self, sources: dict[str, int], wholes: np.ndarray):
        self.sources, self.wholes = sources, wholes
        self.sums = np.zeros((len(sources), len(sources)), np.int64)
        self.room = max(1, CELLS // len(sources))

    def add(self, term: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Counts of whole terms; ``term`` numbers them from 0 in ascending order."""
        for low in range(0, int(term[-1]) + 1 if len(term) else 0, self.room):
            a, b = np.searchsorted(term, (low, low + self.room))
            counts = np.zeros((min(self.room, int(term[-1]) + 1 - low), len(self.sources)), np.int64)
            counts[term[a:b] - low, source[a:b]] = n[a:b]
            p = shares(counts, self.wholes)
            for k in range(len(self.sources) - 1):
                self.sums[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0)


def audit_rows(batches: Iterator[pa.RecordBatch], groups: dict[str, tuple[list[str], list[int]]], most: int) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by lang and term: its skybands (lang, source, item, n, total), and the differences (lang, source, item, value) over its terms."""
    bands: dict[tuple[str, str], Skyband] = {}
    differences: dict[str, Differences] = {}
    rest: pa.Table | None = None

    def count(table: pa.Table) -> None:
        """``table`` holds whole terms."""
        if not len(table):
            return
        langs, terms = table["lang"].to_numpy(zero_copy_only=False), table["term"].to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], (terms[1:] != terms[:-1]) | (langs[1:] != langs[:-1])))
        sources, n = table["source"].to_numpy(zero_copy_only=False), table["n"].to_numpy()
        edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
        for a, b in zip(edges, edges[1:]):
            names, wholes = groups[langs[a]]
            d = differences.get(langs[a])
            if d is None:
                d = differences[langs[a]] = Differences({s: k for k, s in enumerate(names)}, np.array(wholes, np.int64))
            d.add(np.cumsum(new[a:b]) - 1, np.array([d.sources[s] for s in sources[a:b]], np.int64), n[a:b])

    for batch in batches:
        kept = pa.Table.from_batches([batch.take(pa.array(skyband_rows(batch, bands, most)))])
        none = pa.nulls(len(kept), pa.int64())
        yield from pa.table({"lang": kept["lang"], "source": kept["source"], "item": kept["term"], "n": kept["n"], "total": kept["total"], "value": none}).combine_chunks().to_batches(50_000)
        table = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        if not len(table):
            continue
        # a term may go on in the next batch
        lang, term = table["lang"][-1].as_py(), table["term"][-1].as_py()
        whole = len(table)
        while whole and table["term"][whole - 1].as_py() == term and table["lang"][whole - 1].as_py() == lang:
            whole -= 1
        count(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None:
        count(rest)
    for lang, d in differences.items():
        names = pa.array(list(d.sources), pa.string())
        a, b = np.triu_indices(len(names), 1)
        for k in range(0, len(a), 50_000):
            i, j = a[k : k + 50_000], b[k : k + 50_000]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), none, none, pa.array(d.sums[i, j])], ["lang", "source", "item", "n", "total", "value"])


def merged_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The skyband of skybands, of partitions that hold whole groups sorted by term."""
    bands: dict[tuple[str, str], Skyband] = {}
    for batch in batches:
        yield batch.take(pa.array(skyband_rows(batch, bands, most)))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every source of every language of ``docs(text, lang, source)``.

    Part ``pair``: each other source of the language and the sum of absolute differences of all shares (0
    if the language has no terms). Part ``term``: up to ``most`` terms with a larger share in the source
    than in the language, and by how much. Ranks count from 1, by value descending, then item by code point.

    Null text, lang and source are empty; texts without letters have no terms but their group counts;
    repeated rows are documents of their own; other columns are ignored. An empty table gives an empty
    one. All arithmetic is on whole numbers. Every pair of a language's sources is a row of the result,
    so the table of groups, which goes through the driver to the tasks, is expected to be some thousand rows.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    with workspace(spark) as held:
        found = docs.mapInArrow(term_rows, "lang string, source string, term string, n long, docs long")
        counts = written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        totals = written(totals, "totals")
        kept = written(counts.drop("docs").join(few(totals, 48), ["lang", "term"]), "kept_terms")
        languages = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        groups = docs.select("lang", "source").distinct().join(F.broadcast(languages), "lang", "left")
        groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
        groups = groups.select("lang", "source", (F.coalesce("group_n", F.lit(0)) + PRIOR * F.col("v")).alias("whole"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_whole"))
        groups = held.keep(written(groups, "groups", narrow=True))
        sources = defaultdict(lambda: ([], []))
        for r in groups.where("whole IS NOT NULL").select("lang", "source", "whole").orderBy("lang", "source").toLocalIterator():
            sources[r["lang"]][0].append(r["source"])
            sources[r["lang"]][1].append(r["whole"])
        shared = spark.sparkContext.broadcast(dict(sources))
        by_term = kept.select("lang", "source", "term", "n", "total").repartition("lang", "term").sortWithinPartitions("lang", "term")
        audit = by_term.mapInArrow(lambda it: audit_rows(it, shared.value, most), "lang string, source string, item string, n long, total long, value long")
        audit = held.keep(written(audit, "audit"))
    bands = audit.where("value IS NULL").select("lang", "source", F.col("item").alias("term"), "n", "total").repartition("lang", "source").sortWithinPartitions("lang", "source", "term")
    bands = bands.mapInArrow(lambda it: merged_rows(it, most), "lang string, source string, term string, n long, total long").join(few(groups, 64), ["lang", "source"])
    terms = bands.withColumn("value", share("n", "whole") - share("total", "lang_whole")).where("value > 0").withColumnRenamed("term", "item")
    terms = terms.withColumn("rank", F.row_number().over(by("lang", "source"))).where(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    other = groups.select("lang", F.col("source").alias("item"))
    nothing = groups.select("lang", "source").join(other, "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    pairs = audit.where("value IS NOT NULL").select("lang", "source", "item", "value").unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by("lang", "source"))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all sources of ``documents``; ranks are ints."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.group_n + {PRIOR} * v.v)::HUGEINT AS p, 1 + ({SCALE}::HUGEINT * (k.total + {PRIOR})) // (v.lang_n + {PRIOR} * v.v)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(s.value), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY 1, 2, 3),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= {MOST})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked"""
