"""The registered queries on the smallest data against what their contracts say, computed in plain Python or SQL."""

import collections
import math
import re
import zlib

import duckdb
import pytest

from corvane.llm import oracles, queries
from corvane.llm.url_filter import OP5_SQL
from corvane.llm.warc import OP6_SQL

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("name,twin", [("op3_language_id", oracles.OP3_SQL), ("op5_url_filter", OP5_SQL), ("op6_warc", OP6_SQL), ("op9_near_dedup", oracles.OP9_SQL)])
def test_twins(spark, sql, name, twin):
    found = sql.execute(twin)
    columns = [d[0] for d in found.description]
    want = sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in found.fetchall())
    got = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in got) == want


def test_crc_in_sql():
    for n in (0, 7, 1234567890123):
        got = duckdb.sql(f"SELECT xor({oracles.CRC32.format(n)}, 4294967295)").fetchall()[0][0]
        assert got == zlib.crc32(str(n).encode())


def test_op1(spark, docs):
    out = [r for r in rows(spark, "op1_best_fit_packing") if r.bin_id is not None]
    taken = collections.defaultdict(list)
    for r in out:
        taken[r.doc_id].append((r.start, r.words))
    for d, r in docs.items():
        n = len(WORD.findall(r.text or ""))
        assert sum(w for _, w in taken[d]) == n and sorted(taken[d]) == [(a, min(1024, n - a)) for a in range(0, n, 1024)]
    sets = {d: shingles(r.text) for d, r in docs.items()}
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for items in bins.values():
        ends = sorted((r.position, r.position + r.words) for r in items)
        assert ends[-1][1] <= 1024 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        assert len({docs[r.doc_id].source for r in items}) == len(items)
        for i, a in enumerate(items):
            for b in items[:i]:
                x, y = sets[a.doc_id], sets[b.doc_id]
                assert 100 * len(x & y) < 85 * len(x | y)


def test_op2(spark, docs):
    for r in rows(spark, "op2_quality_rules"):
        text = docs[r.doc_id].text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_op4(spark, docs):
    size = {d: len(WORD.findall(r.text or "")) for d, r in docs.items()}
    names = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, free, rest = {}, set(names), 1.5 * sum(total.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * total[s]}
        if not above:
            goal |= share
            break
        for s in above:
            goal[s] = 2.0 * total[s]
            rest -= goal[s]
        free -= above
    out = rows(spark, "op4_source_mixing")
    taken = collections.Counter()
    for r in out:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and math.isclose(r.target, goal[s], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    again = {r.doc_id: r.taken for r in rows(spark, "op4_source_mixing")}
    assert again == {r.doc_id: r.taken for r in out}


def test_op7(spark, docs):
    out = rows(spark, "op7_substring_dedup")
    assert len(out) == len(docs)
    seen = collections.defaultdict(set)
    for r in out:
        before, after = WORD.findall(docs[r.doc_id].text or ""), WORD.findall(r.text or "")
        assert r.changed == (r.text != docs[r.doc_id].text) and len(before) - len(after) == r.words_removed
        for i in range(len(after) - 50):
            seen[tuple(x.translate(LOWER) for x in after[i : i + 51])].add(r.doc_id)
    assert all(len(d) == 1 for d in seen.values())
    whole = {tuple(w) for w in (WORD.findall(r.text or "") for r in docs.values()) if 0 < len(w) < 20}
    assert whole <= {tuple(WORD.findall(r.text or "")) for r in out}  # short texts are never cut


def test_op10(spark, docs):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    tokens = {d: [*WORD.findall((r.text or "").translate(LOWER)), None] for d, r in docs.items()}
    counts = collections.Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    total = {True: [0.0, 0], False: [0.0, 0]}
    for r in rows(spark, "op10_lm_scoring"):
        ts = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0
        total[r.held_out][0] += r.score
        total[r.held_out][1] += len((docs[r.doc_id].text or "").encode())
    bits = {h: -s / math.log10(2) / b for h, (s, b) in total.items()}
    assert bits[False] < bits[True] < 4.5  # bits a byte: what was learned from costs less
