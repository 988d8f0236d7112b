"""Spelling variants against edit distances of all pairs, and the twin."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import queries, spelling

DATA = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(close[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def odd_rows():
    rng = random.Random(4)
    stems = ["interest", "internet", "international", "ñandúes", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Äpfelchen", "naïveté×", "x" * 90, "y" * 200]
    words = list(stems)
    for w in stems:
        for _ in range(14):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcéÉzÿ") + w[i:], w[:i] + rng.choice("xyß") + w[i + 1 :])))
    rows = []
    for k in range(120):
        picked = rng.choices(words, [60 if w in stems else 1 for w in words], k=60)
        rows.append((k, rng.choice((" ", "-", "1", "\n")).join(picked)))
    return rows + [(None, " ".join(words)), (5, None), (6, ""), (7, "12 ! \U0001f600"), (8, "z" * 100_000 + " " + "z" * 100_000 + " " + "z" * 99_999 + " " + "z" * 99_999)] + rows[:20]


@pytest.mark.parametrize("rare,block", [(64, 2048), (1, 4), (3, 1000)])
def test_against_all_pairs(spark, rare, block):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "w", 1, "r", 2) for r in rows], "doc_id long, text string, word string, n long, root string, key int")
    assert sorted(map(tuple, spelling.spelling_variants(docs, rare, block).collect())) == brute(rows)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=9), st.text(max_size=150)), max_size=12))
def test_crc(pairs):
    parts = [b.encode("utf-8", "replace") for _, b in pairs]
    ends = np.cumsum([0] + [len(p) for p in parts])
    state = np.array([zlib.crc32(a.encode("utf-8", "replace")) for a, _ in pairs], np.uint32)
    got = spelling.crcs(state, np.frombuffer(b"".join(parts) or b"x", np.uint8), ends[:-1], ends[1:])
    assert got.tolist() == [zlib.crc32(p, zlib.crc32(a.encode("utf-8", "replace"))) for (a, _), p in zip(pairs, parts)]


def grams_of(word, size_of):
    _, pos, window = spelling.windows(*spelling.coded(pa.array([word])))
    return [(int(w) >> 7 * (6 - size_of(int(w)))) << 7 * (6 - size_of(int(w))) for w in window]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", min_size=7, max_size=12), st.integers(0, 12), st.sampled_from("abx"), st.integers(0, 2), st.integers(0, 9))
def test_an_edit_changes_no_more_grams_than_the_bound(word, at, letter, kind, salt):
    at = min(at, len(word) - 1)
    other = (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :])[kind]

    def size_of(window):  # a prefix tree: whether it goes on after q codes depends on these codes alone
        for q in range(3, 6):
            if hash((window >> 7 * (6 - q), salt)) % 3 == 0:
                return q
        return 6

    mine, theirs = collections.Counter(grams_of(word, size_of)), collections.Counter(grams_of(other, size_of))
    sizes = [min(size_of(int(w)), len(word) + 2 - p) for p, w in zip(*spelling.windows(*spelling.coded(pa.array([word])))[1:])]
    bound = max(sum(p <= place < p + n for p, n in enumerate(sizes)) for place in range(1, len(word) + 1))
    assert sum((mine - theirs).values()) <= bound < len(sizes)


def test_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.QUERIES["op12_spelling_variants"](spark, DATA)
    assert dict(got.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(con.execute(spelling.OP12_SQL).fetchall())
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()])
