"""Text functions against plain Python: composed forms, shared n-grams, and times as text."""

import datetime
import random
import unicodedata

from pyspark.sql import functions as F

from corvane.functions.text import doubtful, is_nfc, longest_common_ngram, nfc
from corvane.operators.ingest import normalised, over_edges


def test_composed_form_of_every_character(spark):
    # but for ideographs and most Hangul syllables, which are alike
    chars = [chr(c) for c in (*range(1, 0x3400), *range(0xA000, 0xAC40), *range(0xD780, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) != "Cn"]
    texts = [a + c for c in chars for a in ("", "a", "ᄀ")]
    rows = spark.createDataFrame([(texts[i : i + 2000],) for i in range(0, len(texts), 2000)], "ts array<string>").select(F.explode("ts").alias("t"))
    got = rows.select("t", nfc(F.col("t")).alias("n"), is_nfc(F.col("t")).alias("y"))
    wrong = [r.t for r in got.collect() if r.n != unicodedata.normalize("NFC", r.t).strip() or r.y != unicodedata.is_normalized("NFC", r.t)]
    assert wrong == []


def test_only_doubtful_texts_reach_python(spark):
    plain = ["Hướng dẫn đăng ký gói cước", "Übergröße", "Привет, мир", "日本語の文章", "한국어", "", "  x　", "Ω λόγος"]
    doubts = [unicodedata.normalize("NFD", t) for t in ("Hướng", "é", "한국어")] + ["Å", "ẋ̣"]
    rows = spark.createDataFrame([(t,) for t in [*plain, *doubts, None]], "t string")
    assert {r.d for r in rows.select(doubtful(F.col("t")).alias("d")).collect()} == {*doubts, None}
    got = rows.select("t", nfc(F.col("t")).alias("n"), is_nfc(F.col("t")).alias("y")).collect()
    nothing = {None: (None, None)}
    assert all((r.n, r.y) == (nothing.get(r.t) or (unicodedata.normalize("NFC", r.t).strip(), unicodedata.is_normalized("NFC", r.t))) for r in got)


def longest(a, b, cap):
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return max((n for n in range(1, cap + 1) if grams(a, n) & grams(b, n)), default=0)


def test_longest_common_ngram(spark):
    rng = random.Random(2)
    pairs = [([], []), (["a"], []), (["a"], ["a"]), (["a"] * 30, ["a"] * 30)]
    for _ in range(300):
        b = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        at = rng.randrange(len(b) + 1)
        a = [rng.choice("abcd") for _ in range(rng.randrange(8))] + b[at : at + rng.randrange(20)] + [rng.choice("abcd") for _ in range(rng.randrange(8))]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for cap in (12, 5, 1):
        got = df.select("a", "b", longest_common_ngram(F.col("a"), F.col("b"), cap).alias("n")).collect()
        assert [(r.a, r.b) for r in got if r.n != longest(r.a, r.b, cap)] == []


def test_times_as_text(spark):
    t, d = datetime.datetime(2024, 3, 1, 4, 5, 6, 70), datetime.date(2024, 3, 1)
    df = spark.createDataFrame([(t, t, d, [t, None], (d, 1), {"k": t}, "s"), (None,) * 7], "i timestamp, l timestamp_ntz, d date, a array<timestamp_ntz>, s struct<d: date, n: int>, m map<string, timestamp_ntz>, o string")
    rows = normalised(df).collect()
    text = "2024-03-01T04:05:06.000070000"
    assert tuple(rows[0]) == (text + "+00:00", text, "2024-03-01", [text, None], ("2024-03-01", 1), {"k": text}, "s")
    assert tuple(rows[1]) == (None,) * 7


def test_pattern_over_edges(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "source int, name string")
    edges = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (4, 7), (3, 9)], "source int, target int")
    ends = spark.createDataFrame([(7, "x"), (8, "y")], "target int, text string")
    assert sorted((r.name, r.text) for r in over_edges(nodes, edges, ends).collect()) == [("a", "x"), ("a", "x"), ("b", "y")]
