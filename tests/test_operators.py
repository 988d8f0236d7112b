"""Operators on small made cases: order statistics, variants, sheets, manifests, checks, files."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.operators import checks as C
from corvane.operators import datasets as D
from corvane.operators import evaluation as E
from corvane.operators import ingest as G
from corvane.operators import manifests as M
from corvane.operators import order as O
from corvane.operators import reports as R
from corvane.operators import retrieval as X
from corvane.sources import tables as S


def test_numbered_with_ties_and_nulls(spark):
    rows = [(None, "n"), *[(i % 7, str(i)) for i in range(500)], *[(3, "hot")] * 300]
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    got = sorted((r.pos, r.k) for r in O.numbered(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(len(rows)))
    assert [k for _, k in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert O.numbered(df.limit(0), ["k"]).count() == 0


def test_ranks_and_quantiles_of_a_hot_group(spark):
    rng = random.Random(3)
    values = {"hot": [rng.random() for _ in range(400)], "one": [5.0], "two": [1.0, 2.0], None: [7.0, 7.0, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("two", None)], "g string, v double")
    ranks = {r.g: r for r in O.nearest_ranks(df, ["g"], "v", (50, 95)).collect()}
    for g, vs in values.items():
        place = lambda q: sorted(vs)[max(1, min(len(vs), round(q / 100 * len(vs) + 0.5))) - 1]  # noqa: E731, B023
        assert (ranks[g].n, ranks[g].p50, ranks[g].p95) == (len(vs), place(50), place(95))
    linear = {r.g: r.p for r in O.linear_quantiles(df, ["g"], "v", {"p": 0.25}).collect()}
    for g, vs in values.items():
        at = (len(vs) - 1) * 0.25
        low, high = sorted(vs)[int(at)], sorted(vs)[min(int(at) + (at % 1 > 0), len(vs) - 1)]
        assert abs(linear[g] - (low + (high - low) * (at % 1))) < 1e-12


def test_variants_of_vietnamese_questions(spark):
    texts = ["Không biết như thế nào, được gói cước Đăng ký?", "plain", "Ẩn số ABC dịch vụ"]
    df = spark.createDataFrame([(str(i), t, "biz", 9) for i, t in enumerate(texts)], "query_id string, text string, business string, gold int")
    rows = {r.query_id: r for r in D.variants(df).collect()}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
    assert rows["0__nodiacritic"].text == plain(texts[0]) == "Khong biet nhu the nao, duoc goi cuoc Dang ky?"
    assert rows["0__abbrev"].text == "ko biết ntn, dc gói dk?" and rows["0__nodiacritic_abbrev"].text == "ko biet ntn, dc goi dk?"
    assert rows["2__lowercase"].text == texts[2].lower() and (rows["0__orig"].business, rows["0__orig"].gold) == ("biz", 9)
    assert {q for q in rows if q.startswith("1__")} == {"1__orig", "1__typo"}
    qrels = D.variant_qrels(D.variants(df), spark.createDataFrame([("0", 5), ("2", 6)], "query_id string, item_id int"))
    assert {(r.query_id, r.item_id) for r in qrels.where("item_id = 6").collect()} == {(q, 6) for q in rows if q.startswith("2__")}


def test_typo_swaps_neighbours_in_two_long_words(spark):
    texts = ["alpha beta gamma  delta epsilon", "tiny words only", "onlyone x"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    rows = {r.base_query_id: r.text.split(" ") for r in D.variants(df).where("variant = 'typo'").collect()}
    for i, t in enumerate(texts):
        words = t.split()
        got = rows.get(str(i), words)
        changed = [(a, b) for a, b in zip(words, got) if a != b]
        assert len(got) == len(words) and len(changed) <= min(2, sum(len(w) > 4 for w in words))
        for a, b in changed:
            at = next(k for k in range(len(a)) if a[k] != b[k])
            assert len(a) > 4 and b == a[:at] + a[at + 1] + a[at] + a[at + 2 :]


def test_robustness_and_leaderboard(spark):
    values = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 0.0), ("b", 2, 0.1), ("hybrid(a+b)", 1, 0.9)], "system string, query_id int, value double")
    forms = spark.createDataFrame([(1, "orig"), (2, "typo")], "query_id int, variant string")
    got = [(r.system, r.variant, r.delta_pct) for r in E.robustness(values, forms).collect()]
    assert got == [("hybrid(a+b)", "orig", 0.0), ("a", "orig", 0.0), ("a", "typo", -50.0), ("b", "orig", None), ("b", "typo", None)]
    board = E.leaderboard(values, spark.createDataFrame([(1,), (3,)], "query_id int"), 50).collect()
    assert [(r.place, r.system, r.n_selected, r.n_scored) for r in board] == [(1, "hybrid(a+b)", 2, 1), (2, "a", 2, 1), (3, "b", 2, 1)]
    assert E.best_system(values).first().system == "a"


def test_hybrids_equal_fusion(spark):
    rows = lambda name, *items: [(name, 1, k + 1, i, 1.0) for k, i in enumerate(items)]
    kind = "system string, query_id long, rank int, item_id long, score double"
    dense, lexical = spark.createDataFrame(rows("d", 4, 2, 9), kind), spark.createDataFrame(rows("bm25", 2, 7), kind)
    fused = [(r["rank"], r.item_id) for r in E.hybrids(dense, lexical).orderBy("rank").collect()]
    assert fused == [(r["rank"], r.item_id) for r in X.rrf(dense.drop("system"), lexical.drop("system")).orderBy("rank").collect()]
    assert E.hybrids(dense, lexical).first().system == "hybrid(d+bm25)"


def test_dense_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, None)], "id long, vec array<double>")
    got = X.dense_topk(df.where("id = 0"), df, 12).orderBy("rank").collect()
    assert [r.item_id for r in got[:9]] == list(range(3, 30, 3)) and [r.item_id for r in got[9:]] == [1, 4, 7]


def test_containing_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, "")]
    items = [(i, t[a : a + n]) for i, (t, a, n) in enumerate((rng.choice(docs[:60])[1], rng.randrange(40), rng.choice([1, 2, 3, 5, 9, 20, 40])) for _ in range(80))] + [(500, ""), (501, None)]
    want = {(q, d) for q, x in items for d, t in docs if x and t and x in t}
    got = S.containing(spark.createDataFrame(items, "id int, text string"), spark.createDataFrame(docs, "id int, text string"))
    assert {(r.query_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)


def test_prefixes_of_a_long_document(spark):
    rows = [("d", i, 3, f"t{i}") for i in range(2000)] + [("z", i, 0, "") for i in range(50)]
    out = D.document_prefixes(spark.createDataFrame(rows, "doc string, idx int, n_tokens long, text string"), 25, 32).collect()
    assert [(r.doc, r.n_chunks, r.n_tokens) for r in out] == [("d", 10, 30)]
    recount = D.document_prefixes(spark.createDataFrame(rows, "doc string, idx int, n_tokens long, text string"), 25, 32, F.lit(40).cast("long"))
    assert recount.count() == 0


def test_prefixes_end_at_a_chunk_beyond_the_band(spark):
    """Chunks after the one that oversteps stay out, whatever shard they are in."""
    rows = [(d, i, n, f"t{i}") for d, ns in {"a": [25, 90], "b": [3, 90], "c": [90], "d": [25, None, 90], "e": [None, 25, 90]}.items() for i, n in enumerate(ns + [1] * 40)]
    out = D.document_prefixes(spark.createDataFrame(rows, "doc string, idx int, n_tokens long, text string"), 25, 32).collect()
    assert sorted((r.doc, r.n_chunks, r.n_tokens, r.text) for r in out) == [("a", 1, 25, "t0"), ("d", 2, 25, "t0\n\nt1"), ("e", 1, 25, "t1")]


def test_prefixes_against_a_plain_loop(spark):
    rng, rows, want = random.Random(6), [], {}
    for doc in range(60):
        total, taken = 0, 0
        counts = [rng.choice([0, 1, 2, 5, 5, 40, 200]) for _ in range(rng.randrange(1, 300))]
        for n in counts:
            if total + n >= 100:
                break
            total, taken = total + n, taken + 1
        rows += [(doc, 3 * i, n, f"t{i}") for i, n in enumerate(counts)]
        if total >= 60:
            want[doc] = (taken, total, "\n\n".join(f"t{i}" for i in range(taken)))
    rng.shuffle(rows)
    out = D.document_prefixes(spark.createDataFrame(rows, "doc int, idx int, n_tokens long, text string"), 60, 100).collect()
    assert 10 < len(want) < 60 and {r.doc: (r.n_chunks, r.n_tokens, r.text) for r in out} == want


def test_fatal_checks(spark):
    with pytest.raises(ValueError, match="repeated question numbers"):
        G.question_set(spark.createDataFrame([(1, "a"), (1, "b")], "stt int, cau_hoi string"))
    blocks = spark.createDataFrame([("1::0", "1. Foo\n1. Foo")], "chunk_id string, block string")
    with pytest.raises(ValueError, match="repeated fact keys"):
        D.keyed_facts(blocks, spark.createDataFrame([], "chunk_id string, k int, fact_id string, text string"))
    with pytest.raises(ValueError, match="without a row"):
        G.in_canonical_order(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", 0), ("b", 1)], "id string, pos int"), "id")
    with pytest.raises(ValueError, match="case"):
        G.question_lookup(spark.createDataFrame([(1, "q")], "pos int, question string"))


def test_fact_keys_take_ids(spark):
    blocks = spark.createDataFrame([("1::0", "1. Foo\n2. Bar\n3. New")], "chunk_id string, block string")
    listed = spark.createDataFrame([("1::0", 1, "f1", "Foo"), ("1::0", 9, "f2", "Bar")], "chunk_id string, k int, fact_id string, text string")
    assert {r.key for r in D.keyed_facts(blocks, listed).collect()} == {"1::0#f1", "1::0#f2", "1::0#k3"}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"model": "m", "dim": 4,\n "modes": {"instruct": {"corpus": {"n": 3, "encode_seconds": 1.5}, "fact": {"n": 0}}}}')
    old = S.read_json(spark, f"{tmp_path}/m.json", f"model string, dim int, modes {M.MODES}")
    (tmp_path / "n.json").write_text('[{"model": "m", "dim": 8, "modes": {"instruct": {"corpus": {"n": 5}}, "no_instruct": {"corpus": {"n": 2, "identical_to_mode": "instruct"}}}}]')
    new = S.read_json(spark, f"{tmp_path}/n.json", f"model string, dim int, modes {M.MODES}")
    both = M.merged_manifests(old, new)
    rows = {(r.mode, r.input): r for r in M.statistics_rows(both).collect()}
    assert both.first().dim == 8 and set(rows) == {("instruct", "corpus"), ("no_instruct", "corpus")}
    assert rows["instruct", "corpus"].n == 5 and rows["no_instruct", "corpus"].notes == "window not recorded; same as instruct"
    pairs = spark.createDataFrame([("m", "instruct"), ("x", "instruct")], "model string, mode string")
    of_mode = spark.createDataFrame([], f"model string, mode string, path string, modes {M.MODES}")
    got = {r.model: r for r in M.manifest_for(pairs, old.select("model", F.lit("p").alias("path"), "modes"), of_mode).collect()}
    assert got["m"].manifest_path == "p" and got["x"].manifest_path is None
    t = old.select(*(c.alias(n) for n, c in M.timing(F.col("modes"), F.lit("instruct"), F.lit("nothing")).items())).first()
    assert t.embedding_corpus_seconds == 1.5 and t.embedding_questions_seconds is None
    assert [M.report_name(5), M.report_name(3, "bo_sung", "fact")] == ["coverage_top5", "coverage_top3_bo_sung_fact"]
    named = M.display_names(pairs, [("m", "instruct", "M!")]).collect()
    assert [r.config for r in named] == ["M!"] and M.run_row(spark, n=1, name="x").first().n == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä,\nb", "g"), (2, 'q"', "h")], "id int, text string, g string")
    S.write_csv(df, f"{tmp_path}/c")
    part = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,")
    assert sorted((r.id, r.text) for r in S.read_csv(spark, f"{tmp_path}/c").collect()) == [("1", "ä,\nb"), ("2", 'q"')]
    S.write_csv(df, f"{tmp_path}/by", by="g")
    assert (tmp_path / "by" / "g=g").is_dir()
    vectors = spark.createDataFrame([("m", "x", "corpus", 0, "a", [1.0, 2.0]), ("m", "x", "q", 0, "b", [1.0, 0.0]), ("m", "y", "corpus", 0, "a", [1.0])], "model string, mode string, input string, pos int, item_id string, vec array<double>")
    S.write_vectors(vectors, f"{tmp_path}/v")
    back = spark.read.parquet(f"{tmp_path}/v")
    index, asked = S.vector_pair(back, "m", "x", "q")
    assert (index.count(), asked.count()) == (1, 1)
    with pytest.raises(ValueError, match="no vectors of q"):
        S.vector_pair(back, "m", "y", "q")
    S.write_per_query(spark.createDataFrame([("s", 1, 0.5)], "system string, query_id int, ndcg_10 double"), f"{tmp_path}/pq")
    assert spark.read.json(f"{tmp_path}/pq").first().system == "s"
    assert list(G.existing(spark, {"a": f"{tmp_path}/c", "b": f"{tmp_path}/none"})) == ["a"]


def test_leakage_keeps_full_precision(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(" ".join(words), " ".join(words[:17]) + " z", "t", "f"), (" ".join(words), " ".join(words[:18][::-1]), "t", "f"), ("", "x", "t", "f")]
    got = [(round(r.containment, 6), r.kept) for r in D.leakage(spark.createDataFrame(rows, "question string, doc string, title string, fact string")).collect()]
    assert got == [(0.85, True), (0.9, False), (1.0, False)]


def test_question_filter(spark):
    df = spark.createDataFrame([("SKIP",), ("one two three four",), ("one two three four five",)], "q string")
    assert [r.ok for r in df.select(D.usable_question(F.col("q")).alias("ok")).collect()] == [False, False, True]


def test_upsert_in_order(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "a", 2)], "id int, config string, seq int")
    new = spark.createDataFrame([(1, "b", 10), (9, "c", 11)], "id int, config string, seq int")
    rows = G.first_appearance(R.upsert(old, new, ["config"]), "config", "seq").orderBy("id", "ordinal").collect()
    assert [(r.id, r.config, r.ordinal) for r in rows] == [(1, "a", 0), (1, "b", 1), (3, "a", 0), (9, "c", 2)]


def test_underfilled_counts_empty_groups(spark):
    picked = spark.createDataFrame([("short",)] * 3, "length_group string")
    assert {(r.length_group, r.n) for r in C.underfilled(picked, ("short", "long"), 3).collect()} == {("long", 0)}
