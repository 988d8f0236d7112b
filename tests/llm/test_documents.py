"""The document operators against brute force, on rows that hold every awkward case."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import kernels as K
from corvane.llm import language_id, lm_scoring, mixing, near_dedup, packing, quality_rules, substring_dedup, url_filter, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, row string, key long, d int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def make_rows():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["Éa", "ñu", "ÀB", "the", "of"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [base, base.upper(), prose(70), None, "", " \t\n", "tiny", "tiny", "a b c d", prose(3000), "\n".join([prose(30), passage, prose(30)]), "\n".join([prose(40), passage, passage, "x"]), "line one two\nline one two\nline one two\nother", "### $$$ && %% " * 30, "12 34 !!"]
    for _ in range(12):  # near copies of the base, at similarities on both sides of the threshold
        w = base.split()
        for _ in range(rng.choice((1, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [prose(rng.randrange(5, 200)) for _ in range(30)]
    rows = [(i, t, rng.choice(("en", "fr", None)), rng.choice(("s0", "s0", "s1", "s2", None)), len(t or ""), "x", 1, "r", 9, 3) for i, t in enumerate(texts)]
    rows.append((None, base, "en", "s0", 3, None, None, None, None, None))
    rows += [rows[2], (2, "another text for a repeated id", None, "s1", 1, "x", 1, "r", 9, 3)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def closed(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_near_duplicates(docs, rows):
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] and sets[i] and sets[j] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))]
    root = closed(len(rows), links)
    smallest = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[root[i]] = min(smallest[root[i]], r[0])
    want = sorted((str(r[0]), len(sets[i]), str(None if r[0] is None else smallest[root[i]] if sets[i] else r[0])) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_one_of_each_group_keeps_columns(docs):
    kept = near_dedup.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 0").count() == 1


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_repeated_paragraphs(docs, rows):
    removed = substring_dedup.repeated_paragraphs(docs)
    lines = substring_dedup._keyed(docs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.removed)) for r in lines.join(removed, ["ka", "kb"]).select("doc_id", "removed").collect())
    units = []
    for at, r in enumerate(dict.fromkeys((r[0], r[1]) for r in rows)):
        for n, line in enumerate((r[1] or "").split("\n")):
            if len(words(line)) >= substring_dedup.LEAST_WORDS:
                units.append((r[0] is not None, r[0] or 0, n, r, shingles(line)))
    units.sort(key=lambda u: u[:3])
    root = closed(len(units), [(i, j) for i in range(len(units)) for j in range(i) if 100 * len(units[i][4] & units[j][4]) >= 80 * len(units[i][4] | units[j][4])])
    gone = collections.defaultdict(list)
    for i, u in enumerate(units):
        if root[i] != i:
            gone[u[3]].append(u[2])
    assert got == sorted((r[0] if r[0] is not None else -1, tuple(gone[r[0], r[1]])) for r in rows if gone.get((r[0], r[1])))


def test_remove_repeats(docs, empty):
    out = substring_dedup.remove_repeats(docs)
    texts = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert out.columns == docs.columns and 3 in texts and texts[3] is None and 1 not in texts
    assert texts[11].count("\n") == 1  # both copies of the passage are gone, the short line stays
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_quality_measures(docs, rows, empty):
    out = quality_rules.measure(docs).select("d.doc_id", *quality_rules.MEASURES).collect()
    want = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        want.append((str(r[0]), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(covered)))
    assert sorted((str(r.doc_id), *r[1:6]) for r in out) == sorted(want)
    bare = sorted((str(r[0]), sum(not any(c.isalpha() for c in w) for w in WORD.findall(r[1] or "")), sum(c.isalpha() for c in r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), r.n_bare, r.n_letters) for r in out) == bare
    assert quality_rules.keep_good(empty).count() == 0


def test_label_model(spark):
    rng = random.Random(1)
    rows, truth = [], []
    for _ in range(2000):
        good = rng.random() < 0.7
        truth.append(good)
        rows.append(tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in (0.9, 0.9, 0.8, 0.8, 0.8, 0.7, 0.7, 0.6, 0.6)))
    votes = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in quality_rules.RULES))
    model = quality_rules.fit(votes)
    assert abs(model.prior - 0.7) < 0.05 and abs(model.good["length"][1] / (1 - model.good["length"][0]) - 0.9) < 0.05
    got = votes.withColumn("p", model.posterior()).select("p").collect()
    assert sum((r.p >= 0.5) == t for r, t in zip(got, truth)) / len(truth) > 0.93


def em_by_hand(rows, rules, rounds, start):
    """The same model by plain loops over all rows, without patterns."""
    prior = start.prior
    side = {True: [dict(start.good[r]) for r in rules], False: [dict(start.bad[r]) for r in rules]}

    def posterior(row):
        good, bad = prior, 1 - prior
        for k, v in enumerate(row):
            good, bad = good * side[True][k][v], bad * side[False][k][v]
        return good / (good + bad)

    for _ in range(rounds):
        p = [posterior(row) for row in rows]
        total = sum(p)
        new = {True: [], False: []}
        for k in range(len(rules)):
            g = {v: (sum(x for x, row in zip(p, rows) if row[k] == v) + 1) / (total + 3) for v in (-1, 0, 1)}
            b = {v: (sum(1 - x for x, row in zip(p, rows) if row[k] == v) + 1) / (len(rows) - total + 3) for v in (-1, 0, 1)}
            share = total / len(rows)
            for v, wrong in ((-1, g[-1] > b[-1]), (1, b[1] > g[1])):
                if wrong:
                    g[v] = b[v] = share * g[v] + (1 - share) * b[v]
            new[True].append(g)
            new[False].append(b)
        side, prior = new, min(max(total / len(rows), 0.05), 0.98)
    return prior, side, [posterior(row) for row in rows]


def test_label_model_by_hand(spark):
    rng = random.Random(4)
    rows = [tuple(rng.choice((-1, 0, 1, 1) if rng.random() < 0.8 else (-1, -1, 0)) for _ in quality_rules.RULES) for _ in range(60)] * 5
    votes = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], ", ".join(f"{r} int" for r in quality_rules.RULES) + ", n int")
    model = quality_rules.fit(votes.drop("n"), rounds=6, tolerance=0.0)
    prior, side, p = em_by_hand(rows, quality_rules.RULES, 6, quality_rules.START)
    assert math.isclose(model.prior, prior, rel_tol=1e-9)
    for k, r in enumerate(quality_rules.RULES):
        for v in (-1, 0, 1):
            assert math.isclose(model.good[r][v], side[True][k][v], rel_tol=1e-9) and math.isclose(model.bad[r][v], side[False][k][v], rel_tol=1e-9)
    got = [r.p for r in votes.withColumn("p", model.posterior()).orderBy("n").select("p").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got, p))


def test_bad_documents_go(spark):
    """Of the labelled documents of 50 words and more, bad ones are rejected and good ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    long = {r.doc_id for r in docs.collect() if len(WORD.findall(r.text or "")) >= 50}
    good, bad = ({d for d in long if labels.get(d) == q} for q in (1, 0))
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_keep_good_keeps_columns(docs):
    kept = quality_rules.keep_good(docs)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and {0, 2, 9} <= ids and not {3, 4, 6, 13} & ids


def test_mixing(docs, rows, empty):
    placed, sources, spans = mixing.mixed(docs)
    taken = collections.defaultdict(list)
    for r in spans.collect():
        taken[r.source_no, r.bucket, r.rn].append((r["pass"], r.start, r.words))
    targets, totals, given = {}, collections.Counter(), collections.Counter()
    for r in sources.collect():
        targets[r.source_no] = (r.source_size, r.target)
    rows_ = placed.collect()
    assert sorted(r.size for r in rows_) == sorted(len(words(r[1])) for r in rows)
    for r in rows_:
        own = taken[r.source_no, r.bucket, r.rn]
        for p in {p for p, _, _ in own}:  # within a pass no word is taken twice
            cover = sorted((s, s + n) for q, s, n in own if q == p)
            assert all(a[1] <= b[0] for a, b in zip(cover, cover[1:])) and cover[-1][1] <= r.size
        totals[r.source_no] += r.size
        given[r.source_no] += sum(n for _, _, n in own)
        assert sum(n for _, _, n in own) <= 2 * r.size
    for s, (size, target) in targets.items():
        assert totals[s] == size and abs(given[s] - target) <= 0.5 and target <= 2 * size + 1e-9
    assert abs(sum(t for _, t in targets.values()) - 1.5 * sum(totals.values())) < 1e-6
    assert mixing.mix_documents(empty).count() == 0
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.select("text").collect()) == sum(given.values())
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, mixing.mixed(docs)[2].collect()))


def plain_permutation(n, source, seed, bits=64):
    """A Feistel walk in plain whole numbers, of the same keys."""
    full = 2**bits
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % full
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % full
        return h ^ (h >> 31)

    def once(x):
        left, right = x >> half, x % 2**half
        for turn in range(4):
            key = (seed * 2654435761 + source * 40503 + turn * 65599) % full
            left, right = right, left ^ (mixed((right + key) % full) % 2**half)
        return left << half | right

    def place(x):
        y = once(x)
        while y >= n:
            y = once(y)
        return y

    return [place(x) for x in range(n)]


def test_mixing_replayed(spark):
    """Every slot of the mix, word by word: draws, permutation and join done again over lists of words."""
    import numpy as np

    size = mixing.BLOCK
    rng = random.Random(4)
    lengths = [*(rng.randrange(0, 900) for _ in range(60)), 5 * size + 7, 0, size]
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(n)), rng.choice(["a", "b", "b", "b", None])) for i, n in enumerate(lengths)]
    placed, sources, spans = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    placed = sorted(placed.collect(), key=lambda r: (r.source_no, r.bucket, r.ka, r.kb, r.doc_id))
    # the words of each source, one document after another
    streams = collections.defaultdict(list)
    for r in placed:
        assert r.offset == len(streams[r.source_no])
        streams[r.source_no] += [(r.doc_id, k) for k in range(r.size)]
    targets = {r.source_no: r.target for r in sources.collect()}
    wanted = {s: min(round(targets[s]), 2 * len(w)) for s, w in streams.items()}
    # slot k of a source takes block permutation[k mod n], until the source has what it owes
    expected, quota = collections.defaultdict(list), {}
    for s, stream in streams.items():
        n = -(-len(stream) // size)
        turn, left, k = plain_permutation(n, s, mixing.SEED), wanted[s], 0
        while left > 0:
            block = stream[turn[k % n] * size : (turn[k % n] + 1) * size][:left]
            expected[s].append(block)
            left, k = left - len(block), k + 1
        quota[s] = k
    # one shard of all slots here; its counts are drawn until every source has given its slots
    counts, _ = mixing._plan([len(streams[s]) for s in sorted(streams)], [targets[s] for s in sorted(streams)])
    assert np.asarray(counts).sum(0).tolist() == [quota[s] for s in sorted(streams)]
    name = {(r.source_no, r.bucket, r.rn): r.doc_id for r in placed}
    got = collections.defaultdict(list)
    for r in spans.collect():
        got[r.source_no, r.shard, r.slot].append((name[r.source_no, r.bucket, r.rn], r.start, r.words))
    for s, blocks in expected.items():
        slots = sorted(k[1:] for k in got if k[0] == s)
        assert len(slots) == len(blocks)
        for (shard, slot), block in zip(slots, blocks):
            words_ = sorted((d, k) for d, start, n in got[s, shard, slot] for k in range(start, start + n))
            assert words_ == sorted(block)
    taken = collections.Counter(d for blocks in expected.values() for block in blocks for d, _ in block)
    own = {r.doc_id: r.taken for r in _op4_rows(spark, rows)}
    assert own == {r[0]: taken.get(r[0], 0) for r in rows}


def _op4_rows(spark, rows):
    """The registered query over the same rows."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-mix-")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return mixing.op4_source_mixing(spark, folder).collect()


@given(st.lists(st.tuples(st.integers(0, 500), st.sampled_from((1.0, 2.0, 3.0))), max_size=8))
@settings(max_examples=60, deadline=None)
def test_targets(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    got = mixing.targets(sizes, weights)
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes)) and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6
    free = [g / w for g, s, w in zip(got, sizes, weights) if g < 2 * s - 1e-9]
    assert not free or max(free) - min(free) < 1e-6


@given(st.integers(1, 700), st.integers(0, 30))
@settings(max_examples=60, deadline=None)
def test_permutation(n, source):
    import numpy as np

    x = np.arange(n)
    y = mixing.permute(x, n, source)
    assert sorted(y) == list(x) and (mixing.permute(y, n, source, back=True) == x).all()


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4), st.integers(0, 6)), max_size=40))
@settings(max_examples=80, deadline=None)
def test_best_fit_is_tightest(items):
    sizes, sources, clusters = [i[0] for i in items], [i[1] for i in items], [(i[2],) for i in items]
    placed = packing.best_fit(sizes, sources, clusters, 20)
    bins = []  # replay: the tightest compatible bin, by brute force
    room_of = {}
    for i in sorted(range(len(items)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(bins)) if bins[b]["room"] >= sizes[i] and sources[i] not in bins[b]["s"] and clusters[i][0] not in bins[b]["c"]]
        tight = min((bins[b]["room"] for b in fits), default=20)
        b, offset = placed[i]
        if b == len(bins):
            bins.append({"room": 20, "s": set(), "c": set()})
            assert not fits
        else:
            assert b in fits and bins[b]["room"] == tight
        assert offset == 20 - bins[b]["room"]
        bins[b]["room"] -= sizes[i]
        bins[b]["s"].add(sources[i])
        bins[b]["c"].add(clusters[i][0])
    assert not room_of and all(b["room"] >= 0 for b in bins)


def test_packing(docs, rows, empty):
    out = packing.pack(docs, capacity=100, group=20).collect()
    spans = collections.defaultdict(int)
    for r in out:
        spans[r.bin_id] += r.words
    assert sum(r.words for r in out) == sum(len(words(r[1])) for r in rows)
    assert all(n <= 100 for b, n in spans.items() if b is not None)
    assert sum(r.bin_id is None for r in out) == sum(not words(r[1]) for r in rows)
    source = {r[0]: r[3] for r in rows if r[0] not in (None, 2)}
    seen = collections.Counter((r.bin_id, source[r.doc_id]) for r in out if r.bin_id is not None and r.doc_id in source)
    assert max(seen.values()) == 1
    assert packing.pack(empty).count() == 0


def brute_language(text, profiles):
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text or "")
    grams = collections.Counter()
    for w in folded.split():
        p = f" {w} "
        grams.update(w)
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    return grams


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | (0 if c == " " else ord(c))
    return value | 1 << 62 if len(gram) == 2 else value


def test_language_id(docs, rows, empty):
    profiles = language_id.learn(docs)
    for lang in ("en", "fr"):
        grams = sum((brute_language(r[1], None) for r in rows if r[2] == lang), collections.Counter())
        best = sorted(grams, key=lambda g: (-grams[g], code(g)))[: language_id.PROFILE]
        assert profiles[lang].tolist() == [code(g) for g in best]
    out = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs, profiles).collect())
    want = []
    for r in rows:
        grams = brute_language(r[1], None)
        top = sorted(grams, key=lambda g: (-grams[g], code(g)))[: language_id.PROFILE]
        if not top:
            want.append((str(r[0]), "und", 0.0))
            continue
        d = {}
        for lang, p in profiles.items():
            rank = {g: k for k, g in enumerate(p.tolist())}
            d[lang] = sum(abs(rank[code(g)] - k) if code(g) in rank else language_id.PROFILE for k, g in enumerate(top))
        lang = min(sorted(d), key=lambda x: d[x])
        want.append((str(r[0]), lang, round(1 - d[lang] / (language_id.PROFILE * len(top)), 9)))
    assert out == sorted(want)
    nothing = language_id.learn(empty)
    assert nothing == {} and {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_held_out_language_accuracy(spark):
    out = language_id.op3_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def stream(text):
    return "".join(w + " " for w in words(text)).encode() + b"\n"


def test_base_and_model_scores(spark, docs, rows, empty):
    model, counts = lm_scoring.learn(docs, depth=2, nodes=64, head=5)
    held = docs.selectExpr("doc_id", "text", "false as held_out")
    out = lm_scoring.score(held, model, counts).collect()
    tokens = collections.Counter(t for r in rows for t in [*words(r[1]), "\n"])
    total, distinct = sum(tokens.values()), len(tokens)
    # context-tree weighting by recursion, on the tree that was found
    contexts = {0: {b""}}
    for d in (1, 2):
        contexts[d] = {int(c).to_bytes(d, "little") for c in model.tree.levels[d]}
    n = collections.Counter()
    positions = []
    for r in rows:
        s = stream(r[1])
        for i, b in enumerate(s):
            past = bytes(s[i - k - 1] if i > k else 10 for k in range(2))
            deepest = next(past[:d] for d in (2, 1, 0) if past[:d] in contexts[d])
            n[deepest, b] += 1
    full = sum(len(stream(r[1])) for r in rows)
    for d in (1, 2):
        seen = collections.Counter()
        for r in rows:
            s = stream(r[1])
            for i in range(len(s)):
                seen[bytes(s[i - k - 1] if i > k else 10 for k in range(d))] += 1
        assert all(c in contexts[d] for c, k in seen.items() if k * 64 >= full)
    assert sum(n.values()) == full

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def own(c, level, prefix):
        return [sum(k for (x, b), k in n.items() if x == c and b >> (7 - level) == prefix * 2 + bit) for bit in (0, 1)]

    def children(c):
        return [x for x in contexts.get(len(c) + 1, ()) if x[: len(c)] == c]

    cache = {}

    def node(c, level, prefix):
        key = c, level, prefix
        if key not in cache:
            mine = own(*key)
            kids = [node(x, level, prefix) for x in children(c)]
            every = [mine[b] + sum(k[0][b] for k in kids) for b in (0, 1)]
            estimate = kt(*every)
            weight = estimate
            if kids:
                below = kt(*mine) + sum(k[1] for k in kids)
                top = max(estimate, below)
                weight = top + math.log((math.exp(estimate - top) + math.exp(below - top)) / 2)
            cache[key] = every, weight, math.exp(estimate - math.log(2) - weight) if kids else 1.0, mine
        return cache[key]

    def log2p(context, b):
        total_ = 0.0
        for level in range(8):
            prefix, bit = b >> (8 - level), b >> (7 - level) & 1
            p, left = 0.0, 1.0
            for d in range(len(context) + 1):
                every, _, stop, mine = node(context[:d], level, prefix)
                p += left * stop * (every[1] + 0.5) / (sum(every) + 1)
                left *= 1 - stop
            p += left * (mine[1] + 0.5) / (sum(mine) + 1)
            total_ += math.log2(p if bit else 1 - p)
        return total_

    memo = {}
    want = {}
    for r in rows:
        s, score = stream(r[1]), 0.0
        for i, b in enumerate(s):
            past = bytes(s[i - k - 1] if i > k else 10 for k in range(2))
            deepest = next(past[:d] for d in (2, 1, 0) if past[:d] in contexts[d])
            if (deepest, b) not in memo:
                memo[deepest, b] = log2p(deepest, b)
            score += memo[deepest, b]
        t = [*words(r[1]), "\n"]
        base = sum(math.log10((tokens[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t)
        want.setdefault(str(r[0]), []).append((len(t), len(t), total, base, score * math.log10(2), -score / len(s)))
    for r in out:
        got = r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.bits_per_byte
        assert any(all(math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-4) for a, b in zip(got, w)) for w in want[str(r.doc_id)]), (r, want[str(r.doc_id)])
    p = (2.0 ** model.table.astype(float)).sum(1)
    assert abs(p - 1).max() < 1e-4
    assert len(positions) == 0
    nothing, counts = lm_scoring.learn(empty)
    assert lm_scoring.score(held, nothing, counts).count() == len(rows)


def test_urls(spark):
    urls = [None, "", "example.org/x", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/1", "http://example.org/en/2#a", "http://org", "http://x.com/fr/casino", "http://x.com/de/", "http://y.net/CASINO/1", "http://y.net/casinos", "http://y.net/cheap", "http://y.net/cheap-pills", "http://cheap.pills.net?free=1", "http://xexample.org/es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5] == ("example.org", "/en/2", "org/", "allow") and got[6] == ("org", "", None, "allow")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == (None, "block")
    assert got[10][3] == "allow" and got[11][3] == "allow" and got[12][3] == got[13][3] == "block" and got[14][2] == "org/"
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    terms = spark.createDataFrame([("Y", 0.0, True), ("x", 1.0, False), ("de", 1.5, None), ("de", 0.5, None), (None, 1.0, True), ("", 1.0, True)], "term string, weight double, strict boolean")
    by_table = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules=(), vocabulary=terms).collect()}
    assert [k for k, v in by_table.items() if v == "block"] == [8, 9, 10, 11, 12]


@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
@settings(max_examples=100, deadline=None)
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.loser_tree_merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.org/x", "same"), (2, "http://a.org/x", "same"), (3, None, None), (4, "http://b.org/", ""), (5, "http://B.org/é?q", "é\r\n\r\nWARC/1.1\r\n"), (6, "bad url\r\n", "one"), (None, "http://a.org/", "same"), (2, "http://a.org/x", "same"), (7, "http://z.org", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_archives(df, f"{tmp_path}/w")
    out = warc.capture_histories(spark, f"{tmp_path}/w").collect()
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    assert len(out) == len(pages) and sorted(r.history_pos for r in out) == list(range(1, 10))
    kinds = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out)
    want = [("1", "same", "revisit", 2), ("2", "same", "response", None), ("2", "same", "revisit", 2), ("3", None, "revisit", 4), ("4", "", "response", None), ("5", pages[4][2], "response", None), ("6", "one", "response", None), ("None", "same", "revisit", 2), ("7", pages[8][2], "response", None)]
    assert kinds == sorted((p, len((x or "").encode()), digest(x), k, str(v)) for p, x, k, v in want)
    order = [r.url_key for r in sorted(out, key=lambda r: r.history_pos)]
    assert order == sorted(order)
    fields = [f for p in (tmp_path / "w").glob("*.gz") for _, f, _ in warc.records(gzip.decompress(p.read_bytes()))]
    assert sum(f["WARC-Type"] == "warcinfo" for f in fields) == len(list((tmp_path / "w").glob("*.gz")))
    assert all((f["WARC-Type"] == "revisit") == ("WARC-Profile" in f) for f in fields)
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.capture_histories(spark, f"{tmp_path}/none").count() == 0


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té.", max_size=30)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_kernels(texts):
    import numpy as np
    import pyarrow as pa

    seen = {}
    for part in K.slices(pa.array(texts, pa.string()), 20):
        w = K.find_words(part.data, part.offsets)
        hashes = K.word_hashes(part.data, w)
        for r in range(part.rows):
            own = words(texts[part.first + r])
            got = hashes[w.first[r] : w.first[r + 1]].tolist()
            assert len(own) == len(got)
            for a, b in zip(own, got):
                assert seen.setdefault(a, b) == b
        sh = K.shingle(hashes, w.first)
        assert [len(set(sh.value[a:b].tolist())) for a, b in zip(sh.first, sh.first[1:])] == [len(shingles(texts[part.first + r])) for r in range(part.rows)]
        data, offsets = lm_scoring.byte_stream(part, w)
        assert [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])] == [stream(texts[part.first + r]) for r in range(part.rows)]
        assert np.all(lm_scoring.contexts(data, offsets, 1)[offsets[:-1]] == 10)
    assert len(set(seen.values())) == len(seen)


