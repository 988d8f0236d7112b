"""op10 against context-tree weighting by hand over all contexts, on a corpus that has many rare ones."""

import collections
import math
import random

from corvane.llm import lm_scoring


def bytes_of(text):
    return b"".join(w.encode() + b" " for w in text.split()) + b"\n"


def nodes_of(stream, i):
    past = bytes(stream[i - k - 1] if i > k else 10 for k in range(6))
    for level in range(8):
        for d in range(7):
            yield level, d, (past[:d], level, stream[i] >> (8 - level)), stream[i] >> (7 - level) & 1


def by_hand(texts, learned):
    counts = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        if t in learned:
            s = bytes_of(t)
            for i in range(len(s)):
                for _, _, node, bit in nodes_of(s, i):
                    counts[node][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    below, stop = collections.defaultdict(float), {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        estimate = weight = kt(*counts[node])
        if len(node[0]) < 6:
            top = max(estimate, below[node])
            weight = top + math.log((math.exp(estimate - top) + math.exp(below[node] - top)) / 2)
        stop[node] = math.exp(estimate - math.log(2) - weight) if len(node[0]) < 6 else 1.0
        if node[0]:
            below[node[0][:-1], node[1], node[2]] += weight
    out = {}
    for t in texts:
        s, total = bytes_of(t), 0.0
        for i in range(len(s)):
            p, left, bit = [0.0] * 8, [1.0] * 8, [0] * 8
            for level, _, node, b in nodes_of(s, i):
                bit[level] = b
                if node in stop:
                    z, o = counts[node]
                    p[level] += left[level] * stop[node] * (o + 0.5) / (z + o + 1)
                    left[level] *= 1 - stop[node]
            total += sum(math.log2(q if b else 1 - q) for q, b in ((p[k] + left[k] / 2, bit[k]) for k in range(8)))
        out[t] = total * math.log10(2), -total / len(s)
    return out


def test_all_contexts_count(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(300)) for i in range(66)}
    texts[66] = ""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == 67 and 0 < sum(r.held_out for r in got.values()) < 30
    learned = {texts[i] for i, r in got.items() if not r.held_out}
    assert 3 * sum(len(bytes_of(t)) for t in learned) > 4 * 65536 * 1.0  # so many bytes that a cap of 65,536 drops contexts seen once
    want = by_hand(list(texts.values()), learned)
    for i, r in got.items():
        assert math.isclose(r.score, want[texts[i]][0], rel_tol=1e-5) and math.isclose(r.bits_per_byte, want[texts[i]][1], rel_tol=1e-5), i
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 10 = 0 held_out")
    model, words, pairs = lm_scoring.learn_full(docs, head=50, frequent=500)
    assert pairs.count() > 500
    for r in lm_scoring.score(docs, model, words, pairs).collect():
        assert math.isclose(r.score, got[r.doc_id].score, rel_tol=1e-6) and math.isclose(r.base_score, got[r.doc_id].base_score, rel_tol=1e-9)
