"""op7 on passages inside longer lines and over short lines, against all windows of 50 words by hand."""

import random

from corvane.llm import substring_dedup


def test_passages_in_any_lines(spark, tmp_path):
    rng = random.Random(9)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    inside, short, loop = new(52), new(60), new(3)
    texts = [new(90) + inside + new(70), new(20) + inside + new(110), new(20) + short + new(20), short + new(9), new(30) + inside[:49] + new(30), loop * 40, new(10) + loop * 30 + new(5), new(400)]
    rows = [(i, (" " if i not in (2, 3) else "\n").join(w)) for i, w in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, want = {}, []
    for d, w in enumerate(texts):
        for at in range(len(w) - 49):
            first.setdefault(tuple(w[at : at + 50]), []).append((d, at))
    later = [set() for _ in texts]
    kept = [set() for _ in texts]
    for places in first.values():
        if len(places) > 1:
            for d, at in places[1:]:
                if d == places[0][0] and at - places[0][1] < 50:
                    kept[d].update(range(places[0][1], places[0][1] + 50))
                later[d].update(range(at, at + 50))
    want = [sorted(a - b) for a, b in zip(later, kept)]
    assert [len(w) for w in want[:5]] == [0, 52, 0, 60, 0] and want[5] and want[6]
    got = {r.doc_id: r for r in substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect()}
    for d, w in enumerate(want):
        if not got[d].removed:  # no whole line of this document went
            assert [k for p in got[d].passages for k in range(p.first, p.last + 1)] == w, d
            assert got[d].words_removed == len(w)
    assert [len(got[d].removed) for d in range(5)] == [0] * 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r.text.split() for r in substring_dedup.remove_repeats(docs).collect()}
    assert left[1] == texts[1][:20] + texts[1][72:] and left[3] == texts[3][60:] and left[0] == texts[0]
