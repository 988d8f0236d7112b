"""N-gram profiles: what is sorted, alphabets too large to pack, and texts that are no UTF-8."""

import collections
import random

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from corvane.llm import language_id

LETTERS = [chr(c) for c in range(0x4E00, 0x9FFF)] + [chr(c) for c in range(0x20000, 0x2A6DF)]


def profile(text):
    """N-grams by falling count and packed value, in plain Python."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    grams = collections.Counter()
    for w in folded.split():
        p = [0, *map(ord, w), 0]
        grams.update(p[1:-1])
        grams.update(1 << 62 | a << 21 | b for a, b in zip(p, p[1:]))
        grams.update(a << 42 | b << 21 | c for a, b, c in zip(p, p[1:], p[2:]))
    return grams, sorted(grams, key=lambda g: (-grams[g], g))[: language_id.PROFILE]


def compare(texts, column):
    langs = [("en", "fr")[k % 3 == 0] for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([column, pa.array(langs)], ["text", "lang"])
    want = collections.Counter()
    for text, lang in zip(texts, langs):
        want.update({(lang, g): n for g, n in profile(text)[0].items()})
    got = collections.Counter()
    for b in language_id.count_rows([batch]):
        got.update({(r["lang"], r["gram"]): r["n"] for r in b.to_pylist()})
    assert got == want
    places = {}
    for lang in ("en", "fr"):
        places[lang] = sorted((g for x, g in want if x == lang), key=lambda g: (-want[lang, g], g))[: language_id.PROFILE]
    out = next(language_id.predictor({k: np.array(p, np.int64) for k, p in places.items()})([batch])).to_pylist()
    for text, row in zip(texts, out, strict=True):
        top = profile(text)[1]
        distances = {}
        for lang, p in places.items():
            rank = {g: k for k, g in enumerate(p)}
            distances[lang] = sum(abs(rank[g] - k) if g in rank else language_id.PROFILE for k, g in enumerate(top))
        lang = min(sorted(distances), key=distances.get) if top else "und"
        assert row["lang_pred"] == lang
        assert row["score"] == (pytest.approx(1 - distances[lang] / (language_id.PROFILE * len(top))) if top else 0)


@pytest.mark.parametrize("letters,packed", [(1, True), (30, True), (len(LETTERS), True), (30, False), (len(LETTERS), False)])
def test_alphabets_of_any_size(letters, packed, monkeypatch):
    rng = random.Random(letters)
    alphabet = rng.sample(LETTERS, letters) + list("aÉßİ")
    texts = [None, "", " ", "a", "7", "".join(LETTERS[:letters])]
    texts += ["".join(rng.choice(alphabet) if rng.random() < 0.8 else " " for _ in range(rng.randrange(900))) for _ in range(150)]
    if not packed:  # as with many rows and a large alphabet
        monkeypatch.setattr(language_id, "_fits", lambda *_: False)
    compare(texts, pa.array(texts))


def test_what_packs():
    assert language_id._fits(3, 61) and not language_id._fits(4, 61)


def test_bytes_that_are_no_utf8():
    rows = [b"ab\xff\xfecd", b"\xc3", b"\xa9 la", b"caf\xc3\xa9", None, b"\xe2\x82", b"", b"the end"]
    column = pa.array(rows, pa.binary()).view(pa.string())
    compare([r.decode("utf-8", "replace") if r is not None else None for r in rows], column)


def test_occurrences_are_sorted_as_single_numbers(monkeypatch):
    """What tells equal n-grams from others by the place of each occurrence sees distinct n-grams only, if any."""
    texts = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"])["text"].combine_chunks()
    occurrences = sum(sum(profile(t)[0].values()) for t in texts.to_pylist())
    seen = [0]
    for name in ("unique", "lexsort", "argsort"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **b: seen.append(np.shape(x)[-1]) or f(x, *a, **b))
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * len(texts))], ["text", "lang"])
    counts = list(language_id.count_rows([batch]))
    assert sum(b["n"].to_numpy().sum() for b in counts) == occurrences
    list(language_id.predictor({"en": counts[0]["gram"].to_numpy()[:300]})([batch]))
    assert max(seen) < occurrences / 20
