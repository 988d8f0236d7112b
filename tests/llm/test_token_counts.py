"""Token counts by distinct pre-tokens against the library on whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import kernels as K
from corvane.llm import queries
from corvane.llm import token_counts as T

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  a", "a b  c ", "a\nb", "\ta\r\n", "ab▁c", "▁", "▁▁ ▁x", "<s>x</s>", "<unk>", "<0x41>", "é é ﬁ Å", "a\x00b", "\x01", "\x01\x01a", "x" * 50, "　", "☃ 😀", "�", " \n ", None,
    "日本語のテキスト", "ab" * 40_000, "👩‍👩‍👧 ok", "́é", "same text", "same text",
]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def pieces(model):
    return T.Pieces(model)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("frequent", [T.FREQUENT, 5, 0])
def test_odd_texts(spark, model, library, frequent):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id here", 2, None, None), (3, "a repeated id", 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, key string, tokens string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_bytes) for r in T.token_counts(docs, model, frequent).collect())
    assert got == sorted((r[0] is None, r[0], len(library.encode(r[1] or "")), len((r[1] or "").encode())) for r in rows)


def test_empty_table(spark, model):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .,'▁\n\x00éß中😀0-_(<s>", max_size=30), max_size=5))
def test_pre_tokens_add_up(pieces, library, texts):
    import pyarrow as pa

    for part in K.slices(T.plain_blanks(pa.array(texts, pa.string()))):
        data, spans = T.pre_tokens(part, pieces.joined)
        found = [data[a:b].tobytes().decode() for a, b in zip(spans.start, spans.end)]
        counts = pieces.counts(found)
        for k in range(part.rows):
            own = slice(spans.first[k], spans.first[k + 1])
            assert "".join(found[own]) == ((" " if texts[part.first + k] else "") + texts[part.first + k]).replace("▁", " ")
            assert sum(counts[own]) == len(library.encode(texts[part.first + k]))


def test_a_model_that_normalises_is_refused(tmp_path, monkeypatch, model):
    class Folding:
        def __init__(self, **_):
            pass

        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normalises"):
        T.Pieces(model)


def test_most_frequent_is_bounded(spark):
    table = spark.range(1000).selectExpr("id AS key", "id % 97 + 1 AS n", "1L AS pieces")
    for most in (0, 10, 500, 1000):
        kept = {r.key: r.n for r in T.most_frequent(table, most).collect()}
        assert len(kept) <= most and (most < 500 or len(kept) > most // 2)
        assert not kept or min(kept.values()) > max((r.n for r in table.collect() if r.key not in kept), default=0)


def test_registered(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.QUERIES["op13_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == {d: (len((t or "").encode()), len(library.encode(t or ""))) for d, t in docs.items()}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out) and len(out) == len(docs)
