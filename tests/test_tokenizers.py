"""Byte-pair counts: by hand on a small table, and against a library on a public one."""

import base64

import pytest
from pyspark.sql import functions as F

from corvane.functions import tokenizers as T
from corvane.operators import reports as R


def test_merges_by_hand():
    ranks = {b: i for i, b in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aab"])}
    # "aabc": ab (rank 3) before bc (4) gives a|ab|c; aab has a rank (6), abc needs ab|c (5) first: a|abc
    assert T.merged(b"aabc", ranks) == 2 and T.merged(b"abc", ranks) == 1 and T.merged(b"ccb", ranks) == 3 and T.merged(b"xbc", ranks) == 2
    assert T.merged(b"abab", ranks) == 2


def test_counts_of_a_small_table(spark, tmp_path):
    tokens = [bytes([i]) for i in range(256)] + [b"th", b"the", b" t", b" the"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    count = T.token_counter(spark, T.read_ranks(spark, str(path)))
    df = T.with_model_tokens(spark.createDataFrame([(1, "the the"), (2, None), (3, ""), (4, "thé  x")], "id int, text string"), {"small": count})
    # " the": th (rank 256) is merged before " t", then the; " the" at last
    assert {r.id: r.tokens_small for r in df.collect()} == {1: 2, 2: 0, 3: 0, 4: 6}
    profile = R.corpus_profile(df.drop("tokens_small"), count(F.col("text"))).first()
    assert (profile.tokens, profile.max_tokens) == (8, 6)
    padded = df.where("id in (1, 4)").agg((F.max("tokens_small") * F.count("*")).alias("padded"), F.sum("tokens_small").alias("real")).first()
    assert (padded.padded, padded.real) == (12, 8)


def test_counts_of_a_public_table(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    content = T.read_ranks(spark, public.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=T._table(content), special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = T.with_model_tokens(docs, {"bytes": T.token_counter(spark, content)}).collect()
    assert all(r.tokens_bytes == len(library.encode_ordinary(r.text or "")) for r in got) and len(got) > 100
