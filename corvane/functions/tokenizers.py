"""Token counts by model tokenizers: byte-pair merges from a file of ranks, as a column for each tokenizer.

A rank file has a line ``<base64 of the token's bytes> <rank>`` for each token; its path is the caller's, and
what it holds goes to the tasks once. Texts are cut into pieces by the tokenizer's pattern, pieces of a batch
are merged once each, and a text has the sum of its pieces' tokens: no ids are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the usual pattern of byte-level tokenizers (contractions, letters, digits, other signs, blanks).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a piece: of all neighbours the pair of least rank is merged, the first of equal ones, until none has a rank."""
    if piece in ranks:
        return 1
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The file of ranks, from wherever Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


@lru_cache(4)
def _table(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def token_counter(spark: SparkSession, ranks: bytes, pattern: str = PATTERN):
    """A function of a text column: its tokens by these ranks, 0 for a null text. Special tokens inside texts are text."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cut = _table(shared.value), regex.compile(pattern)
        known: dict[str, int] = {}
        for batch in texts:
            out = []
            for text in batch:
                n = 0
                for piece in cut.findall(text or ""):
                    m = known.get(piece)
                    if m is None:
                        if len(known) > 1 << 18:
                            known.clear()
                        m = known[piece] = merged(piece.encode(), table)
                    n += m
                out.append(n)
            yield pd.Series(out, dtype="int64")

    return count


def with_model_tokens(df: DataFrame, counters: dict[str, object], text: Column | str = "text") -> DataFrame:
    """``df`` with a column ``tokens_<name>`` for each tokenizer."""
    return df.withColumns({f"tokens_{name}": count(text) for name, count in counters.items()})
