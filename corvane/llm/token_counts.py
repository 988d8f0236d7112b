"""Token counts of documents, by counting the pieces of each distinct pre-token once.

A sentence-piece model merges neighbouring pieces only into pieces of its vocabulary. Two neighbouring
characters that stand side by side in no piece are therefore never merged across: texts may be cut there,
and the pieces of the cut parts, the pre-tokens, add up to those of the text. The vocabulary itself says
where to cut (:class:`Pieces`), down to the bytes on either side of a cut.

One pass over the texts names the distinct pre-tokens and their numbers. Each is encoded once. A second
pass replaces pre-tokens by their piece counts: the most frequent ``FREQUENT`` are looked up in the task,
the others join a table by name. Names are 64-bit hashes, as everywhere in this subpackage; no piece ids
of texts are kept anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.storage import workspace, written

FREQUENT = 1 << 20
LIMIT = 4096
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 1 << 18
SPACE = "▁"


class Pieces:
    """A sentence-piece model without normalisation, and where it lets texts be cut."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.encoder.normalize(" a  Å\nﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}Å\nﬁ{SPACE}":
            raise ValueError("the model normalises texts, or adds no blank before them: its pieces do not add up over pre-tokens")
        joined = np.zeros((256, 256), bool)
        for k in range(self.encoder.get_piece_size()):
            if not (self.encoder.is_control(k) or self.encoder.is_byte(k) or self.encoder.is_unknown(k)):
                piece = np.frombuffer(self.encoder.id_to_piece(k).replace(SPACE, " ").encode(), np.uint8)
                joined[piece[:-1], piece[1:]] = True
        joined[:, 0x80:0xC0] = True  # inside a character
        self.joined = joined
        alone = [chr(c) for c in range(1, 128) if not joined[c].any() or not (joined[c, :0x80].any() or joined[c, 0xC0:].any()) and not joined[:, c].any()]
        if not alone:
            raise ValueError("every character of the model joins another one")
        self.fence = alone[0]
        self.behind = len(self.encoder.encode(self.fence))

    def counts(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token; a character that joins no other keeps the model's own leading blank away."""
        return [len(x) - self.behind for x in self.encoder.encode([self.fence + p for p in pre_tokens], num_threads=1)]


@cache
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def plain_blanks(column: pa.Array) -> pa.Array:
    """Texts as the model sees them: its sign for a blank and the blank are the same."""
    return pc.replace_substring(column.fill_null(""), SPACE, " ")


def pre_tokens(part: K.Slice, joined: np.ndarray) -> tuple[np.ndarray, K.Words]:
    """The bytes of a slice with a blank before each non-empty text, and the spans of its pre-tokens."""
    filled = np.flatnonzero(np.diff(part.offsets))
    data = np.insert(part.data, part.offsets[filled], 32)
    offsets = part.offsets + np.searchsorted(filled, np.arange(part.rows + 1))
    cut = np.ones(len(data), bool)
    cut[1:] = ~joined[data[:-1], data[1:]]
    cut[offsets[:-1][filled]] = True
    start = np.flatnonzero(cut)
    return data, K.Words(start, np.append(start[1:], len(data)), np.searchsorted(start, offsets))


def distinct_rows(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """(key, piece, n): pre-tokens of a partition and how often they occur, each seldom more than once a task."""
    joined = _pieces(model).joined
    held, rows = [], 0

    def given(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables).group_by(["key", "piece"]).aggregate([("n", "sum")])
        yield from table.select(["key", "piece", "n_sum"]).rename_columns(["key", "piece", "n"]).combine_chunks().to_batches(50_000)

    for batch in batches:
        for part in K.slices(plain_blanks(batch.column("text"))):
            data, spans = pre_tokens(part, joined)
            key, first, n = np.unique(K.word_hashes(data, spans, lower=False), return_index=True, return_counts=True)
            held.append(pa.table({"key": key.view(np.int64), "piece": K.texts(data, spans.start[first], spans.end[first]), "n": n.astype(np.int64)}))
            rows += len(key)
            if rows > 2 * HELD:
                held = [pa.concat_tables(held).group_by(["key", "piece"]).aggregate([("n", "sum")]).select(["key", "piece", "n_sum"]).rename_columns(["key", "piece", "n"])]
                rows = len(held[0])
                if rows > HELD:
                    yield from given(held)
                    held, rows = [], 0
    if held:
        yield from given(held)


def piece_rows(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """(key, n, pieces) of distinct pre-tokens."""
    pieces = _pieces(model)
    for batch in batches:
        found = pieces.counts(batch.column("piece").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(found, pa.int64())], ["key", "n", "pieces"])


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows with the largest ``n``: all down to the lowest eighth of a power of two at which they are at most ``most``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["step"], r["rows"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, rows = None, 0
    for at, count in sizes:
        rows += count
        if rows > most:
            break
        least = at
    return table.where(F.lit(False) if least is None else step >= least)


COUNTED = "rid long, doc_id long, n_bytes long, tokens long, rest array<long>"


def counted_rows(batches: Iterator[pa.RecordBatch], model: bytes, known: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text the pieces of its known pre-tokens, and the names of the other ones, one for each occurrence."""
    joined = _pieces(model).joined
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column("text").fill_null("")
        sizes = pc.binary_length(texts).cast(pa.int64())
        for part in K.slices(plain_blanks(texts)):
            data, spans = pre_tokens(part, joined)
            keys = K.word_hashes(data, spans, lower=False).view(np.int64)
            row = np.repeat(np.arange(part.rows), spans.counts)
            there = np.zeros(len(keys), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = known[at] == keys
                tokens = np.bincount(row[there], pieces[at[there]], part.rows).astype(np.int64)
            else:
                tokens = np.zeros(part.rows, np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[~there], minlength=part.rows)))).astype(np.int32)
            here = slice(part.first, part.first + part.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid + np.arange(part.rows)), batch.column("doc_id")[here], sizes[here], pa.array(tokens), pa.ListArray.from_arrays(ends, keys[~there])],
                ["rid", "doc_id", "n_bytes", "tokens", "rest"],
            )
            rid += part.rows


def token_counts(docs: DataFrame, model: bytes, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row of ``docs(doc_id, text)``, as the sentence-piece ``model`` (the bytes of its file) counts whole texts.

    No begin, end or special tokens are added, and their names inside texts are text. A null text is empty
    and has no tokens; repeated rows, also of one doc_id, count each by itself; other columns are ignored.
    An empty table gives an empty one. A text of any length is one row of one task. ``frequent`` bounds
    the pre-tokens that are broadcast (16 bytes each); it changes no count. A model that normalises texts
    raises ValueError.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with workspace(docs.sparkSession) as held:
        distinct = texts.select("text").mapInArrow(lambda it: distinct_rows(it, model), "key long, piece string, n long")
        distinct = distinct.groupBy("key").agg(F.min("piece").alias("piece"), F.sum("n").alias("n"))
        table = held.keep(written(distinct.mapInArrow(lambda it: piece_rows(it, model), "key long, n long, pieces long"), "pieces"))
        head = most_frequent(table, frequent).select("key", "pieces").toArrow().sort_by("key")
        known, pieces = head["key"].to_numpy(), head["pieces"].to_numpy().astype(np.int32)
        shared = docs.sparkSession.sparkContext.broadcast((known, pieces))
        counted = held.keep(written(texts.mapInArrow(lambda it: counted_rows(it, model, *shared.value), COUNTED), "counted"))
    none = F.lit(None).cast("long")
    rest = counted.select("rid", F.explode("rest").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("n")).join(table.select("key", "pieces"), "key")
    parts = counted.select("rid", "doc_id", "n_bytes", "tokens").unionByName(rest.select("rid", none.alias("doc_id"), none.alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("tokens")))
    summed = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` by the public model of 32,000 pieces, for every whole text."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, model).withColumn("over_limit", F.col("n_tokens") > LIMIT)
