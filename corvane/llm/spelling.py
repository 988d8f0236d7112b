"""Spelling variants: words one edit apart, found through an index of grams of variable length.

Words stand between two marks. The gram that starts at a position is the shortest one, from ``QMIN``
characters, that occurs at most ``RARE`` times in all words, or else ``QMAX`` characters: the dictionary is a
prefix tree cut where it becomes selective. A gram depends on nothing but its own characters, so an edit
changes only the grams that cover its place. The most that cover one place is the word's bound: a word
one edit away shares all grams but these. It is therefore in one of the lists of any bound + 1 grams, and
only the lists of the rarest are merged. What two words of a list then have in common before and after
their first difference decides exactly.

Lists of grams that are frequent even at ``QMAX`` are divided once more. The edit is either right of the
shared gram, and all on its left is equal, or the other way round: each word stands in one list with its
left part and one with its right part. Lists of more than ``BLOCK`` words are merged as a grid of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.llm.storage import few, workspace, written

LEAST = 7
QMIN, QMAX = 3, LEAST - 1  # a word of LEAST letters has LEAST grams, of which an edit changes at most QMAX
RARE = 64
BLOCK = 2048
TIMES = 10
ONE_IN = 31
HELD = 1 << 18
BITS = 7

_OPEN, _CLOSE = 1, 2
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(3, 29)
_CODE[0xC0:0x100] = np.arange(29, 93)
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC = _crc_table()


def crcs(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what each ``state`` is the CRC-32 of, followed by a span of ``data``."""
    order = np.argsort(start - end, kind="stable")  # the longest first
    size = (end - start)[order]
    out = state[order] ^ np.uint32(0xFFFFFFFF)
    start = start[order]
    for k in range(int(min(size[0], 64)) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # those longer than k
        out[:n] = _CRC[(out[:n] ^ data[start[:n] + k]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -64))):
        out[k] = zlib.crc32(data[start[k] + 64 : start[k] + size[k]].tobytes(), int(out[k]))
    result = np.empty_like(out)
    result[order] = out
    return result


def word_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition, each seldom more than once a task."""
    held, rows = [], 0

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
        for part in K.slices(batch.column("text"), 2 * K.SLICE_BYTES):
            data = K.LOWER[part.data]
            two = data == 0xC3  # leads the two bytes of U+00C0 to U+00FF
            inside = _ASCII[data] | two
            inside[1:] |= two[:-1]
            found = K.runs(inside, part.offsets)
            shorter = np.concatenate(([0], np.cumsum(two)))
            letters = found.end - found.start - (shorter[found.end] - shorter[found.start])
            row = np.repeat(np.arange(part.rows), found.counts)
            long = np.flatnonzero(letters >= least)
            start, end, letters, row = found.start[long], found.end[long], letters[long], row[long]
            names, first, code = np.unique(K.word_hashes(data, K.Words(start, end, found.first), lower=False), return_index=True, return_inverse=True)
            pair, times = np.unique(row * max(len(names), 1) + code, return_counts=True)
            row, code = np.divmod(pair, max(len(names), 1))
            crc = crcs(prefix[part.first + row], data, start[first[code]], end[first[code]])
            cut = crc % np.uint32(ONE_IN) == 0
            whole = np.bincount(code[~cut], times[~cut], len(names)).astype(np.int64)
            there = np.flatnonzero(whole)
            held.append(pa.table({"word": K.texts(data, start[first[there]], end[first[there]]), "n": whole[there]}))
            other, raw = [], data.tobytes()
            for k, h in zip(code[cut].tolist(), crc[cut].tolist()):
                word = raw[start[first[k]] : end[first[k]]].decode()
                other.append(word[: h % len(word)] + word[h % len(word) + 1 :])
            held.append(pa.table({"word": pa.array(other, pa.string()), "n": times[cut]}))
            rows += len(there) + len(other)
            if rows > 2 * HELD:
                held = [merged(held)]
                rows = len(held[0])
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches(50_000)
                    held, rows = [], 0
    if held:
        yield from merged(held).combine_chunks().to_batches(50_000)


def word_counts(docs: DataFrame, least: int = LEAST, occurrences: int = 2) -> DataFrame:
    """``(word, n)``: the lower-cased runs of letters of ``docs(doc_id, text)``, one in ``ONE_IN`` of a document's with a letter less, by its checksum."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(lambda it: word_rows(it, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= occurrences) & (F.length("word") >= least))


def coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, each between its marks, and where each begins (one more at the end)."""
    texts = words.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 2)))
    codes = np.empty(first[-1], np.int64)
    codes[first[:-1]] = _OPEN
    codes[first[1:] - 1] = _CLOSE
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(len(texts)), sizes) + 1
    codes[at] = _CODE[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    return codes, first


def windows(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, position, window): the ``QMAX`` codes from each place at which a gram can start; blanks follow a word's end."""
    counts = np.diff(first) - QMIN + 1
    word = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, stop = first[word] + pos, first[word + 1]
    window = np.zeros(len(at), np.int64)
    for k in range(QMAX):
        window = (window << BITS) | np.where(at + k < stop, codes[np.minimum(at + k, len(codes) - 1)], 0)
    return word, pos, window


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, pos, window = windows(*coded(batch.column("word")))
        for k in range(0, len(word), 50_000):
            some = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([batch.column("wid").take(pa.array(word[some])), pa.array(pos[some].astype(np.int32)), pa.array(window[some])], ["wid", "pos", "window"])


def gram_dictionary(found: DataFrame, rare: int) -> DataFrame:
    """``(window, size, often)``: of each window the length of its gram and how often that occurs.

    A prefix of ``QMIN`` codes has a bounded number of windows, so that all counts come from one shuffle.
    """
    counts = found.groupBy("window").agg(F.count("*").alias("n"))
    for q in range(QMIN, QMAX):
        prefixes = ", ".join(f"shiftright(window, {BITS * (QMAX - p)})" for p in range(QMIN, q + 1))
        counts = counts.withColumn(f"n{q}", F.expr(f"sum(n) OVER (PARTITION BY {prefixes})"))
    size, often = F.lit(QMAX), F.col("n")
    for q in reversed(range(QMIN, QMAX)):
        size, often = F.when(F.col(f"n{q}") <= rare, q).otherwise(size), F.when(F.col(f"n{q}") <= rare, F.col(f"n{q}")).otherwise(often)
    return counts.select("window", size.cast("int").alias("size"), often.alias("often"))


POSTED = "key long, hot boolean, word string, n long, pos int"


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of a partition sorted by ``keys``; no group of equal keys is cut."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not len(table):
            continue
        columns = [table[k] for k in keys]
        last = [c[-1].as_py() for c in columns]
        low, high = 0, len(table)  # rows before the last group: sorted, so by halves
        if all(c[0].as_py() == x for c, x in zip(columns, last)):
            rest = table
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if all(c[middle].as_py() == x for c, x in zip(columns, last)) else (middle, high)
        yield table.slice(0, high)
        rest = table.slice(high)
    if rest is not None:
        yield rest


def posting_rows(batches: Iterator[pa.RecordBatch], rare: int) -> Iterator[pa.RecordBatch]:
    """The lists in which each word stands: those of its rarest grams, one more than an edit can change.

    A word's first row, at position -1, brings the word itself.
    """
    for table in _whole(batches, ["wid"]):
        table = table.combine_chunks()
        named = table.filter(pc.less(table["pos"], 0)).combine_chunks()
        table = table.filter(pc.greater_equal(table["pos"], 0)).combine_chunks()
        pos, size, often, window = (table[c].to_numpy().astype(np.int64) for c in ("pos", "size", "often", "window"))
        gram = window >> BITS * (QMAX - size) << BITS * (QMAX - size)
        begins = np.flatnonzero(pos == 0)
        word = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(pos))))
        # grams over each place of the words: +1 where a gram begins, -1 behind its end
        slots = np.diff(np.append(begins, len(pos))) + QMIN  # places of a word and its marks, and one behind
        base = np.cumsum(slots) - slots
        size = np.minimum(size, slots[word] - 1 - pos)  # grams end with the word
        steps = np.bincount(base[word] + pos, minlength=slots.sum()) - np.bincount(base[word] + pos + size, minlength=slots.sum())
        over = np.cumsum(steps)
        over[base], over[base + slots - 2] = 0, 0  # the marks themselves are not edited
        bound = np.maximum.reduceat(over, base)
        order = np.lexsort((pos, gram, often, word))
        rank = np.arange(len(order)) - begins[word[order]]
        chosen = order[rank <= bound[word[order]]]
        hot = often[chosen] > rare
        one, texts, n = chosen[~hot], named["word"].combine_chunks(), named["n"].combine_chunks()
        keys, rows = [gram[one]], [one]
        if hot.any():
            two, names = chosen[hot], texts.take(pa.array(word[chosen[hot]])).to_pylist()
            for side, mark in ((0, b"<"), (1, b">")):
                # the marks are one place each: letters before the gram, letters behind it
                parts = [t[: max(p - 1, 0)] if side == 0 else t[p + QMAX - 1 :] for t, p in zip(names, pos[two].tolist())]
                keys.append(np.array([_name(g, mark, part) for g, part in zip(gram[two].tolist(), parts)], np.int64))
                rows.append(two)
        key, row = np.concatenate(keys), np.concatenate(rows)
        dealt = np.concatenate((np.zeros(len(one), bool), np.ones(len(row) - len(one), bool)))
        for k in range(0, len(row), 50_000):
            some = pa.array(word[row[k : k + 50_000]])
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 50_000]), pa.array(dealt[k : k + 50_000]), texts.take(some), n.take(some), pa.array(pos[row[k : k + 50_000]].astype(np.int32))], ["key", "hot", "word", "n", "pos"])


def _name(gram: int, side: bytes, part: str) -> int:
    """A list's key below zero, where no gram's is; lists that share one are merged together, which costs time only."""
    import xxhash

    return -(xxhash.xxh64_intdigest(side + gram.to_bytes(8, "little") + part.encode()) >> 1) - 1


def _alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many codes are equal from places ``a`` and ``b`` on, in direction ``step``, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[codes[a[live] + step * k] == codes[b[live] + step * k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, a_n, b, b_n) one edit apart and in the same list, ``a`` before ``b`` in code-point order; rows are sorted by key, cell and length."""
    for table in _whole(batches, ["key", "x", "y"]):
        table = table.combine_chunks()
        words = table["word"].combine_chunks()
        codes, first = coded(words)
        size = np.diff(first) - 2
        key, x, y, own, pos = (table[c].to_numpy() for c in ("key", "x", "y", "own", "pos"))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        group = np.cumsum(new)
        found, live, d = [], np.arange(len(key)), 0
        while len(live):
            d += 1
            live = live[live + d < len(key)]
            live = live[(group[live + d] == group[live]) & (size[live + d] - size[live] <= 1)]
            other = live + d
            longer, moved = size[other] - size[live], pos[other] - pos[live]
            fits = ((moved == 0) | (moved == longer)) & ((x[live] == y[live]) | (own[live] != own[other]))
            i, j = live[fits], other[fits]
            if len(i):
                before = _alike(codes, first[i] + 1, first[j] + 1, size[i], 1)
                behind = _alike(codes, first[i + 1] - 2, first[j + 1] - 2, size[i], -1)
                near = (before + behind >= size[j] - 1) & ((before < size[i]) | (size[j] > size[i]))
                found.append(np.stack((i[near], j[near])))
        if found:
            i, j = np.concatenate(found, 1)
            a, b = words.take(pa.array(i)), words.take(pa.array(j))
            n = table["n"].to_numpy()
            swap = np.array([p > q for p, q in zip(a.to_pylist(), b.to_pylist())], bool)
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            pairs = pa.table({"a": words.take(pa.array(i)), "a_n": n[i], "b": words.take(pa.array(j)), "b_n": n[j]}).group_by(["a", "a_n", "b", "b_n"]).aggregate([])
            yield from pairs.select(["a", "a_n", "b", "b_n"]).combine_chunks().to_batches(50_000)


def near_words(words: DataFrame, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """``(a, a_n, b, b_n)``, each pair of words one edit apart once, for a written table ``words(wid, word, n)`` of :func:`word_counts` with distinct ``wid``."""
    with workspace(words.sparkSession) as held:
        found = words.mapInArrow(window_rows, "wid long, pos int, window long")
        grams = gram_dictionary(found, rare)
        names = words.select("wid", F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("window"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("often"), "word", "n")
        decomposed = found.join(grams, "window").unionByName(names, allowMissingColumns=True).repartition("wid").sortWithinPartitions("wid", "pos")
        posted = written(decomposed.mapInArrow(lambda it: posting_rows(it, rare), POSTED), "postings")
        large = posted.where("hot").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
        large = written(large.select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "large", narrow=True)
        rows = posted.join(few(large), "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.lit(0)))
        rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.length("word").alias("size"), "word", "n", "pos")
        rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "size")
        pairs = rows.mapInArrow(near_rows, "a string, a_n long, b string, b_n long").distinct()
        return held.keep(written(pairs, "near"))


def spelling_variants(docs: DataFrame, rare: int = RARE, block: int = BLOCK, times: int = TIMES) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each word of ``docs(doc_id, text)`` with at least ``LEAST`` letters and two occurrences.

    ``n_near`` words are one edit away; ``form`` is the most frequent of them (ties: the first in
    code-point order) if it is at least ``times`` times as frequent, ``root`` the last form of forms.

    Null and letterless texts have no words, a null doc_id counts as an empty name, repeated rows count
    each; words of any length are compared whole; other columns are ignored; an empty table gives an
    empty one. ``rare`` and ``block`` change no result.
    """
    spark = docs.sparkSession
    with workspace(spark) as held:
        words = held.keep(written(word_counts(docs).withColumn("wid", F.monotonically_increasing_id()), "words"))
        near = near_words(words, rare, block)
        sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
        best = near.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
        formed = words.join(best, "word", "left")
        is_form = -F.col("first.less") >= times * F.col("n")
        formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("first.near")).alias("form"), F.when(is_form, -F.col("first.less")).alias("form_n"))
        formed = held.keep(written(formed, "formed"))
        roots = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:  # a form is ``times`` times as frequent: steps double, so rounds are few
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
            step = written(roots.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
            roots, moved = step.drop("moved"), step.where("moved").limit(1).count()
            if not moved:
                break
        held.keep(step)
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` with their forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TABLE = "[" + ", ".join(str(x) for x in _CRC.tolist()) + "]::BIGINT[]"

#: Near words by another way: words with one letter left out, joined with each other and with whole words.
OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT rid, doc_id, w, count(*) AS n FROM (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w
  FROM (SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS doc_id, text FROM documents)) WHERE length(w) >= {LEAST} GROUP BY 1, 2, 3),
b AS (SELECT w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c >> 8, list_extract({_TABLE}, (xor(c, x) & 255) + 1))), 4294967295) AS h FROM b),
s AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT p.word, p.n, q.word AS near, q.n AS near_n FROM less p JOIN less q ON p.v = q.v AND p.i = q.i AND p.word <> q.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.v = w.word UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.v = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM f UNION SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM f JOIN chain c USING (word) JOIN f l ON l.word = c.root WHERE l.form IS NULL"""
