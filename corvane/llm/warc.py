"""WARC archives: writing with payload deduplication, reading back, and merging capture indexes.

Records are written through Spark's own text sink (the record terminator is its line separator), so any
Hadoop file system serves; archives are read back whole, each bounded by ``ARCHIVE_BYTES`` of payload, and
parsed by Content-Length. Every archive gives one locally sorted run of captures. Runs are dealt by
ranges of (URL key, time), and each range merges its pieces of all runs with a loser tree, which
gives globally ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.storage import few, new_path, written
from corvane.llm.url_filter import LOWER, UPPER, host_and_path

ARCHIVE_BYTES, RANGE_ROWS = 24 << 20, 100_000
END = "\r\n\r\n"
#: Fixed values of the format: how a revisit was found to be one, and what opens an archive.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO = "software: corvane\r\nformat: WARC File Format 1.1\r\n"
EPOCH = 1_704_067_200  # captures of a table without times are dated by page_id, in seconds from 2024-01-01
INDEX = "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base-32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexes = F.sha1(F.encode(text, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then ``)`` and the path; empty for a null url or one without ``://``."""
    host, path = host_and_path(url)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)).otherwise("")


def with_types(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, size, record_type, refers_to)``: of equal payloads the largest page_id is the response.

    Only digests that occur more than once meet the pages again.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    often = rows.where("page_id is not null").groupBy("digest", "page_id").agg(F.count("*").alias("n")).groupBy("digest")
    often = often.agg(F.max(F.struct("page_id", "n")).alias("m"), F.sum("n").alias("rows"))
    nulls = rows.where("page_id is null").select("digest").distinct().withColumn("null_id", F.lit(True))
    often = often.join(nulls, "digest", "left").where("rows > 1 or null_id")
    often = written(often.select(F.col("digest").alias("d"), F.col("m.page_id").alias("response"), F.col("m.n").alias("again")), "often")
    rows = rows.join(few(often, 64), F.col("digest") == F.col("d"), "left").drop("d")
    # rows that repeat the response's page_id and payload: one is the response
    first = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
    is_it = F.col("page_id").eqNullSafe(F.col("response"))
    single, several = rows.where(~(F.coalesce(F.col("again"), F.lit(1)) > 1) | ~is_it), rows.where((F.coalesce(F.col("again"), F.lit(1)) > 1) & is_it)
    rows = single.withColumn("nth", F.lit(1)).unionByName(several.withColumn("nth", first))
    response = F.col("response").isNull() | (F.col("page_id").eqNullSafe(F.col("response")) & (F.col("nth") == 1))
    return rows.select("page_id", "url", "payload", "digest", "size", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record per row of ``pages(page_id, url, html)`` as gzip archives under ``path``.

    A revisit carries the HTTP header (with the payload's length), the digest and the page it refers to, not the payload.
    """
    rows = with_types(pages)
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string"))).alias("bytes"), F.count("*").alias("rows")).first()
    archives = (total["bytes"] or 0) // ARCHIVE_BYTES + total["rows"] // 100_000 + 1
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload"))).otherwise(http)
    at = EPOCH + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Captured-Seconds", at.cast("string")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")), line("WARC-Url-Key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value"), F.xxhash64("page_id", "digest").alias("k"))
    dealt = records.repartition(archives, "k").select("value").mapInArrow(opened, "value string")
    dealt.write.option("lineSep", END).option("compression", "gzip").text(path)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of an archive behind one that describes it."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"archive {TaskContext.get().partitionId()}")
    at = datetime.fromtimestamp(EPOCH, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {at}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n{INFO}"
    yield pa.RecordBatch.from_arrays([pa.array([info])], ["value"])
    yield from batches


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:])
        end = stop + 4 + int(fields["Content-Length"])
        yield at, fields, data[stop + 4 : end]
        at = end + len(END)


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of captures per archive, sorted by URL key, time and page; digests of responses come from the payload read."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = zlib.decompress(content.as_py(), 31)
            run = []
            for offset, fields, block in records(data):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                if fields["WARC-Type"] == "response":
                    size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{path} is damaged at {offset}")
                else:
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), _page(fields["WARC-Refers-To"])
                run.append((fields["WARC-Url-Key"], int(fields["WARC-Captured-Seconds"]), _page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers, path.rpartition("/")[2], offset))
            run.sort(key=_order)
            yield _batch(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if k == "string" else pa.int64() for k in INDEX.replace(",", "").split()[1::2]]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], INDEX.replace(",", "").split()[::2])


def loser_tree_merge(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """Merges sorted runs. Inner nodes hold the loser of the match below them; a step replays one path to the root."""
    k = len(runs)
    if not k:
        return
    sources: list[Iterable] = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and keys[a] is not None
        return keys[a] < keys[b] or (keys[a] == keys[b] and a < b)

    losers = [-1] * k
    winner = 0
    for leaf in range(k):  # each leaf climbs until it meets an empty node
        climber, node = leaf, (leaf + k) // 2
        while node and losers[node] >= 0:
            if beats(losers[node], climber):
                losers[node], climber = climber, losers[node]
            node //= 2
        if node:
            losers[node] = climber
        else:
            winner = climber
    while keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(sources[winner], None)
        keys[winner] = None if heads[winner] is None else key(heads[winner])
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merged_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of runs that fell into this range; adds the range's number and the place within it."""
    runs: list[list[tuple]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not runs or _order(row) < _order(runs[-1][-1]):
                runs.append([])
            runs[-1].append(row)
    part, at, out = TaskContext.get().partitionId(), 0, []

    def flush() -> pa.RecordBatch:
        b = _batch(out)
        n = len(out)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at - n, at), pa.int64())], [*b.schema.names, "part", "place"])

    for row in loser_tree_merge(runs):
        out.append(row)
        at += 1
        if len(out) == 10_000:
            yield flush()
            out = []
    if out:
        yield flush()


def capture_histories(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of all archives under ``path``: one row per record with its global ``history_pos`` (from 1).

    Ordered by (url_key, captured, page_id), a null page first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = written(files.mapInArrow(sorted_runs, INDEX), "runs")
    ranges = runs.count() // RANGE_ROWS + 1
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    merged = written(dealt.mapInArrow(merged_range, f"{INDEX}, part int, place long"), "histories")
    parts = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    joined = merged.join(F.broadcast(before), "part")
    return joined.withColumn("history_pos", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, history_pos)``, one row per row of pages.

    A null html is an empty payload. Rows that repeat page_id and payload: one is the response, the others
    revisit it. A row with a null page_id revisits an equal payload of a numbered page; without one it is a response.
    """
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_pos")


OP6_SQL = f"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT *, sha1(html) AS hex, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), c AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(translate(h, '{UPPER}', '{LOWER}'), '.')), ',') || ')' || regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') ELSE '' END AS url_key
  FROM b
), d AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM c)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) AS history_pos
FROM d"""
