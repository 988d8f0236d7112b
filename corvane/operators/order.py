"""Positions in a global order, and order statistics of groups, without gathering a table or a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import few, workspace, written


def numbered(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 0) in the order: ranges are sorted side by side, their sizes give the offsets.

    Rows equal in ``order`` follow by a hash of the row, so that a frequent value is spread over ranges. Nulls sort first.
    """
    with workspace(df.sparkSession) as held:
        order = [*(F.col(c) if isinstance(c, str) else c for c in order), F.xxhash64(*df.columns)]
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
        # the id holds the partition in its upper bits and the row's place in it in the lower 33
        rows = held.keep(written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered"))
        low = F.lit((1 << 33) - 1)
        part, within = F.shiftright("_row", 33), F.col("_row").bitwiseAND(low)
        sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        # a row for each range, as many as the shuffle has partitions
        offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        offsets = held.keep(written(offsets, "offsets", narrow=True))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, within + F.col("_before")).drop("_row", "_part", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its keys: places of one global order, less the group's first.

    No group is gathered; rows with a null key go.
    """
    placed = numbered(df, [*keys, *order], "_of_all")
    first = placed.groupBy(*keys).agg(F.min("_of_all").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_of_all") - F.col("_first")).drop("_of_all", "_first")


def at_places(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """``(*keys, n, <name>...)``: for each group the values at the given places (from 1) of its ascending order.

    ``places`` are expressions over the group's size ``n``. Null values do not count. Equal values are counted
    where they are read, and only distinct ones are ordered: neither a group nor a value can be too frequent.
    """
    with workspace(rows.sparkSession) as held:
        counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
        ranges = counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).withColumn("_row", F.monotonically_increasing_id())
        ranges = written(ranges.withColumn("_part", F.shiftright("_row", 33)), "ranges")
        sizes = ranges.groupBy("_part").agg(F.sum("_c").alias("_n"))
        # a row for each range, as many as the shuffle has partitions
        offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        pos = ranges.join(F.broadcast(offsets), "_part").withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy("_part").orderBy("_row")))
        pos = written(pos.select(*keys, value, "_c", (F.col("_end") - F.col("_c")).alias("_pos")), "positions")
        ends = written(pos.groupBy(*keys).agg(F.min("_pos").alias("_start"), F.sum("_c").alias("n")), "groups", narrow=True)
        same = reduce(lambda a, b: a & b, (F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys), F.lit(True))
        wanted = few(ends.where("n > 0").select("*", F.array(*(p.cast("long") for p in places.values())).alias("_at")), 64)
        hits = pos.alias("p").join(wanted.alias("e"), same).select(*(F.col(f"p.{k}").alias(k) for k in keys), "e.n", F.col(f"p.{value}").alias("_v"), (F.col("p._pos") - F.col("e._start")).alias("_i"), "p._c", "e._at")
        hits = hits.where(F.exists("_at", lambda x: (x > F.col("_i")) & (x <= F.col("_i") + F.col("_c"))))
        at = lambda i: F.get("_at", F.lit(i))
        out = hits.groupBy(*keys, "n").agg(*(F.max(F.when((at(i) > F.col("_i")) & (at(i) <= F.col("_i") + F.col("_c")), F.col("_v"))).alias(name) for i, name in enumerate(places)))
        return held.keep(written(out, "places", narrow=True))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """``(*keys, n, p<q>...)``: nearest-rank percentiles, place round-half-even(q / 100 * n + 0.5), clamped to 1 .. n."""
    n = F.col("n")
    place = lambda q: F.greatest(F.lit(1), F.least(n, F.bround(F.lit(float(q)) / 100 * n + 0.5).cast("long")))
    return at_places(rows, keys, value, {f"p{q}": place(q) for q in percents})


def linear_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(*keys, n, <name>...)``: quantiles that interpolate between the two neighbouring values."""
    n = F.col("n")
    at = {name: (n - 1) * F.lit(q) for name, q in shares.items()}
    places = {}
    for name, x in at.items():
        places[f"_{name}_low"] = F.floor(x) + 1
        places[f"_{name}_high"] = F.ceil(x) + 1
    found = at_places(rows, keys, value, places)
    low, high = (lambda name: F.col(f"_{name}_low")), (lambda name: F.col(f"_{name}_high"))
    return found.select(*keys, "n", *((low(name) + (high(name) - low(name)) * (x - F.floor(x))).alias(name) for name, x in at.items()))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` per query by score, ties by item; keeps the first ``k``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    out = scores.withColumn("rank", rank.cast("int"))
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "rank", "item_id", "score")
