"""Bootstrap intervals of means. Draws are made beside the values, block by block; only sums per replicate are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import md5_number
from corvane.storage import workspace, written

#: Values of a group that are drawn from together, in one row.
BLOCK = 1024


def _draw(seed: int, *parts: Column) -> Column:
    """A number by MD5 of the seed and the parts that are not null: it depends on no task, and SQL can replay it."""
    return md5_number(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def _draws_of_blocks(sizes: DataFrame, n: int, seed: int, block: int) -> DataFrame:
    """``(size, block, draws)``: how many of a replicate's ``size`` draws fall into each block of a group that has several.

    They depend on the group's size only, so groups of one size share them. ``draws`` maps a replicate to its count.
    """
    each = sizes.where(F.col("size") > block).select("size").distinct()
    each = each.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))))
    each = each.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "size", "r", "first")
    each = each.select("size", "r", F.explode(F.sequence("first", F.least(F.col("first") + block, F.col("size")) - 1)).alias("i"))
    counts = each.groupBy("size", "r", F.floor(_draw(seed, F.col("r"), F.col("i")) % F.col("size") / block).alias("block")).agg(F.count("*").alias("c"))
    return counts.groupBy("size", "block").agg(F.map_from_entries(F.collect_list(F.struct("r", "c"))).alias("draws"))


def replicates(values: DataFrame, keys: list[str], n: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``(*keys, r, mean)``: ``n`` bootstrap means of every group of ``values(*keys, pos, value)``, ``pos`` counting from 0 in the group.

    A group is cut into blocks of ``block`` values, a row each. The draws of a replicate fall into blocks as
    they would fall on values, and each block then draws as often from its own values: together that is a
    draw from the whole group. A block leaves ``n`` sums; neither values nor draws meet in a join.
    """
    sizes = values.groupBy(*keys).agg(F.count("*").alias("size"))
    blocks = values.groupBy(*keys, F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    blocks = blocks.join(sizes, keys).join(_draws_of_blocks(sizes, n, seed, block), ["size", "block"], "left").withColumn("v", F.col("v.value"))
    many, held = F.col("size") > block, F.size("v")
    tag = F.when(many, F.col("block"))

    def total(r: Column) -> Column:
        times = F.when(many, F.coalesce(F.try_element_at("draws", r), F.lit(0).cast("long"))).otherwise(F.col("size"))
        drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), times - 1), F.lit(0.0), lambda s, i: s + F.get("v", (_draw(seed, r, i, tag) % held).cast("int")))
        return F.when(times > 0, drawn).otherwise(F.lit(0.0))

    sums = blocks.select(*keys, "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), total)).alias("r", "total"))
    return sums.groupBy(*keys, "r").agg((F.sum("total") / F.max("size")).alias("mean"))


def interval(values: DataFrame, keys: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """``(*keys, mean, lo, hi, n)``: means of ``values(*keys, pos, value)`` with the 2.5 and 97.5 per cent ends of their bootstrap means."""
    with workspace(values.sparkSession) as held:
        values = written(values, "values", narrow=True)
        ends = replicates(values, keys, n, seed).groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
        means = values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
        out = means.join(ends, keys).select(*keys, "mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "n")
        return held.keep(written(out, "intervals", narrow=True))
