"""Resampling with a hash in place of a random stream: md5 of (seed, repetition, place) gives the same draw anywhere."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the MD5 of the parts joined by ':'."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(281474976710656.0)


def numbered_blocks(points: DataFrame, block: float) -> tuple[DataFrame, DataFrame]:
    """The points with their square block (bx, by), and the occupied blocks with s, c and their number in order.

    Blocks are numbered by the totals of columns before theirs and their place in the column, so no task orders all."""
    low = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    placed = points.crossJoin(F.broadcast(low)).withColumns({"bx": F.floor((F.col("x") - F.col("x0")) / block), "by": F.floor((F.col("y") - F.col("y0")) / block)})
    sums = placed.groupBy("bx", "by").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    before = Window.orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    columns = sums.groupBy("bx").agg(F.count("*").alias("k")).select("bx", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = sums.withColumn("place", F.row_number().over(Window.partitionBy("bx").orderBy("by")) - 1)
    return placed, inside.join(columns, "bx").select("bx", "by", (F.col("before") + F.col("place")).alias("block"), "s", "c")


def draws(blocks: DataFrame, n: int, seed: int) -> DataFrame:
    """rep, block, times: how often each of n repetitions draws a block, with replacement, as many draws as blocks."""
    spark = blocks.sparkSession
    total = blocks.agg(F.count("*").alias("blocks"))
    out = spark.range(n).withColumnRenamed("id", "rep").crossJoin(F.broadcast(total)).where("blocks > 0")
    out = out.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    out = out.withColumn("block", F.floor(uniform(F.lit(seed), F.col("rep"), F.col("slot")) * F.col("blocks")).cast("long"))
    return out.groupBy("rep", "block").agg(F.count("*").alias("times"))


def block_bootstrap(points: DataFrame, block: float, n: int, seed: int) -> DataFrame:
    """rep, statistic: means of n resamples of the occupied square blocks of (x, y, value), drawn with replacement.

    Blocks send their sum and count, and a repetition how often it draws a block."""
    _, blocks = numbered_blocks(points, block)
    out = draws(blocks, n, seed).join(blocks.select("block", "s", "c"), "block")
    out = out.groupBy("rep").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.sum(F.col("c") * F.col("times")).alias("c"))
    return out.select("rep", (F.col("s") / F.col("c")).alias("statistic"))


def block_bootstrap_with(points: DataFrame, statistic: Callable[[pd.Series], float], block: float, n: int, seed: int) -> DataFrame:
    """As block_bootstrap with any statistic of the values: one task a repetition sees its resample."""
    placed, blocks = numbered_blocks(points, block)
    rows = draws(blocks, n, seed).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rows = rows.join(blocks.select("block", "bx", "by"), "block").join(placed.select("bx", "by", "value"), ["bx", "by"]).select("rep", "value")
    return rows.groupBy("rep").applyInPandas(lambda pdf: pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "statistic": [float(statistic(pdf["value"]))]}), "rep long, statistic double")


def confidence_interval(stats: DataFrame, level: float) -> DataFrame:
    """low, high at places floor(alpha n) and ceil((1 - alpha) n), clamped; (0, 0) without values."""
    alpha = (1.0 - level) / 2.0
    out = stats.agg(F.array_sort(F.collect_list("statistic")).alias("v")).withColumn("n", F.size("v"))
    at = lambda i: F.element_at("v", (F.least(F.greatest(i.cast("int"), F.lit(0)), F.col("n") - 1) + 1).cast("int"))
    low, high = at(F.floor(F.lit(alpha) * F.col("n"))), at(F.ceil(F.lit(1.0 - alpha) * F.col("n")))
    return out.select(F.when(F.col("n") == 0, 0.0).otherwise(low).alias("low"), F.when(F.col("n") == 0, 0.0).otherwise(high).alias("high"))


def mean_difference(a: Column, b: Column) -> Column:
    return F.avg(a) - F.avg(b)


def permuted(samples: DataFrame, a: str, b: str, n: int, seed: int, statistic: Callable[[Column, Column], Column] = mean_difference, buckets: int = 1024) -> DataFrame:
    """rep, difference: the statistic of n random splits of the rows (id, grp, value) of groups a and b.

    A split takes as many rows as a has, those of the least random numbers. Counts by number bucket, summed before the shuffle, say in which
    bucket the last of them lies; only that bucket's rows are put in order. `statistic` makes an aggregate of two
    columns, the values of either side (null on the other)."""
    pooled = samples.where(F.col("grp").isin(a, b))
    size = pooled.agg(F.count_if(F.col("grp") == a).alias("na"))
    rows = pooled.select("id", "value").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("u", uniform(F.lit(seed), F.col("rep"), F.col("id"))).withColumn("bucket", F.floor(F.col("u") * buckets).cast("int"))
    counts = rows.groupBy("rep", "bucket").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("rep").orderBy("bucket"))
    counts = counts.withColumn("upto", upto).crossJoin(F.broadcast(size)).where(F.col("upto") >= F.col("na"))
    last = counts.groupBy("rep").agg(F.min(F.struct("bucket", (F.col("na") - F.col("upto") + F.col("k")).alias("wanted"))).alias("m"))
    last = last.select("rep", F.col("m.bucket").alias("last"), F.col("m.wanted").alias("wanted"))
    rows = rows.join(F.broadcast(last), "rep")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("u", "id"))
    inner = rows.where(F.col("bucket") == F.col("last")).withColumn("first", place <= F.col("wanted"))
    split = rows.where(F.col("bucket") != F.col("last")).withColumn("first", F.col("bucket") < F.col("last")).unionByName(inner)
    value = F.col("value")
    return split.groupBy("rep").agg(statistic(F.when(F.col("first"), value), F.when(~F.col("first"), value)).alias("difference"))


def permutation_test(samples: DataFrame, a: str, b: str, n: int, seed: int, statistic: Callable[[Column, Column], Column] = mean_difference) -> DataFrame:
    """observed, p_value = (extreme + 1) / (n + 1), n_permutations; of any statistic, by default the difference of means."""
    own, value = samples.where(F.col("grp").isin(a, b)), F.col("value")
    seen = own.agg(statistic(F.when(F.col("grp") == a, value), F.when(F.col("grp") == b, value)).alias("observed"))
    counted = permuted(samples, a, b, n, seed, statistic).crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count_if(F.abs("difference") >= F.abs("observed")).alias("x"))
    return counted.select("observed", ((F.col("x") + 1) / F.lit(float(n + 1))).alias("p_value"), F.lit(n).alias("n_permutations"))
