"""The test tables as model tables: events are a 100-column pixel grid, orders are polygons, customers are cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axial import PI
from ..operators.ring import polar_ring

COLS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(c: str):
    return F.col(c) - PI * F.floor(F.col(c) / PI)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return e.select(F.lit(0).alias("image_id"), F.floor(F.col("event_id") / COLS).cast("int").alias("row"), (F.col("event_id") % COLS).cast("int").alias("col"), "value", _fold("value").alias("theta"), (F.col("value") - F.floor("value")).alias("coherence"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    edge = (F.col("row") % 10).isin(0, 9) | (F.col("col") % 10).isin(0, 9) | (F.col("value") <= 20)
    return p.withColumn("label", F.when(edge, 0).otherwise(F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 10) + 1).cast("int"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contour_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = Window.partitionBy("contour_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = line.select("contour_id", F.row_number().over(order).alias("seq"), F.count("*").over(Window.partitionBy("contour_id")).alias("n"), "l_quantity").where("n >= 3")
    x, y = polar_ring(F.col("n"), F.col("seq"), F.col("l_quantity"))
    return r.select("contour_id", "seq", x.alias("x"), y.alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    key = F.col("c_custkey")
    return c.select(F.lit(0).alias("image_id"), key.alias("id"), (key * 7919 % 10007 / 10.0).alias("x"), (key * 104729 % 10009 / 10.0).alias("y"), _fold("c_acctbal").alias("theta"), F.col("c_mktsegment").alias("condition"))


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select("image_id", (F.col("row") * COLS + F.col("col")).cast("long").alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "theta")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel grid as images of ten rows."""
    p = pixels(spark, sf_dir)
    return p.withColumn("image_id", F.floor(F.col("row") / 10).cast("int")).withColumn("row", F.col("row") % 10)


def band_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bands(spark, sf_dir)
    edge = F.col("row").isin(0, 9) | (F.col("col") % 10).isin(0, 9) | (F.col("value") <= 20)
    return p.withColumn("label", F.when(edge, 0).otherwise(F.floor(F.col("col") / 10) + 1).cast("int"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel grid as images of 5 x 5 pixels."""
    p = pixels(spark, sf_dir)
    tile = F.floor(F.col("row") / 5) * (COLS // 5) + F.floor(F.col("col") / 5)
    return p.withColumn("image_id", tile.cast("int")).withColumns({"row": F.col("row") % 5, "col": F.col("col") % 5})


def band_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands under file names with a well and a number, as two pages of integers."""
    p, band = bands(spark, sf_dir), F.col("image_id")
    name = F.format_string("%s%02d_dapi-vim-%05d.tif", F.substring(F.lit("abcdefgh"), band % 8 + 1, F.lit(1)), (F.floor(band / 8) % 99 + 1).cast("int"), band)
    return p.select(name.alias("image_id"), "row", "col", F.round(F.col("value") * 100).cast("long").alias("dapi"), F.floor(F.col("coherence") * 1000).cast("int").alias("vimentin"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rectangular cells, four in a row an image: image_id, k, r0, c0 (first pixel), h, w."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k = (F.col("s_suppkey") % 4).cast("int")
    s = s.select(F.floor(F.col("s_suppkey") / 4).cast("int").alias("image_id"), k.alias("k"), (6 + F.col("s_nationkey") % 8).cast("int").alias("h"), (6 + F.col("s_suppkey") * 7 % 9).cast("int").alias("w"))
    return s.withColumns({"r0": F.lit(4), "c0": F.col("k") * 24 + 4})


def slide_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nuclei and bodies of the slides, 38 x 96 pixels: 3 x 3 nuclei in their cells; below, a strip of faint pixels."""
    s = slides(spark, sf_dir)
    every = s.select("image_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(37)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(95))))
    every = every.withColumn("k", F.when(F.col("row") < 24, F.floor(F.col("col") / 24)).cast("int"))
    p = every.join(s, ["image_id", "k"], "left")

    def inside(r, c, h, w):
        return F.coalesce((F.col("row") >= r) & (F.col("row") < r + h) & (F.col("col") >= c) & (F.col("col") < c + w), F.lit(False))

    r, c = F.col("r0") + F.floor(F.col("h") / 2) - 1, F.col("c0") + F.floor(F.col("w") / 2) - 1
    nucleus = F.when(inside(r, c, 3, 3), 100.0 + F.col("k")).otherwise(0.0)
    body = F.when(inside(F.col("r0"), F.col("c0"), F.col("h"), F.col("w")), 50.0).when(F.col("row") >= 28, 1.0).otherwise(0.0)
    at = [F.col("image_id"), F.col("row"), F.col("col")]
    return p.select(*at, nucleus.alias("value")), p.select(*at, body.alias("value"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, twelve an image."""
    c, key = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_custkey")
    return c.select(F.floor(key / 12).cast("int").alias("image_id"), key.alias("id"), F.col("c_acctbal").cast("double").alias("x"), (key * key * 31 % 10007 / 10.0).alias("y"))
