"""Continuum parameters from moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bulk_energy_density(s: Column, a: Column, c: Column) -> Column:
    return a * s * s + c * s * s * s * s


def ldg_params(cells: DataFrame, xi: float, pixel_size: float = 1.0, column: str = "s", by: str = "image_id") -> DataFrame:
    """a = -2 <s^2>, b = 0, c = 1, k_elastic = (xi * pixel_size)^2 |a|, l_elastic = k; all 0 without cells."""
    m = F.avg(F.col(column) * F.col(column))
    out = cells.groupBy(by).agg(m.alias("m"))
    a = F.coalesce(-2.0 * F.col("m"), F.lit(0.0))
    length = F.lit((xi * pixel_size) ** 2 if math.isfinite(xi) else math.inf)
    return out.select(by, a.alias("a"), F.lit(0.0).alias("b"), F.when(F.col("m").isNull(), 0.0).otherwise(1.0).alias("c"), F.when(a == 0, 0.0).otherwise(length * F.abs(a)).alias("k_elastic"))


def activity(n: Column, area: Column, k: Column) -> Column:
    """zeta = k n / area; 0 for no area."""
    return F.when(area < 1e-15, 0.0).otherwise(k * n / F.when(area >= 1e-15, area))


def parameter_bundle(ldg: DataFrame, frank: DataFrame, defects: DataFrame, area: float, by: str = "image_id") -> DataFrame:
    """One row an image: the coefficients, elastic constant, activity, Frank energies and their JSON."""
    n = defects.groupBy(by).agg(F.count("*").alias("n_defects"))
    out = ldg.join(frank, by).join(n, by, "left").withColumn("n_defects", F.coalesce("n_defects", F.lit(0)))
    zeta = activity(F.col("n_defects").cast("double"), F.lit(float(area)), F.col("k_elastic"))
    ratio = F.when(F.col("splay").isNotNull() & (F.col("bend") > 1e-15), F.col("splay") / F.when(F.col("bend") > 1e-15, F.col("bend"))).otherwise(math.inf)
    out = out.select(by, F.col("a").alias("a_landau"), F.col("b").alias("b_landau"), F.col("c").alias("c_landau"), F.col("k_elastic").alias("k_r"), zeta.alias("zeta_eff"), F.col("splay").alias("frank_splay"), F.col("bend").alias("frank_bend"), ratio.alias("frank_ratio"))
    return out.withColumn("json", params_json(out, by))


def params_json(frame: DataFrame, by: str = "image_id") -> Column:
    """Pretty JSON of the parameters; infinite values become null."""
    cols = [c for c in frame.columns if c != by]
    finite = [F.when(F.abs(F.col(c)) < math.inf, F.col(c)).alias(c) for c in cols]
    return F.to_json(F.struct(*finite), {"pretty": "true", "ignoreNullFields": "false"})
