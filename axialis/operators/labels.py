"""Aggregates over labelled pixels and cells: rows (image_id, row, col, label, theta, coherence); label 0 is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axial import PI, eigen, fold, mean_axis, symmetry_order


def labels(mask: DataFrame) -> DataFrame:
    """Distinct positive labels."""
    return mask.where("label > 0").select("image_id", "label").distinct()


def fit_ellipses(mask: DataFrame) -> DataFrame:
    """Moment ellipses of labels with at least 3 pixels and a positive minor axis; angles from the row axis."""
    m = mask.where("label > 0").groupBy("image_id", "label").agg(
        F.count("*").alias("n_pixels"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.var_pop("row").alias("a"), F.covar_pop("row", "col").alias("b"), F.var_pop("col").alias("d"),
    )
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    l1, l2 = eigen(a, b, d)
    m = m.withColumns({"l1": l1, "l2": l2}).where("n_pixels >= 3 and l2 >= 1e-15")
    major, minor = 2.0 * F.sqrt("l1"), 2.0 * F.sqrt("l2")
    return m.select("image_id", "label", "n_pixels", "centroid_row", "centroid_col", major.alias("semi_major"), minor.alias("semi_minor"), (major / minor).alias("aspect_ratio"), fold(0.5 * F.atan2(2.0 * b, a - d)).alias("angle"))


def angle_from_x(angle: Column) -> Column:
    """A row-axis angle of an ellipse as an angle from the x axis."""
    return fold(PI / 2 - angle)


def _listed(found: DataFrame, listed: DataFrame | None, column: str) -> DataFrame:
    if listed is None:
        return found
    return listed.select("image_id", "label").join(found, ["image_id", "label"], "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


def cell_orientations(mask: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Coherence-weighted axial mean of each label; of a listed label without pixels 0."""
    found = mask.where("label > 0").groupBy("image_id", "label").agg(mean_axis(F.col("coherence"), F.col("theta")).alias("orientation"))
    return _listed(found, listed, "orientation")


def cell_mean_coherence(mask: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    found = mask.where("label > 0").groupBy("image_id", "label").agg(F.avg("coherence").alias("mean_coherence"))
    return _listed(found, listed, "mean_coherence")


def mean_katic_orders(field: DataFrame, orders: tuple[int, ...], *by: str) -> DataFrame:
    """psi<k> = |mean of coherence exp(i k theta)| of each group for several k, in one grouping; an empty one 0."""
    def size(k):
        re, im = F.avg(F.col("coherence") * F.cos(k * F.col("theta"))), F.avg(F.col("coherence") * F.sin(k * F.col("theta")))
        return F.coalesce(F.sqrt(re * re + im * im), F.lit(0.0)).alias(f"psi{k}")

    return field.groupBy(*by).agg(*[size(symmetry_order(k)) for k in orders])


def mean_katic_order(field: DataFrame, k: int, *by: str) -> DataFrame:
    """order: the mean of one symmetry order, as in mean_katic_orders."""
    return mean_katic_orders(field, (k,), *by).withColumnRenamed(f"psi{k}", "order")


def nematic_order(angles: DataFrame, *by: str) -> DataFrame:
    """S, mean_angle, n of groups of at least two angles; in one pass."""
    c, s = F.avg(F.cos(2.0 * F.col("theta"))), F.avg(F.sin(2.0 * F.col("theta")))
    out = angles.groupBy(*by).agg(F.count("theta").alias("n"), F.sqrt(c * c + s * s).alias("order"), fold(0.5 * F.atan2(s, c)).alias("mean_angle"))
    return out.where("n >= 2")


def cells_with_nuclei(cells: DataFrame, nuclei: DataFrame) -> DataFrame:
    """Cells with their nucleus's aspect ratio and angle, 0 where there is none."""
    own = nuclei.select("image_id", "label", F.col("aspect_ratio").alias("nuclear_aspect_ratio"), F.col("angle").alias("nuclear_angle"))
    return cells.join(own, ["image_id", "label"], "left").fillna(0.0, ["nuclear_aspect_ratio", "nuclear_angle"])


def sampled(cells: DataFrame, field: DataFrame, pixel_size: float, columns: tuple[str, ...] = ("theta", "coherence")) -> DataFrame:
    """The field at each cell's centroid (x, y): the pixel that holds it, clamped to the image."""
    size = field.groupBy("image_id").agg(F.max("row").alias("h"), F.max("col").alias("w"))
    at = lambda c, most: F.least(F.greatest(F.floor(F.col(c) / pixel_size).cast("int"), F.lit(0)), F.col(most))
    placed = cells.join(size, "image_id").withColumns({"row": at("y", "h"), "col": at("x", "w")}).drop("h", "w")
    return placed.join(field.select("image_id", "row", "col", *columns), ["image_id", "row", "col"], "left")


def cell_records(cells: DataFrame) -> DataFrame:
    """Cells with every numeric descriptor present: a missing one is 0."""
    numbers = [c for c, kind in cells.dtypes if kind in ("double", "float")]
    return cells.fillna(0.0, numbers)
