"""Shape of closed contours, held as rows (contour_id, seq, x, y).

One window finds each vertex's successor (the last one's is the first), one aggregation over the same partitioning
gives every descriptor, so a contour is shuffled once. Contours of fewer than three points are left out, or refused
with strict=True.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axial import PI, fold, ratio, symmetry_order

SHAPE_K = (1, 2, 4, 6)
FOURIER_K = (1, 2, 3, 4, 6)


def edges(rings: DataFrame, key: str = "contour_id") -> DataFrame:
    """Adds nx, ny (the successor), n_points, cx, cy (the vertex mean)."""
    order = Window.partitionBy(key).orderBy("seq")
    every = Window.partitionBy(key)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rings.withColumn("nx", F.coalesce(F.lead("x").over(order), F.first("x").over(full)))
    out = out.withColumn("ny", F.coalesce(F.lead("y").over(order), F.first("y").over(full)))
    return out.withColumns({"n_points": F.count("*").over(every), "cx": F.avg("x").over(every), "cy": F.avg("y").over(every)})


def contours(rings: DataFrame, key: str = "contour_id", strict: bool = False) -> DataFrame:
    """The edges of valid contours."""
    out = edges(rings, key)
    if strict:
        return out.where(F.when(F.col("n_points") < 3, F.raise_error("a contour needs at least 3 points").cast("boolean")).otherwise(True))
    return out.where("n_points >= 3")


def _amplitude(k: int) -> Column:
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    size, phi = F.sqrt(dx * dx + dy * dy), F.atan2(dy, -dx)
    re, im, total = F.sum(size * F.cos(k * phi)), F.sum(size * F.sin(k * phi)), F.sum(size)
    return F.when(total < 1e-15, 0.0).otherwise(F.sqrt(re * re + im * im) / total)


def _mode(k: int) -> tuple[Column, Column]:
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    r, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)
    return F.avg(r * F.cos(k * theta)), -F.avg(r * F.sin(k * theta))


def shape_katic(k: int) -> Column:
    return _amplitude(symmetry_order(k))


def analyze_shapes(rings: DataFrame, key: str = "contour_id", strict: bool = False) -> DataFrame:
    """Every descriptor of every contour: area, perimeter, centroid, W1 tensor, elongation, spectra, shape index,
    hull area and convexity (area over hull area, 0 where the hull has none)."""
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    safe = F.when(size >= 1e-15, size)
    sums = {
        "n_points": F.count("*"), "signed_area": 0.5 * F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")), "perimeter": F.sum(size),
        "centroid_x": F.avg("x"), "centroid_y": F.avg("y"),
        "w1_xx": 0.5 * F.coalesce(F.sum(dy * dy / safe), F.lit(0.0)), "w1_xy": -0.5 * F.coalesce(F.sum(dx * dy / safe), F.lit(0.0)), "w1_yy": 0.5 * F.coalesce(F.sum(dx * dx / safe), F.lit(0.0)),
    }
    sums |= {"xs": F.collect_list(F.struct("x", "y"))} | {f"q{k}": _amplitude(k) for k in SHAPE_K}
    for k in (0, *FOURIER_K):
        sums[f"re{k}"], sums[f"im{k}"] = _mode(k)
    out = contours(rings, key, strict).groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])
    a, b, d = F.col("w1_xx"), F.col("w1_xy"), F.col("w1_yy")
    out = out.withColumns({"area": F.abs("signed_area"), "hull_area": hull_area("xs")})
    size0 = F.sqrt(F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0"))
    fourier = [F.when(size0 < 1e-15, 0.0).otherwise(F.sqrt(F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")) / size0) for k in FOURIER_K]
    return out.select(
        key, "n_points", "signed_area", "area", "perimeter", "centroid_x", "centroid_y", "w1_xx", "w1_xy", "w1_yy",
        ratio(F.sqrt((a - d) * (a - d) + 4.0 * b * b), a + d).alias("elongation"), fold(0.5 * F.atan2(2.0 * b, a - d)).alias("elongation_angle"),
        F.when(F.col("area") < 1e-15, 0.0).otherwise(F.col("perimeter") / F.sqrt("area")).alias("shape_index"),
        F.array(*[f"q{k}" for k in SHAPE_K]).alias("shape_katic"), F.array(*fourier).alias("fourier"),
        "hull_area", ratio(F.col("area"), F.col("hull_area")).alias("convexity"),
    )


def fourier_mode(rings: DataFrame, k: int, key: str = "contour_id") -> DataFrame:
    """Amplitude and phase of one Fourier mode of the radius about the vertex mean."""
    re, im = _mode(k)
    out = contours(rings, key).groupBy(key).agg(re.alias("re"), im.alias("im"))
    return out.select(key, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"), F.atan2("im", "re").alias("phase"))


def _chain(group: np.ndarray, x: np.ndarray, y: np.ndarray, side: float) -> np.ndarray:
    """Twice the area under the lower (side 1) or upper (-1) hull of each group's points, which are sorted by x.

    A point on or beyond the chord of its neighbours isn't a corner; all such go at once until none is left."""
    groups = int(group[-1]) + 1 if len(group) else 0
    while len(x) > 2:
        turn = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (y[1:-1] - y[:-2]) * (x[2:] - x[:-2])
        drop = (side * turn <= 0) & (group[2:] == group[:-2])
        if not drop.any():
            break
        keep = np.concatenate([[True], ~drop, [True]])
        group, x, y = group[keep], x[keep], y[keep]
    same = group[1:] == group[:-1]
    return np.bincount(group[1:][same], ((x[1:] - x[:-1]) * (y[1:] + y[:-1]))[same], minlength=groups)


@F.arrow_udf(T.DoubleType())
def hull_area(points: pa.Array) -> pa.Array:
    """Area of the convex hull of each list of (x, y); of fewer than three distinct points or a line 0."""
    n = np.asarray(points.value_lengths().fill_null(0))
    flat = points.flatten()
    x, y = (np.asarray(flat.field(k).cast(pa.float64())) for k in (0, 1))
    group = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((y, x, group))
    group, x, y = group[order], x[order], y[order]
    area = np.zeros(len(n))
    if len(x):
        # a group's points of one x count by the lowest for the lower hull, by the highest for the upper
        new = np.ones(len(x), bool)
        new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
        last = np.append(new[1:], True)
        twice = _chain(group[last], x[last], y[last], -1.0) - _chain(group[new], x[new], y[new], 1.0)
        area[: len(twice)] = np.maximum(0.5 * twice, 0.0)
    return pa.array(area)


def convexity(rings: DataFrame, key: str = "contour_id") -> DataFrame:
    """Area over hull area, 0 where the hull has none."""
    return analyze_shapes(rings, key).select(key, "area", "hull_area", "convexity")


def polar_ring(n: Column, seq: Column, radius: Column) -> tuple[Column, Column]:
    angle = 2.0 * PI * (seq - 1) / n
    return radius * F.cos(angle), radius * F.sin(angle)
