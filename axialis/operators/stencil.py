"""Fields on pixel grids, held as rows (image_id, row, col, value).

Two back-ends. The relational one uses windows for neighbours and rows of taps for blurs: separable, so
2 (2 r + 1) rows a pixel. The tile one, the default, cuts images into tiles with a halo as wide as the stencil and runs dense array
code on each tile; an image of any size becomes many tasks, and one shuffle serves all scales. Outside an image is 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axial import PI, eigen, fold, ratio, symmetry_order, wrap

SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
TILE = 256


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """(shift, weight) over a radius of ceil(4 sigma), weights sum to 1; below 0.5 the identity."""
    if sigma < 0.5:
        return [(0, 1.0)]
    r = math.ceil(4 * sigma)
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    total = sum(w)
    return [(d, x / total) for d, x in zip(range(-r, r + 1), w, strict=True)]


def zeros(spark, width: int, height: int, image_id: int = 0) -> DataFrame:
    """A field of zeros."""
    return spark.range(width * height).select(F.lit(image_id).alias("image_id"), F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), F.lit(0.0).alias("value"))


def field_checked(field: DataFrame, width: int, height: int) -> DataFrame:
    """One row an image that isn't exactly width x height distinct pixels (none: the field is well formed)."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    n = field.groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("row", "col").alias("distinct"), F.count_if(inside).alias("inside"))
    return n.where(~((F.col("n") == width * height) & (F.col("distinct") == F.col("n")) & (F.col("inside") == F.col("n"))))


def pixels_at(field: DataFrame, places: DataFrame, column: str = "value") -> DataFrame:
    """The field's value at each (image_id, row, col) of `places`."""
    return places.join(field.select("image_id", "row", "col", column), ["image_id", "row", "col"], "left")


def with_pixels(field: DataFrame, places: DataFrame, column: str = "value") -> DataFrame:
    """The field with the values of `places` put in; frames don't change in place."""
    new = places.select("image_id", "row", "col", F.col(column).alias("__new"))
    return field.join(new, ["image_id", "row", "col"], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def _tiles(field: DataFrame, columns: tuple[str, ...], halo: int, tile: int) -> tuple[DataFrame, int]:
    """Pixels dealt to the tiles (tr, tc) that hold them or have them in their halo, with the image's last row and
    column (h, w); and the tile's size, at least the halo."""
    tile = max(tile, halo)
    size = field.groupBy("image_id").agg(F.max("row").alias("h"), F.max("col").alias("w"))
    spread = lambda axis: F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / tile)).cast("int"), F.floor((F.col(axis) + halo) / tile).cast("int"))
    dealt = field.select("image_id", "row", "col", *columns).join(size, "image_id")
    dealt = dealt.withColumn("tr", F.explode(spread("row"))).withColumn("tc", F.explode(spread("col")))
    return dealt.where((F.col("tr") * tile <= F.col("h")) & (F.col("tc") * tile <= F.col("w"))), tile


class _Tile:
    """One tile's frame: its dense arrays with halo, and its own part."""

    def __init__(self, pdf: pd.DataFrame, halo: int, tile: int):
        h, w, tr, tc = (int(pdf[c].iloc[0]) for c in ("h", "w", "tr", "tc"))
        self.pdf, self.image = pdf, pdf["image_id"].iloc[0]
        self.r0, self.c0 = max(0, tr * tile - halo), max(0, tc * tile - halo)
        self.shape = (min(h, (tr + 1) * tile - 1 + halo) - self.r0 + 1, min(w, (tc + 1) * tile - 1 + halo) - self.c0 + 1)
        rows, cols = (tr * tile, min(h + 1, (tr + 1) * tile)), (tc * tile, min(w + 1, (tc + 1) * tile))
        self.own = np.s_[rows[0] - self.r0 : rows[1] - self.r0, cols[0] - self.c0 : cols[1] - self.c0]
        self.rows, self.cols = (x.ravel() for x in np.mgrid[rows[0] : rows[1], cols[0] : cols[1]])

    def dense(self, column: str) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.pdf["row"].to_numpy() - self.r0, self.pdf["col"].to_numpy() - self.c0] = self.pdf[column].to_numpy()
        return out


def gaussian_blur(field: DataFrame, sigma: float, columns: tuple[str, ...] = ("value",), backend: str = "tile", tile: int = TILE) -> DataFrame:
    """Separable blur with zero padding of several columns at once: one shuffle of tiles, or (relational) one an axis."""
    if sigma < 0.5:
        return field.select("image_id", "row", "col", *columns)
    if backend == "relational":
        return _blur_by_rows(field, sigma, columns)
    taps = gaussian_kernel(sigma)
    dealt, tile = _tiles(field, columns, taps[-1][0], tile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(pdf, taps[-1][0], tile)
        return pd.DataFrame({"image_id": t.image, "row": t.rows, "col": t.cols} | {c: _blurred(t.dense(c), taps)[t.own].ravel() for c in columns})

    kind = field.schema["image_id"].dataType.simpleString()
    return dealt.groupBy("image_id", "tr", "tc").applyInPandas(run, f"image_id {kind}, row int, col int, " + ", ".join(f"`{c}` double" for c in columns))


def _blur_by_rows(field: DataFrame, sigma: float, columns: tuple[str, ...]) -> DataFrame:
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in gaussian_kernel(sigma)])
    size = field.groupBy("image_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    out = field.select("image_id", "row", "col", *columns).join(size, "image_id")
    for axis in ("col", "row"):
        shifted = out.withColumn("k", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("k.d"))
        shifted = shifted.where((F.col(axis) >= 0) & (F.col(axis) <= F.col(f"last_{axis}")))
        out = shifted.groupBy("image_id", "row", "col").agg(*[F.sum(F.col(c) * F.col("k.w")).alias(c) for c in columns], F.first("last_row").alias("last_row"), F.first("last_col").alias("last_col"))
    return out.select("image_id", "row", "col", *columns)


def scharr(field: DataFrame) -> DataFrame:
    """gx, gy by 3 x 3 Scharr stencils, 0 on the border."""
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    v = F.col("value")
    before, after = F.lag(v).over(along), F.lead(v).over(along)
    one = field.select("image_id", "row", "col", (after - before).alias("d"), (3.0 * before + 10.0 * v + 3.0 * after).alias("s"))
    gx = (3.0 * F.lag("d").over(down) + 10.0 * F.col("d") + 3.0 * F.lead("d").over(down)) / 32.0
    gy = (F.lead("s").over(down) - F.lag("s").over(down)) / 32.0
    return one.select("image_id", "row", "col", F.coalesce(gx, F.lit(0.0)).alias("gx"), F.coalesce(gy, F.lit(0.0)).alias("gy"))


def _orientation(products: DataFrame, *more: str) -> DataFrame:
    a, b, d = F.col("jxx"), F.col("jxy"), F.col("jyy")
    l1, l2 = eigen(a, b, d)
    out = products.select("image_id", "row", "col", *more, "jxx", "jxy", "jyy", l1.alias("lambda1"), l2.alias("lambda2"))
    return out.withColumns({"coherence": ratio(F.col("lambda1") - F.col("lambda2"), F.col("lambda1") + F.col("lambda2")), "theta": fold(0.5 * F.atan2(2.0 * b, a - d) + PI / 2)})


def structure_tensor(field: DataFrame, sigma: float, backend: str = "tile") -> DataFrame:
    """theta (fibre direction, [0, pi)), coherence, lambda1, lambda2 and the smoothed tensor of each pixel."""
    if backend == "tile":
        return multiscale_structure_tensor(field, (sigma,)).drop("scale_idx", "sigma")
    g = scharr(field)
    products = g.select("image_id", "row", "col", (F.col("gx") * F.col("gx")).alias("jxx"), (F.col("gx") * F.col("gy")).alias("jxy"), (F.col("gy") * F.col("gy")).alias("jyy"))
    return _orientation(gaussian_blur(products, sigma, ("jxx", "jxy", "jyy"), "relational"))


def _blurred(x: np.ndarray, kernel: list[tuple[int, float]]) -> np.ndarray:
    """Both axes by products with the kernel's band matrices; cut at the edges, as what lies outside is 0."""
    right = np.array([w for d, w in kernel if d >= 0])

    def band(n: int) -> np.ndarray:
        w = np.zeros(n)
        w[: len(right)] = right[:n]
        at = np.arange(n)
        return w[np.abs(at[:, None] - at)]

    return band(x.shape[0]) @ x @ band(x.shape[1])


def multiscale_structure_tensor(field: DataFrame, sigmas: tuple[float, ...] = SCALES, tile: int = TILE) -> DataFrame:
    """scale_idx, sigma and the structure tensor of each pixel and scale; the gradient is made once."""
    kernels = [gaussian_kernel(s) for s in sigmas]
    halo = 1 + max(k[-1][0] for k in kernels)
    dealt, tile = _tiles(field, ("value",), halo, tile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(pdf, halo, tile)
        v = t.dense("value")
        gx, gy = np.zeros_like(v), np.zeros_like(v)
        if min(v.shape) > 2:
            d, s = v[:, 2:] - v[:, :-2], 3 * v[:, :-2] + 10 * v[:, 1:-1] + 3 * v[:, 2:]
            gx[1:-1, 1:-1] = (3 * d[:-2] + 10 * d[1:-1] + 3 * d[2:]) / 32
            gy[1:-1, 1:-1] = (s[2:] - s[:-2]) / 32
        out = []
        for i, (sigma, kernel) in enumerate(zip(sigmas, kernels, strict=True)):
            a, b, c = (_blurred(x, kernel)[t.own].ravel() for x in (gx * gx, gx * gy, gy * gy))
            root = np.sqrt((a - c) ** 2 + 4 * b * b)
            l1, l2 = (a + c + root) / 2, (a + c - root) / 2
            total = l1 + l2
            theta = 0.5 * np.arctan2(2 * b, a - c) + np.pi / 2
            theta -= np.pi * np.floor(theta / np.pi)
            theta[theta >= np.pi] = 0.0
            out.append(pd.DataFrame({"image_id": t.image, "row": t.rows, "col": t.cols, "scale_idx": i, "sigma": float(sigma), "jxx": a, "jxy": b, "jyy": c, "lambda1": l1, "lambda2": l2, "coherence": np.divide(l1 - l2, total, out=np.zeros_like(total), where=total > 1e-15), "theta": theta}))
        return pd.concat(out)

    kind = field.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, row int, col int, scale_idx int, sigma double, jxx double, jxy double, jyy double, lambda1 double, lambda2 double, coherence double, theta double"
    return dealt.groupBy("image_id", "tr", "tc").applyInPandas(run, schema)


def optimal_scale(multi: DataFrame, digits: int | None = None) -> DataFrame:
    """sigma of the greatest coherence of each pixel, the first listed on ties, and that coherence."""
    c = F.round("coherence", digits) if digits is not None else F.col("coherence")
    best = F.max(F.struct(c.alias("c"), (-F.col("scale_idx")).alias("i"), F.col("sigma").alias("s")))
    return multi.groupBy("image_id", "row", "col").agg(best.alias("m")).select("image_id", "row", "col", F.col("m.s").alias("optimal_sigma"), F.col("m.c").alias("max_coherence"))


def katic_field(field: DataFrame, k: int) -> DataFrame:
    """magnitude, re, im of coherence * exp(i k theta)."""
    k = symmetry_order(k)
    return field.withColumns({"magnitude": F.col("coherence"), "re": F.col("coherence") * F.cos(k * F.col("theta")), "im": F.col("coherence") * F.sin(k * F.col("theta"))})


def grid_defects(field: DataFrame, k: int = 2, threshold: float = PI / 2) -> DataFrame:
    """Plaquettes of which |winding| exceeds the threshold: row + 0.5, col + 0.5, winding, charge (sign / k).

    Each edge's axial difference is taken in its canonical direction and negated against it."""
    k = symmetry_order(k)
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    one = field.select("image_id", "row", "col", (F.col("theta") * (k / 2.0)).alias("t00")).withColumn("t01", F.lead("t00").over(along))
    two = one.withColumns({"t10": F.lead("t00").over(down), "t11": F.lead("t01").over(down)}).where("t01 is not null and t11 is not null")
    t = {c: F.col(c) for c in ("t00", "t01", "t10", "t11")}
    winding = wrap(t["t01"] - t["t00"]) + wrap(t["t11"] - t["t01"]) - wrap(t["t11"] - t["t10"]) - wrap(t["t10"] - t["t00"])
    two = two.select("image_id", (F.col("row") + 0.5).alias("row"), (F.col("col") + 0.5).alias("col"), winding.alias("winding"))
    return two.where(F.abs("winding") > threshold).withColumn("charge", F.signum("winding") / k)


def poincare_hopf(defects: DataFrame, chi: float, tolerance: float = 0.1, images: DataFrame | None = None) -> DataFrame:
    """total, deviation and valid of each image of `images` (image_id); an image without defects has a total of 0.

    Without `images` only those with defects are known."""
    out = defects.groupBy("image_id").agg(F.sum("charge").alias("total"))
    if images is not None:
        out = images.select("image_id").distinct().join(out, "image_id", "left").fillna(0.0, ["total"])
    return out.select("image_id", "total", F.abs(F.col("total") - chi).alias("deviation"), (F.abs(F.col("total") - chi) < tolerance).alias("valid"))


def frank_grid(field: DataFrame, dx: float = 1.0, axial: bool = False) -> DataFrame:
    """splay, bend and ratio of each image from central differences of the director, or of wrapped angles."""
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    t = F.col("theta")
    near = field.select("image_id", "row", "col", t, F.lag(t).over(along).alias("w"), F.lead(t).over(along).alias("e"))
    near = near.withColumns({"n": F.lag(t).over(down), "s": F.lead(t).over(down)}).where("w is not null and e is not null and n is not null and s is not null")
    h = 2.0 * dx
    if axial:
        tx, ty = wrap(F.col("e") - F.col("w")) / h, wrap(F.col("s") - F.col("n")) / h
        splay, bend = -F.sin(t) * tx + F.cos(t) * ty, F.cos(t) * tx + F.sin(t) * ty
    else:
        splay = (F.cos("e") - F.cos("w")) / h + (F.sin("s") - F.sin("n")) / h
        bend = (F.sin("e") - F.sin("w")) / h - (F.cos("s") - F.cos("n")) / h
    sums = near.groupBy("image_id").agg((F.sum(splay * splay) * (dx * dx)).alias("splay"), (F.sum(bend * bend) * (dx * dx)).alias("bend"))
    every = field.select("image_id").distinct().join(sums, "image_id", "left").fillna(0.0, ["splay", "bend"])
    return every.withColumn("ratio", ratio(F.col("splay"), F.col("bend"), 1e-15, math.inf))


def normalised(field: DataFrame, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Values scaled to 0..1 between two percentiles of their image; a flat image is 0."""
    p = field.groupBy("image_id").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("p"))
    scaled = (F.col("value") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0])
    out = field.join(p, "image_id")
    return out.withColumn("value", F.when(F.col("p")[1] > F.col("p")[0], F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).otherwise(0.0)).drop("p")
