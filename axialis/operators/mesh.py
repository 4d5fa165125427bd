"""Triangulated cells: triangles (image_id, tri_id, v0, v1, v2) over points (image_id, id, x, y, theta)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axial import distance, wrap


def gathered(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """Each triangle with its corners' x, y, theta: three equi-joins, or one shuffle of corners.

    Corners are unpivoted, joined once and pivoted back by aggregation, so points are shuffled once, not three times."""
    corner = triangles.select("image_id", "tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "id"))
    placed = corner.join(points.select("image_id", "id", "x", "y", "theta"), ["image_id", "id"])
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("x", "y", "theta")]
    return placed.groupBy("image_id", "tri_id").agg(F.count("*").alias("corners"), *pick).where("corners = 3").drop("corners")


def _short(g: DataFrame, max_edge: float) -> DataFrame:
    xy = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(3)]
    return g.where(F.greatest(*[distance(*xy[i], *xy[(i + 1) % 3]) for i in range(3)]) <= max_edge)


def mesh_defects(triangles: DataFrame, points: DataFrame, max_edge: float, threshold: float = 0.3) -> DataFrame:
    """x, y, winding (in units of pi) and charge (winding / 2) of triangles with one, taken counter-clockwise."""
    g = _short(gathered(triangles, points), max_edge)
    area = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    t = [F.col(f"theta{k}") for k in range(3)]
    turn = (wrap(t[1] - t[0]) + wrap(t[2] - t[1]) + wrap(t[0] - t[2])) / np.pi
    g = g.select("image_id", "tri_id", ((F.col("x0") + F.col("x1") + F.col("x2")) / 3.0).alias("x"), ((F.col("y0") + F.col("y1") + F.col("y2")) / 3.0).alias("y"), F.round(F.when(area < 0, -turn).otherwise(turn)).alias("winding"))
    return g.where(F.abs("winding") > threshold).withColumn("charge", F.col("winding") / 2.0)


def frank_mesh(triangles: DataFrame, points: DataFrame, max_edge: float) -> DataFrame:
    """splay, bend, ratio, n_triangles of each image by linear elements."""
    g = _short(gathered(triangles, points), max_edge)
    x, y = [F.col(f"x{k}") for k in range(3)], [F.col(f"y{k}") for k in range(3)]
    det = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    g = g.withColumn("det", det).where("0.5 * abs(det) >= 1e-10 and abs(det) >= 1e-10")
    t0 = F.col("theta0")
    t1, t2 = t0 + wrap(F.col("theta1") - t0), t0 + wrap(F.col("theta2") - t0)
    tx = (t0 * (y[1] - y[2]) + t1 * (y[2] - y[0]) + t2 * (y[0] - y[1])) / F.col("det")
    ty = (t0 * (x[2] - x[1]) + t1 * (x[0] - x[2]) + t2 * (x[1] - x[0])) / F.col("det")
    g = g.select("image_id", (0.5 * F.abs("det")).alias("area"), tx.alias("tx"), ty.alias("ty"), ((t0 + t1 + t2) / 3.0).alias("t"))
    splay = -F.sin("t") * F.col("tx") + F.cos("t") * F.col("ty")
    bend = F.cos("t") * F.col("tx") + F.sin("t") * F.col("ty")
    sums = g.groupBy("image_id").agg(F.sum(splay * splay * F.col("area")).alias("splay"), F.sum(bend * bend * F.col("area")).alias("bend"), F.count("*").alias("n_triangles"))
    every = triangles.select("image_id").distinct().join(sums, "image_id", "left").fillna(0, ["splay", "bend", "n_triangles"])
    return every.withColumn("ratio", F.when(F.col("bend") > 1e-20, F.col("splay") / F.when(F.col("bend") > 1e-20, F.col("bend"))).otherwise(1.0))


def triangulated(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points, counter-clockwise.

    Bowyer-Watson with points inserted in random order, moved by 1e-9 of the size. Outside of each hull edge lies a triangle
    with the vertex -1, whose circle is the half-plane, so the hull is exact. A circle through its triangle's
    first corner is c (x^2 + y^2) - m x - n y < 0 about it, with c = 0 for a half-plane; one array operation tests all."""
    count = len(xy)
    size = max(float(np.ptp(xy, axis=0).max()), 1e-12) if count else 0.0
    if count < 3:
        return np.zeros((0, 3), int)
    rng = np.random.default_rng(5)
    p = (xy - xy.min(0)) / size + rng.uniform(-1e-9, 1e-9, xy.shape)
    order = rng.permutation(count).tolist()
    a, b = p[order[0]], p[order[1]]
    third = int(np.argmax([abs((b[0] - a[0]) * (p[k][1] - a[1]) - (b[1] - a[1]) * (p[k][0] - a[0])) for k in order[2:]])) + 2
    order[2], order[third] = order[third], order[2]
    corners = np.full((2 * count + 16, 3), -2)
    circles = np.zeros((5, 2 * count + 16))
    points = p.tolist()

    def put(slot: int, t: tuple[int, int, int]) -> None:
        while t[0] == -1 or t[1] == -1:
            t = (t[1], t[2], t[0])
        (ax, ay), (bx, by) = points[t[0]], points[t[1]]
        bx, by = bx - ax, by - ay
        c, m, n = 0.0, -by, bx
        if t[2] >= 0:
            cx, cy = points[t[2]][0] - ax, points[t[2]][1] - ay
            bb, cc = bx * bx + by * by, cx * cx + cy * cy
            c, m, n = bx * cy - by * cx, cy * bb - by * cc, bx * cc - cx * bb
        corners[slot] = t
        circles[:, slot] = ax, ay, c, m, n

    i, j, k = order[:3]
    (ax, ay), (bx, by), (cx, cy) = points[i], points[j], points[k]
    if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) < 0:
        j, k = k, j
    for slot, t in enumerate(((i, j, k), (j, i, -1), (k, j, -1), (i, k, -1))):
        put(slot, t)
    used, free = 4, []
    for i in order[3:]:
        ax, ay, c, m, n = circles[:, :used]
        x, y = points[i][0] - ax, points[i][1] - ay
        bad = np.flatnonzero(c * (x * x + y * y) - m * x - n * y < 0).tolist()
        edges = set()
        for slot in bad:
            u, v, w = corners[slot].tolist()
            edges |= {(u, v), (v, w), (w, u)}
            corners[slot], circles[:, slot] = -2, 0.0
        free += bad
        for u, v in edges:
            if (v, u) not in edges:
                if not free:
                    free.append(used)
                    used += 1
                put(free.pop(), (u, v, i))
    out = corners[:used][(corners[:used] >= 0).all(1)]
    a, b, c = xy[out[:, 0]], xy[out[:, 1]], xy[out[:, 2]]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
    return out[area > 1e-12 * size * size]


def delaunay(points: DataFrame) -> DataFrame:
    """image_id, tri_id, v0, v1, v2 of each image's distinct points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "y"]).sort_values("id")
        ids = pdf["id"].to_numpy()
        t = ids[triangulated(pdf[["x", "y"]].to_numpy(float))].reshape(-1, 3)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "tri_id": np.arange(len(t)), "v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]})

    kind = points.schema["image_id"].dataType.simpleString()
    return points.select("image_id", "id", "x", "y").groupBy("image_id").applyInPandas(run, f"image_id {kind}, tri_id long, v0 long, v1 long, v2 long")


def neighbours(triangles: DataFrame) -> DataFrame:
    """image_id, id, neighbour: each adjacency in both directions, once."""
    pairs = F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("v1", "v0"), ("v2", "v1"), ("v0", "v2"))])
    return triangles.select("image_id", F.explode(pairs).alias("e")).select("image_id", "e.id", "e.neighbour").distinct()


def quads(field: DataFrame, width: int) -> DataFrame:
    """Two triangles (a, b, d), (a, d, e) of each plaquette of a dense grid; ids are row * width + col."""
    size = field.groupBy("image_id").agg(F.max("row").alias("h"), F.max("col").alias("w"))
    cell = field.select("image_id", "row", "col").join(size, "image_id").where("row < h and col < w")
    a = (F.col("row") * width + F.col("col")).cast("long")
    pair = F.array(F.array(a, a + 1, a + width + 1), F.array(a, a + width + 1, a + width))
    out = cell.select("image_id", a.alias("a"), F.posexplode(pair).alias("k", "v"))
    return out.select("image_id", (2 * F.col("a") + F.col("k")).alias("tri_id"), *[F.col("v")[i].alias(f"v{i}") for i in range(3)])
