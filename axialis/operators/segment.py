"""Masks and contours of images (image_id, row, col, value): one task an image, dense array code inside.

A learned nucleus model isn't part of this package; `segment_nuclei` takes any function from an array to labels and
falls back on a threshold with connected components, whose results are not those of a learned model.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dense(pdf: pd.DataFrame, column: str, dtype=float) -> np.ndarray:
    out = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), dtype)
    out[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf[column].to_numpy()
    return out


def components(on: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 1 by their first pixel."""
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        new = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                near = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                near[tuple(edge)] = 0
                new = np.where(on & (near > 0) & ((near < new) | (new == 0)), near, new)
        root = np.concatenate([[0], new.ravel()])
        new = np.where(on, root[new], 0)
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(on.shape) + (0 if (label == 0).any() else 1)
        label = new


def threshold_labels(image: np.ndarray) -> np.ndarray:
    """Components brighter than Otsu's threshold."""
    if image.max() <= image.min():
        return np.zeros(image.shape, int)
    hist, edges = np.histogram(image, 256)
    mid, w = (edges[:-1] + edges[1:]) / 2, np.cumsum(hist)
    m = np.cumsum(hist * mid)
    rest = w[-1] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * rest * (m / w - (m[-1] - m) / rest) ** 2)
    return components(image > mid[int(between.argmax())])


def segment_nuclei(images: DataFrame, model: Callable[[np.ndarray], np.ndarray] = threshold_labels) -> DataFrame:
    """image_id, row, col, label from a model of the nuclei channel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = model(dense(pdf, "value"))
        return pdf[["image_id", "row", "col"]].assign(label=label[pdf["row"], pdf["col"]].astype("int32"))

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "row", "col", "value").groupBy("image_id").applyInPandas(run, f"image_id {kind}, row int, col int, label int")


def _disk(r: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]


def _shifted(x: np.ndarray, i: int, j: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    h, w = x.shape
    out[max(0, i) : h + min(0, i), max(0, j) : w + min(0, j)] = x[max(0, -i) : h + min(0, -i), max(0, -j) : w + min(0, -j)]
    return out


def closed(on: np.ndarray, r: int = 3) -> np.ndarray:
    grown = np.zeros_like(on)
    for i, j in _disk(r):
        grown |= _shifted(on, i, j, False)
    out = np.ones_like(on)
    for i, j in _disk(r):
        out &= _shifted(grown, i, j, True)
    return out


def distance_inside(on: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest background pixel (columns first, then lower envelopes of rows)."""
    h, w = on.shape
    far = float(h * h + w * w)
    g = np.where(on, np.inf, 0.0)
    for rows in (range(1, h), range(h - 2, -1, -1)):
        for r in rows:
            g[r] = np.minimum(g[r], g[r - rows.step] + 1)
    g = np.where(np.isfinite(g), g, np.sqrt(far)) ** 2
    at = np.arange(w)
    cost = (at[:, None] - at[None, :]) ** 2
    return np.sqrt(np.stack([(row[None, :] + cost).min(1) for row in g]))


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flooding from markers in order of height, ties in order of arrival, 4-connected, inside the mask."""
    label = np.where(mask, markers, 0).astype(int)
    queue: list = []
    n = 0
    for r, c in zip(*np.nonzero(label), strict=True):
        heappush(queue, (height[r, c], n, r, c))
        n += 1
    while queue:
        _, _, r, c = heappop(queue)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < label.shape[0] and 0 <= x < label.shape[1] and mask[y, x] and not label[y, x]:
                label[y, x] = label[r, c]
                heappush(queue, (height[y, x], n, y, x))
                n += 1
    return label


def cell_bodies(image: np.ndarray, nuclei: np.ndarray) -> np.ndarray:
    """Watershed of the body channel from the nuclei: above the 20th percentile of positive pixels, closed by a disk of 3."""
    positive = image[image > 0]
    level = np.percentile(positive, 20) if len(positive) else 0.1
    on = closed(image > level)
    return watershed(-distance_inside(on), nuclei, on)


def segment_cell_bodies(images: DataFrame, nuclei: DataFrame) -> DataFrame:
    """image_id, row, col, label of cell bodies from body pixels and the nuclei mask."""
    both = images.select("image_id", "row", "col", "value").join(nuclei.select("image_id", "row", "col", "label"), ["image_id", "row", "col"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = cell_bodies(dense(pdf, "value"), dense(pdf, "label", int))
        return pdf[["image_id", "row", "col"]].assign(label=label[pdf["row"], pdf["col"]].astype("int32"))

    kind = images.schema["image_id"].dataType.simpleString()
    return both.groupBy("image_id").applyInPandas(run, f"image_id {kind}, row int, col int, label int")


def traced(on: np.ndarray) -> list[tuple[float, float]]:
    """The longest iso-contour at 0.5 of a binary mask as (row, col) points, by marching squares on a padded grid."""
    m = np.pad(on, 1).astype(int)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]
    top, right, bottom, left = (0, 0.5), (0.5, 1), (1, 0.5), (0.5, 0)
    parts = {1: [(top, left)], 2: [(right, top)], 3: [(right, left)], 4: [(bottom, right)], 5: [(top, left), (bottom, right)], 6: [(bottom, top)], 7: [(bottom, left)], 8: [(left, bottom)], 9: [(top, bottom)], 10: [(right, top), (left, bottom)], 11: [(right, bottom)], 12: [(left, right)], 13: [(top, right)], 14: [(left, top)]}
    following: dict = {}
    for r, c in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        for a, b in parts[int(code[r, c])]:
            following[(r + a[0] - 1, c + a[1] - 1)] = (r + b[0] - 1, c + b[1] - 1)
    best: list = []
    while following:
        start, at = following.popitem()
        ring = [start]
        while at != start and at in following:
            ring.append(at)
            at = following.pop(at)
        best = max(best, ring, key=len)
    return best


def extract_contours(mask: DataFrame, pixel_size: float) -> DataFrame:
    """image_id, label, seq, x, y: each label's longest contour, counter-clockwise, in length units; a task a label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        on = dense(pdf.assign(row=pdf["row"] - r0, col=pdf["col"] - c0, one=1), "one", bool)
        xy = np.array([((c + c0) * pixel_size, (r + r0) * pixel_size) for r, c in traced(on)]).reshape(-1, 2)
        x, y = xy[:, 0], xy[:, 1]
        if len(x) and (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
            x, y = x[::-1], y[::-1]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "label": pdf["label"].iloc[0], "seq": np.arange(len(x), dtype="int32"), "x": x, "y": y})

    kind = mask.schema["image_id"].dataType.simpleString()
    return mask.where("label > 0").select("image_id", "label", "row", "col").groupBy("image_id", "label").applyInPandas(run, f"image_id {kind}, label int, seq int, x double, y double")
