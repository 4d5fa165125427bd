"""Pair statistics of points (image_id, id, x, y, theta).

Pairs closer than a radius come from a bucketed join: points fall into squares as wide as the radius, one side is
copied to the nine squares around, an equi-join on the square and an exact distance follow. Sums over pairs need no rows
of pairs: each point meets those after it, in its own square and the five that can hold them, as ranges of sorted arrays,
and only sums by image and bin leave a task. Crowded squares are cut into parts by the first point of a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axial import distance, symmetry_order

STRIPS = 4  # strips of a square; a power of two, so that the strips of a square are exactly its own
PART = 4_000  # first points of pairs in a part of a square
ROWS, PAIRS = 1 << 18, 1 << 15  # worked on at once


def close_pairs(points: DataFrame, radius: float, *carry: str) -> DataFrame:
    """Each pair (a.id < b.id) at a distance of at most `radius`: image_id, a_*, b_*, d."""
    cols = ["id", "x", "y", *carry]
    a = points.select("image_id", F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"), *[F.col(c).alias(f"a_{c}") for c in cols])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = points.select("image_id", F.explode(around).alias("o"), *[F.col(c).alias(f"b_{c}") for c in cols])
    b = b.withColumns({"bx": F.floor(F.col("b_x") / radius) + F.col("o.i"), "by": F.floor(F.col("b_y") / radius) + F.col("o.j")}).drop("o")
    both = a.join(b, ["image_id", "bx", "by"]).where("a_id < b_id")
    both = both.withColumn("d", distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")))
    return both.where(F.col("d") <= radius).drop("bx", "by")


def _dealt(points: DataFrame, side: float, carry: tuple[str, ...]) -> DataFrame:
    """Points of squares: `own` ones are the first of pairs there, and all may be the second. Rows of a part are together."""
    p = points.where("id IS NOT NULL").where((F.abs("x") < math.inf) & (F.abs("y") < math.inf))
    p = p.select("image_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *carry)
    p = p.withColumns({"bx": F.floor(F.col("x") / side), "by": F.floor(F.col("y") / side), "strip": F.floor(F.col("y") / side * STRIPS)})
    square, here = ["image_id", "bx", "by"], (0, 0)
    parts = p.groupBy(*square).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((i, j) == here).alias("home")) for i, j in (here, (1, 0), (-1, 0), (1, -1), (0, -1), (-1, -1))])
    p = p.select("*", F.explode(near).alias("o")).withColumns({"bx": F.col("bx") + F.col("o.i"), "by": F.col("by") + F.col("o.j")})
    p = p.join(parts, square).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = F.col("o.home") & (F.pmod(F.hash("id"), F.col("parts")) == F.col("part"))
    p = p.select(*square, "part", "strip", "id", "x", "y", own.alias("own"), *carry)
    session = points.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return p.repartition(n, *square, "part").sortWithinPartitions(*square, "part")


def _ranges(rows: dict[str, np.ndarray], side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First points and the ranges of rows, sorted by group, strip and x, that hold their second ones."""
    group, strip, n = rows["group"], rows["strip"], len(rows["group"])
    begins = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(strip) != 0)])
    segment = np.zeros(n, "int64")
    segment[begins[1:]] = 1
    segment = np.cumsum(segment)
    at = rows["x"] - rows["bx"] * side
    key = segment * (8 * side) + at  # squares on both sides end far from the next segment's
    slack = 1e-14 * (abs(key).max() + abs(rows["x"]).max())
    own = np.flatnonzero(rows["own"])
    out = [(own, own + 1, np.searchsorted(key, key[own] + (side + slack), "right"))]
    for step in range(1, STRIPS + 1):
        first = own[segment[own] + step < len(begins)]
        second = begins[segment[first] + step]
        apart = strip[second] - strip[first]
        ok = (group[second] == group[first]) & (apart <= STRIPS)
        first, apart = first[ok], apart[ok]
        width = side * np.sqrt(1 - ((apart - 1) / STRIPS) ** 2) * (1 + 1e-9) + slack
        middle = (segment[first] + step) * (8 * side) + at[first]
        out.append((first, np.searchsorted(key, middle - width, "left"), np.searchsorted(key, middle + width, "right")))
    first, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    some = high > low
    return first[some], low[some], high[some]


def _pairs(first: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rows of both points, some pairs at once."""
    many = high - low
    ends = np.cumsum(many)
    at = 0
    while at < len(first):
        gone = ends[at] - many[at]
        to = max(at + 1, int(np.searchsorted(ends, gone + PAIRS, "right")))
        each = many[at:to]
        yield np.repeat(first[at:to], each), np.arange(ends[to - 1] - gone) + np.repeat(low[at:to] - (ends[at:to] - each - gone), each)
        at = to


def _pair_sums(points: DataFrame, radius: float, n_bins: int, prepare, *carry: str) -> DataFrame:
    """image_id, bin, n, s, m: number of pairs (of unlike ids) and sums of two weights in each bin that has any.

    `prepare` makes of the rows a function of first rows, second rows and distances that returns bins (n_bins: none),
    weights, and the second weights or None for ones."""
    side = radius * (1 + 1e-9)

    def sums(table: pa.Table):
        image = table.column("image_id").combine_chunks().dictionary_encode()
        rows = {c: table.column(c).to_numpy() for c in table.column_names if c != "image_id"} | {"image": image.indices.to_numpy()}
        if rows["id"].dtype == object:
            rows["id"] = np.unique(rows["id"], return_inverse=True)[1]
        rows |= {f"no_{c}": table.column(c).is_null().to_numpy() for c in carry}
        changes = sum(np.diff(rows[c]) != 0 for c in ("image", "bx", "by", "part"))
        rows["group"] = np.r_[0, np.cumsum(changes > 0)]
        order = np.lexsort((rows["id"], rows["y"], rows["x"], rows["strip"], rows["group"]))
        rows = {c: v[order] for c, v in rows.items()}
        by_id = np.lexsort((rows["id"], rows["group"]))
        alike = ((np.diff(rows["id"][by_id]) == 0) & (np.diff(rows["group"][by_id]) == 0)).any()
        x, y, ids, images = rows["x"], rows["y"], rows["id"], len(image.dictionary)
        base, size = rows["image"].astype("int64") * (n_bins + 1), images * (n_bins + 1)
        total = np.zeros((3, size))
        weigh = prepare(rows)
        for i, j in _pairs(*_ranges(rows, side)):
            if alike:
                unlike = ids[i] != ids[j]
                i, j = i[unlike], j[unlike]
            dx, dy = x[j] - x[i], y[j] - y[i]
            bins, s, m = weigh(i, j, np.sqrt(dx * dx + dy * dy))
            if images > 1:
                bins = bins + base[i]
            n = np.bincount(bins, minlength=size)
            total += n, np.bincount(bins, s, size), n if m is None else np.bincount(bins, m, size)
        total = total.reshape(3, images, n_bins + 1)[:, :, :n_bins]
        which, bins = np.nonzero(total[0])
        n, s, m = (t[which, bins] for t in total)
        return pa.RecordBatch.from_arrays([image.dictionary.take(pa.array(which)), pa.array(bins, pa.int32()), pa.array(n.astype("int64")), pa.array(s), pa.array(m)], ["image_id", "bin", "n", "s", "m"])

    def run(batches):
        held, n, least = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= least:  # all but the last group are whole
                table = pa.Table.from_batches(held)
                image = table.column("image_id").combine_chunks().dictionary_encode().indices.to_numpy()
                keys = [image, *(table.column(c).to_numpy() for c in ("bx", "by", "part"))]
                last = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in keys])))
                if last:
                    yield sums(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
                least = max(ROWS, 2 * n)
        if n:
            yield sums(pa.Table.from_batches(held))

    kind = points.schema["image_id"].dataType.simpleString()
    found = _dealt(points, side, carry).mapInArrow(run, f"image_id {kind}, bin int, n long, s double, m double")
    return found.groupBy("image_id", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "m")])


def orientational_correlation(points: DataFrame, k: int, max_r: float, n_bins: int) -> DataFrame:
    """image_id, bin, r, g, n for every bin; an empty bin has g = 0."""
    k, width = symmetry_order(k), max_r / n_bins

    def prepare(rows):
        known = ~rows["no_theta"]
        angle = np.where(known, rows["theta"], 0.0).astype("float64") * k
        c, s, every = np.cos(angle), np.sin(angle), known.all()

        def weigh(i, j, d):
            bins = np.minimum(d / width, n_bins - 1).astype("int64")
            bins[(d >= max_r) | (d < 1e-15)] = n_bins
            g = c[i] * c[j] + s[i] * s[j]
            both = None if every else known[i] & known[j]
            return bins, g if every else np.where(both, g, 0.0), both

        return weigh

    sums = _pair_sums(points, max_r, n_bins, prepare, "theta").select("image_id", "bin", F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("g"), "n")
    bins = points.select("image_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = bins.join(sums, ["image_id", "bin"], "left")
    return out.select("image_id", "bin", ((F.col("bin") + 0.5) * width).alias("r"), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("n", F.lit(0)).alias("n"))


def correlation_length(bins: DataFrame, least: int = 5) -> DataFrame:
    """xi = -1/slope of ln g over r where g > 0.01 in bins of enough pairs; infinite without a falling line."""
    fit = bins.where((F.col("g") > 0.01) & (F.col("n") >= least)).groupBy("image_id").agg(F.count("*").alias("k"), F.regr_slope(F.log("g"), F.col("r")).alias("slope"))
    every = bins.select("image_id").distinct().join(fit, "image_id", "left")
    bad = F.col("slope").isNull() | F.isnan("slope") | (F.col("k") < 2) | (F.col("slope") >= 0)
    return every.select("image_id", F.when(bad, F.lit(math.inf)).otherwise(-1.0 / F.when(~bad, F.col("slope"))).alias("xi"))


def ripley_k(points: DataFrame, bbox: tuple[float, float, float, float], radii: list[float], edge: str = "lower_id") -> DataFrame:
    """image_id, r, k, l. Weights correct for the box's edges by the point of lower id, or by both (edge="symmetric")."""
    if edge not in ("lower_id", "symmetric"):
        raise ValueError("edge is lower_id or symmetric")
    x0, y0, x1, y1 = bbox
    steps = np.unique(np.array(radii, "float64"))

    def prepare(rows):
        x, y, ids = rows["x"], rows["y"], rows["id"]
        near = np.minimum(np.minimum(x - x0, x1 - x), np.minimum(y - y0, y1 - y))

        def weight(at, d):
            out, gap = np.ones(len(d)), near[at]
            cut = np.flatnonzero((gap < d) & (d >= 1e-15))
            out[cut] = 1.0 / np.maximum(gap[cut] / d[cut], 0.25)
            return out

        def weigh(i, j, d):
            w = 2.0 * weight(np.where(ids[i] < ids[j], i, j), d) if edge == "lower_id" else weight(i, d) + weight(j, d)
            return np.searchsorted(steps, d, "left"), w, None

        return weigh

    sums = _pair_sums(points, float(steps[-1]), len(steps), prepare)
    reached = F.explode(F.slice(F.array(*[F.lit(float(r)) for r in steps]), F.col("bin") + 1, len(steps)))
    sums = sums.select("image_id", "s", reached.alias("r")).groupBy("image_id", "r").agg(F.sum("s").alias("s"))
    every = F.array(*[F.lit(float(r)) for r in radii])
    n = points.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("r", F.explode(every))
    k = F.coalesce("s", F.lit(0.0)) * ((x1 - x0) * (y1 - y0)) / (F.col("n") * F.col("n"))
    return n.join(sums, ["image_id", "r"], "left").select("image_id", "r", k.alias("k"), (F.sqrt(k / math.pi) - F.col("r")).alias("l"))
