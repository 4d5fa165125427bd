"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows independently."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axial import frame
from ..operators import homology, labels, mesh, pairs, resample, ring, stencil, theory
from . import adapters as A

BBOX = (0.0, 0.0, 1000.7, 1000.9)
RADII = [10.0, 20.0, 30.0]


def r6(c, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r6(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def nematic_order(s, d):
    out = labels.nematic_order(A.cells(s, d), "condition")
    return rounded(out.select("condition", "n", "order", (F.col("order") * F.cos(2.0 * F.col("mean_angle"))).alias("qx"), (F.col("order") * F.sin(2.0 * F.col("mean_angle"))).alias("qy")))


def _shapes(s, d):
    return ring.analyze_shapes(A.rings(s, d))


def shape_area_perimeter(s, d):
    return rounded(_shapes(s, d).select("contour_id", "n_points", "area", "perimeter", "signed_area"))


def contour_centroid(s, d):
    return rounded(_shapes(s, d).select("contour_id", "centroid_x", "centroid_y"))


def w1_elongation(s, d):
    axis = [(F.col("elongation") * f(2.0 * F.col("elongation_angle"))).alias(n) for f, n in ((F.cos, "qx"), (F.sin, "qy"))]
    return rounded(_shapes(s, d).select("contour_id", "w1_xx", "w1_xy", "w1_yy", "elongation", *axis))


def shape_index(s, d):
    return rounded(_shapes(s, d).select("contour_id", "shape_index"))


def shape_katic_spectrum(s, d):
    return rounded(_shapes(s, d).select("contour_id", *[F.col("shape_katic")[i].alias(f"q{k}") for i, k in enumerate(ring.SHAPE_K)]))


def fourier_spectrum(s, d):
    return rounded(_shapes(s, d).select("contour_id", *[F.col("fourier")[i].alias(f"a{k}") for i, k in enumerate(ring.FOURIER_K)]))


def fourier_mode_2(s, d):
    m = ring.fourier_mode(A.rings(s, d), 2)
    return rounded(m.select("contour_id", "amplitude", (F.col("amplitude") * F.cos("phase")).alias("re")))


def convexity(s, d):
    return rounded(ring.convexity(A.rings(s, d)))


def nuclear_ellipse(s, d):
    e = labels.fit_ellipses(A.mask(s, d))
    axis = [((F.col("semi_major") ** 2 - F.col("semi_minor") ** 2) / 4.0 * f(2.0 * F.col("angle"))).alias(n) for f, n in ((F.cos, "qx"), (F.sin, "qy"))]
    return rounded(e.select("label", "n_pixels", "centroid_row", "centroid_col", "semi_major", "semi_minor", "aspect_ratio", *axis))


def cell_orientation(s, d):
    return rounded(labels.cell_orientations(A.mask(s, d)).select("label", F.cos(2.0 * F.col("orientation")).alias("c2"), F.sin(2.0 * F.col("orientation")).alias("s2")), 5)


def cell_mean_coherence(s, d):
    return rounded(labels.cell_mean_coherence(A.mask(s, d)).select("label", "mean_coherence"))


def mean_katic_order(s, d):
    return rounded(labels.mean_katic_orders(A.mask(s, d).where("label > 0"), (1, 2, 4, 6), "label"))


def gaussian_blur(s, d):
    return rounded(stencil.gaussian_blur(A.pixels(s, d), 1.0).select("row", "col", "value"))


def scharr(s, d):
    return rounded(stencil.scharr(A.pixels(s, d)).select("row", "col", "gx", "gy"), 8)


def _tensor_out(t):
    return rounded(t.select("row", "col", "lambda1", "lambda2", "coherence", (F.col("coherence") * F.cos(2.0 * F.col("theta"))).alias("qx"), (F.col("coherence") * F.sin(2.0 * F.col("theta"))).alias("qy")), 5)


def structure_tensor(s, d):
    return _tensor_out(stencil.structure_tensor(A.pixels(s, d), 1.0))


def structure_tensor_relational(s, d):
    return _tensor_out(stencil.structure_tensor(A.pixels(s, d), 1.0, "relational"))


def katic_order_field(s, d):
    k = stencil.katic_field(A.pixels(s, d), 4)
    return rounded(k.select("row", "col", "magnitude", "re", "im"))


def multiscale_optimal_scale(s, d):
    m = stencil.multiscale_structure_tensor(A.pixels(s, d), (1.0, 2.0, 3.0))
    return stencil.optimal_scale(m, 5).select("row", "col", "optimal_sigma", (F.col("max_coherence") + 0.0).alias("max_coherence"))


def percentile_normalise(s, d):
    return rounded(stencil.normalised(A.pixels(s, d)).select("row", "col", "value"))


def grid_defects(s, d):
    return rounded(stencil.grid_defects(A.pixels(s, d)).select("row", "col", "winding", "charge"))


def poincare_hopf(s, d):
    return rounded(stencil.poincare_hopf(stencil.grid_defects(A.pixels(s, d)), 1.0).select("total", "deviation", "valid"))


def director_frames(s, d):
    f = A.pixels(s, d).select("row", "col", frame(F.col("theta")).alias("f"))
    return rounded(f.select("row", "col", *[F.col("f")[i].alias(f"f{i}") for i in range(9)]))


def frank_grid(s, d):
    return rounded(stencil.frank_grid(A.pixels(s, d)).select("splay", "bend", "ratio"), 4)


def mesh_defects(s, d):
    p = A.grid_points(s, d)
    return rounded(mesh.mesh_defects(mesh.quads(A.pixels(s, d), A.COLS), p, 2.0).select("tri_id", "x", "y", "winding", "charge"))


def frank_mesh(s, d):
    f = mesh.frank_mesh(mesh.quads(A.pixels(s, d), A.COLS), A.grid_points(s, d), 2.0)
    return rounded(f.select("splay", "bend", "ratio", F.col("n_triangles").cast("long").alias("n_triangles")), 4)


def orientational_correlation(s, d):
    return rounded(pairs.orientational_correlation(A.cells(s, d), 2, 50.0, 20).select("bin", "r", "g", "n"))


def correlation_length(s, d):
    """On a field with a falling correlation: angles that turn slowly with x."""
    p = A.cells(s, d).withColumn("theta", F.col("x") * 0.01)
    return rounded(pairs.correlation_length(pairs.orientational_correlation(p, 2, 50.0, 20)).select("xi"))


def ripley_k(s, d):
    return rounded(pairs.ripley_k(A.cells(s, d), BBOX, RADII).select("r", "k", "l"))


def block_bootstrap(s, d):
    p = A.cells(s, d).select("x", "y", F.col("theta").alias("value"))
    return rounded(resample.block_bootstrap(p, 250.0, 200, 42))


def bootstrap_interval(s, d):
    p = A.cells(s, d).select("x", "y", F.col("theta").alias("value"))
    return rounded(resample.confidence_interval(resample.block_bootstrap(p, 250.0, 200, 42), 0.95))


def permutation_test(s, d):
    e = A.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("grp"), "value")
    return rounded(resample.permutation_test(e, "click", "view", 20, 7))


def _ordered(s, d):
    return A.cells(s, d).withColumn("s", F.abs(F.cos("theta")))


def ldg_params(s, d):
    return rounded(theory.ldg_params(_ordered(s, d), 10.0, 0.345, by="condition"))


def bulk_energy(s, d):
    c = _ordered(s, d)
    return rounded(c.select("id", theory.bulk_energy_density(F.col("s"), F.lit(-0.5), F.lit(1.0)).alias("energy")))


def activity(s, d):
    n = A.cells(s, d).groupBy("condition").agg(F.count("*").alias("n"))
    return rounded(n.select("condition", theory.activity(F.col("n").cast("double"), F.lit(1000.0), F.lit(0.1)).alias("zeta")))


def parameter_bundle_rows(s, d):
    return theory.parameter_bundle(theory.ldg_params(_ordered(s, d), 10.0), stencil.frank_grid(A.pixels(s, d)), stencil.grid_defects(A.pixels(s, d)), 1000.0)


def parameter_bundle(s, d):
    return rounded(parameter_bundle_rows(s, d).drop("json", "image_id"), 3)


def cell_nucleus_join(s, d):
    m = A.mask(s, d)
    every = m.where("label > 0").groupBy("image_id", "label").agg(F.avg("value").alias("value"))
    nuclei = labels.fit_ellipses(m.where("value > 50"))
    return rounded(labels.cells_with_nuclei(every, nuclei).select("label", "value", "nuclear_aspect_ratio"))


def field_sample(s, d):
    c = A.cells(s, d).select("image_id", "id", "x", "y")
    return rounded(labels.sampled(c, A.pixels(s, d), 11.0).select("id", "row", "col", "theta", "coherence"))


def pixel_read_write(s, d):
    p = A.pixels(s, d)
    put = p.where("value > 90").select("image_id", "row", "col", F.lit(0.0).alias("value"))
    return rounded(stencil.with_pixels(p.select("image_id", "row", "col", "value"), put).select("row", "col", "value"))


def close_pairs(s, d):
    p = pairs.close_pairs(A.cells(s, d), 8.0)
    return rounded(p.select("a_id", "b_id", "d"))


def neighbor_counts(s, d):
    """Delaunay neighbours of the cells of each condition: one task a condition.

    The cells lie on a lattice; they are moved a little so that no four of them are on one circle."""
    move = F.col("id") * F.col("id") % 1009 / 1e5
    p = A.cells(s, d).select(F.col("condition").alias("image_id"), "id", (F.col("x") + move).alias("x"), (F.col("y") - move).alias("y"))
    return mesh.neighbours(mesh.delaunay(p)).groupBy("image_id", "id").agg(F.count("*").alias("n_neighbours"))


def persistence(s, d):
    """Lower-star persistence of the pixel grid in bands of ten rows, one task a band."""
    p = A.pixels(s, d).withColumn("image_id", F.floor(F.col("row") / 10).cast("int")).withColumn("row", F.col("row") % 10)
    v = p.select("image_id", (F.col("row") * A.COLS + F.col("col")).cast("long").alias("id"), "value")
    return rounded(homology.lifetimes(homology.persistence(homology.lower_star(v, mesh.quads(p, A.COLS)))))


def streaming_order_batch(s, d):
    from ..streaming.axial import windowed_order

    e = A.table(s, d, "events").select("ts", "event_type", (F.col("value") - math.pi * F.floor(F.col("value") / math.pi)).alias("theta"))
    out = windowed_order(e, "1 hour", "10 minutes", ("event_type",))
    return rounded(out.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", "order"))


PX = "px AS (SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, value AS v, value - pi() * floor(value / pi()) AS t, value - floor(value) AS h FROM events)"
MK = f"{PX}, mk AS (SELECT *, CASE WHEN r % 10 IN (0, 9) OR c % 10 IN (0, 9) OR v <= 20 THEN 0 ELSE (r // 10) * 10 + c // 10 + 1 END::INT AS label FROM px)"
RG = """o AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity AS q FROM lineitem),
p AS (SELECT id, seq, n, q * cos(2.0e0 * pi() * (seq - 1) / n) AS x, q * sin(2.0e0 * pi() * (seq - 1) / n) AS y FROM o WHERE n >= 3),
e AS (SELECT a.*, b.x AS nx, b.y AS ny, b.x - a.x AS dx, b.y - a.y AS dy, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS len
  FROM p a JOIN p b ON a.id = b.id AND b.seq = a.seq % a.n + 1),
m AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY id),
f AS (SELECT p.id, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS rad, atan2(y - cy, x - cx) AS th FROM p JOIN m USING (id))"""
CE = """ce AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10.0e0 AS x, (c_custkey * 104729 % 10009) / 10.0e0 AS y,
  c_acctbal - pi() * floor(c_acctbal / pi()) AS t, c_mktsegment AS condition FROM customer)"""


def _q(name: str, digits: int = 6) -> str:
    return f"round({name}, {digits}) + 0.0"


def _wrap(x: str) -> str:
    return f"(({x}) - pi() * floor((({x}) + pi() / 2) / pi()))"


def _blur(sigma: float, cols: list[str], source: str, name: str) -> str:
    """CTEs that blur columns of `source` (r, c, ...) by rows of taps, ending in `name`."""
    k, w = f"k_{name}", math.ceil(4 * sigma)
    one, each = ", ".join(f"sum({x}) AS {x}" for x in cols), ", ".join(f"s.{x} * k.w AS {x}" for x in cols)
    return f"""{k} AS (SELECT d, exp(-d * d / {2 * sigma * sigma}e0) / sum(exp(-d * d / {2 * sigma * sigma}e0)) OVER () AS w FROM (SELECT unnest(range({-w}, {w + 1})) AS d)),
{name}_1 AS (SELECT r, c, {one} FROM (SELECT s.r, (s.c + k.d)::INT AS c, {each} FROM {source} s CROSS JOIN {k} k) WHERE c BETWEEN 0 AND 99 GROUP BY r, c),
{name} AS (SELECT r, c, {one} FROM (SELECT (s.r + k.d)::INT AS r, s.c, {each} FROM {name}_1 s CROSS JOIN {k} k) WHERE r BETWEEN 0 AND (SELECT max(r) FROM {source}) GROUP BY r, c)"""


SC = f"""{PX}, g1 AS (SELECT r, c, lead(v) OVER w - lag(v) OVER w AS d, 3 * lag(v) OVER w + 10 * v + 3 * lead(v) OVER w AS s FROM px WINDOW w AS (PARTITION BY r ORDER BY c)),
g AS (SELECT r, c, coalesce((3 * lag(d) OVER w + 10 * d + 3 * lead(d) OVER w) / 32, 0) AS gx, coalesce((lead(s) OVER w - lag(s) OVER w) / 32, 0) AS gy FROM g1 WINDOW w AS (PARTITION BY c ORDER BY r)),
j AS (SELECT r, c, gx * gx AS a, gx * gy AS b, gy * gy AS d FROM g)"""
EIG = "SELECT r, c, a, b, d, (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS l1, (a + d - sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS l2"
DEF = f"""{PX}, q AS (SELECT p.r, p.c, {_wrap("b.t - p.t")} + {_wrap("d.t - b.t")} - {_wrap("d.t - e.t")} - {_wrap("e.t - p.t")} AS w
  FROM px p JOIN px b ON b.r = p.r AND b.c = p.c + 1 JOIN px d ON d.r = p.r + 1 AND d.c = p.c + 1 JOIN px e ON e.r = p.r + 1 AND e.c = p.c),
df AS (SELECT r + 0.5e0 AS "row", c + 0.5e0 AS col, w AS winding, sign(w) / 2.0e0 AS charge FROM q WHERE abs(w) > pi() / 2)"""
TRI = f"""{PX}, cellz AS (SELECT r, c FROM px WHERE c < 99 AND r < (SELECT max(r) FROM px)),
tr AS (SELECT 2 * (r * 100 + c) AS id, r AS r0, c AS c0, r AS r1, c + 1 AS c1, r + 1 AS r2, c + 1 AS c2 FROM cellz
  UNION ALL SELECT 2 * (r * 100 + c) + 1, r, c, r + 1, c + 1, r + 1, c FROM cellz),
tg AS (SELECT id, c0::DOUBLE AS x0, r0::DOUBLE AS y0, c1::DOUBLE AS x1, r1::DOUBLE AS y1, c2::DOUBLE AS x2, r2::DOUBLE AS y2, a.t AS t0, b.t AS t1, z.t AS t2
  FROM tr JOIN px a ON a.r = r0 AND a.c = c0 JOIN px b ON b.r = r1 AND b.c = c1 JOIN px z ON z.r = r2 AND z.c = c2)"""
PAIR = f"{CE}, pr AS (SELECT a.id AS ai, b.id AS bi, a.x AS ax, a.y AS ay, a.t AS at_, b.t AS bt, a.x * 0.01e0 AS ax1, b.x * 0.01e0 AS bx1, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM ce a JOIN ce b ON a.id < b.id AND abs(a.x - b.x) <= 50 AND abs(a.y - b.y) <= 50)"
RNG = "(('0x' || substring(md5({}), 1, 12))::BIGINT / 281474976710656.0e0)"
BOOT = f"""{CE}, lo AS (SELECT min(x) AS x0, min(y) AS y0 FROM ce), bl AS (SELECT floor((x - x0) / 250) AS bx, floor((y - y0) / 250) AS by_, sum(t) AS s, count(*) AS n FROM ce, lo GROUP BY ALL),
nb AS (SELECT row_number() OVER (ORDER BY bx, by_) - 1 AS b, s, n FROM bl), dr AS (SELECT rep, slot, floor({RNG.format("'42:' || rep || ':' || slot")} * (SELECT count(*) FROM nb))::BIGINT AS b
  FROM (SELECT unnest(range(200)) AS rep), (SELECT unnest(range((SELECT count(*) FROM nb))) AS slot)),
st AS (SELECT rep, sum(s) / sum(n) AS statistic FROM dr JOIN nb USING (b) GROUP BY rep)"""
FRANK = f"""{PX}, fr AS (SELECT (cos(e.t) - cos(w.t)) / 2 + (sin(s.t) - sin(n.t)) / 2 AS sp, (sin(e.t) - sin(w.t)) / 2 - (cos(s.t) - cos(n.t)) / 2 AS be
  FROM px p JOIN px e ON e.r = p.r AND e.c = p.c + 1 JOIN px w ON w.r = p.r AND w.c = p.c - 1 JOIN px s ON s.c = p.c AND s.r = p.r + 1 JOIN px n ON n.c = p.c AND n.r = p.r - 1)"""
KAT = lambda k: f"sqrt(power(sum(len * cos({k} * atan2(dy, -dx))), 2) + power(sum(len * sin({k} * atan2(dy, -dx))), 2)) / sum(len)"
FOU = lambda k: f"sqrt(power(avg(rad * cos({k} * th)), 2) + power(avg(rad * sin({k} * th)), 2))"
ELL = lambda where: f"el AS (SELECT label, count(*) AS n_pixels, avg(r) AS cr, avg(c) AS cc, var_pop(r) AS a, covar_pop(r, c) AS b, var_pop(c) AS d FROM mk WHERE label > 0{where} GROUP BY label HAVING count(*) >= 3), ev AS (SELECT *, (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS l1, (a + d - sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS l2 FROM el)"
COH = "CASE WHEN l1 + l2 > 1e-15 THEN (l1 - l2) / (l1 + l2) ELSE 0 END"


def _tensor_sql() -> str:
    return f"""WITH {SC}, {_blur(1.0, ["a", "b", "d"], "j", "bl")}, ev AS ({EIG} FROM bl), tt AS (SELECT *, {COH} AS coh, 0.5e0 * atan2(2 * b, a - d) + pi() / 2 AS th FROM ev)
SELECT r AS "row", c AS col, {_q("l1", 5)} AS lambda1, {_q("l2", 5)} AS lambda2, {_q("coh", 5)} AS coherence, {_q("coh * cos(2 * th)", 5)} AS qx, {_q("coh * sin(2 * th)", 5)} AS qy FROM tt"""


def _scales_sql() -> str:
    parts, rows = [], []
    for i, s in enumerate((1.0, 2.0, 3.0)):
        parts += [_blur(s, ["a", "b", "d"], "j", f"b{i}"), f"e{i} AS ({EIG} FROM b{i})"]
        rows.append(f"SELECT r, c, {s}e0 AS sigma, {i} AS i, round({COH}, 5) AS coh FROM e{i}")
    return f"""WITH {SC}, {", ".join(parts)}, al AS ({" UNION ALL ".join(rows)}), rk AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY coh DESC, i) AS k FROM al)
SELECT r AS "row", c AS col, sigma AS optimal_sigma, coh + 0.0 AS max_coherence FROM rk WHERE k = 1"""


SQL = {
    "nematic_order": f"WITH {CE}, s AS (SELECT condition, count(*) AS n, avg(cos(2 * t)) AS x, avg(sin(2 * t)) AS y FROM ce GROUP BY condition) SELECT condition, n, {_q('sqrt(x * x + y * y)')} AS \"order\", {_q('x')} AS qx, {_q('y')} AS qy FROM s WHERE n >= 2",
    "shape_area_perimeter": f"WITH {RG} SELECT id AS contour_id, count(*) AS n_points, {_q('abs(0.5 * sum(x * ny - nx * y))')} AS area, {_q('sum(len)')} AS perimeter, {_q('0.5 * sum(x * ny - nx * y)')} AS signed_area FROM e GROUP BY id",
    "contour_centroid": f"WITH {RG} SELECT id AS contour_id, {_q('cx')} AS centroid_x, {_q('cy')} AS centroid_y FROM m",
    "w1_elongation": f"WITH {RG}, w AS (SELECT id, 0.5 * coalesce(sum(dy * dy / len), 0) AS a, -0.5 * coalesce(sum(dx * dy / len), 0) AS b, 0.5 * coalesce(sum(dx * dx / len), 0) AS d FROM e WHERE len >= 1e-15 GROUP BY id) SELECT id AS contour_id, {_q('a')} AS w1_xx, {_q('b')} AS w1_xy, {_q('d')} AS w1_yy, {_q('CASE WHEN a + d > 1e-15 THEN sqrt(power(a - d, 2) + 4 * b * b) / (a + d) ELSE 0 END')} AS elongation, {_q('CASE WHEN a + d > 1e-15 THEN (a - d) / (a + d) ELSE 0 END')} AS qx, {_q('CASE WHEN a + d > 1e-15 THEN 2 * b / (a + d) ELSE 0 END')} AS qy FROM w",
    "shape_index": f"WITH {RG}, w AS (SELECT id, abs(0.5 * sum(x * ny - nx * y)) AS a, sum(len) AS p FROM e GROUP BY id) SELECT id AS contour_id, {_q('CASE WHEN a < 1e-15 THEN 0 ELSE p / sqrt(a) END')} AS shape_index FROM w",
    "shape_katic_spectrum": f"WITH {RG} SELECT id AS contour_id, {', '.join(_q(KAT(k)) + f' AS q{k}' for k in (1, 2, 4, 6))} FROM e GROUP BY id",
    "fourier_spectrum": f"WITH {RG} SELECT id AS contour_id, {', '.join(_q(f'{FOU(k)} / avg(rad)') + f' AS a{k}' for k in (1, 2, 3, 4, 6))} FROM f GROUP BY id",
    "fourier_mode_2": f"WITH {RG} SELECT id AS contour_id, {_q(FOU(2))} AS amplitude, {_q('avg(rad * cos(2 * th))')} AS re FROM f GROUP BY id",
    "convexity": f"""WITH {RG}, h AS (SELECT a.id, 0.5 * abs(sum(a.x * b.y - b.x * a.y)) AS ha FROM p a JOIN p b ON a.id = b.id AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.id = a.id AND (z.x <> a.x OR z.y <> a.y) AND (z.x <> b.x OR z.y <> b.y) AND ((b.x - a.x) * (z.y - a.y) - (b.y - a.y) * (z.x - a.x) < -1e-9
   OR (abs((b.x - a.x) * (z.y - a.y) - (b.y - a.y) * (z.x - a.x)) <= 1e-9 AND ((z.x - a.x) * (z.x - b.x) + (z.y - a.y) * (z.y - b.y)) > 0))) GROUP BY a.id),
 s AS (SELECT id, abs(0.5 * sum(x * ny - nx * y)) AS ar FROM e GROUP BY id) SELECT id AS contour_id, {_q('ar')} AS area, {_q('ha')} AS hull_area, {_q('CASE WHEN ha < 1e-15 THEN 0 ELSE ar / ha END')} AS convexity FROM s JOIN h USING (id)""",
    "nuclear_ellipse": f"WITH {MK}, {ELL('')} SELECT label, n_pixels, {_q('cr')} AS centroid_row, {_q('cc')} AS centroid_col, {_q('2 * sqrt(l1)')} AS semi_major, {_q('2 * sqrt(l2)')} AS semi_minor, {_q('sqrt(l1) / sqrt(l2)')} AS aspect_ratio, {_q('a - d')} AS qx, {_q('2 * b')} AS qy FROM ev WHERE l2 >= 1e-15",
    "cell_orientation": f"WITH {MK}, o AS (SELECT label, sum(h * cos(2 * t)) AS x, sum(h * sin(2 * t)) AS y FROM mk WHERE label > 0 GROUP BY label) SELECT label, {_q('x / sqrt(x * x + y * y)', 5)} AS c2, {_q('y / sqrt(x * x + y * y)', 5)} AS s2 FROM o",
    "cell_mean_coherence": f"WITH {MK} SELECT label, {_q('avg(h)')} AS mean_coherence FROM mk WHERE label > 0 GROUP BY label",
    "mean_katic_order": f"WITH {MK} SELECT label, {', '.join(_q(f'sqrt(power(avg(h * cos({k} * t)), 2) + power(avg(h * sin({k} * t)), 2))') + f' AS psi{k}' for k in (1, 2, 4, 6))} FROM mk WHERE label > 0 GROUP BY label",
    "gaussian_blur": f"WITH {PX}, {_blur(1.0, ['v'], 'px', 'bl')} SELECT r AS \"row\", c AS col, {_q('v')} AS value FROM bl",
    "scharr": f"WITH {SC} SELECT r AS \"row\", c AS col, {_q('gx', 8)} AS gx, {_q('gy', 8)} AS gy FROM g",
    "structure_tensor": _tensor_sql(),
    "structure_tensor_relational": _tensor_sql(),
    "katic_order_field": f"WITH {PX} SELECT r AS \"row\", c AS col, {_q('h')} AS magnitude, {_q('h * cos(4 * t)')} AS re, {_q('h * sin(4 * t)')} AS im FROM px",
    "multiscale_optimal_scale": _scales_sql(),
    "percentile_normalise": f"WITH {PX}, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM px) SELECT r AS \"row\", c AS col, {_q('CASE WHEN hi > lo THEN least(1, greatest(0, (v - lo) / (hi - lo))) ELSE 0 END')} AS value FROM px, q",
    "grid_defects": f"WITH {DEF} SELECT \"row\", col, {_q('winding')} AS winding, {_q('charge')} AS charge FROM df",
    "poincare_hopf": f"WITH {DEF} SELECT {_q('sum(charge)')} AS total, {_q('abs(sum(charge) - 1)')} AS deviation, abs(sum(charge) - 1) < 0.1 AS valid FROM df",
    "director_frames": f"WITH {PX} SELECT r AS \"row\", c AS col, {_q('cos(t)')} AS f0, {_q('-sin(t)')} AS f1, 0.0e0 AS f2, {_q('sin(t)')} AS f3, {_q('cos(t)')} AS f4, 0.0e0 AS f5, 0.0e0 AS f6, 0.0e0 AS f7, 1.0e0 AS f8 FROM px",
    "frank_grid": f"WITH {FRANK} SELECT {_q('sum(sp * sp)', 4)} AS splay, {_q('sum(be * be)', 4)} AS bend, {_q('sum(sp * sp) / sum(be * be)', 4)} AS ratio FROM fr",
    "mesh_defects": f"WITH {TRI}, w AS (SELECT *, ({_wrap('t1 - t0')} + {_wrap('t2 - t1')} + {_wrap('t0 - t2')}) / pi() * sign((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS w FROM tg) SELECT id::BIGINT AS tri_id, {_q('(x0 + x1 + x2) / 3')} AS x, {_q('(y0 + y1 + y2) / 3')} AS y, round(w) + 0.0 AS winding, round(w) / 2 + 0.0 AS charge FROM w WHERE abs(w) > 0.3",
    "frank_mesh": f"""WITH {TRI}, u AS (SELECT *, t0 + {_wrap('t1 - t0')} AS a1, t0 + {_wrap('t2 - t0')} AS a2, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS det FROM tg),
 g AS (SELECT abs(det) / 2 AS ar, (t0 * (y1 - y2) + a1 * (y2 - y0) + a2 * (y0 - y1)) / det AS gx, (t0 * (x2 - x1) + a1 * (x0 - x2) + a2 * (x1 - x0)) / det AS gy, (t0 + a1 + a2) / 3 AS t FROM u),
 s AS (SELECT sum(power(-sin(t) * gx + cos(t) * gy, 2) * ar) AS sp, sum(power(cos(t) * gx + sin(t) * gy, 2) * ar) AS be, count(*) AS n FROM g) SELECT {_q('sp', 4)} AS splay, {_q('be', 4)} AS bend, {_q('sp / be', 4)} AS ratio, n AS n_triangles FROM s""",
    "orientational_correlation": f"WITH {PAIR}, b AS (SELECT floor(d / 2.5e0)::INT AS bin, avg(cos(2 * (at_ - bt))) AS g, count(*) AS n FROM pr WHERE d >= 1e-15 AND d < 50 GROUP BY 1) SELECT i::INT AS bin, (i + 0.5e0) * 2.5e0 AS r, {_q('coalesce(g, 0)')} AS g, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS i) LEFT JOIN b ON b.bin = i",
    "correlation_length": f"WITH {PAIR}, b AS (SELECT floor(d / 2.5e0) AS bin, avg(cos(2 * (ax1 - bx1))) AS g, count(*) AS n FROM pr WHERE d >= 1e-15 AND d < 50 GROUP BY 1), f AS (SELECT regr_slope(ln(g), (bin + 0.5e0) * 2.5e0) AS s, count(*) AS k FROM b WHERE g > 0.01 AND n >= 5) SELECT CASE WHEN k < 2 OR s IS NULL OR s >= 0 THEN 'inf'::DOUBLE ELSE {_q('-1 / s')} END AS xi FROM f",
    "ripley_k": f"WITH {PAIR}, w AS (SELECT d, 2 * CASE WHEN d < 1e-15 OR least(ax, 1000.7e0 - ax, ay, 1000.9e0 - ay) >= d THEN 1 ELSE 1 / greatest(least(ax, 1000.7e0 - ax, ay, 1000.9e0 - ay) / d, 0.25e0) END AS w FROM pr), k AS (SELECT r, coalesce(sum(w), 0) * 1000.7e0 * 1000.9e0 / power((SELECT count(*) FROM ce), 2) AS k FROM (SELECT unnest([10.0e0, 20.0e0, 30.0e0]) AS r) LEFT JOIN w ON d <= r GROUP BY r) SELECT r, {_q('k')} AS k, {_q('sqrt(k / pi()) - r')} AS l FROM k",
    "block_bootstrap": f"WITH {BOOT} SELECT rep, {_q('statistic')} AS statistic FROM st",
    "bootstrap_interval": f"WITH {BOOT}, o AS (SELECT statistic AS v, row_number() OVER (ORDER BY statistic) - 1 AS i FROM st) SELECT {_q('(SELECT v FROM o WHERE i = 5)')} AS low, {_q('(SELECT v FROM o WHERE i = 195)')} AS high",
    "permutation_test": f"""WITH p AS (SELECT event_id AS id, event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'view')), n AS (SELECT count(*) FILTER (g = 'click') AS na, avg(v) FILTER (g = 'click') - avg(v) FILTER (g = 'view') AS obs FROM p),
 d AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {RNG.format("'7:' || rep || ':' || id")}, id) AS k FROM p, (SELECT unnest(range(20)) AS rep)), s AS (SELECT rep, avg(v) FILTER (k <= na) - avg(v) FILTER (k > na) AS diff FROM d, n GROUP BY rep)
 SELECT {_q('obs')} AS observed, {_q('(count(*) FILTER (abs(diff) >= abs(obs)) + 1) / 21.0e0')} AS p_value, 20 AS n_permutations FROM s, n GROUP BY obs""",
    "ldg_params": f"WITH {CE}, m AS (SELECT condition, avg(power(cos(t), 2)) AS m FROM ce GROUP BY condition) SELECT condition, {_q('-2 * m')} AS a, 0.0e0 AS b, 1.0e0 AS c, {_q('power(3.45e0, 2) * 2 * m')} AS k_elastic FROM m",
    "bulk_energy": f"WITH {CE} SELECT id, {_q('-0.5e0 * power(cos(t), 2) + power(cos(t), 4)')} AS energy FROM ce",
    "activity": f"WITH {CE} SELECT condition, {_q('0.1e0 * count(*) / 1000')} AS zeta FROM ce GROUP BY condition",
    "parameter_bundle": f"WITH {FRANK}, {DEF[len(PX) + 2:]}, {CE}, m AS (SELECT avg(power(cos(t), 2)) AS m FROM ce), f AS (SELECT sum(sp * sp) AS sp, sum(be * be) AS be FROM fr), n AS (SELECT count(*) AS n FROM df) SELECT {_q('-2 * m', 3)} AS a_landau, 0.0e0 AS b_landau, 1.0e0 AS c_landau, {_q('200 * m', 3)} AS k_r, {_q('200 * m * n / 1000', 3)} AS zeta_eff, {_q('sp', 3)} AS frank_splay, {_q('be', 3)} AS frank_bend, {_q('sp / be', 3)} AS frank_ratio FROM m, f, n",
    "cell_nucleus_join": f"WITH {MK}, {ELL(' AND v > 50')}, a AS (SELECT label, avg(v) AS v FROM mk WHERE label > 0 GROUP BY label) SELECT a.label, {_q('a.v')} AS value, {_q('coalesce(sqrt(l1) / sqrt(l2), 0)')} AS nuclear_aspect_ratio FROM a LEFT JOIN (SELECT * FROM ev WHERE l2 >= 1e-15) x ON x.label = a.label",
    "field_sample": f"WITH {PX}, {CE}, s AS (SELECT id, least(greatest(floor(y / 11.0e0)::INT, 0), (SELECT max(r) FROM px)) AS r, least(greatest(floor(x / 11.0e0)::INT, 0), (SELECT max(c) FROM px)) AS c FROM ce) SELECT id, s.r AS \"row\", s.c AS col, {_q('px.t')} AS theta, {_q('h')} AS coherence FROM s JOIN px ON px.r = s.r AND px.c = s.c",
    "pixel_read_write": f"WITH {PX} SELECT r AS \"row\", c AS col, {_q('CASE WHEN v > 90 THEN 0 ELSE v END')} AS value FROM px",
    "close_pairs": f"WITH {PAIR} SELECT ai AS a_id, bi AS b_id, {_q('d')} AS d FROM pr WHERE d <= 8",
    "neighbor_counts": f"""WITH {CE}, mv AS (SELECT id, condition, x + (id * id % 1009) / 1e5 AS x, y - (id * id % 1009) / 1e5 AS y FROM ce),
 ed AS (SELECT a.condition AS image_id, a.id AS a, b.id AS b, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) AS dot
   FROM mv a JOIN mv b ON b.condition = a.condition AND a.id < b.id JOIN mv c ON c.condition = a.condition AND c.id <> a.id AND c.id <> b.id),
 de AS (SELECT image_id, a, b FROM ed GROUP BY ALL HAVING NOT bool_or(turn = 0 AND dot < 0) AND coalesce(max(CASE WHEN turn < 0 THEN dot / turn END), '-inf'::DOUBLE) <= coalesce(min(CASE WHEN turn > 0 THEN dot / turn END), 'inf'::DOUBLE))
 SELECT image_id, id, count(*) AS n_neighbours FROM (SELECT image_id, a AS id FROM de UNION ALL SELECT image_id, b FROM de) GROUP BY ALL""",
    "streaming_order_batch": f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, {_q('sqrt(power(avg(cos(2 * (value - pi() * floor(value / pi())))), 2) + power(avg(sin(2 * (value - pi() * floor(value / pi())))), 2))')} AS \"order\" FROM events GROUP BY ALL",
}

ROWS_ONLY = ("persistence",)
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
