"""TIFF variants, hulls, persistence of components and whole analyses."""

import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest

from axialis.operators import homology, ring, stencil
from axialis.plans import adapters as A
from axialis.plans import image_queries
from axialis.plans.pipeline import analyze_fields
from axialis.sources import tiff


def lzw(data: bytes) -> bytes:
    """A plain encoder: clear, codes, end."""
    table, codes, word, width = {bytes([k]): k for k in range(256)}, [(256, 9)], b"", 9
    following = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            codes.append((256, width))
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        word = data[k : k + 1]
    if word:
        codes.append((table[word], width))
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 2:
            out += bytes([257 - n, data[at]])
            at += n
        else:
            n = min(128, len(data) - at, 5)
            out += bytes([n - 1]) + data[at : at + n]
            at += n
    return bytes(out + b"\x80")


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: packbits}


def tiff_of(image, order="<", big=False, packed=1, tile=None, strip=7, predictor=1, planar=1):
    """A file of one image, (rows, cols) or (rows, cols, samples)."""
    kind = image.dtype.newbyteorder(order)
    deep = image if image.ndim == 3 else image[:, :, None]
    h, w, samples = deep.shape
    planes = [deep[:, :, k : k + 1] for k in range(samples)] if planar == 2 else [deep]
    parts = []
    for plane in planes:
        th, tw = tile or (strip, w)
        for r in range(0, h, th):
            for c in range(0, w, tw):
                part = plane[r : r + th, c : c + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                parts.append(PACK[packed](np.ascontiguousarray(part).astype(kind).tobytes()))
    body = b"".join(parts)
    head = 16 if big else 8
    offsets = [head + sum(map(len, parts[:k])) for k in range(len(parts))]
    code = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = {256: w, 257: h, 258: 8 * image.dtype.itemsize, 259: packed, 277: samples, 284: planar, 317: predictor, 339: code}
    tags |= {322: tile[1], 323: tile[0], 324: offsets, 325: list(map(len, parts))} if tile else {278: strip, 273: offsets, 279: list(map(len, parts))}
    many, inline = ("Q", 8) if big else ("I", 4)
    extra, at = b"", head + len(body)
    entries = []
    for tag, value in sorted(tags.items()):
        values = value if isinstance(value, list) else [value]
        kind_ = 16 if big else 4
        data = struct.pack(order + many * len(values), *values)
        if len(data) > inline:
            data, extra = struct.pack(order + many, at + len(extra)), extra + data
        entries.append(struct.pack(order + "HH" + many, tag, kind_, len(values)) + data)
    where = at + len(extra)
    count = struct.pack(order + ("Q" if big else "H"), len(entries))
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, where) if big else struct.pack(order + "HI", 42, where))
    return start + body + extra + count + b"".join(entries) + struct.pack(order + many, 0)


@pytest.mark.parametrize("packed", list(PACK))
def test_tiff_variants(packed):
    rng = np.random.default_rng(packed)
    for image in (rng.integers(0, 60_000, (53, 41)).astype("uint16"), np.tile(np.arange(300, dtype="int32") // 9, (90, 1)), rng.random((20, 30)).astype("float32"), rng.integers(0, 4, (200, 200)).astype("uint8")):
        for order in "<>":
            for tile in (None, (16, 32)):
                for predictor in (1, 2) if image.dtype.kind != "f" else (1,):
                    (got,) = tiff.pages(tiff_of(image, order, order == ">", packed, tile, predictor=predictor))
                    assert got.shape == image.shape and (got == image).all()


def test_tiff_samples():
    image = np.random.default_rng(0).integers(0, 255, (19, 23, 3)).astype("uint8")
    for planar in (1, 2):
        for tile in (None, (16, 16)):
            (got,) = tiff.pages(tiff_of(image, planar=planar, tile=tile, predictor=2))
            assert (got == image).all()
    with pytest.raises(ValueError):
        tiff.pages(tiff_of(image).replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7)))
    with pytest.raises(ValueError):
        tiff.pages(b"no image at all")


def test_written_tiffs_hold_all_values(spark, tmp_path):
    rows = [("a", 0, 65535), ("b", 0, 65536), ("c", -1, 65535), ("d", -5, 5), ("e", 0, 3 * 10**9), ("f", -(2**40), 2**50)]
    images = spark.createDataFrame([(f"{n}.tif", 0, k, int(v)) for n, *both in rows for k, v in enumerate(both)], "image_id string, row int, col int, value long")
    written = {r["image_id"][0]: r["length"] for r in tiff.write_tiffs(images, str(tmp_path), ("value",)).collect()}
    assert written["a"] == written["d"] == 8 + 2 * 2 + 2 + 9 * 12 + 4
    got = tiff.load_tiffs(spark, str(tmp_path), {"x": 0}, normalise=False)["x"].selectExpr("substr(image_id, -5, 1) AS n", "col", "value").collect()
    assert sorted(map(tuple, got)) == sorted((n, k, float(v)) for n, *both in rows for k, v in enumerate(both))
    with pytest.raises(Exception, match="without value"):
        tiff.write_tiffs(images.withColumn("value", A.F.when(images["col"] == 0, images["value"])), str(tmp_path / "missing"), ("value",))


def test_tiff_channels_of_bright_pixels(spark, tmp_path):
    """Values of 655.36 and more take over 16 bits once they are multiplied by 100."""
    e = spark.range(1000).selectExpr("id AS event_id", "CASE id WHEN 3 THEN 655.36D WHEN 500 THEN 30000000.25D WHEN 999 THEN -3.5D ELSE id % 70 / 4D END AS value")
    e.write.parquet(str(tmp_path / "events.parquet"))
    sql = image_queries.SQL["tiff_channels"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = image_queries.tiff_channels(spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = duckdb.sql(f"SELECT {columns} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r["length"] for r in image_queries.tiff_discovery(spark, str(tmp_path)).collect()} == {4236}


def hull_by_hand(points):
    ring_ = sorted(set(points))

    def half(row):
        out = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(ring_) + half(ring_[::-1])
    return 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True)))


def test_hulls(spark):
    rng = random.Random(3)
    shapes = [[(rng.gauss(0, 9), rng.gauss(0, 9)) for _ in range(rng.randint(3, 60))] for _ in range(60)]
    shapes += [[(float(rng.randint(0, 4)), float(rng.randint(0, 4))) for _ in range(rng.randint(3, 30))] for _ in range(60)]
    shapes += [[(float(k), float(k)) for k in range(9)], [(1.0, 1.0)] * 5, [(2.0, float(k)) for k in range(4)]]
    rows = [(k, i, x, y) for k, s in enumerate(shapes) for i, (x, y) in enumerate(s)]
    got = {r["contour_id"]: r["hull_area"] for r in ring.convexity(spark.createDataFrame(rows, "contour_id int, seq int, x double, y double")).collect()}
    assert got == pytest.approx({k: hull_by_hand(s) for k, s in enumerate(shapes)}, abs=1e-9)


def test_components_die_as_in_the_reduction():
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        values = {k: float(rng.randint(0, 9)) for k in range(n)}
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)} if n > 1 else set()
        edges = [(max(values[a], values[b]), a, b) for a, b in sorted(pairs)]
        simplices = [(f, 0, (v,)) for v, f in values.items()] + [(f, 1, (a, b)) for f, a, b in edges]
        assert sorted(homology.merged(values, edges)) == sorted(x for x in homology.reduced(simplices) if x[2] == 0)


def test_components_in_blocks(spark):
    rng, n = random.Random(9), 24
    rows, want, whole = [], [], []
    for image in (0, 1):
        ids = list(range(n * n)) if image == 0 else rng.sample(range(10**12), n * n)  # neighbours near by number, or not
        values = [float(rng.randint(0, 40)) for _ in ids]
        edges = [(k, k + step) for k in range(n * n) for step, ok in ((1, k % n < n - 1), (n, k < n * n - n), (n + 1, k % n < n - 1 and k < n * n - n)) if ok]
        simplices = [(f, 0, (v,)) for v, f in zip(ids, values, strict=True)] + [(max(values[a], values[b]), 1, (ids[a], ids[b])) for a, b in edges]
        rows += [(image, dim, v[0], v[1] if dim else None, f) for f, dim, v in simplices]
        want += [(image, *x) for x in homology.reduced(simplices) if x[2] == 0]
        whole.append(len(simplices))
    frame = spark.createDataFrame(rows, "image_id int, dim int, v0 long, v1 long, filt double")
    for blocks in ((48, 192), (1,), ()):
        assert sorted(map(tuple, homology.persistence_of_components(frame, blocks).collect())) == sorted(want)
    parts = frame.selectExpr("image_id", "dim AS kind", "v0", "coalesce(v1, v0) AS v1", "filt AS x", "0D AS y").where("image_id = 0")
    left = homology._settled_blocks(parts, 192).where(A.F.col("kind") != homology.DONE).count()
    assert left < whole[0] / 3  # the task that gets a whole image gets what blocks leave


def test_images_without_defects(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    defects = spark.createDataFrame([(1, 0.5), (1, 0.5)], "image_id int, charge double")
    got = {r["image_id"]: (r["total"], r["valid"]) for r in stencil.poincare_hopf(defects, 1.0, images=images).collect()}
    assert got == {1: (1.0, True), 2: (0.0, False)}


def test_analysis_of_few_cells(spark, sf_dir):
    nuclei, body = A.slide_pixels(spark, sf_dir)
    two = nuclei.where("image_id = 1").withColumn("value", A.F.when(nuclei["col"] < 48, nuclei["value"]).otherwise(0.0))
    got = analyze_fields(two, body.where("image_id = 1"), 0.5, scales=(1.0, 2.0))
    assert got.cells.count() == 2 and got.correlation.count() == 0
    assert got.parameters.first()["k_r"] == math.inf and got.persistence.count() == 2
    got.release()
    whole = [analyze_fields(nuclei.where("image_id = 1"), body.where("image_id = 1"), 0.5, scales=(1.0, 2.0), parity=p) for p in (False, True)]
    assert whole[0].cells.count() == 4 and whole[0].correlation.count() == 20 and whole[0].persistence.where("dim = 0").count() >= 1
    a = [r.parameters.first()["a_landau"] for r in whole]
    cells = whole[0].cells.agg(A.F.avg(A.F.col("psi2") ** 2), A.F.avg(A.F.col("elongation") ** 2)).first()
    assert a == pytest.approx([-2 * cells[0], -2 * cells[1]])
