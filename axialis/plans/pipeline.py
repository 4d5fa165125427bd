"""The whole analysis of many images at once, and comparisons of conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import homology, labels, mesh, pairs, resample, ring, segment, stencil, theory
from ..sources import tiff


@dataclass
class AnalysisResult:
    """Frames keyed by image_id."""

    cells: DataFrame
    fields: DataFrame
    defects: DataFrame
    correlation: DataFrame
    frank: DataFrame
    parameters: DataFrame
    persistence: DataFrame
    scales: tuple[float, ...] = field(default=stencil.SCALES)
    kept: tuple[DataFrame, ...] = ()

    def summary(self) -> DataFrame:
        return tiff.summary(self.cells, self.defects, self.frank)

    def release(self) -> None:
        """Frees the frames that were kept; the result's frames are then made anew when used."""
        for df in self.kept:
            df.unpersist()


def analyze_fields(nuclei_image: DataFrame, body_image: DataFrame, pixel_size: float, k_values=(1, 2, 4, 6), scales=stencil.SCALES, model=segment.threshold_labels, n_bins: int = 20, parity: bool = False) -> AnalysisResult:
    """Segmentation, shape, orientation, defects, correlation and parameters of the images in two channels.

    The pixel size has no default: published values of one instrument differ by a factor of two. Cells are correlated by
    the field's angle at their centroid's pixel; an image of fewer than three cells has no bins and an infinite length.
    With parity=True the order parameter is the elongation and the correlation length is scaled by the pixel size once
    more, as in the surveyed pipeline. `persistence` is that of psi2 over the Delaunay mesh of the cells."""
    nuclei = segment.segment_nuclei(nuclei_image, model).persist()
    bodies = segment.segment_cell_bodies(body_image, nuclei).persist()
    outlines = segment.extract_contours(bodies, pixel_size).withColumn("contour_id", F.struct("image_id", "label"))
    shapes = ring.analyze_shapes(outlines).select("contour_id.image_id", "contour_id.label", "area", "perimeter", "centroid_x", "centroid_y", "elongation", "elongation_angle", "shape_index", "convexity", "shape_katic", "fourier")
    multi = stencil.multiscale_structure_tensor(body_image, tuple(scales)).persist()
    best = stencil.optimal_scale(multi)
    middle = multi.where(F.col("scale_idx") == len(scales) // 2)
    fields_ = middle.join(best, ["image_id", "row", "col"]).persist()
    labelled = fields_.join(bodies, ["image_id", "row", "col"])
    cells = labels.cells_with_nuclei(shapes, labels.fit_ellipses(nuclei))
    cells = cells.join(labels.cell_orientations(labelled), ["image_id", "label"], "left").join(labels.cell_mean_coherence(labelled), ["image_id", "label"], "left")
    orders = tuple(dict.fromkeys((*k_values, 2)))
    cells = cells.join(labels.mean_katic_orders(labelled.where("label > 0"), orders, "image_id", "label"), ["image_id", "label"], "left")
    cells = labels.cell_records(cells).persist()
    defects = stencil.grid_defects(fields_, 2)
    size = body_image.groupBy("image_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    largest = size.agg(F.max(F.greatest("h", "w"))).first()[0] or 1
    points = cells.select("image_id", F.col("label").cast("long").alias("id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), "psi2")
    enough = points.groupBy("image_id").agg(F.count("*").alias("n")).where("n >= 3").select("image_id")
    placed = labels.sampled(points.join(enough, "image_id"), fields_, pixel_size, ("theta",))
    bins = pairs.orientational_correlation(placed, 2, 0.5 * largest * pixel_size, n_bins)
    frank = stencil.frank_grid(fields_, pixel_size)
    images = size.select("image_id")
    xi = images.join(pairs.correlation_length(bins), "image_id", "left").withColumn("xi", F.coalesce("xi", F.lit(float("inf"))) * F.lit(pixel_size if parity else 1.0))
    ldg = images.join(theory.ldg_params(cells, 1.0, 1.0, "elongation" if parity else "psi2"), "image_id", "left").fillna(0.0)
    ldg = ldg.join(xi, "image_id").withColumn("k_elastic", F.when(F.col("a") == 0, 0.0).otherwise(F.col("xi") * F.col("xi") * F.abs("a")))
    area = size.select("image_id", (F.col("h") * F.col("w") * pixel_size**2).alias("area"))
    bundle = theory.parameter_bundle(ldg.drop("xi"), frank, defects, 1.0).join(area, "image_id")
    bundle = bundle.withColumn("zeta_eff", theory.activity(F.col("zeta_eff"), F.col("area"), F.lit(1.0))).drop("json")
    bundle = bundle.withColumn("json", theory.params_json(bundle))
    mesh_ = mesh.delaunay(points)
    rises = homology.persistence(homology.lower_star(points.select("image_id", "id", F.col("psi2").alias("value")), mesh_))
    return AnalysisResult(cells, fields_, defects, bins, frank, bundle, rises, tuple(scales), (nuclei, bodies, multi, fields_, cells))


def analyze(spark: SparkSession, folder: str, pixel_size: float, channels: dict[str, int] | None = None, **how) -> AnalysisResult:
    """All TIFF images of a folder."""
    images = tiff.load_tiffs(spark, folder, channels)
    return analyze_fields(images["dapi"], images["vimentin"], pixel_size, **how)


@dataclass
class Experiment:
    """Folders by condition, all images analysed as one table."""

    spark: SparkSession
    pixel_size: float
    conditions: dict[str, str] = field(default_factory=dict)

    def add_condition(self, name: str, folder: str) -> Experiment:
        self.conditions[name] = folder
        return self

    def run(self, channels: dict[str, int] | None = None, **how) -> ComparisonResult:
        images: dict[str, DataFrame] = {}
        named = None
        for name, folder in self.conditions.items():
            own = tiff.discover_tiffs(self.spark, folder).select(F.col("path").alias("image_id"), F.lit(name).alias("condition"))
            named = own if named is None else named.unionByName(own)
            for channel, part in tiff.load_tiffs(self.spark, folder, channels).items():
                images[channel] = part if channel not in images else images[channel].unionByName(part)
        if named is None:
            raise ValueError("an experiment needs a condition")
        return compare_fields(images["dapi"], images["vimentin"], named, self.pixel_size, **how)


def compare_fields(nuclei_image: DataFrame, body_image: DataFrame, conditions: DataFrame, pixel_size: float, **how) -> ComparisonResult:
    """The analysis of the images of all conditions; `conditions` has image_id and condition."""
    return ComparisonResult(analyze_fields(nuclei_image, body_image, pixel_size, **how), conditions)


@dataclass
class ComparisonResult:
    result: AnalysisResult
    conditions: DataFrame

    def cells(self) -> DataFrame:
        """All cells with their condition."""
        return self.result.cells.join(self.conditions, "image_id")

    def report(self, folder: str) -> DataFrame:
        """Writes summary.json; returns condition, n_images, summaries."""
        return tiff.write_report(self.conditions.join(self.result.summary(), "image_id", "left"), folder)

    def compare(self, a: str, b: str, column: str, n: int = 999, seed: int = 42, statistic=resample.mean_difference) -> DataFrame:
        """Permutation test of one cell column between two conditions."""
        rows = self.cells().select(F.concat_ws("/", "condition", "image_id", "label").alias("id"), F.col("condition").alias("grp"), F.col(column).alias("value"))
        return resample.permutation_test(rows, a, b, n, seed, statistic)
