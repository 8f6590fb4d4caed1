"""From pixels to everything an image gives: process(pixels, settings), lazily, for any number of images at once."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.operators import borders, contours, quantize, regions, render
from hueweave.settings import Settings
from hueweave.sources import sinks

log = logging.getLogger(__name__)


@dataclass
class Output:
    """DataFrames by image_id; metrics has one row for each image. What several of them need is persisted until release()."""

    palette: DataFrame
    svg: DataFrame
    facets: DataFrame
    stats: DataFrame
    neighbours: DataFrame
    paths: DataFrame
    labels: DataFrame
    colours: DataFrame
    quantized: DataFrame
    metrics: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()

    def stages(self) -> dict[str, DataFrame]:
        """Rasters of the stages: reduced colours, traced borders, smoothed borders, and these with labels."""
        traced = contours.loops(self.facets)
        traced = traced.select("image_id", F.concat("xs", F.slice("xs", 1, 1)).alias("xs"), F.concat("ys", F.slice("ys", 1, 1)).alias("ys"))
        return {
            "reduction": self.facets.join(self.colours, ["image_id", "color_index"]).select("image_id", "x", "y", "r", "g", "b"),
            "border_path": render.stage(self.facets, self.colours, traced),
            "border_segmentation": render.stage(self.facets, self.colours, self.paths),
            "label_placement": render.stage(self.facets, self.colours, self.paths, self.labels),
        }

    def rasterised(self) -> DataFrame:
        """The SVG's areas as pixels on white."""
        return render.painted(self.facets, render.filled(self.paths), self.stats, self.colours)

    def debug_json(self) -> DataFrame:
        """image_id, data: palette, SVG, facets, labels and metrics of each image as JSON."""
        entry = F.struct(F.col("color_index").alias("index"), F.array("r", "g", "b").alias("color"), "color_alias", "frequency", "area_percentage")
        palette = self.palette.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("palette"))
        facets = sinks.facets_json(self.stats, self.neighbours, self.labels)
        metrics = self.metrics.select("image_id", F.struct(*[c for c in self.metrics.columns if c != "image_id"]).alias("pipeline_stats"))
        all_ = palette.join(self.svg, "image_id", "left").join(facets, "image_id").join(metrics, "image_id")
        return all_.select("image_id", F.to_json(F.struct(*[c for c in all_.columns if c != "image_id"]), {"ignoreNullFields": "false", "pretty": "true"}).alias("data"))


def quantize_pixels(pixels: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Fitted colours and the indexed raster. Colour spaces other than RGB are taken as RGB."""
    if s.color_space.lower() != "rgb":
        log.warning("color space %s is taken as rgb", s.color_space)
    fitted = quantize.fit(quantize.histogram(pixels), s).persist(StorageLevel.DISK_ONLY)
    return fitted, quantize.indexed(pixels, fitted)


def process(pixels: DataFrame, s: Settings | None = None) -> Output:
    """pixels(image_id, x, y, r, g, b and perhaps a), dense; no pixels give no rows."""
    s = s or Settings()
    fitted, index = quantize_pixels(pixels, s)
    colours = quantize.palette(fitted)
    cleaned = regions.strip_cleanup(index, s.narrow_pixel_strip_cleanup_runs, counted=True).persist(StorageLevel.DISK_ONLY)
    facets = regions.facet_map(contours.reduced(cleaned, colours, s)).persist(StorageLevel.DISK_ONLY)
    stats = regions.facet_stats(facets)
    paths = borders.paths(facets, s.border_smoothing_passes).persist(StorageLevel.DISK_ONLY)
    labels = contours.labels(paths, stats)
    per_facet = paths.groupBy("image_id", "facet_id").agg(*[F.first(c).alias(c) for c in ("traced_points", "segments", "matched_segments", "reversed_segments")])
    before = regions.facet_map(cleaned).groupBy("image_id").agg((F.max("facet_id") + 1).alias("facets_before_reduction"))
    metrics = fitted.groupBy("image_id").agg(F.count("r").alias("original_unique_colors"), F.count(F.when(F.col("r").isNull(), 1)).alias("quantized_palette_size"), F.max("steps").alias("quantize_iterations"))
    metrics = metrics.join(cleaned.groupBy("image_id").agg(F.sum("changes").alias("narrow_cleanup_replaced_pixels")), "image_id").join(before, "image_id")
    metrics = metrics.join(stats.groupBy("image_id").agg(F.count("*").alias("facets_after_reduction")), "image_id")
    contour = per_facet.groupBy("image_id").agg(F.sum("traced_points").alias("contour_traced_path_points"), F.sum("segments").alias("contour_raw_segments"), F.sum("matched_segments").alias("contour_matched_segments"), F.sum("reversed_segments").alias("contour_reverse_segments"))
    return Output(
        palette=quantize.palette_stats(facets, colours, s.color_aliases),
        svg=render.svg(paths, stats, colours, s, labels),
        facets=facets,
        stats=stats,
        neighbours=regions.neighbour_lists(regions.adjacency(facets)),
        paths=paths,
        labels=labels,
        colours=colours,
        quantized=quantize.recoloured(pixels, index, colours),
        metrics=metrics.join(contour, "image_id", "left"),
        held=[fitted, cleaned, facets, paths],
    )
