"""Command line: python -m hueweave -i images -o out --format svg,palette.json,quantized.png,png"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hueweave import api
from hueweave.settings import Settings, load
from hueweave.sources import raster, sinks

log = logging.getLogger("hueweave")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("hueweave")
    p.add_argument("-i", "--input", required=True, help="an image, a folder or a pattern, in any store that Spark reads")
    p.add_argument("-o", "--output", required=True, help="a folder, or a file whose stem names the outputs")
    p.add_argument("-c", "--config", help="settings as JSON")
    p.add_argument("--format", default="svg,palette.json,quantized.png,png")
    p.add_argument("-k", "--kmeans-clusters", type=int)
    p.add_argument("--remove-facets-smaller-than", type=int)
    p.add_argument("--border-smoothing-passes", type=int)
    p.add_argument("--resize", action="store_true")
    p.add_argument("--no-resize", action="store_true")
    p.add_argument("--resize-max-width", type=int)
    p.add_argument("--resize-max-height", type=int)
    p.add_argument("--log-level", default="info", choices=["debug", "info", "warn", "error"])
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true")
    return p.parse_args(argv)


def settings(a: argparse.Namespace) -> Settings:
    """The file's settings, or defaults, also (with a warning) where there is no such file; what the command line names wins. A limit of size turns resizing on, --no-resize off."""
    there = a.config and Path(a.config).exists()
    if a.config and not there:
        log.warning("no settings at %s, defaults are taken", a.config)
    s = load(Path(a.config).read_text()) if there else Settings()
    named = {k: getattr(a, k) for k in ("kmeans_clusters", "remove_facets_smaller_than", "border_smoothing_passes", "resize_max_width", "resize_max_height") if getattr(a, k) is not None}
    if a.resize or a.resize_max_width is not None or a.resize_max_height is not None:
        named["resize_enabled"] = True
    if a.no_resize:
        named["resize_enabled"] = False
    return dataclasses.replace(s, **named)


def formats(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split(",")) if x]


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """All images of the input at once; a file for each format and image, named by image id where there are several."""
    s, began = settings(a), time.perf_counter()
    images = raster.image_files(spark, a.input, strict=True)
    if s.resize_enabled:
        images = raster.resized_images(images, s.resize_max_width, s.resize_max_height)
    else:
        images = images.withColumns({"original_width": F.col("width"), "original_height": F.col("height"), "resized": F.lit(False)})
    out = api.process(raster.rgba_pixels(images), s)
    folder, stem = sinks.place(a.output)
    numbered = images.select("image_id").limit(2).count() > 1
    for f in formats(a.format):
        if f == "svg":
            data = out.svg.withColumnRenamed("svg", "data")
        elif f == "palette.json":
            data = sinks.palette_json(out.palette)
        elif f in ("quantized.png", "quantized.jpg"):
            data = (sinks.png if f.endswith("png") else sinks.jpeg)(out.quantized)
        elif f in ("png", "jpg"):
            data = (sinks.png if f == "png" else sinks.jpeg)(out.rasterised())
        elif f == "debug.json":
            data = out.debug_json()
        elif f == "profile.json":
            row = images.select("image_id", "original_width", "original_height", "width", "height", "resized").join(out.metrics, "image_id").join(out.svg.select("image_id", F.octet_length("svg").alias("svg_bytes")), "image_id", "left")
            row = row.withColumns({"input": F.lit(a.input), "output": F.lit(a.output), "requested_formats": F.lit(formats(a.format)), "total_ms": F.lit(round(1000 * (time.perf_counter() - began)))})
            data = row.select("image_id", F.to_json(F.struct(*[c for c in row.columns if c != "image_id"]), {"pretty": "true"}).alias("data"))
        else:
            log.warning("format %s is not known, skipped", f)
            continue
        sinks.write_files(data, folder, stem, f, numbered)
        log.info("wrote %s", f)
    out.release()


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    level = "error" if a.quiet else "debug" if a.verbose else a.log_level
    logging.basicConfig(format="%(levelname)s %(message)s")
    log.setLevel({"warn": "WARNING"}.get(level, level.upper()))
    run(SparkSession.builder.appName("hueweave").getOrCreate(), a)


if __name__ == "__main__":
    main()
