"""Pixels: from image bytes, from RGBA buffers, and from the events table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.functions.colour import resized

#: Tiles of 50 columns, 2,500 pixels each; blocks of 5 by 5 share the colour of their first event, but for one event in ten or so.
EVENT_PIXELS = """
WITH e AS (
  SELECT event_id, user_id, CAST(floor(value) AS INT) AS v,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 60 WHEN 'purchase' THEN 120 WHEN 'signup' THEN 180 ELSE 240 END AS t,
    CAST(floor(event_id / 2500) AS BIGINT) AS image_id, CAST(event_id % 50 AS INT) AS x, CAST(floor((event_id % 2500) / 50) AS INT) AS y
  FROM events),
p AS (
  SELECT *, CASE WHEN user_id % 10 = 0 THEN event_id ELSE CAST(image_id * 2500 + (y - y % 5) * 50 + (x - x % 5) AS BIGINT) END AS src FROM e)
SELECT p.image_id, p.x, p.y, CAST((a.user_id * 53) % 256 AS INT) AS r, CAST(a.v % 256 AS INT) AS g, a.t AS b
FROM p JOIN e a ON a.event_id = p.src"""


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_PIXELS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def checked(images: DataFrame) -> DataFrame:
    """images(image_id, width, height, rgba); an empty image or a wrong length raises."""
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    fits = F.length("rgba") == F.col("width") * F.col("height") * 4
    return images.withColumn("rgba", F.when(~ok, F.raise_error("EmptyImage").cast("binary")).when(~fits, F.raise_error("InvalidRgbaLength").cast("binary")).otherwise(F.col("rgba")))


def rgba_pixels(images: DataFrame) -> DataFrame:
    """A row per pixel of checked images: image_id, x, y, r, g, b, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                px = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int32)
                at = np.arange(len(px))
                yield pa.record_batch([pa.array(np.full(len(px), i, np.int64)), pa.array((at % w).astype(np.int32)), pa.array((at // w).astype(np.int32)), *(pa.array(px[:, c]) for c in range(4))], names=["image_id", "x", "y", "r", "g", "b", "a"])

    cols = checked(images).select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "rgba")
    return cols.mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int")


def image_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """images(image_id, width, height, rgba) from files that the image source decodes; ids by path. See decoded."""
    return decoded(spark.read.format("image").load(path), strict)


def decoded(files: DataFrame, strict: bool = False) -> DataFrame:
    """images of rows of the image source; files that do not decode to 1, 3 or 4 channels go, or, if strict, raise with their path."""
    fits = F.col("nChannels").isin(1, 3, 4)
    refused = F.raise_error(F.concat(F.lit("UndecodableImage: "), F.col("origin"))).cast("boolean") if strict else F.lit(False)
    raw = files.select("image.*").filter(F.when(fits, True).otherwise(refused))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, w, h, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h * w, n)
                rgb = np.repeat(px, 3, axis=1) if n == 1 else px[:, [2, 1, 0]]
                out.append(np.concatenate([rgb, px[:, 3:4] if n == 4 else np.full((h * w, 1), 255, np.uint8)], 1).tobytes())
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(out, pa.binary())], names=["image_id", "width", "height", "rgba"])

    own = raw.select(F.xxhash64("origin").alias("image_id"), "nChannels", "width", "height", "data")
    return own.mapInArrow(run, "image_id long, width int, height int, rgba binary")


def lanczos(size: int, to: int) -> np.ndarray:
    """to x size weights of a Lanczos filter of three lobes, as wide as the reduction needs; rows sum to one."""
    ratio = size / to
    x = (np.arange(size)[None] + 0.5 - (np.arange(to)[:, None] + 0.5) * ratio) / max(ratio, 1.0)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized_images(images: DataFrame, max_width: int, max_height: int) -> DataFrame:
    """images made to fit the limits, with original_width, original_height and resized; smaller ones stay as they are."""
    w, h = resized(F.col("width"), F.col("height"), max_width, max_height)
    cols = checked(images).select(F.col("image_id").cast("long"), w.alias("width"), h.alias("height"), "rgba", F.col("width").cast("int").alias("original_width"), F.col("height").cast("int").alias("original_height"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for to_w, to_h, raw, w, h in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if (to_w, to_h) != (w, h):
                    px = np.frombuffer(raw, np.uint8).reshape(h, w, 4).astype(np.float32)
                    px = np.einsum("ah,hwc->awc", lanczos(h, to_h).astype(np.float32), px, optimize=True)
                    px = np.einsum("bw,awc->abc", lanczos(w, to_w).astype(np.float32), px, optimize=True)
                    raw = np.floor(np.clip(px, 0, 255) + 0.5).astype(np.uint8).tobytes()
                out.append(raw)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary()), b.column(4), b.column(5)], names=["image_id", "width", "height", "rgba", "original_width", "original_height"])

    out = cols.mapInArrow(run, "image_id long, width int, height int, rgba binary, original_width int, original_height int")
    return out.withColumn("resized", (F.col("width") != F.col("original_width")) | (F.col("height") != F.col("original_height")))
