"""Colours to a palette: histogram, deterministic weighted k-means on it, and what pixels become."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hueweave.functions.colour import chop
from hueweave.settings import Settings

STEPS = 32


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, r, g, b, weight by colour of six bits a channel; at most 262,144 rows an image."""
    return pixels.groupBy("image_id", *[chop(F.col(c)).alias(c) for c in "rgb"]).agg(F.count("*").alias("weight"))


def samples(hist: DataFrame) -> DataFrame:
    nth = Window.partitionBy("image_id").orderBy("r", "g", "b")
    return hist.withColumn("sample_idx", (F.row_number().over(nth) - 1).cast("int"))


def seeds(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> list[int]:
    """The sample that the seed names, then again and again the one of most weight times squared distance to the nearest chosen; ties to the first."""
    chosen, near = [seed % len(points)], np.full(len(points), np.inf)
    while len(chosen) < k:
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int((near * weight).argmax()))
    return chosen


def cluster(points: np.ndarray, weight: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Assignments, palette and steps. The last assignments belong to the centroids before the last update, which the palette has."""
    k = max(1, min(s.kmeans_clusters, len(points)))
    centre = points[seeds(points, weight, k, s.random_seed)].astype(np.float64)
    for step in range(1, STEPS + 1):
        which = ((points[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.bincount(which, weight, k)
        mean = np.stack([np.bincount(which, points[:, c] * weight, k) for c in range(3)], 1)
        used = total > 0
        after = centre.copy()
        after[used] = mean[used] / total[used, None]
        moved = np.sqrt(((after - centre) ** 2).sum(axis=1)).sum()
        centre = after
        if moved <= s.kmeans_min_delta:
            break
    palette = np.clip(np.floor(centre + 0.5), 0, 255).astype(np.int64)
    if s.color_restrictions:
        allowed = np.array(s.color_restrictions)
        palette = allowed[((palette[:, None] - allowed[None]) ** 2).sum(axis=2).argmin(axis=1)]
    return which, palette, step


def fit(hist: DataFrame, s: Settings) -> DataFrame:
    """Per image, a row for each colour of the histogram with its color_index and that index's palette colour, and one for each palette entry
    (r null). An image is one group, of its histogram only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "g", "b"])
        which, palette, steps = cluster(rows[["r", "g", "b"]].to_numpy(np.float64), rows["weight"].to_numpy(np.float64), s)
        own = pd.DataFrame({"image_id": rows["image_id"].to_numpy(), "r": rows["r"].to_numpy(), "g": rows["g"].to_numpy(), "b": rows["b"].to_numpy(), "color_index": which})
        entries = pd.DataFrame({"image_id": rows["image_id"].iloc[0], "r": None, "g": None, "b": None, "color_index": np.arange(len(palette))})
        out = pd.concat([own.astype(object), entries.astype(object)], ignore_index=True)
        p = palette[out["color_index"].to_numpy(np.int64)]
        return out.assign(pr=p[:, 0], pg=p[:, 1], pb=p[:, 2], steps=steps)

    return hist.groupBy("image_id").applyInPandas(run, "image_id long, r int, g int, b int, color_index int, pr int, pg int, pb int, steps int")


def palette(fitted: DataFrame) -> DataFrame:
    return fitted.filter("r is null").select("image_id", "color_index", F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"))


def indexed(pixels: DataFrame, fitted: DataFrame) -> DataFrame:
    """image_id, x, y, color_index: an equi-join on the colour of six bits."""
    own = fitted.filter("r is not null").select("image_id", *[F.col(c).alias(f"q{c}") for c in "rgb"], "color_index")
    px = pixels.select("image_id", "x", "y", *[chop(F.col(c)).alias(f"q{c}") for c in "rgb"])
    return px.join(own, ["image_id", "qr", "qg", "qb"]).select("image_id", "x", "y", "color_index")


def recoloured(pixels: DataFrame, index: DataFrame, colours: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b, a: pixels in their palette colours; their own alpha stays, or is 255."""
    own = pixels.select("image_id", "x", "y", F.col("a") if "a" in pixels.columns else F.lit(255).alias("a"))
    return index.join(own, ["image_id", "x", "y"]).join(colours, ["image_id", "color_index"]).select("image_id", "x", "y", "r", "g", "b", "a")


def palette_stats(index: DataFrame, colours: DataFrame, aliases: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """image_id, color_index, r, g, b, color_alias, frequency, area_percentage (a share of 1); unused entries stay."""
    n = index.groupBy("image_id", "color_index").agg(F.count("*").alias("n"))
    all_ = F.greatest(F.lit(1), F.sum("frequency").over(Window.partitionBy("image_id")))
    out = colours.join(n, ["image_id", "color_index"], "left").withColumn("frequency", F.coalesce("n", F.lit(0))).drop("n")
    alias = F.lit(None).cast("string")
    for name, c in sorted((aliases or {}).items(), reverse=True):
        alias = F.when((F.col("r") == c[0]) & (F.col("g") == c[1]) & (F.col("b") == c[2]), F.lit(name)).otherwise(alias)
    return out.withColumns({"color_alias": alias, "area_percentage": F.col("frequency") / all_})


def nearest_of(hist: DataFrame, centres: list[tuple[float, float, float]]) -> DataFrame:
    """Each colour's nearest centre, ties to the first."""
    d = [F.struct(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", p, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("k")) for i, p in enumerate(centres)]
    return hist.withColumn("color_index", F.array_min(F.array(*d))["k"])
