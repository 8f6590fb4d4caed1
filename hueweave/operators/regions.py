"""Facets: cleanup of narrow strips, connected components, borders, neighbours and boundary steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(px: DataFrame, value: str) -> DataFrame:
    """px with the value of the left, up, right and down neighbour, null beyond the canvas. One deal by image serves all windows."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    return px.repartition("image_id").withColumns({"left": F.lag(value).over(row), "right": F.lead(value).over(row), "up": F.lag(value).over(column), "down": F.lead(value).over(column)})


def strip_cleanup(index: DataFrame, runs: int, counted: bool = False) -> DataFrame:
    """Pixels that differ from both vertical neighbours take the upper's colour, else from both horizontal ones the left's; interior ones only, from a snapshot each run.

    counted: with `changes`, how often a pixel changed."""
    index = index.withColumn("changes", F.lit(0))
    for _ in range(runs):
        c, a = F.col("color_index"), around(index, "color_index")
        inner = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("up").isNotNull() & F.col("down").isNotNull()
        new = F.when(inner & (c != F.col("up")) & (c != F.col("down")), F.col("up")).when(inner & (c != F.col("left")) & (c != F.col("right")), F.col("left")).otherwise(c)
        index = a.select("image_id", "x", "y", new.alias("color_index"), (F.col("changes") + (new != c).cast("int")).alias("changes"))
    return index if counted else index.select("image_id", "x", "y", "color_index")


def label(grid: np.ndarray) -> np.ndarray:
    """Connected areas of equal values (-1: none), numbered in the order of their first pixel."""
    h, w = grid.shape
    lab = np.arange(h * w).reshape(h, w)
    right, down = grid[:, 1:] == grid[:, :-1], grid[1:] == grid[:-1]
    u = np.concatenate([lab[:, 1:][right], lab[1:][down]])
    v = np.concatenate([lab[:, :-1][right], lab[:-1][down]])
    root = np.arange(h * w)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    out = np.unique(root, return_inverse=True)[1].reshape(h, w)
    out[grid < 0] = -1
    return out


def facet_map(index: DataFrame) -> DataFrame:
    """index with facet_id. An image is one group."""

    def run(px: pd.DataFrame) -> pd.DataFrame:
        x, y = px["x"].to_numpy(), px["y"].to_numpy()
        grid = np.full((y.max() + 1, x.max() + 1), -1, np.int64)
        grid[y, x] = px["color_index"].to_numpy()
        ids = label(grid)[y, x]
        return px.assign(facet_id=np.unique(ids, return_inverse=True)[1].astype(np.int32))

    cols = index.select("image_id", "x", "y", "color_index")
    return cols.groupBy("image_id").applyInPandas(run, "image_id long, x int, y int, color_index int, facet_id int")


def facet_stats(facets: DataFrame) -> DataFrame:
    return facets.groupBy("image_id", "facet_id").agg(F.min("color_index").alias("color_index"), F.count("*").alias("point_count"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def border_points(facets: DataFrame) -> DataFrame:
    """Pixels on the canvas edge or next to another facet."""
    f = F.col("facet_id")
    other = [F.coalesce(F.col(c) != f, F.lit(True)) for c in ("left", "right", "up", "down")]
    return around(facets, "facet_id").filter(other[0] | other[1] | other[2] | other[3]).select("image_id", "facet_id", "x", "y")


def adjacency(facets: DataFrame) -> DataFrame:
    """image_id, facet_id, neighbour_id, both ways."""
    a = around(facets, "facet_id").select("image_id", "facet_id", F.explode(F.array("left", "right", "up", "down")).alias("neighbour_id"))
    return a.filter("neighbour_id != facet_id").distinct()


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("image_id", "facet_id").agg(F.array_sort(F.collect_list("neighbour_id")).alias("neighbours"))


def boundary_steps(facets: DataFrame) -> DataFrame:
    """Directed unit steps around each facet, itself on the left: image_id, facet_id, x, y, sx, sy, ex, ey, side, neighbour (-1: canvas edge)."""
    x, y, f = F.col("x"), F.col("y"), F.col("facet_id")
    step = lambda side, sx, sy, ex, ey, n: F.when(F.coalesce(F.col(n) != f, F.lit(True)), F.struct(F.lit(side).alias("side"), sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"), F.coalesce(n, F.lit(-1)).alias("neighbour")))
    steps = F.array(step("left", x, y, x, y + 1, "left"), step("top", x + 1, y, x, y, "up"), step("right", x + 1, y + 1, x + 1, y, "right"), step("bottom", x, y + 1, x + 1, y + 1, "down"))
    return around(facets, "facet_id").select("image_id", "facet_id", "x", "y", F.explode(F.array_compact(steps)).alias("s")).select("image_id", "facet_id", "x", "y", "s.*")
