"""Pictures of facets: SVG, filled rasters, rasters of single stages, and labels for a preview."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.functions.colour import css, tint
from hueweave.operators.regions import border_points
from hueweave.settings import Settings

#: Colours of the stage rasters.
BORDER, LINE, LABEL = (32, 32, 32), (17, 17, 17), (210, 0, 24)


def number(c: Column) -> Column:
    """Shortest decimal, whole numbers without a point."""
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def path_data(xs: Column, ys: Column) -> Column:
    """A loop as M and quadratic curves whose control points are the middles, so every curve is straight."""
    point = lambda i: F.concat(number(F.get(xs, i)), F.lit(" "), number(F.get(ys, i)))
    middle = lambda i: F.concat(number((F.get(xs, i - 1) + F.get(xs, i)) / 2), F.lit(" "), number((F.get(ys, i - 1) + F.get(ys, i)) / 2))
    rest = F.transform(F.slice(F.sequence(F.lit(0), F.size(xs) - 1), F.lit(2), F.size(xs)), lambda i: F.concat(F.lit("Q "), middle(i), F.lit(" "), point(i)))
    return F.concat_ws(" ", F.concat(F.lit("M "), point(F.lit(0))), rest, F.lit("Z"))


def svg(loops: DataFrame, stats: DataFrame, palette: DataFrame, s: Settings | None = None, labels: DataFrame | None = None) -> DataFrame:
    """image_id, svg: one even-odd path for each facet in the order of ids, and colour numbers at the labels' centres where shown."""
    s = s or Settings()
    path = loops.filter(F.size("xs") >= 3).select("image_id", "facet_id", "loop_id", path_data(F.col("xs"), F.col("ys")).alias("d"))
    d = path.groupBy("image_id", "facet_id").agg(F.array_sort(F.collect_list(F.struct("loop_id", "d"))).alias("parts")).withColumn("d", F.array_join(F.transform("parts", lambda p: p["d"]), " "))
    one = d.join(stats.select("image_id", "facet_id", "color_index"), ["image_id", "facet_id"]).join(palette, ["image_id", "color_index"])
    fill = css(F.col("r"), F.col("g"), F.col("b")) if s.fill_facets else F.lit("none")
    stroke = ("#222", "0.2") if s.show_borders else ("none", "0")
    tag = F.format_string(f'<path data-facet-id="%d" d="%s" fill="%s" fill-rule="evenodd" stroke="{stroke[0]}" stroke-width="{stroke[1]}" stroke-linejoin="round"/>', "facet_id", "d", fill)
    tags = one.select("image_id", F.lit(0).alias("layer"), "facet_id", tag.alias("t"))
    if s.show_labels and labels is not None:
        at = labels.join(stats.select("image_id", "facet_id", "color_index"), ["image_id", "facet_id"])
        text = F.format_string('<text x="%s" y="%s" font-size="4" text-anchor="middle" dominant-baseline="middle" fill="black">%d</text>', number(F.col("min_x") + F.col("width") / 2), number(F.col("min_y") + F.col("height") / 2), "color_index")
        tags = tags.unionByName(at.select("image_id", F.lit(1).alias("layer"), "facet_id", text.alias("t")))
    size = stats.groupBy("image_id").agg((F.max("max_x") + 1).alias("w"), (F.max("max_y") + 1).alias("h"))
    all_ = tags.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("layer", "facet_id", "t"))).alias("tags")).join(size, "image_id")
    head = F.format_string('<?xml version="1.0" encoding="UTF-8"?><svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d"><rect width="100%%" height="100%%" fill="white"/>', "w", "h", "w", "h")
    return all_.select("image_id", F.concat(head, F.array_join(F.transform("tags", lambda t: t["t"]), ""), F.lit("</svg>")).alias("svg"))


def filled(loops: DataFrame) -> DataFrame:
    """image_id, x, y, facet_id of the pixels whose centre lies within a facet's loops by the even-odd rule; a later facet covers an earlier one.

    Edges meet rows, crossings of a facet and row are paired in order, and pairs give runs of pixels. The largest group is one facet's crossings of one row."""
    n = F.size("xs")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("xs", i).alias("x0"), F.get("ys", i).alias("y0"), F.get("xs", (i + 1) % n).alias("x1"), F.get("ys", (i + 1) % n).alias("y1")))
    e = loops.select("image_id", "facet_id", F.explode(edge).alias("e")).select("image_id", "facet_id", "e.*").filter("y0 != y1")
    low, high = F.ceil(F.least("y0", "y1") - 0.5), F.ceil(F.greatest("y0", "y1") - 0.5) - 1
    rows = e.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("y", F.explode(F.sequence("low", "high")))
    cross = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    lines = rows.select("image_id", "facet_id", "y", cross.alias("c")).groupBy("image_id", "facet_id", "y").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pair = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("c", i) - 0.5).alias("a"), (F.ceil(F.get("c", i + 1) - 0.5) - 1).alias("b")))
    runs = lines.select("image_id", "facet_id", "y", F.explode(pair).alias("p")).filter("p.a <= p.b")
    px = runs.select("image_id", F.explode(F.sequence(F.col("p.a").cast("int"), F.col("p.b").cast("int"))).alias("x"), F.col("y").cast("int").alias("y"), "facet_id")
    return px.groupBy("image_id", "x", "y").agg(F.max("facet_id").alias("facet_id"))


def painted(canvas: DataFrame, fill: DataFrame, stats: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: every pixel of canvas in the colour of the facet that fill gives it, white where it gives none."""
    colour = stats.select("image_id", "facet_id", "color_index").join(palette, ["image_id", "color_index"]).select("image_id", "facet_id", "r", "g", "b")
    px = fill.join(colour, ["image_id", "facet_id"]).select("image_id", "x", "y", "r", "g", "b")
    return canvas.select("image_id", "x", "y").join(px, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"])


def _line(x0: int, y0: int, x1: int, y1: int) -> Iterator[tuple[int, int]]:
    """Pixels of a straight line: whole steps along both axes, whichever keeps the error small."""
    a, b = abs(x1 - x0), abs(y1 - y0)
    sx, sy, error = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1), a - b
    yield x0, y0
    while (x0, y0) != (x1, y1):
        twice = 2 * error
        if twice >= -b:
            error, x0 = error - b, x0 + sx
        if twice <= a:
            error, y0 = error + a, y0 + sy
        yield x0, y0


def line_pixels(loops: DataFrame) -> DataFrame:
    """image_id, x, y of the pixels that the lines of loops cross, corners rounded half away from zero; they may lie beyond the canvas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for i, xs, ys in zip(b["image_id"], b["xs"], b["ys"], strict=True):
                x, y = (np.floor(np.asarray(v, float) + 0.5).astype(int).tolist() for v in (xs, ys))
                for p in zip(x, y, x[1:], y[1:], strict=False):
                    out.update((i, *q) for q in _line(*p))
            yield pd.DataFrame(sorted(out), columns=["image_id", "x", "y"]).astype({"image_id": "int64", "x": "int32", "y": "int32"})

    return loops.select("image_id", "xs", "ys").mapInPandas(run, "image_id long, x int, y int").distinct()


def label_pixels(labels: DataFrame) -> DataFrame:
    """image_id, x, y of the frames of label boxes and of a small cross in their middle."""
    b = labels.select("image_id", "min_x", "min_y", (F.col("min_x") + F.col("width") - 1).alias("max_x"), (F.col("min_y") + F.col("height") - 1).alias("max_y"))
    b = b.withColumns({"cx": F.col("min_x") + F.floor((F.col("max_x") - F.col("min_x")) / 2).cast("int"), "cy": F.col("min_y") + F.floor((F.col("max_y") - F.col("min_y")) / 2).cast("int")})
    across = lambda lo, hi, y: F.transform(F.sequence(lo, hi), lambda x: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))
    down = lambda lo, hi, x: F.transform(F.sequence(lo, hi), lambda y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))
    c = {k: F.col(k) for k in ("min_x", "min_y", "max_x", "max_y", "cx", "cy")}
    all_ = F.concat(across(c["min_x"], c["max_x"], c["min_y"]), across(c["min_x"], c["max_x"], c["max_y"]), down(c["min_y"], c["max_y"], c["min_x"]), down(c["min_y"], c["max_y"], c["max_x"]), across(c["cx"] - 1, c["cx"] + 1, c["cy"]), down(c["cy"] - 1, c["cy"] + 1, c["cx"]))
    return b.select("image_id", F.explode(all_).alias("p")).select("image_id", "p.x", "p.y").distinct()


def stage(facets: DataFrame, palette: DataFrame, loops: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """image_id, x, y, r, g, b: tinted facets, their border pixels dark; over them the lines of loops, and over these the label boxes.

    A pixel takes the colour of its topmost layer, which is one sum by pixel."""
    base = facets.join(palette, ["image_id", "color_index"]).select("image_id", "x", "y", F.lit(0).alias("layer"), *[tint(F.col(c)).alias(c) for c in "rgb"])
    layers = [(border_points(facets), BORDER)] + ([(line_pixels(loops), LINE)] if loops is not None else []) + ([(label_pixels(labels), LABEL)] if labels is not None else [])
    for i, (px, colour) in enumerate(layers):
        base = base.unionByName(px.select("image_id", "x", "y", F.lit(i + 1).alias("layer"), *[F.lit(v).alias(c) for c, v in zip("rgb", colour, strict=True)]))
    top = base.groupBy("image_id", "x", "y").agg(F.max(F.struct("layer", "r", "g", "b")).alias("t"), F.min("layer").alias("low"))
    return top.filter("low = 0").select("image_id", "x", "y", "t.r", "t.g", "t.b")


def preview_labels(labels: DataFrame, stats: DataFrame, scale: float = 1.0, font: float = 12.0) -> DataFrame:
    """image_id, facet_id, label, x, y, font_size: labels that fit their boxes and do not overlap, those of large facets placed first.

    A label needs a scaled box of 10 by 10, a facet of 24 pixels and a font of at least 5. Its size is bounded by the box's width, height and short side."""
    at = labels.join(stats.select("image_id", "facet_id", "color_index", "point_count"), ["image_id", "facet_id"])
    w, h = F.col("width") * scale, F.col("height") * scale
    units = F.greatest(F.lit(1.0), F.length(F.col("color_index").cast("string")) * 0.92)
    size = F.least(F.lit(float(font)), w * 0.64 / units, h * 0.5, F.least(w, h) * 0.46)
    fits = at.filter((w >= 10) & (h >= 10) & (F.col("point_count") >= 24)).select("image_id", "facet_id", "point_count", F.col("color_index").cast("string").alias("label"), ((F.col("min_x") + F.col("width") / 2) * scale).alias("x"), ((F.col("min_y") + F.col("height") / 2) * scale).alias("y"), size.alias("font_size"), units.alias("units"), (w * h).alias("box")).filter("font_size >= 5")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["point_count", "box", "facet_id"], ascending=[False, False, True])
        pad = np.maximum(1.5, rows["font_size"] * 0.18)
        half_w, half_h = rows["font_size"] * rows["units"] * 0.36 + pad, rows["font_size"] * 0.475 + pad
        boxes = np.stack([rows["x"] - half_w, rows["y"] - half_h, rows["x"] + half_w, rows["y"] + half_h], 1)
        placed: list[int] = []
        for i, b in enumerate(boxes):
            p = boxes[placed]
            if not ((b[0] < p[:, 2]) & (b[2] > p[:, 0]) & (b[1] < p[:, 3]) & (b[3] > p[:, 1])).any():
                placed.append(i)
        return rows.iloc[placed][["image_id", "facet_id", "label", "x", "y", "font_size"]]

    return fits.groupBy("image_id").applyInPandas(run, "image_id long, facet_id int, label string, x double, y double, font_size double")
