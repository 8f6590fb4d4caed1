"""Small facets merged into neighbours, and facets beyond a cap into those that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def removal_plan(stats: DataFrame, smaller_than: int, cap: int) -> DataFrame:
    """Facets to remove, in order from large to small: under size, or beyond the cap."""
    first = Window.partitionBy("image_id").orderBy(F.desc("point_count"), F.desc("facet_id"))
    p = stats.withColumns({"removal_order": F.row_number().over(first), "n": F.count("*").over(Window.partitionBy("image_id"))})
    p = p.withColumns({"under_size": F.col("point_count") < smaller_than, "over_cap": F.col("removal_order") <= F.col("n") - cap})
    return p.filter("under_size or over_cap").select("image_id", "facet_id", "point_count", F.col("removal_order").cast("int").alias("removal_order"), "under_size", (F.col("over_cap") & ~F.col("under_size")).alias("due_to_cap"))


def kept(stats: DataFrame, cap: int) -> DataFrame:
    """The largest facets, ties to the smaller id; one at least."""
    first = Window.partitionBy("image_id").orderBy(F.desc("point_count"), "facet_id")
    return stats.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max(cap, 1)).select("image_id", "facet_id", "point_count", F.col("nth").cast("int").alias("nth"))


def owners(stats: DataFrame, edges: DataFrame, palette: DataFrame, smaller_than: int) -> DataFrame:
    """For each facet under size, the neighbour that takes it: the nearest in colour, ties to the smaller id.

    Neighbours that are not under size come first; where there are none, those of greater id, which keeps two from swapping."""
    s = stats.join(palette, ["image_id", "color_index"]).select("image_id", "facet_id", "r", "g", "b", (F.col("point_count") < smaller_than).alias("small"))
    n = s.select("image_id", *[F.col(c).alias(f"n_{c}") for c in ("r", "g", "b", "small")], F.col("facet_id").alias("neighbour_id"))
    d = sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "rgb"), F.lit(0))
    e = s.filter("small").join(edges, ["image_id", "facet_id"]).join(n, ["image_id", "neighbour_id"])
    e = e.filter(~F.col("n_small") | (F.col("neighbour_id") > F.col("facet_id")))
    best = F.min(F.struct("n_small", d.alias("d"), "neighbour_id"))
    return e.groupBy("image_id", "facet_id").agg(best.alias("m")).select("image_id", "facet_id", F.col("m.neighbour_id").alias("owner_id"))


def reduce_round(facets: DataFrame, stats: DataFrame, own: DataFrame) -> DataFrame:
    """image_id, x, y, color_index after every owner of one round has taken its facets; all read the same snapshot."""
    to = own.join(stats.select("image_id", F.col("facet_id").alias("owner_id"), F.col("color_index").alias("new")), ["image_id", "owner_id"]).select("image_id", "facet_id", "new")
    return facets.join(to, ["image_id", "facet_id"], "left").select("image_id", "x", "y", F.coalesce("new", "color_index").alias("color_index"))
