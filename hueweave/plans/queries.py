"""Registered raster queries over the pixels of the events table, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.functions import colour
from hueweave.operators import benchmarks, borders, contours, quantize, reduction, regions, render
from hueweave.settings import Settings
from hueweave.sources.raster import EVENT_PIXELS, event_pixels

K, SMALL, CAP = 6, 12, 40
CENTRES = [(32, 32, 32), (224, 32, 64), (32, 224, 64), (128, 128, 192), (224, 224, 224)]
RESTRICTED = ((0, 0, 0), (255, 255, 255), (200, 40, 40), (40, 40, 200), (200, 200, 40))
ALIAS = "dusk"
SETTINGS = Settings(kmeans_clusters=K)


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return quantize.histogram(event_pixels(spark, d))


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    """A fixed quantiser, by which later stages are held against SQL."""
    index = (F.floor(F.col("r") / 64) * 8 + F.floor(F.col("g") / 64) * 2 + F.floor(F.col("b") / 128)).cast("int")
    return event_pixels(spark, d).select("image_id", "x", "y", index.alias("color_index"))


def _colours(stats: DataFrame) -> DataFrame:
    i = F.col("color_index")
    rgb = {"r": F.floor(i / 8) * 64, "g": F.floor(i / 2) % 4 * 64, "b": i % 2 * 128}
    return stats.select("image_id", "color_index").distinct().select("image_id", "color_index", *[v.cast("int").alias(c) for c, v in rgb.items()])


def _facets(spark: SparkSession, d: str) -> DataFrame:
    return regions.facet_map(_fixed(spark, d))


def pixel_chop(spark, d):
    return event_pixels(spark, d).select("image_id", "x", "y", *[colour.chop(F.col(c)).alias(c) for c in "rgb"])


def color_histogram(spark, d):
    return quantize.samples(_hist(spark, d))


def distinct_colors(spark, d):
    return _hist(spark, d).groupBy("image_id").agg(F.count("*").alias("colors"))


def nearest_centroid(spark, d):
    return quantize.nearest_of(_hist(spark, d), CENTRES)


def kmeans_palette(spark, d):
    return quantize.palette(quantize.fit(_hist(spark, d), SETTINGS))


def restricted_palette(spark, d):
    return quantize.palette(quantize.fit(_hist(spark, d), Settings(kmeans_clusters=K, color_restrictions=RESTRICTED)))


def indexed_pixels(spark, d):
    px = event_pixels(spark, d)
    return quantize.indexed(px, quantize.fit(quantize.histogram(px), SETTINGS))


def palette_frequency(spark, d):
    px = event_pixels(spark, d)
    fitted = quantize.fit(quantize.histogram(px), SETTINGS)
    return quantize.palette_stats(quantize.indexed(px, fitted), quantize.palette(fitted), {ALIAS: (0, 0, 0)}).select("image_id", "color_index", "frequency", "area_percentage")


def strip_cleanup_1(spark, d):
    return regions.strip_cleanup(_fixed(spark, d), 1)


def strip_cleanup_3(spark, d):
    return regions.strip_cleanup(_fixed(spark, d), 3)


def facet_map(spark, d):
    return _facets(spark, d)


def facet_stats(spark, d):
    return regions.facet_stats(_facets(spark, d))


def border_points(spark, d):
    return regions.border_points(_facets(spark, d))


def adjacency(spark, d):
    return regions.adjacency(_facets(spark, d))


def neighbour_count(spark, d):
    return regions.neighbour_lists(regions.adjacency(_facets(spark, d))).select("image_id", "facet_id", F.array_join("neighbours", ",").alias("neighbours"))


def removal_plan(spark, d):
    return reduction.removal_plan(facet_stats(spark, d), SMALL, CAP)


def kept_facets_topk(spark, d):
    return reduction.kept(facet_stats(spark, d), CAP)


def _owners(facets):
    stats = regions.facet_stats(facets)
    return stats, reduction.owners(stats, regions.adjacency(facets), _colours(stats), SMALL)


def fastpath_owner(spark, d):
    return _owners(_facets(spark, d))[1]


def reduce_round_1(spark, d):
    facets = _facets(spark, d)
    return reduction.reduce_round(facets, *_owners(facets))


def boundary_steps(spark, d):
    return regions.boundary_steps(_facets(spark, d))


def boundary_length(spark, d):
    return boundary_steps(spark, d).groupBy("image_id", "facet_id", "neighbour").agg(F.count("*").alias("steps"))


def resize_dims(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    w, h = (F.col("p_size") * 97).cast("int"), (F.col("p_partkey") % 3000).cast("int")
    nw, nh = colour.resized(w, h, 1024, 768)
    return p.select("p_partkey", nw.alias("new_width"), nh.alias("new_height"))


def reduced_facets(spark, d):
    return regions.facet_stats(regions.facet_map(contours.reduced(_fixed(spark, d), _colours(_fixed(spark, d)), Settings(remove_facets_smaller_than=SMALL, maximum_number_of_facets=CAP))))


def loops_area(spark, d):
    return contours.loops(_facets(spark, d)).select("image_id", "facet_id", "loop_id", "signed_area", "is_outer", F.size("xs").alias("points"))


def label_bounds(spark, d):
    return contours.labels(contours.loops(_facets(spark, d)), facet_stats(spark, d))


def svg_documents(spark, d):
    facets = _facets(spark, d)
    return render.svg(borders.paths(facets, 2), regions.facet_stats(facets), _colours(_fixed(spark, d)))


def signed_facet_area(spark, d):
    return contours.loops(_facets(spark, d)).groupBy("image_id", "facet_id").agg(F.sum("signed_area").alias("signed_area"))


def smoothed_paths(spark, d):
    return borders.paths(_facets(spark, d), 2).select("image_id", "facet_id", "loop_id", "signed_area", "is_outer", F.size("xs").alias("points"), "traced_points", "segments", "matched_segments", "reversed_segments")


def filled_facets(spark, d):
    return render.filled(contours.loops(_facets(spark, d)))


def filled_smoothed(spark, d):
    facets = _facets(spark, d)
    return render.painted(facets, render.filled(borders.paths(facets, 2)), regions.facet_stats(facets), _colours(_fixed(spark, d)))


def border_stage(spark, d):
    return render.stage(_facets(spark, d), _colours(_fixed(spark, d)))


def label_stage(spark, d):
    facets = _facets(spark, d)
    paths = borders.paths(facets, 2)
    return render.stage(facets, _colours(_fixed(spark, d)), paths, contours.labels(paths, regions.facet_stats(facets)))


def preview_labels(spark, d):
    stats = facet_stats(spark, d)
    return render.preview_labels(contours.labels(contours.loops(_facets(spark, d)), stats), stats, scale=6.0)


def facet_summary(spark, d):
    facets = _facets(spark, d)
    lists = regions.neighbour_lists(regions.adjacency(facets)).select("image_id", "facet_id", F.array_join("neighbours", ",").alias("neighbours"))
    return regions.facet_stats(facets).join(lists, ["image_id", "facet_id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit("")))


def bucket_sizes(spark, d):
    n = facet_stats(spark, d).groupBy("image_id").agg(F.max(F.col("max_x") + 1).alias("w"), F.max(F.col("max_y") + 1).alias("h"), F.count("*").alias("n"))
    return n.select("image_id", colour.bucket_size(F.col("w"), F.col("h"), F.col("n")).alias("bucket_size"))


def _runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.col("user_id").alias("total_ms"), (F.col("event_id") % 97).alias("render_ms"), (F.col("event_id") % 2).alias("half"))
    return e, lambda rows: benchmarks.summary(rows, "name", ["total_ms", "render_ms"], "total_ms")


def benchmark_summary(spark, d):
    runs, summary = _runs(spark, d)
    return summary(runs)


def baseline_delta(spark, d):
    """Two series of runs, those of even events and those of odd ones, held against each other."""
    runs, summary = _runs(spark, d)
    return benchmarks.delta(summary(runs.filter("half = 0")), summary(runs.filter("half = 1")), "name", ["min_total_ms", "max_total_ms"])


QUERIES = (pixel_chop, color_histogram, distinct_colors, nearest_centroid, kmeans_palette, restricted_palette, indexed_pixels, palette_frequency, strip_cleanup_1, strip_cleanup_3, facet_map, facet_stats, border_points, adjacency, neighbour_count, removal_plan, kept_facets_topk, fastpath_owner, reduce_round_1, boundary_steps, boundary_length, resize_dims, reduced_facets, loops_area, signed_facet_area, smoothed_paths, filled_facets, filled_smoothed, border_stage, label_stage, label_bounds, preview_labels, svg_documents, facet_summary, bucket_sizes, benchmark_summary, baseline_delta)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# SQL ---------------------------------------------------------------------------------------------------------------

PX = f"px AS ({EVENT_PIXELS})"
HIST = f"{PX}, hist AS (SELECT image_id, r - r % 4 AS r, g - g % 4 AS g, b - b % 4 AS b, count(*) AS weight FROM px GROUP BY ALL)"
SAMPLES = f"{HIST}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS INT) AS sample_idx FROM hist)"
INDEX = f"{PX}, ix AS (SELECT image_id, x, y, CAST(r // 64 * 8 + g // 64 * 2 + b // 128 AS INT) AS color_index FROM px)"


def _kmeans() -> str:
    """Farthest points, then 32 steps; a step after the end repeats the last. Assignments are those of the centres before the last update."""
    d = lambda p, q: "+".join(f"({p}.{c}-{q}.{c})*({p}.{c}-{q}.{c})" for c in "rgb")
    out = [SAMPLES, "pts AS MATERIALIZED (SELECT image_id, sample_idx, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(weight AS DOUBLE) AS w FROM s)"]
    out.append("c0 AS MATERIALIZED (SELECT image_id, 0 AS k, r, g, b FROM pts WHERE sample_idx = 0)")
    for i in range(1, K):
        out.append(f"c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} UNION ALL SELECT image_id, {i}, r, g, b FROM (SELECT p.image_id, p.r, p.g, p.b, row_number() OVER (PARTITION BY p.image_id ORDER BY min({d('p', 'c')}) * p.w DESC, p.sample_idx) AS nth FROM pts p JOIN c{i - 1} c USING (image_id) GROUP BY p.image_id, p.sample_idx, p.r, p.g, p.b, p.w) WHERE nth = 1)")
    out.append(f"t0 AS MATERIALIZED (SELECT *, r AS pr, g AS pg, b AS pb, FALSE AS done FROM c{K - 1})")
    for i in range(1, 33):
        mean = f"SELECT image_id, k, sum(r * w) / sum(w) AS r, sum(g * w) / sum(w) AS g, sum(b * w) / sum(w) AS b FROM (SELECT p.image_id, p.r, p.g, p.b, p.w, m.k FROM pts p JOIN n{i} m USING (image_id, sample_idx)) GROUP BY image_id, k"
        out.append(f"n{i} AS MATERIALIZED (SELECT image_id, sample_idx, k FROM (SELECT p.image_id, p.sample_idx, c.k, row_number() OVER (PARTITION BY p.image_id, p.sample_idx ORDER BY {d('p', 'c')}, c.k) AS nth FROM pts p JOIN t{i - 1} c USING (image_id)) WHERE nth = 1)")
        out.append(f"u{i} AS MATERIALIZED (SELECT o.*, coalesce(m.r, o.r) AS nr, coalesce(m.g, o.g) AS ng, coalesce(m.b, o.b) AS nb FROM t{i - 1} o LEFT JOIN ({mean}) m USING (image_id, k))")
        out.append(f"t{i} AS MATERIALIZED (SELECT image_id, k, CASE WHEN done THEN r ELSE nr END AS r, CASE WHEN done THEN g ELSE ng END AS g, CASE WHEN done THEN b ELSE nb END AS b, CASE WHEN done THEN pr ELSE r END AS pr, CASE WHEN done THEN pg ELSE g END AS pg, CASE WHEN done THEN pb ELSE b END AS pb, done OR sum(sqrt((nr-r)*(nr-r)+(ng-g)*(ng-g)+(nb-b)*(nb-b))) OVER (PARTITION BY image_id) <= 1.0 AS done FROM u{i})")
    out.append("pal AS (SELECT image_id, CAST(k AS INT) AS color_index, " + ", ".join(f"CAST(greatest(0, least(255, floor({c} + 0.5))) AS INT) AS {c}" for c in "rgb") + " FROM t32)")
    out.append(f"asg AS (SELECT image_id, sample_idx, CAST(k AS INT) AS color_index FROM (SELECT p.image_id, p.sample_idx, c.k, row_number() OVER (PARTITION BY p.image_id, p.sample_idx ORDER BY {'+'.join(f'(p.{c}-c.p{c})*(p.{c}-c.p{c})' for c in 'rgb')}, c.k) AS nth FROM pts p JOIN t32 c USING (image_id)) WHERE nth = 1)")
    out.append("kx AS (SELECT px.image_id, px.x, px.y, asg.color_index FROM px JOIN s ON px.image_id = s.image_id AND px.r - px.r % 4 = s.r AND px.g - px.g % 4 = s.g AND px.b - px.b % 4 = s.b JOIN asg ON asg.image_id = s.image_id AND asg.sample_idx = s.sample_idx)")
    return "WITH " + ",\n".join(out)


def _cleaned(runs: int) -> str:
    out = [INDEX.replace("ix AS", "x0 AS")]
    for i in range(runs):
        out.append(f"""n{i} AS (SELECT *, lag(color_index) OVER r AS le, lead(color_index) OVER r AS ri, lag(color_index) OVER c AS up, lead(color_index) OVER c AS dn FROM x{i}
 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
x{i + 1} AS (SELECT image_id, x, y, CASE WHEN le IS NULL OR ri IS NULL OR up IS NULL OR dn IS NULL THEN color_index WHEN color_index <> up AND color_index <> dn THEN up WHEN color_index <> le AND color_index <> ri THEN le ELSE color_index END AS color_index FROM n{i})""")
    return "WITH " + ",\n".join(out) + f"\nSELECT image_id, x, y, color_index FROM x{runs}"


FACETS = f"""WITH RECURSIVE {INDEX},
nd AS MATERIALIZED (SELECT *, image_id * 2500 + y * 50 + x AS id FROM ix),
ed AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM nd a JOIN nd b ON a.image_id = b.image_id AND a.color_index = b.color_index AND b.y = a.y AND b.x = a.x + 1
 UNION ALL SELECT a.id, b.id FROM nd a JOIN nd b ON a.image_id = b.image_id AND a.color_index = b.color_index AND b.x = a.x AND b.y = a.y + 1),
e2 AS MATERIALIZED (SELECT * FROM ed UNION ALL SELECT dst, src FROM ed),
cc(root, node) AS (SELECT id, id FROM nd UNION SELECT cc.root, e2.dst FROM cc JOIN e2 ON cc.node = e2.src WHERE cc.root < e2.dst),
rt AS MATERIALIZED (SELECT node, min(root) AS root FROM cc GROUP BY node),
f AS MATERIALIZED (SELECT nd.image_id, nd.x, nd.y, nd.color_index, CAST(dense_rank() OVER (PARTITION BY nd.image_id ORDER BY rt.root) - 1 AS INT) AS facet_id FROM nd JOIN rt ON rt.node = nd.id),
st AS (SELECT image_id, facet_id, min(color_index) AS color_index, count(*) AS point_count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM f GROUP BY image_id, facet_id),
nb AS (SELECT *, lag(facet_id) OVER r AS le, lead(facet_id) OVER r AS ri, lag(facet_id) OVER c AS up, lead(facet_id) OVER c AS dn FROM f
 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
adj AS (SELECT DISTINCT image_id, facet_id, n AS neighbour_id FROM (SELECT image_id, facet_id, unnest([le, ri, up, dn]) AS n FROM nb) WHERE n <> facet_id),
stp AS (
 SELECT image_id, facet_id, x, y, 'left' AS side, x AS sx, y AS sy, x AS ex, y + 1 AS ey, coalesce(le, -1) AS neighbour FROM nb WHERE le IS NULL OR le <> facet_id
 UNION ALL SELECT image_id, facet_id, x, y, 'top', x + 1, y, x, y, coalesce(up, -1) FROM nb WHERE up IS NULL OR up <> facet_id
 UNION ALL SELECT image_id, facet_id, x, y, 'right', x + 1, y + 1, x + 1, y, coalesce(ri, -1) FROM nb WHERE ri IS NULL OR ri <> facet_id
 UNION ALL SELECT image_id, facet_id, x, y, 'bottom', x, y + 1, x + 1, y + 1, coalesce(dn, -1) FROM nb WHERE dn IS NULL OR dn <> facet_id),
cl AS (SELECT st.*, color_index // 8 * 64 AS r, color_index // 2 % 4 * 64 AS g, color_index % 2 * 128 AS b FROM st),
ow AS (SELECT image_id, facet_id, owner_id, new FROM (
 SELECT a.image_id, a.facet_id, n.facet_id AS owner_id, n.color_index AS new, row_number() OVER (PARTITION BY a.image_id, a.facet_id ORDER BY n.point_count < {SMALL}, (a.r-n.r)*(a.r-n.r)+(a.g-n.g)*(a.g-n.g)+(a.b-n.b)*(a.b-n.b), n.facet_id) AS nth
 FROM cl a JOIN adj ON adj.image_id = a.image_id AND adj.facet_id = a.facet_id JOIN cl n ON n.image_id = adj.image_id AND n.facet_id = adj.neighbour_id
 WHERE a.point_count < {SMALL} AND (n.point_count >= {SMALL} OR n.facet_id > a.facet_id)) WHERE nth = 1)
"""

_D = " , ".join(f"struct_pack(d := (r-{p[0]})*(r-{p[0]})+(g-{p[1]})*(g-{p[1]})+(b-{p[2]})*(b-{p[2]}), k := {i})" for i, p in enumerate(CENTRES))
_R = " , ".join(f"struct_pack(d := (p.r-{c[0]})*(p.r-{c[0]})+(p.g-{c[1]})*(p.g-{c[1]})+(p.b-{c[2]})*(p.b-{c[2]}), k := {i}, r := {c[0]}, g := {c[1]}, b := {c[2]})" for i, c in enumerate(RESTRICTED))


_SUMMARY = "SELECT event_type AS name, round(avg(user_id), 2) AS average_total_ms, round(avg(event_id % 97), 2) AS average_render_ms, min(user_id) AS min_total_ms, max(user_id) AS max_total_ms FROM events{of} GROUP BY event_type"


def oracle_sql() -> dict[str, str]:
    return {
        "pixel_chop": f"WITH {PX} SELECT image_id, x, y, r - r % 4 AS r, g - g % 4 AS g, b - b % 4 AS b FROM px",
        "color_histogram": f"WITH {SAMPLES} SELECT * FROM s",
        "distinct_colors": f"WITH {HIST} SELECT image_id, count(*) AS colors FROM hist GROUP BY image_id",
        "nearest_centroid": f"WITH {HIST} SELECT *, list_min([{_D}]).k AS color_index FROM hist",
        "kmeans_palette": f"{_kmeans()} SELECT image_id, color_index, r, g, b FROM pal",
        "restricted_palette": f"{_kmeans()}, q AS (SELECT image_id, color_index, list_min([{_R}]) AS m FROM pal p) SELECT image_id, color_index, m.r AS r, m.g AS g, m.b AS b FROM q",
        "indexed_pixels": f"{_kmeans()} SELECT * FROM kx",
        "palette_frequency": f"{_kmeans()} SELECT pal.image_id, pal.color_index, count(kx.x) AS frequency, count(kx.x) / sum(count(kx.x)) OVER (PARTITION BY pal.image_id) AS area_percentage FROM pal LEFT JOIN kx USING (image_id, color_index) GROUP BY pal.image_id, pal.color_index",
        "strip_cleanup_1": _cleaned(1),
        "strip_cleanup_3": _cleaned(3),
        "facet_map": f"{FACETS} SELECT image_id, x, y, color_index, facet_id FROM f",
        "facet_stats": f"{FACETS} SELECT * FROM st",
        "border_points": f"{FACETS} SELECT DISTINCT image_id, facet_id, x, y FROM stp",
        "adjacency": f"{FACETS} SELECT * FROM adj",
        "neighbour_count": f"{FACETS} SELECT image_id, facet_id, string_agg(CAST(neighbour_id AS VARCHAR), ',' ORDER BY neighbour_id) AS neighbours FROM adj GROUP BY image_id, facet_id",
        "removal_plan": f"{FACETS}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY point_count DESC, facet_id DESC) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM st) SELECT image_id, facet_id, point_count, CAST(nth AS INT) AS removal_order, point_count < {SMALL} AS under_size, nth <= n - {CAP} AND point_count >= {SMALL} AS due_to_cap FROM o WHERE point_count < {SMALL} OR nth <= n - {CAP}",
        "kept_facets_topk": f"{FACETS}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY point_count DESC, facet_id) AS k FROM st) SELECT image_id, facet_id, point_count, CAST(k AS INT) AS nth FROM o WHERE k <= {CAP}",
        "fastpath_owner": f"{FACETS} SELECT image_id, facet_id, owner_id FROM ow",
        "reduce_round_1": f"{FACETS} SELECT f.image_id, f.x, f.y, coalesce(ow.new, f.color_index) AS color_index FROM f LEFT JOIN ow ON ow.image_id = f.image_id AND ow.facet_id = f.facet_id",
        "boundary_steps": f"{FACETS} SELECT * FROM stp",
        "boundary_length": f"{FACETS} SELECT image_id, facet_id, neighbour, count(*) AS steps FROM stp GROUP BY ALL",
        "signed_facet_area": f"{FACETS} SELECT image_id, facet_id, -CAST(point_count AS DOUBLE) AS signed_area FROM st",
        "filled_facets": f"{FACETS} SELECT image_id, x, y, facet_id FROM f",
        "border_stage": f"{FACETS}, bp AS (SELECT DISTINCT image_id, x, y FROM stp), pc AS (SELECT image_id, x, y, color_index // 8 * 64 AS r, color_index // 2 % 4 * 64 AS g, color_index % 2 * 128 AS b FROM f) SELECT pc.image_id, pc.x, pc.y, " + ", ".join(f"CAST(CASE WHEN bp.x IS NOT NULL THEN 32 ELSE floor(pc.{c} * 0.82 + 45.9 + 0.5) END AS INT) AS {c}" for c in "rgb") + " FROM pc LEFT JOIN bp ON bp.image_id = pc.image_id AND bp.x = pc.x AND bp.y = pc.y",
        "facet_summary": f"{FACETS}, nl AS (SELECT image_id, facet_id, string_agg(CAST(neighbour_id AS VARCHAR), ',' ORDER BY neighbour_id) AS neighbours FROM adj GROUP BY image_id, facet_id) SELECT st.*, coalesce(nl.neighbours, '') AS neighbours FROM st LEFT JOIN nl ON nl.image_id = st.image_id AND nl.facet_id = st.facet_id",
        "bucket_sizes": f"{FACETS} SELECT image_id, CAST(greatest(1, ceil(sqrt((max(max_x) + 1) * (max(max_y) + 1) / greatest(1, count(*))))) AS INT) AS bucket_size FROM st GROUP BY image_id",
        "benchmark_summary": _SUMMARY.format(of=""),
        "baseline_delta": f"WITH a AS ({_SUMMARY.format(of=' WHERE event_id % 2 = 0')}), b AS ({_SUMMARY.format(of=' WHERE event_id % 2 = 1')}) SELECT a.name, b.min_total_ms - a.min_total_ms AS delta_min_total_ms, b.max_total_ms - a.max_total_ms AS delta_max_total_ms FROM a JOIN b ON b.name = a.name",
        "resize_dims": "WITH p AS (SELECT p_partkey, CAST(p_size * 97 AS INT) AS w, CAST(p_partkey % 3000 AS INT) AS h FROM part) SELECT p_partkey, CAST(CASE WHEN w > 0 AND h > 0 THEN greatest(1, round(w * least(1.0::DOUBLE, 1024.0::DOUBLE / w, 768.0::DOUBLE / h))) ELSE w END AS INT) AS new_width, CAST(CASE WHEN w > 0 AND h > 0 THEN greatest(1, round(h * least(1.0::DOUBLE, 1024.0::DOUBLE / w, 768.0::DOUBLE / h))) ELSE h END AS INT) AS new_height FROM p",
    }
