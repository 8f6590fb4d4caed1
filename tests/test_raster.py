"""Raster operators: small fixtures with known results, and every query against its SQL."""

import json

import duckdb
import numpy as np
import pytest

from hueweave import __main__ as main
from hueweave import api
from hueweave.operators import borders, contours, quantize, regions, render
from hueweave.plans import queries as registry
from hueweave.settings import Settings, form, load, restrictions
from hueweave.sources import sinks
from hueweave.sources.raster import image_files, resized_images, rgba_pixels
from hueweave.streaming import images as images_

D = "/root/testdata/sf0.001"


def index(spark, rows):
    return spark.createDataFrame([(1, x, y, c) for y, r in enumerate(rows) for x, c in enumerate(r)], "image_id long, x int, y int, color_index int")


def grid(df, value="color_index"):
    px = df.toPandas()
    out = np.zeros((px["y"].max() + 1, px["x"].max() + 1), int)
    out[px["y"], px["x"]] = px[value]
    return out.tolist()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    a, b = registry.queries()[name](spark, D).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    a, b = (x[c].sort_values(c).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for k in c:
        assert (a[k] == b[k].astype(a[k].dtype)).all(), k


def test_two_pixels(spark):
    images = spark.createDataFrame([(1, 2, 1, bytearray([255, 0, 0, 255, 0, 255, 0, 255]))], "image_id long, width int, height int, rgba binary")
    px = rgba_pixels(images)
    fitted = quantize.fit(quantize.histogram(px), Settings())
    assert sorted(map(tuple, quantize.palette(fitted).select("color_index", "r", "g", "b").collect())) == [(0, 0, 252, 0), (1, 252, 0, 0)]
    assert grid(quantize.indexed(px, fitted)) == [[1, 0]]


def test_wrong_length_raises(spark):
    images = spark.createDataFrame([(1, 2, 2, bytearray(4))], "image_id long, width int, height int, rgba binary")
    with pytest.raises(Exception, match="InvalidRgbaLength"):
        rgba_pixels(images).collect()


def test_facet_ids_are_in_scan_order(spark):
    f = regions.facet_map(index(spark, [[0, 1, 1], [0, 1, 2], [3, 3, 2]]))
    s = {r.facet_id: (r.color_index, r.point_count) for r in regions.facet_stats(f).collect()}
    assert s == {0: (0, 2), 1: (1, 3), 2: (2, 2), 3: (3, 2)}
    n = {r.facet_id: r.neighbours for r in regions.neighbour_lists(regions.adjacency(f)).collect()}
    assert n == {0: [1, 3], 1: [0, 2, 3], 2: [1, 3], 3: [0, 1, 2]}


@pytest.mark.parametrize(
    ("rows", "colours", "small", "cap", "want"),
    [
        ([[0, 0, 0], [0, 1, 0], [0, 0, 0]], [(255, 0, 0), (0, 0, 255)], 2, 1 << 32, [[0, 0, 0]] * 3),
        ([[0, 1, 2]] * 3, [(255, 0, 0), (0, 255, 0), (0, 0, 255)], 1, 2, [[0, 1, 1]] * 3),
        ([[0, 0, 1, 1], [0, 2, 2, 1], [3, 3, 2, 1], [3, 3, 2, 1]], [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)], 1, 2, [[1, 1, 1, 1], [1, 2, 2, 1], [2, 2, 2, 1], [2, 2, 2, 1]]),
    ],
)
def test_reduction(spark, rows, colours, small, cap, want):
    palette = spark.createDataFrame([(1, i, *c) for i, c in enumerate(colours)], "image_id long, color_index int, r int, g int, b int")
    for order in (True, False):
        s = Settings(remove_facets_smaller_than=small, maximum_number_of_facets=cap, remove_facets_from_large_to_small=order)
        assert grid(contours.reduced(index(spark, rows), palette, s)) == want


def test_donut_loops_label_and_svg(spark):
    rows = [[0] * 5, [0, 1, 1, 1, 0], [0, 1, 2, 1, 0], [0, 1, 1, 1, 0], [0] * 5]
    f = regions.facet_map(index(spark, rows))
    loops = contours.loops(f)
    got = sorted((r.facet_id, r.loop_id, r.signed_area, r.is_outer) for r in loops.collect())
    assert got == [(0, 0, -25.0, True), (0, 1, 9.0, False), (1, 0, -9.0, True), (1, 1, 1.0, False), (2, 0, -1.0, True)]
    box = {r.facet_id: r for r in contours.labels(loops, regions.facet_stats(f)).collect()}[0]
    assert not (box.min_x <= 2 < box.min_x + box.width and box.min_y <= 2 < box.min_y + box.height)
    palette = spark.createDataFrame([(1, i, 10 * i, 0, 0) for i in range(3)], "image_id long, color_index int, r int, g int, b int")
    svg = render.svg(loops, regions.facet_stats(f), palette).first().svg
    assert svg.count("<path") == 3 and svg.split("<path")[1].count("M ") == 2


def test_labels_begin_with_the_centroid():
    """A convex facet's label stays at the centre of mass unless a cell is better by itself; of equal rings the last is the outer one."""
    square = np.array([(0, 0), (0, 4), (4, 4), (4, 0)], float)
    assert contours.inmost([square]) == (2.0, 2.0, 2.0)
    corner = np.array([(0, 0), (0, 6), (2, 6), (2, 2), (6, 2), (6, 0)], float)
    assert np.allclose(contours._centroid(corner), (2.2, 2.2))
    assert contours._centroid(np.array([(1, 1), (3, 3)], float)) == (1.0, 1.0)
    rings = [square, square + 10, square[:3]]
    assert contours.outer_first(rings)[0] is rings[1]


def test_reduction_is_linear_in_the_image():
    """Facets cost their own pixels: a noisy picture of 27,000 pixels and 20,000 facets, against masks of the whole canvas for the first round."""
    r = np.random.default_rng(9)
    cells = r.integers(0, 6, (150, 180))
    palette = r.integers(0, 256, (6, 3))
    out = contours.reduce_grid(cells, palette, Settings(remove_facets_smaller_than=4))
    assert np.bincount(regions.label(out).ravel()).min() >= 4 and set(np.unique(out)) <= set(range(6))


def test_traced_area_is_the_canvas(spark):
    f = registry._facets(spark, D)
    total = contours.loops(f).agg({"signed_area": "sum"}).first()[0]
    assert -total == f.count()


def test_settings():
    s = load('{"kmeansClusters": 4, "resize": {"maxWidth": 10}, "unknown": 1}', random_seed=3)
    assert (s.kmeans_clusters, s.resize_max_width, s.random_seed, s.border_smoothing_passes) == (4, 10, 3, 2)
    assert restrictions("// x\n\n1, 2,3\n") == ((1, 2, 3),)
    with pytest.raises(ValueError):
        restrictions("1,2,300")
    s = form({"clusters": "12px", "precision": "-1", "seed": "0", "smoothing": "x", "removeFacets": "0", "maxFacets": "", "resizeWidth": "7", "resizeEnabled": "true", "fillFacets": "0", "colorRestrictions": "1,2,3\n1,2\n//", "removalOrder": "small_to_large", "unknown": "1"})
    assert s == Settings(kmeans_clusters=12, resize_max_width=7, resize_enabled=True, fill_facets=False, color_restrictions=((1, 2, 3),), remove_facets_from_large_to_small=False)


PALETTE = "image_id long, color_index int, r int, g int, b int"


def images(spark, *rows):
    data = [(i + 1, w, h, bytearray(b for p in px for b in (*p, 255))) for i, (w, h, px) in enumerate(rows)]
    return spark.createDataFrame(data, "image_id long, width int, height int, rgba binary")


DONUT = (5, 5, [(0, 0, 255) if (x, y) == (2, 2) else (255, 0, 0) if x in (0, 4) or y in (0, 4) else (0, 255, 0) for y in range(5) for x in range(5)])


def test_segments_change_with_the_neighbour():
    steps = borders.Steps(np.array([[0, 0, 1], [0, 0, 1], [2, 2, 1]]))
    outer = steps.loops()[0]
    assert tuple(steps.start[:, outer[0]]) == (0, 0)
    assert [n for n, _ in steps.segments(outer)] == [-1, 2, 1]


def test_two_facets_share_their_border():
    rows = borders.bordered(np.array([[0, 1], [0, 1]]), 2)
    assert [r[6:] for r in rows] == [(2, 1, 0), (2, 1, 1)] and [r[2] for r in rows] == [-2, -2]


def test_smoothing_keeps_ends_and_canvas_edges():
    p = np.array([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4)], float)
    assert borders.smoothed(p, 9, 9, 1).tolist() == [[1, 1], [1.5, 2], [2.5, 3], [4, 4]]
    assert borders.smoothed(p, 9, 3, 1).tolist() == [[1, 1], [1.5, 2], [2, 3], [3, 3], [4, 4]]
    assert borders.smoothed(p[:5], 9, 9, 3).tolist() == p[:5].tolist()


def test_random_grids_trace_and_fill_back(spark):
    r = np.random.default_rng(5)
    cells = r.integers(0, 3, (23, 31))
    f = regions.facet_map(index(spark, cells.tolist())).persist()
    ids = np.array(grid(f, "facet_id"))
    total, closed = np.zeros(ids.max() + 1), 0
    steps = borders.Steps(ids)
    for p in steps.loops():
        line = steps.corners(p)
        total[steps.facet[p[0]]] += borders.area(line)
        closed += (line[0] == line[-1]).all()
        whole = np.concatenate([s for _, s in steps.segments(p)])
        assert {tuple(q) for q in whole} == {tuple(q) for q in line}
    assert closed == len(steps.loops()) and (-total == np.bincount(ids.ravel())).all()
    assert np.array_equal(grid(render.filled(contours.loops(f)), "facet_id"), ids)
    assert np.array_equal(grid(render.filled(borders.paths(f, 0)), "facet_id"), ids)


def test_whole_donut(spark):
    px = rgba_pixels(images(spark, DONUT, (2, 2, [(255, 0, 0)] * 2 + [(0, 0, 255)] * 2)))
    s = Settings(kmeans_clusters=3, narrow_pixel_strip_cleanup_runs=0, remove_facets_smaller_than=1, border_smoothing_passes=0, show_labels=True)
    out = api.process(px, s)
    freq = {(r.image_id, r.color_index): (r.r, r.g, r.b, r.frequency) for r in out.palette.collect()}
    assert freq == {(1, 0): (0, 0, 252, 1), (1, 1): (252, 0, 0, 16), (1, 2): (0, 252, 0, 8), (2, 0): (0, 0, 252, 2), (2, 1): (252, 0, 0, 2)}
    svg = {r.image_id: r.svg for r in out.svg.collect()}
    assert svg[1].count("<path") == svg[1].count("<text") == 3 and svg[1].split("<path")[1].count("M ") == 2
    assert "M 0 0 Q 0 0.5 0 1 " in svg[1] and svg[1].endswith("</svg>")
    assert grid(out.rasterised().filter("image_id = 1"), "g")[1] == [0, 252, 252, 252, 0]
    stages = {k: v.filter("image_id = 2") for k, v in out.stages().items()}
    assert all(v.count() == 4 for v in stages.values())
    m = {r.image_id: r for r in out.metrics.collect()}[1]
    assert (m.facets_before_reduction, m.facets_after_reduction, m.contour_traced_path_points) == (3, 3, 52)
    debug = {r.image_id: json.loads(r.data) for r in out.debug_json().collect()}
    assert debug[2]["facet_count"] == 2 and debug[2]["facets_summary"][0]["neighbour_facets"] == [1] and len(debug[1]["palette"]) == 3
    out.release()
    nothing = api.process(px.filter("false"), s)
    assert nothing.svg.count() == nothing.palette.count() == 0


def test_lines_and_label_boxes(spark):
    loops = spark.createDataFrame([(1, [0.0, 3.0], [0.0, 1.0])], "image_id long, xs array<double>, ys array<double>")
    assert {(r.x, r.y) for r in render.line_pixels(loops).collect()} == {(0, 0), (1, 0), (2, 1), (3, 1)}
    box = spark.createDataFrame([(1, 0, 2, 2, 5, 3)], "image_id long, facet_id int, min_x int, min_y int, width int, height int")
    got = {(r.x, r.y) for r in render.label_pixels(box).collect()}
    assert (4, 3) in got and (2, 2) in got and (6, 4) in got and len(got) == 12 + 3


def test_preview_labels_do_not_overlap(spark):
    box = [(1, f, x, 0, 20, 20) for f, x in ((0, 0), (1, 5), (2, 40), (3, 80))]
    labels = spark.createDataFrame(box, "image_id long, facet_id int, min_x int, min_y int, width int, height int")
    stats = spark.createDataFrame([(1, 0, 3, 50), (1, 1, 4, 90), (1, 2, 12, 60), (1, 3, 1, 20)], "image_id long, facet_id int, color_index int, point_count long")
    got = {r.facet_id: (r.label, round(r.font_size, 2)) for r in render.preview_labels(labels, stats).collect()}
    assert got == {1: ("4", 9.2), 2: ("12", 6.96)}


def test_files_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    sinks.write_files(sinks.png(rgba_pixels(images(spark, DONUT))), str(source), "donut", "png", numbered=False)
    assert [f.name for f in source.iterdir()] == ["donut.png"]
    back = image_files(spark, str(source))
    assert back.first().rgba == images(spark, DONUT).first().rgba
    (tmp_path / "c.json").write_text('{"narrowPixelStripCleanupRuns": 0}')
    main.run(spark, main.arguments(["-c", str(tmp_path / "c.json"), "-i", str(source), "-o", str(tmp_path / "out" / "x.svg"), "-k", "3", "--remove-facets-smaller-than", "1", "--format", "svg, palette.json,png,jpg,quantized.png,quantized.jpg,debug.json,profile.json,nonsense"]))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["x.debug.json", "x.jpg", "x.palette.json", "x.png", "x.profile.json", "x.quantized.jpg", "x.quantized.png", "x.svg"]
    assert [e["frequency"] for e in json.loads((tmp_path / "out" / "x.palette.json").read_text())] == [1, 16, 8]
    assert json.loads((tmp_path / "out" / "x.profile.json").read_text())["width"] == 5
    seen = []
    images_.watch(spark, str(source), str(tmp_path / "state"), lambda out, n: seen.append((n, out.svg.count()))).awaitTermination()
    assert seen == [(0, 1)]


@pytest.mark.parametrize("w,h", [(1, 1), (8, 8), (37, 21), (64, 50)])
def test_jpeg_round_trip(spark, tmp_path, w, h):
    """Read back by the JVM's decoder: smooth pictures nearly as they were, one colour and noise too."""
    r = np.random.default_rng(w)
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([x * 255 // max(w, 2), y * 255 // max(h, 2), (x + y) * 255 // (w + h)], 2)
    for i, (px, most) in enumerate(((smooth, 8), (np.full((h, w, 3), 77), 3), (r.integers(0, 256, (h, w, 3)), 40))):
        (tmp_path / f"{i}.jpg").write_bytes(sinks.encode_jpeg(px.astype(np.uint8)))
        back = image_files(spark, str(tmp_path / f"{i}.jpg"), strict=True).first()
        got = np.frombuffer(back.rgba, np.uint8).reshape(back.height, back.width, 4)
        assert got.shape == (h, w, 4) and np.abs(got[..., :3].astype(int) - px).max() <= most, i


def test_files_that_do_not_decode(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    assert image_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="UndecodableImage.*x.png"):
        image_files(spark, str(tmp_path), strict=True).collect()


def test_resizing(spark):
    px = [(x * 10, 100, 0) for y in range(8) for x in range(16)]
    r = resized_images(images(spark, (16, 8, px), (2, 2, px[:4])), 8, 8).orderBy("image_id").collect()
    assert [(x.width, x.height, x.resized) for x in r] == [(8, 4, True), (2, 2, False)]
    got = np.frombuffer(r[0].rgba, np.uint8).reshape(4, 8, 4)
    assert (got[..., 1] == 100).all() and (np.diff(got[0, :, 0].astype(int)) > 0).all() and bytes(r[1].rgba) == images(spark, (2, 2, px[:4])).first().rgba


def test_command_line_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"kmeansClusters": 5, "resize": {"enabled": true}}')
    s = main.settings(main.arguments(["-i", "a", "-o", "b", "-c", str(tmp_path / "c.json"), "--no-resize", "--border-smoothing-passes", "1"]))
    assert (s.kmeans_clusters, s.resize_enabled, s.border_smoothing_passes) == (5, False, 1)
    assert main.settings(main.arguments(["-i", "a", "-o", "b", "--resize-max-width", "7"])).resize_enabled
    assert main.settings(main.arguments(["-i", "a", "-o", "b", "-c", str(tmp_path / "none.json"), "-k", "9"])).kmeans_clusters == 9
    assert sinks.place("out/x.svg") == ("out", "x") and sinks.place("out") == ("out", "result")
