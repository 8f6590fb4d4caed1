"""Work within one image: the whole reduction, boundary loops and label places. An image is one group."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.operators.borders import Steps, area, grid
from hueweave.operators.regions import label
from hueweave.settings import Settings

def _graph(ids: np.ndarray) -> list[list[int]]:
    """Sorted neighbours of each facet."""
    pairs = np.concatenate([np.stack([ids[:, 1:].ravel(), ids[:, :-1].ravel()], 1), np.stack([ids[1:].ravel(), ids[:-1].ravel()], 1)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    out: list[list[int]] = [[] for _ in range(int(ids.max()) + 1)]
    for a, b in np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0).tolist():
        out[a].append(b)
    return out


def _owned(graph: list[list[int]], color: np.ndarray, palette: np.ndarray, keepers: list[int]) -> list[int]:
    """The keeper that each facet goes to: fewest hops, then least colour change along the way, then least id."""
    best: dict[int, tuple] = {}
    heap = [(0, 0, k, k) for k in keepers]
    while heap:
        hops, change, owner, at = heapq.heappop(heap)
        if at in best:
            continue
        best[at] = (hops, change, owner)
        for n in graph[at]:
            if n not in best:
                heapq.heappush(heap, (hops + 1, change + int(((palette[color[at]] - palette[color[n]]) ** 2).sum()), owner, n))
    return [best[i][2] if i in best else i for i in range(len(graph))]


def _split(ids: np.ndarray, facet: int, pixels: np.ndarray, eligible: set[int], color: np.ndarray, palette: np.ndarray) -> dict[tuple[int, int], int]:
    """A large facet's pixels (places in the flat raster), each to the neighbour that reaches it first from the border, then the nearest in colour, then the least id."""
    h, w = ids.shape
    own = {divmod(p, w) for p in pixels.tolist()}
    change = {n: int(((palette[color[facet]] - palette[color[n]]) ** 2).sum()) for n in eligible}
    near = lambda y, x: [(y + b, x + a) for a, b in ((-1, 0), (0, -1), (1, 0), (0, 1)) if 0 <= x + a < w and 0 <= y + b < h]
    heap = [(1, change[ids[q]], int(ids[q]), p) for p in own for q in near(*p) if ids[q] in eligible]
    heapq.heapify(heap)
    out: dict[tuple[int, int], int] = {}
    while heap:
        d, c, owner, p = heapq.heappop(heap)
        if p not in out:
            out[p] = owner
            for q in near(*p):
                if q in own and q not in out:
                    heapq.heappush(heap, (d + 1, c, owner, q))
    return out


def reduce_grid(grid: np.ndarray, palette: np.ndarray, s: Settings) -> np.ndarray:
    """Rounds of merging until none is left to merge or none can be: first, once, everything beyond the cap goes to the facets that stay, then facets under size
    go to neighbours, all from one snapshot a round. Facets of over 64 pixels with several neighbours are split among them."""
    capped = False
    while True:
        ids = label(grid)
        count = np.bincount(ids.ravel())
        color = np.zeros(len(count), np.int64)
        color[ids.ravel()] = grid.ravel()
        small = np.flatnonzero(count < s.remove_facets_smaller_than)
        over = len(count) > s.maximum_number_of_facets
        if not len(small) and not over:
            return grid
        graph = _graph(ids)
        if over and not capped:
            capped = True
            keepers = sorted(range(len(count)), key=lambda i: (-count[i], i))[: max(1, s.maximum_number_of_facets)]
            grid = color[_owned(graph, color, palette, keepers)][ids]
            continue
        protected, new = set(small.tolist()), grid.copy()
        far, tone, size = ((palette[:, None] - palette[None]) ** 2).sum(axis=2).tolist(), color.tolist(), count.tolist()
        # pixels by facet, so that a facet costs its own pixels and not the canvas
        flat, order, ends = new.reshape(-1), np.argsort(ids, axis=None, kind="stable"), np.cumsum(count)
        for f in small.tolist():
            own = order[ends[f] - count[f] : ends[f]]
            eligible = [n for n in graph[f] if n not in protected] or [n for n in graph[f] if n > f]
            if not eligible:
                continue
            if len(eligible) == 1 or size[f] <= 64:
                near = far[tone[f]]
                flat[own] = tone[min(eligible, key=lambda n: (near[tone[n]], n))]
            else:
                for p, owner in _split(ids, f, own, set(eligible), color, palette).items():
                    new[p] = color[owner]
        if (new == grid).all():
            return grid
        grid = new


def reduced(index: DataFrame, palette: DataFrame, s: Settings) -> DataFrame:
    """image_id, x, y, color_index after reduction; palette(image_id, color_index, r, g, b)."""

    def run(px: pd.DataFrame, colours: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((int(px["color_index"].max()) + 1 if len(px) else 1, 3), np.int64)
        used = colours[colours["color_index"] < len(table)]
        table[used["color_index"].to_numpy()] = used[["r", "g", "b"]].to_numpy()
        if len(px):
            own = grid(px, "color_index")
            if (own >= 0).all():
                px = px.assign(color_index=reduce_grid(own, table, s)[px["y"].to_numpy(), px["x"].to_numpy()])
            else:  # a canvas whose last row is not full: what is missing is a facet that stays
                table = np.concatenate([table, [[0, 0, 0]]])
                size = int((own < 0).sum())
                full = np.where(own < 0, len(table) - 1, own)
                px = px.assign(color_index=reduce_grid(full, table, s)[px["y"].to_numpy(), px["x"].to_numpy()] if size >= s.remove_facets_smaller_than else px["color_index"])
        return px

    # both sides may stem from one plan, so their columns get names of their own
    cols = index.select(*[F.col(c).alias(f"px_{c}") for c in ("image_id", "x", "y", "color_index")])
    own = palette.select(*[F.col(c).alias(f"pal_{c}") for c in ("image_id", "color_index", "r", "g", "b")])
    plain = lambda df: df.rename(columns=lambda c: c.split("_", 1)[1])
    return cols.groupBy("px_image_id").cogroup(own.groupBy("pal_image_id")).applyInPandas(lambda a, b: run(plain(a), plain(b)), "image_id long, x int, y int, color_index int")


def loops(facets: DataFrame) -> DataFrame:
    """image_id, facet_id, loop_id, signed_area, is_outer, xs, ys: unsmoothed loops of each facet, the largest first, which is the outer one."""

    def run(px: pd.DataFrame) -> pd.DataFrame:
        steps, traced = Steps(grid(px, "facet_id")), {}
        for p in steps.loops():
            line = steps.corners(p)
            traced.setdefault(int(steps.facet[p[0]]), []).append((area(line), line[:-1].astype(int)))
        rows = [(px["image_id"].iloc[0], f, i, a, i == 0, p[:, 0], p[:, 1]) for f, all_ in traced.items() for i, (a, p) in enumerate(sorted(all_, key=lambda t: -abs(t[0])))]
        return pd.DataFrame(rows, columns=["image_id", "facet_id", "loop_id", "signed_area", "is_outer", "xs", "ys"])

    cols = facets.select("image_id", "x", "y", "facet_id")
    return cols.groupBy("image_id").applyInPandas(run, "image_id long, facet_id int, loop_id int, signed_area double, is_outer boolean, xs array<int>, ys array<int>")


def _distance(x: float, y: float, rings: list[np.ndarray]) -> float:
    """To the nearest edge, negative outside by the even-odd rule."""
    inside, best = False, math.inf
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        cross = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
        inside ^= bool(cross.sum() % 2)
        d = b - a
        t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.maximum((d * d).sum(axis=1), 1e-12), 0, 1)
        best = min(best, float(((a[:, 0] + t * d[:, 0] - x) ** 2 + (a[:, 1] + t * d[:, 1] - y) ** 2).min()))
    return math.sqrt(best) * (1 if inside else -1)


def _centroid(ring: np.ndarray) -> tuple[float, float]:
    """The centre of mass of a ring's area, or its first point where it has none."""
    after = np.roll(ring, -1, axis=0)
    cross = ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]
    if abs(cross.sum()) < 1e-12:
        return float(ring[0, 0]), float(ring[0, 1])
    x, y = ((ring + after) * cross[:, None]).sum(axis=0) / (3 * cross.sum())
    return float(x), float(y)


def outer_first(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The ring of the largest area first, of equal ones the last."""
    size = [abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())) for r in rings]
    outer = max(range(len(rings)), key=lambda i: (size[i], i))
    return [rings[outer], *rings[:outer], *rings[outer + 1 :]]


def inmost(rings: list[np.ndarray], precision: float = 1.0) -> tuple[float, float, float]:
    """The point farthest from the polygon's edges, to within `precision`: cells are split while they could hold a better one.

    The outer ring's centroid stands, then the middle of its bounds, until something is better by itself."""
    lo, hi = rings[0].min(axis=0), rings[0].max(axis=0)
    size = float(min(hi - lo))
    if size <= 0:
        return float(lo[0]), float(lo[1]), 0.0
    cell = lambda x, y, h: (lambda d: (-(d + h * math.sqrt(2)), x, y, h, d))(_distance(x, y, rings))
    half = size / 2
    queue = [cell(float(x) + half, float(y) + half, half) for x in np.arange(lo[0], hi[0], size) for y in np.arange(lo[1], hi[1], size)]
    heapq.heapify(queue)
    best = max(cell(*_centroid(rings[0]), 0.0), cell(*((lo + hi) / 2).tolist(), 0.0), key=lambda c: c[4])
    while queue:
        c = heapq.heappop(queue)
        if c[4] > best[4]:
            best = c
        if -c[0] - best[4] <= precision:
            break
        h = c[3] / 2
        for a in (-h, h):
            for b in (-h, h):
                heapq.heappush(queue, cell(c[1] + a, c[2] + b, h))
    return best[1], best[2], best[4]


def labels(loops_: DataFrame, stats: DataFrame) -> DataFrame:
    """image_id, facet_id, min_x, min_y, width, height: a box about the inmost point, within the facet's bounds;
    the bounds themselves for facets without loops."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f, own in rows.sort_values("loop_id").groupby("facet_id"):
            rings = [np.stack([np.asarray(x, float), np.asarray(y, float)], 1) for x, y in zip(own["xs"], own["ys"], strict=True)]
            out.append((own["image_id"].iloc[0], f, *inmost(outer_first(rings))))
        return pd.DataFrame(out, columns=["image_id", "facet_id", "px", "py", "d"])

    at = loops_.select("image_id", "facet_id", "loop_id", "xs", "ys").groupBy("image_id").applyInPandas(run, "image_id long, facet_id int, px double, py double, d double")
    reach = F.greatest(F.col("d") / F.sqrt(F.lit(2.0)), F.lit(0.5))
    within = lambda v, lo, hi: F.greatest(lo, F.least(v, hi)).cast("int")
    box = {}
    for c in "xy":
        lo, hi, at_c = F.col(f"min_{c}"), F.col(f"max_{c}"), F.col(f"p{c}")
        box |= {f"{c}0": F.coalesce(within(F.floor(at_c - reach), lo, hi), lo), f"{c}1": F.coalesce(within(F.ceil(at_c + reach), lo + 1, hi + 1), hi + 1)}
    b = stats.join(at, ["image_id", "facet_id"], "left").select("image_id", "facet_id", *[v.alias(k) for k, v in box.items()])
    return b.select("image_id", "facet_id", F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), *[F.greatest(F.lit(1), F.col(f"{c}1") - F.col(f"{c}0")).cast("int").alias(n) for c, n in (("x", "width"), ("y", "height"))])
