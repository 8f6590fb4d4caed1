"""Borders of facets: loops of unit steps, segments between changes of neighbour, smoothing, and segments that two facets share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEFT, TOP, RIGHT, BOTTOM = range(4)
#: Side of a pixel: where its neighbour lies, and where the step along it starts and ends, as (y, x) from the pixel. The facet is on the step's left.
SIDES = {LEFT: ((0, -1), (0, 0), (1, 0)), TOP: ((-1, 0), (0, 1), (0, 0)), RIGHT: ((0, 1), (1, 1), (0, 1)), BOTTOM: ((1, 0), (1, 0), (1, 1))}
#: Ends of two segments that are no farther apart than this can be the same border.
TOLERANCE = 4.0


class Steps:
    """All directed unit steps of a grid of facets (-1: none), by facet; within one, those of pixels on its bounds first, then by row and column of
    the start, then by side. Loops start at the first step that is left in this order."""

    def __init__(self, ids: np.ndarray):
        h, w = ids.shape
        self.shape, self.pad = ids.shape, np.pad(ids, 1, constant_values=-1)
        parts = []
        for side, ((dy, dx), (sy, sx), (ey, ex)) in SIDES.items():
            other = self.pad[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
            y, x = np.nonzero((other != ids) & (ids >= 0))
            parts.append(np.stack([ids[y, x], other[y, x], np.full(len(y), side), y, x, y + sy, x + sx, y + ey, x + ex]))
        e = np.concatenate(parts, axis=1).astype(np.int64)
        f, y, x = e[0], e[3], e[4]
        n = int(f.max(initial=-1)) + 1
        ends = []
        for v in (y, x):
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(low, f, v)
            np.maximum.at(high, f, v)
            ends += [v == low[f], v == high[f]]
        e = e[:, np.lexsort((e[2], e[6], e[5], ~np.logical_or.reduce(ends), f))]
        self.facet, self.neighbour, self.side = e[0], e[1], e[2]
        self.start, self.end = e[5:7], e[7:9]
        self._follow()

    def _follow(self) -> None:
        """The step that follows each, and the other one where two leave its end: the tightest turn to the left comes first."""
        h, w = self.shape
        at = lambda p: (self.facet * (h + 1) + p[0]) * (w + 1) + p[1]
        self.start_key, self.end_key = at(self.start), at(self.end)
        order = np.argsort(self.start_key, kind="stable")
        keys = self.start_key[order]
        lo, hi = np.searchsorted(keys, self.end_key, "left"), np.searchsorted(keys, self.end_key, "right")
        a, b = order[np.minimum(lo, len(order) - 1)], order[np.minimum(hi, len(order)) - 1]
        turn = lambda n: (self.side[n] - self.side + 1) % 4
        swap = turn(b) < turn(a)
        self.first, self.second = np.where(swap, b, a), np.where(swap, a, b)

    def loops(self) -> list[np.ndarray]:
        """Steps of each loop, in order. A loop ends where it comes back to its first corner."""
        seen, out = bytearray(len(self.facet)), []
        first, second, start, end = self.first.tolist(), self.second.tolist(), self.start_key.tolist(), self.end_key.tolist()
        for s in range(len(first)):
            if seen[s]:
                continue
            at, own = s, []
            while not seen[at]:
                seen[at] = 1
                own.append(at)
                if end[at] == start[s]:
                    break
                at = second[at] if seen[first[at]] else first[at]
            out.append(np.array(own))
        return out

    def corners(self, loop: np.ndarray) -> np.ndarray:
        """Points (x, y) of a loop: every start, then the last end."""
        return np.concatenate([self.start[::-1, loop], self.end[::-1, loop[-1:]]], axis=1).T.astype(np.float64)

    def segments(self, loop: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(neighbour, points) between changes: of the neighbour, or, at a turn, of the facet across the corner.

        What is left at the end joins the first segment if that has the same neighbour."""
        before, after = loop[:-1], loop[1:]
        n, a, b = self.neighbour, self.side[before], self.side[after]
        turns = (a - b) % 2 == 1
        row = self.end[0, before] - ((a == TOP) | (b == TOP))
        column = self.end[1, before] - ((a == LEFT) | (b == LEFT))
        across = self.pad[row + 1, column + 1]
        change = (n[before] != n[after]) | ((n[before] >= 0) & turns & (across != n[before]))
        points = self.corners(loop)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(loop)]
        out = [(int(n[loop[i]]), points[i : j + 1]) for i, j in zip(cuts, cuts[1:], strict=False)]
        if len(out) > 1 and out[0][0] == out[-1][0]:
            last = out.pop()[1]
            out[0] = out[0][0], np.concatenate([last[:-1] if (last[-1] == out[0][1][0]).all() else last, out[0][1]])
        return out


def area(points: np.ndarray) -> float:
    """Half the sum of cross products of a line of points; outer loops are negative, as y grows downwards."""
    x, y = points[:, 0], points[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def distinct(points: np.ndarray) -> np.ndarray:
    """Without points that equal the one before."""
    return points[np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)])]


def smoothed(points: np.ndarray, width: int, height: int, passes: int) -> np.ndarray:
    """The ends stay; points between them become the middles of pairs, but for pairs with a point on the canvas edge, which stay. A point without a pair goes.

    Lines of five points or fewer are left as they are."""
    for _ in range(passes):
        if len(points) <= 5:
            break
        k = (len(points) - 2) // 2
        a, b = points[1 : 2 * k : 2], points[2 : 2 * k + 1 : 2]
        edge = ((a <= 0) | (b <= 0) | (a >= (width, height)) | (b >= (width, height))).any(axis=1)
        both = np.stack([np.where(edge[:, None], a, (a + b) / 2), b], axis=1).reshape(-1, 2)
        stays = np.stack([np.ones(k, bool), edge], axis=1).ravel()
        points = distinct(np.concatenate([points[:1], both[stays], points[-1:]]))
    return points


def shared(segments: list[tuple[int, int, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Points of each (facet, neighbour, points) after two facets' segments along one border have become one line, and which were matched and reversed.

    In the order given, a segment takes its neighbour's first free one whose ends meet its own within TOLERANCE, straight or reversed, the
    nearer if both do; the other then has its points. Candidates are found by the pair of facets."""
    by: dict[tuple[int, int], list[int]] = {}
    for i, (f, n, _) in enumerate(segments):
        by.setdefault((f, n), []).append(i)
    points: list[np.ndarray | None] = [None] * len(segments)
    matched, reverse = np.zeros(len(segments), bool), np.zeros(len(segments), bool)
    for i, (f, n, own) in enumerate(segments):
        if points[i] is not None:
            continue
        points[i] = own
        for j in by.get((n, f), ()) if n >= 0 else ():
            if points[j] is not None:
                continue
            other = segments[j][2]
            gap = [np.hypot(*(own[p] - other[q])) for p, q in ((0, 0), (-1, -1), (0, -1), (-1, 0))]
            straight, back = max(gap[:2]) <= TOLERANCE, max(gap[2:]) <= TOLERANCE
            if straight or back:
                reverse[j] = back and not (straight and gap[0] + gap[1] <= gap[2] + gap[3])
                points[j] = own[::-1] if reverse[j] else own
                matched[[i, j]] = True
                break
    return points, matched, reverse


def bordered(ids: np.ndarray, passes: int) -> list[tuple]:
    """(facet, loop, area, outer, points, traced points, segments, those with a partner, those that take its points reversed): loops put together from smoothed, shared segments.

    A facet's loops come by area, the largest, the outer one, first; loops of fewer than four points go."""
    steps, h, w = Steps(ids), *ids.shape
    traced: dict[int, list] = {}
    for loop in steps.loops():
        traced.setdefault(int(steps.facet[loop[0]]), []).append(loop)
    segments, of = [], []
    for f, loops in traced.items():
        for k, loop in enumerate(sorted(loops, key=lambda p: -abs(area(steps.corners(p))))):
            for n, p in steps.segments(loop):
                segments.append((f, n, smoothed(p, w, h, passes)))
                of.append((f, k))
    points, matched, reverse = shared(segments)
    numbers = {f: [sum(map(len, loops)), 0, 0, 0] for f, loops in traced.items()}
    lines: dict[tuple[int, int], list[np.ndarray]] = {}
    for i, (f, k) in enumerate(of):
        lines.setdefault((f, k), []).append(points[i])
        numbers[f][1] += 1
        numbers[f][2] += int(matched[i])
        numbers[f][3] += int(reverse[i])
    made: dict[int, list] = {}
    for (f, _), p in lines.items():
        line = distinct(np.concatenate(p))
        if (line[0] != line[-1]).any():
            line = np.concatenate([line, line[:1]])
        if len(line) >= 4:
            made.setdefault(f, []).append((area(line), line))
    return [(f, i, a, i == 0, p, *numbers[f]) for f, all_ in made.items() for i, (a, p) in enumerate(sorted(all_, key=lambda t: -abs(t[0])))]


def grid(px: pd.DataFrame, value: str) -> np.ndarray:
    out = np.full((px["y"].max() + 1, px["x"].max() + 1), -1, np.int64)
    out[px["y"].to_numpy(), px["x"].to_numpy()] = px[value].to_numpy()
    return out


def paths(facets: DataFrame, passes: int = 2) -> DataFrame:
    """image_id, facet_id, loop_id, signed_area, is_outer, xs, ys and the facet's traced_points, segments, matched_segments and reversed_segments.

    An image is one group, as a segment's partner is another facet's; no facets give no rows."""
    names = ["facet_id", "loop_id", "signed_area", "is_outer", "xs", "ys", "traced_points", "segments", "matched_segments", "reversed_segments"]

    def run(px: pd.DataFrame) -> pd.DataFrame:
        rows = [(f, i, a, o, p[:, 0], p[:, 1], *n) for f, i, a, o, p, *n in bordered(grid(px, "facet_id"), passes)]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "image_id", px["image_id"].iloc[0])
        return out

    cols = facets.select("image_id", "x", "y", "facet_id")
    return cols.groupBy("image_id").applyInPandas(run, "image_id long, facet_id int, loop_id int, signed_area double, is_outer boolean, xs array<double>, ys array<double>, traced_points int, segments int, matched_segments int, reversed_segments int")
