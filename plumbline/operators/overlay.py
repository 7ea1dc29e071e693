"""Areas of overlays of general polygons, and open runs against rings.

Between two neighbouring heights at which some edge ends or two edges cross, every polygon is a set of trapezoids whose
sides keep their order, so the measure of any overlay there is its width at the middle times the height: exact up to
rounding, without building the overlay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grid import boxed, meeting
from plumbline.operators.scope import touching_pairs
from plumbline.plans.scratch import spread

# Fixed value: up to so many edges, arrays cost more than plain numbers.
FEW_EDGES = 48


def edges_of(rings: list[np.ndarray]) -> np.ndarray:
    """(ax, ay, bx, by) of all edges of a polygon's rings, its hull first, then its holes."""
    return np.concatenate([np.column_stack([r, np.roll(r, -1, axis=0)]) for r in rings]) if rings else np.zeros((0, 4))


def crossings(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Heights at which edges of e and f cross."""
    a, b = e[:, None, :], f[None, :, :]
    rx, ry, sx, sy = a[..., 2] - a[..., 0], a[..., 3] - a[..., 1], b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
    det = rx * sy - ry * sx
    skew = np.where(det != 0, det, 1)
    t = ((b[..., 0] - a[..., 0]) * sy - (b[..., 1] - a[..., 1]) * sx) / skew
    u = ((b[..., 0] - a[..., 0]) * ry - (b[..., 1] - a[..., 1]) * rx) / skew
    hit = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return (a[..., 1] + t * ry)[hit]


def _slabs(polygons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(polygons)
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], crossings(every, every)]))
    return (heights[1:] + heights[:-1]) / 2, np.diff(heights)


def _spans(edges: np.ndarray, y: float) -> np.ndarray:
    """Intervals of a polygon at a height, by the even-odd rule."""
    cut = (edges[:, 1] > y) != (edges[:, 3] > y)
    e = edges[cut]
    return np.sort(e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])).reshape(-1, 2)


def _measure(cover: list[np.ndarray], at_least: int) -> float:
    """Length that at least so many of the interval sets cover."""
    ends = np.concatenate(cover) if cover else np.zeros((0, 2))
    if not len(ends):
        return 0.0
    x = np.concatenate([ends[:, 0], ends[:, 1]])
    step = np.concatenate([np.ones(len(ends)), -np.ones(len(ends))])
    order = np.argsort(x, kind="stable")
    return float((np.diff(x[order]) * (np.cumsum(step[order])[:-1] >= at_least)).sum())


def _plain_area(polygons: list[list[tuple]], at_least: int) -> float:
    """overlay_area() of polygons of a few edges each, in plain numbers: most of an array's time would go into its making."""
    every = [e for p in polygons for e in p]
    heights = {y for e in every for y in (e[1], e[3])}
    for i, (ax, ay, bx, by) in enumerate(every):
        rx, ry = bx - ax, by - ay
        for cx, cy, dx, dy in every[:i]:
            sx, sy = dx - cx, dy - cy
            det = rx * sy - ry * sx
            if det and 0 < ((cx - ax) * sy - (cy - ay) * sx) / det < 1 and 0 < ((cx - ax) * ry - (cy - ay) * rx) / det < 1:
                heights.add(ay + ((cx - ax) * sy - (cy - ay) * sx) / det * ry)
    heights = sorted(heights)
    total = 0.0
    for low, high in zip(heights, heights[1:]):
        y = (low + high) / 2
        ends = []
        for p in polygons:
            at = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for ax, ay, bx, by in p if (ay > y) != (by > y))
            ends += [(x, 1 - 2 * (k % 2)) for k, x in enumerate(at)]
        ends.sort(key=lambda e: e[0])
        depth, width = 0, 0.0
        for (x, step), (after, _) in zip(ends, ends[1:]):
            depth += step
            if depth >= at_least:
                width += after - x
        total += width * (high - low)
    return total


def overlay_area(polygons: list[list[np.ndarray]], at_least: int) -> float:
    """Area that at least so many of the polygons cover: 1 is their union, len(polygons) their intersection."""
    cuts = [edges_of(p) for p in polygons]
    if sum(map(len, cuts)) <= FEW_EDGES:
        plain = [c.tolist() for c in cuts]
        if math.isfinite(sum(v for p in plain for e in p for v in e)):
            return _plain_area(plain, at_least)
    middle, height = _slabs(cuts)
    return float(sum(_measure([_spans(e, y) for e in cuts], at_least) * h for y, h in zip(middle, height)))


def repaired(ring: np.ndarray) -> tuple[np.ndarray | None, str | None]:
    """A ring fit for overlay, or why there is none: repeated points go; too few points and no area are reasons."""
    return measured(ring)[:2]


def measured(ring: np.ndarray) -> tuple[np.ndarray | None, str | None, float | None]:
    """repaired(), and the area."""
    if len(ring):
        ring = ring[np.append(True, (np.diff(ring, axis=0) != 0).any(1))]
        if len(ring) > 1 and (ring[0] == ring[-1]).all():
            ring = ring[:-1]
    if len(ring) < 3:
        return None, "fewer than three points", None
    size = overlay_area([[ring]], 1)
    return (None, "no area", None) if size <= 0 else (ring, None, size)


def polygon_collisions(shapes: DataFrame, least_fraction: float = 0.05) -> DataFrame:
    """Overlapping pairs of polygons (sheet_id, id, condition_id, ring): boxes meet in the join, areas are measured after it."""
    met = touching_pairs(boxed(shapes.select("sheet_id", "id", "condition_id", "ring"))).select("sheet_id", "a_id", "b_id", "a_condition_id", "b_condition_id", "a_ring", "b_ring")

    def compared(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                (a, _, one), (b, _, two) = (measured(np.array([list(p) for p in r], float)) for r in (row.a_ring, row.b_ring))
                if a is None or b is None:
                    continue
                shared = overlay_area([[a], [b]], 2)
                if shared > 64 * np.finfo(float).eps * max(one, two) and shared / min(one, two) >= least_fraction:
                    out.append((row.sheet_id, row.a_id, row.b_id, shared, shared / min(one, two), row.a_condition_id == row.b_condition_id))
            yield pd.DataFrame(out, columns=["sheet_id", "a_id", "b_id", "shared", "fraction", "same_condition"])

    kinds = dict(met.dtypes)
    return spread(met).mapInPandas(compared, f"sheet_id {kinds['sheet_id']}, a_id {kinds['a_id']}, b_id {kinds['b_id']}, shared double, fraction double, same_condition boolean")


def polygons(shapes: DataFrame) -> DataFrame:
    """(id, status, reason, area) of shapes (id, ring) as polygons: measured after one repair, or unmeasured and why."""

    def run(frames):
        for frame in frames:
            out = []
            for i, ring in zip(frame["id"], frame["ring"]):
                fit, why, size = measured(np.array([list(p) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2)))
                out.append((i, "unmeasured" if fit is None else "measured", why, size))
            yield pd.DataFrame(out, columns=["id", "status", "reason", "area"])

    return spread(shapes.select("id", "ring")).mapInPandas(run, "id long, status string, reason string, area double")


def outside_runs(line: np.ndarray, ring: np.ndarray) -> list[np.ndarray]:
    """The pieces of an open run that lie outside a ring, in order."""
    edges = edges_of([ring])
    pieces: list[list[np.ndarray]] = []
    for a, b in zip(line[:-1], line[1:]):
        d, t = b - a, [0.0, 1.0]
        for e in edges:
            s = e[2:] - e[:2]
            det = d[0] * s[1] - d[1] * s[0]
            if det != 0:
                w = e[:2] - a
                p, q = (w[0] * s[1] - w[1] * s[0]) / det, (w[0] * d[1] - w[1] * d[0]) / det
                if 0 < p < 1 and 0 <= q <= 1:
                    t.append(p)
        t = np.unique(t)
        for lo, hi in zip(t[:-1], t[1:]):
            x, y = a + d * (lo + hi) / 2
            cut = (edges[:, 1] > y) != (edges[:, 3] > y)
            e = edges[cut]
            inside = (x < e[:, 0] + (y - e[:, 1]) / np.where(e[:, 3] == e[:, 1], 1, e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])).sum() % 2 == 1
            if inside:
                continue
            start, end = a + d * lo, a + d * hi
            if pieces and np.allclose(pieces[-1][-1], start):
                pieces[-1].append(end)
            else:
                pieces.append([start, end])
    return [np.array(p) for p in pieces]


def clipped_runs(runs: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, length_before, length_after, pieces, outcome) of open runs (sheet_id, id, line) cut by all rings (sheet_id, ring) of
    their sheet: whole, cut into pieces, or erased; a row for each run."""
    met = meeting(boxed(runs.select("sheet_id", "id", "line"), "line"), boxed(rings.select("sheet_id", "ring")))
    near = met.groupBy(F.col("a.id").alias("cut_id")).agg(F.collect_list("b.ring").alias("rings"))
    joined = runs.select("id", "line").join(near, F.col("id") == F.col("cut_id"), "left").select("id", "line", "rings")

    def clip(frames):
        length = lambda z: float(np.hypot(*np.diff(z, axis=0).T).sum()) if len(z) > 1 else 0.0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                line = np.array([list(p) for p in row.line], float)
                pieces = [line]
                for ring in row.rings if row.rings is not None else ():
                    pieces = [q for p in pieces for q in outside_runs(p, np.array([list(z) for z in ring], float))]
                before, after = length(line), sum(map(length, pieces), 0.0)
                outcome = "whole" if before - after < 1e-9 else "erased" if after < 1e-9 else "cut"
                out.append((row.id, before, after, len(pieces) if outcome != "erased" else 0, outcome))
            yield pd.DataFrame(out, columns=["id", "length_before", "length_after", "pieces", "outcome"])

    return joined.mapInPandas(clip, "id long, length_before double, length_after double, pieces long, outcome string")
