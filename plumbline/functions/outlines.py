"""Outlines as drawn by hand or traced: hits, thinning, tidying, and snapping to drawn ends and lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.geometry import contains, edges, ring_distance, segment_distance

# How far (px) a point is pulled to a drawn end, how far from square an edge is squared (degrees), and the most that tidying may change an area (%).
ANCHOR, OFF_AXIS, MOST_DRIFT, SIMPLER, GAP = 6.0, 7.0, 3.0, 1.5, 2.0


def hit(role: Column, ring: Column, holes: Column, x: Column, y: Column, reach: Column) -> Column:
    """Whether a point hits a shape: a count within twice the reach, a run along its line, a floor inside (not in a hole) or at any edge."""
    steps = F.slice(edges(ring), 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    on_line = F.exists(steps, lambda e: segment_distance(x, y, e) < reach)
    at = F.try_element_at(ring, F.lit(1))
    near = F.hypot(at[0] - x, at[1] - y) < 2 * reach
    none = F.array().cast("array<array<array<double>>>")
    listed = F.coalesce(holes, none)
    inside = contains(ring, x, y) & ~F.exists(listed, lambda h: contains(h, x, y))
    at_edge = (ring_distance(ring, x, y) < reach) | F.exists(listed, lambda h: ring_distance(h, x, y) < reach)
    return F.coalesce(F.when(role == "count", near).when(role.isin("linear", "surface_area"), on_line).otherwise(inside | at_edge), F.lit(False))


def thinned(stroke: Column, least: float) -> Column:
    """A stroke without the points nearer than least to the last one kept; its first and last stay."""
    inner = F.slice(stroke, F.lit(2), F.greatest(F.size(stroke) - 2, F.lit(0)))
    far = lambda acc, p: F.hypot(p[0] - F.element_at(acc, -1)[0], p[1] - F.element_at(acc, -1)[1]) >= least
    kept = F.aggregate(inner, F.slice(stroke, 1, 1), lambda acc, p: F.when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return F.when(F.size(stroke) <= 2, stroke).otherwise(F.concat(kept, F.slice(stroke, -1, 1)))


def axis_locked(x: Column, y: Column, neighbours: Column, reach: float) -> Column:
    """[x, y] of a dragged point, each coordinate pulled to its nearest neighbour's within reach."""
    def one(value: Column, i: int) -> Column:
        near = F.array_sort(F.transform(F.filter(neighbours, lambda p: F.abs(p[i] - value) <= reach), lambda p: F.struct(F.abs(p[i] - value).alias("off"), p[i].alias("to"))))
        return F.coalesce(F.try_element_at(near, F.lit(1))["to"], value)

    return F.array(one(x, 0), one(y, 1))


def snapped(ring: np.ndarray, ends: np.ndarray, reach: float = ANCHOR, gap: float = GAP) -> np.ndarray:
    """A ring with its points on the nearest drawn end within reach, those that come together dropped; as it was if too few are left."""
    if not len(ends) or not len(ring):
        return ring
    away = np.hypot(ring[:, None, 0] - ends[:, 0], ring[:, None, 1] - ends[:, 1])
    best = away.argmin(1)
    moved = np.where((away[np.arange(len(ring)), best] <= reach)[:, None], ends[best], ring)
    kept: list[np.ndarray] = []
    for p in moved:
        if not kept or math.hypot(*(p - kept[-1])) > gap:
            kept.append(p)
    while len(kept) > 1 and math.hypot(*(kept[0] - kept[-1])) <= gap:
        kept.pop()
    return np.array(kept) if len(kept) >= 3 else ring


def _area(ring: np.ndarray) -> float:
    after = np.concatenate((ring[1:], ring[:1]))
    return abs(float(ring[:, 0] @ after[:, 1] - ring[:, 1] @ after[:, 0])) / 2


def _simpler(line: np.ndarray, reach: float) -> np.ndarray:
    """Points of an open line that matter to within reach: those furthest from the chords of the rest."""
    kept, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        long = math.hypot(*d)
        off = line[a + 1 : b] - line[a]
        away = np.abs(off[:, 0] * d[1] - off[:, 1] * d[0]) / long if long else np.hypot(off[:, 0], off[:, 1])
        k = int(away.argmax())
        if away[k] > reach:
            kept.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(kept))


def tidied(ring: np.ndarray, ends: np.ndarray, reach: float = ANCHOR) -> tuple[np.ndarray, bool]:
    """(ring, changed) of a traced ring made plain: points on drawn ends stay there, others are simplified between them, and edges nearly along
    an axis are squared; left as it was if its area would change by more than MOST_DRIFT %."""
    if len(ring) < 3:
        return ring, False
    away = np.hypot(ring[:, None, 0] - ends[:, 0], ring[:, None, 1] - ends[:, 1]) if len(ends) else np.full((len(ring), 1), np.inf)
    best = away.argmin(1)
    fixed = away[np.arange(len(ring)), best] <= reach
    pulled = np.where(fixed[:, None], ends[best], ring) if len(ends) else ring.copy()
    start = int(np.argmax(fixed)) if fixed.any() else int(np.argmax(np.hypot(*(pulled - pulled.mean(0)).T)))
    pulled, fixed = np.roll(pulled, -start, axis=0), np.roll(fixed, -start)
    closed, marks = np.append(pulled, pulled[:1], axis=0), np.append(np.flatnonzero(fixed), len(ring))
    if marks[0] != 0:
        marks = np.append(0, marks)
    if len(marks) == 2:  # one anchor, or none: halve the ring at its far side
        marks = np.array([0, int(np.argmax(np.hypot(*(pulled - pulled[0]).T))), len(ring)])
    keep = np.unique(np.concatenate([a + _simpler(closed[a : b + 1], SIMPLER) for a, b in zip(marks, marks[1:])]))
    keep = keep[keep < len(ring)]
    points, anchored = pulled[keep], fixed[keep]
    near = np.hypot(*(points - np.roll(points, 1, axis=0)).T) <= GAP
    points, anchored = points[~(near & ~anchored)], anchored[~(near & ~anchored)]
    if len(points) >= 3:
        step = np.abs(np.roll(points, -1, axis=0) - points)
        slack = math.tan(math.radians(OFF_AXIS))
        for _ in range(4):
            for i in range(len(points)):
                j = (i + 1) % len(points)
                axis = 1 if step[i, 1] <= slack * step[i, 0] else 0 if step[i, 0] <= slack * step[i, 1] else None
                if axis is not None and not (anchored[i] and anchored[j]):
                    to = points[i, axis] if anchored[i] else points[j, axis] if anchored[j] else (points[i, axis] + points[j, axis]) / 2
                    points[i, axis] = points[j, axis] = to
    before = _area(ring)
    if len(points) < 3 or not before or abs(_area(points) - before) / before * 100 > MOST_DRIFT:
        return ring, False
    return points, len(points) != len(ring) or not np.array_equal(np.roll(points, start, axis=0), ring)


def onto_lines(ring: np.ndarray, segments: np.ndarray, reach: float, least_cover: float = 0.35, degrees: float = 3.0) -> np.ndarray:
    """A ring with each edge moved onto the nearest parallel drawn line (x1, y1, x2, y2) within reach that runs along at least least_cover of it;
    corners are where the moved edges meet. Edges without such a line stay."""
    n = len(ring)
    if n < 3 or not reach > 0 or not len(segments):
        return ring
    a, d = ring, np.roll(ring, -1, axis=0) - ring
    long = np.hypot(d[:, 0], d[:, 1])
    u = d / np.where(long > 0, long, 1)[:, None]
    s = segments[:, 2:] - segments[:, :2]
    size = np.hypot(s[:, 0], s[:, 1])
    offset = np.zeros(n)
    for e in range(n):
        if not long[e] > 0:
            continue
        parallel = np.abs(u[e, 0] * s[:, 1] - u[e, 1] * s[:, 0]) <= math.sin(math.radians(degrees)) * size
        normal = np.array([-u[e, 1], u[e, 0]])
        off = ((segments[:, :2] - a[e]) @ normal + (segments[:, 2:] - a[e]) @ normal) / 2
        t = np.sort(np.column_stack([(segments[:, :2] - a[e]) @ u[e], (segments[:, 2:] - a[e]) @ u[e]]), axis=1)
        over = np.minimum(long[e], t[:, 1]) - np.maximum(0, t[:, 0])
        ok = parallel & (np.abs(off) <= reach) & (over > 0) & (size > 0)
        groups: dict[int, float] = {}
        for o, c in zip(np.round(off[ok], 6), over[ok]):
            groups[o] = groups.get(o, 0.0) + c
        fit = [o for o, c in groups.items() if c >= least_cover * long[e]]
        if fit:
            offset[e] = min(fit, key=lambda o: (abs(o), o))
    out = ring.astype(float).copy()
    for i in range(n):
        p, q = (i - 1) % n, i
        na, nb = np.array([-u[p, 1], u[p, 0]]), np.array([-u[q, 1], u[q, 0]])
        det = na[0] * nb[1] - na[1] * nb[0]
        ca, cb = na @ a[p] + offset[p], nb @ a[q] + offset[q]
        if abs(det) > 1e-9:
            corner = np.array([ca * nb[1] - cb * na[1], na[0] * cb - nb[0] * ca]) / det
            out[i] = corner if math.hypot(*(corner - ring[i])) <= 4 * reach else ring[i]
        else:
            out[i] = ring[i] + nb * offset[q]
    return out
