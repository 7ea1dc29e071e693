"""Lines and curves in NumPy: simplification, arcs, splines, the least rectangle about points; and their Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: the points that keep an open line within tolerance, ends always."""
    keep = np.zeros(len(line), bool)
    if not len(line):
        return line
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, mid = line[b] - line[a], line[a + 1 : b] - line[a]
        long = math.hypot(*d)
        off = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / long if long else np.hypot(*mid.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def simplified_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring is cut at its first point and the one furthest from it, and both halves simplified."""
    if len(ring) < 4:
        return ring
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    one, two = simplified(ring[: far + 1], tolerance), simplified(np.vstack([ring[far:], ring[:1]]), tolerance)
    return np.vstack([one[:-1], two[:-1]])


def circle_through(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float] | None:
    """(centre, radius); None for points on a line."""
    p, q = b - a, c - a
    det = 2 * (p[0] * q[1] - p[1] * q[0])
    if abs(det) < 1e-12:
        return None
    s = np.array([q[1] * p.dot(p) - p[1] * q.dot(q), p[0] * q.dot(q) - q[0] * p.dot(p)]) / det
    return a + s, float(np.hypot(*s))


def _turns(a: np.ndarray, b: np.ndarray, c: np.ndarray, centre: np.ndarray) -> tuple[float, float]:
    angle = lambda p: math.atan2(*(p - centre)[::-1])
    start, through, end = angle(a), (angle(b) - angle(a)) % (2 * math.pi), (angle(c) - angle(a)) % (2 * math.pi)
    return start, end if through <= end else end - 2 * math.pi


def arc_length(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Length of the arc from a through b to c; straight where they are on a line."""
    circle = circle_through(a, b, c)
    if circle is None:
        return float(np.hypot(*(b - a)) + np.hypot(*(c - b)))
    return abs(_turns(a, b, c, circle[0])[1]) * circle[1]


def flat_arc(a: np.ndarray, b: np.ndarray, c: np.ndarray, tolerance: float = 0.05) -> np.ndarray:
    """Points of the arc so close that no chord leaves it by more than tolerance."""
    circle = circle_through(a, b, c)
    if circle is None:
        return np.array([a, b, c])
    centre, radius = circle
    start, sweep = _turns(a, b, c, centre)
    step = 2 * math.acos(max(-1.0, 1 - min(tolerance, radius) / radius))
    t = start + np.linspace(0, sweep, max(2, math.ceil(abs(sweep) / max(step, 1e-3)) + 1))
    out = centre + radius * np.column_stack([np.cos(t), np.sin(t)])
    out[0], out[-1] = a, c
    return out


def spline(points: np.ndarray, steps: int = 8) -> np.ndarray:
    """Catmull-Rom through all points, steps pieces between neighbours."""
    if len(points) < 3:
        return points
    p = np.vstack([2 * points[0] - points[1], points, 2 * points[-1] - points[-2]])
    t = np.linspace(0, 1, steps, endpoint=False)[:, None]
    parts = [0.5 * (2 * p[i] + (p[i + 1] - p[i - 1]) * t + (2 * p[i - 1] - 5 * p[i] + 4 * p[i + 1] - p[i + 2]) * t**2 + (3 * p[i] - p[i - 1] - 3 * p[i + 1] + p[i + 2]) * t**3) for i in range(1, len(p) - 2)]
    return np.vstack([*parts, points[-1:]])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(items):
        out: list[np.ndarray] = []
        for q in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, tilt in degrees below 90) of the smallest rectangle about points; a side of the hull lies along it, ties
    go to the least tilt."""
    h = hull(points)
    if len(h) < 3:
        d = h[-1] - h[0] if len(h) else np.zeros(2)
        return float(np.hypot(*d)), 0.0, math.degrees(math.atan2(d[1], d[0])) % 90
    best = None
    for d in np.roll(h, -1, axis=0) - h:
        u = d / np.hypot(*d)
        x, y = h @ u, h @ np.array([-u[1], u[0]])
        w, v = np.ptp(x), np.ptp(y)
        tilt = math.degrees(math.atan2(u[1], u[0])) % 90
        key = (round(w * v, 9), tilt)
        if best is None or key < best[0]:
            best = (key, (float(max(w, v)), float(min(w, v)), tilt))
    return best[1]


def _points(value) -> np.ndarray:
    return np.array([list(p) for p in value], float).reshape(-1, 2)


def simplify(line: Column, tolerance: float) -> Column:
    """Simplified open lines, by Arrow batches."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: None if v is None else simplified(_points(v), tolerance).tolist())

    return run(line)


def rectangle_sides(points: Column) -> Column:
    """[long, short, tilt] of the least rectangle, by Arrow batches."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else list(least_rectangle(_points(v))))

    return run(points)
