"""Runs that two floors share: where one ring follows another, what lies between them, and which of them commit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import round1, round2_fixed
from plumbline.operators.grid import boxed, meeting
from plumbline.operators.overlay import edges_of
from plumbline.plans.scratch import spread

# Fixed values, in feet: distance of samples, what counts as touching, the widest gap, the shortest run; the most samples of a ring,
# the cosine up to which a ring runs alongside, what counts as the same point, and how finely an end is sought.
STEP, TOUCH, WIDEST, SHORTEST = 0.25, 1 / 12, 1.0, 1.0
MOST_SAMPLES, ALONGSIDE, COINCIDENT, HALVINGS = 1_000_000, 0.5, 1e-9, 24
# Fixed value: up to so many edges, arrays cost more than plain numbers.
FEW_EDGES = 64


def samples(ring: np.ndarray, step: float = STEP) -> np.ndarray:
    """Points along a ring at most step apart, every corner among them; none for a step or ring that asks for too many."""
    if not step > 0 or len(ring) < 3:
        return np.zeros((0, 2))
    legs = np.roll(ring, -1, axis=0) - ring
    long = np.hypot(legs[:, 0], legs[:, 1])
    pieces = np.where(long > 0, np.maximum(1, np.ceil(long / step)), 0)
    if not np.isfinite(pieces).all() or pieces.sum() > MOST_SAMPLES:
        return np.zeros((0, 2))
    n = pieces.astype(np.int64)
    leg = np.repeat(np.arange(len(ring)), n)
    share = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) / np.maximum(n[leg], 1)
    return ring[leg] + legs[leg] * share[:, None]


def nearest(points: np.ndarray, ring: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(distance, nearest point) of each point to a ring's edges."""
    e = edges_of([ring])
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    square = (d * d).sum(1)
    far, at = [np.zeros(0)], [np.zeros((0, 2))]
    for k in range(0, len(points), block):
        p = points[k : k + block]
        t = np.clip(((p[:, None] - a) * d).sum(2) / np.where(square > 0, square, 1), 0, 1)
        foot = a + t[..., None] * d
        away = np.hypot(*np.moveaxis(p[:, None] - foot, 2, 0))
        best = away.argmin(1)
        far.append(away[np.arange(len(p)), best])
        at.append(foot[np.arange(len(p)), best])
    return np.concatenate(far), np.concatenate(at)


def alongside(points: np.ndarray, heading: np.ndarray, ring: np.ndarray, widest: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether each point runs beside the ring, its distance): near, and the ring lies across the heading rather than ahead."""
    far, at = nearest(points, ring)
    off = at - points
    long = np.hypot(heading[:, 0], heading[:, 1])
    ahead = np.abs((heading * off).sum(1)) <= ALONGSIDE * long * far
    return (far <= widest) & (long > 0) & (ahead | (far < COINCIDENT)), far


def islands(near: np.ndarray) -> list[np.ndarray]:
    """Indices of the maximal runs of true values around a ring: a run may go over its start."""
    if near.all():
        return [np.arange(len(near))]
    start = int(np.argmin(near))  # a false value: no run goes over it
    turned = np.roll(near, -start)
    edge = np.diff(np.concatenate([[0], turned.astype(int), [0]]))
    return [(np.arange(a, b) + start) % len(near) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _beside(x: float, y: float, hx: float, hy: float, edges: list[tuple], widest: float) -> bool:
    """alongside() of one point."""
    far, fx, fy = math.inf, 0.0, 0.0
    for ax, ay, dx, dy in edges:
        square = dx * dx + dy * dy
        t = min(max(((x - ax) * dx + (y - ay) * dy) / square, 0.0), 1.0) if square > 0 else 0.0
        px, py = ax + t * dx, ay + t * dy
        away = math.hypot(x - px, y - py)
        if away < far:
            far, fx, fy = away, px, py
    long = math.hypot(hx, hy)
    return far <= widest and long > 0 and (abs(hx * (fx - x) + hy * (fy - y)) <= ALONGSIDE * long * far or far < COINCIDENT)


def _end(inside: np.ndarray, outside: np.ndarray, ring: np.ndarray, widest: float) -> np.ndarray:
    """The furthest point from a sample inside a run towards its neighbour outside that still runs alongside."""
    heading = (outside - inside)[None]
    low, high = 0.0, 1.0
    few = ring.tolist() if len(ring) <= FEW_EDGES else None  # plain numbers: most of an array's time would go into its making
    edges = few and [(*p, q[0] - p[0], q[1] - p[1]) for p, q in zip(few, few[1:] + few[:1])]
    (x, y), (hx, hy) = inside.tolist(), heading[0].tolist()
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if _beside(x + hx * middle, y + hy * middle, hx, hy, edges, widest) if edges else alongside(inside[None] + heading * middle, heading, ring, widest)[0][0]:
            low = middle
        else:
            high = middle
    return inside + heading[0] * low


def without_collinear(path: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """A path without the points that lie on the line between their neighbours."""
    if len(path) < 3:
        return path
    kept = [path[0]]
    for b, c in zip(path[1:-1], path[2:]):
        a = kept[-1]
        chord = c - a
        long = np.hypot(*chord)
        if not long > 0 or abs((b - a)[0] * chord[1] - (b - a)[1] * chord[0]) / long > tolerance:
            kept.append(b)
    return np.array([*kept, path[-1]])


def shared_runs(a: np.ndarray, b: np.ndarray, step: float = STEP, touch: float = TOUCH, widest: float = WIDEST, shortest: float = SHORTEST) -> list[tuple[float, float, str, np.ndarray]]:
    """(length, median gap, status, path) of each run of ring a along ring b: butt where they touch, withheld where a wall may lie between."""
    points = samples(a, step)
    if len(points) < 2 or len(b) < 3:
        return []
    beside, gap = alongside(points, np.roll(points, -1, axis=0) - np.roll(points, 1, axis=0), b, widest)
    out = []
    for run in islands(beside) if beside.any() else ():
        path = points[run]
        if len(run) < len(points):
            head, tail = _end(path[0], points[(run[0] - 1) % len(points)], b, widest), _end(path[-1], points[(run[-1] + 1) % len(points)], b, widest)
            path = np.concatenate([[head], path, [tail]])
        long, middle = float(np.hypot(*np.diff(path, axis=0).T).sum()), float(np.median(gap[run]))
        if long >= shortest:
            out.append((long, middle, "butt" if middle <= touch else "withheld", without_collinear(path)))
    return out


def transitions(rings: DataFrame) -> DataFrame:
    """rings: (sheet_id, id, condition_id, ring in feet); runs between floors of different conditions on a sheet, walked along the
    floor of the lower id: length and gap as measured, and the path. A wall-separated run is withheld, not committed."""
    wide = boxed(rings.select("sheet_id", "id", "condition_id", "ring"), margin=WIDEST / 2)
    met = meeting(wide, wide).where("a.id < b.id AND a.condition_id <> b.condition_id")
    pairs = met.select(F.col("a.sheet_id").alias("sheet_id"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("a.ring").alias("a_ring"), F.col("b.ring").alias("b_ring"))

    def measured(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                a, b = (np.array([list(p) for p in r], float) for r in (row.a_ring, row.b_ring))
                out += [(row.sheet_id, row.a_id, row.b_id, k, long, gap, status, path.tolist()) for k, (long, gap, status, path) in enumerate(shared_runs(a, b))]
            yield pd.DataFrame(out, columns=["sheet_id", "a_id", "b_id", "run", "length", "gap", "status", "path"])

    return spread(pairs).mapInPandas(measured, "sheet_id long, a_id long, b_id long, run long, length double, gap double, status string, path array<array<double>>")


def committed(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What becomes of transition runs, with door thresholds (sheet_id, a_id, b_id, length, gap) beside them: butt runs commit, a door
    between two floors commits its own width, and a wall-separated run of such a pair is answered by it; others stay withheld, and why."""
    doors = thresholds.select("sheet_id", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "length", "gap")
    paired = doors.select("sheet_id", "a_id", "b_id", F.lit(True).alias("has_door")).distinct()
    judged = runs.join(paired, ["sheet_id", "a_id", "b_id"], "left").where("status = 'butt' OR has_door IS NULL")
    butt = F.col("status") == "butt"
    rows = judged.select("sheet_id", "a_id", "b_id", round2_fixed(F.col("length")).alias("length_lf"), round1(F.col("gap") * 12).alias("gap_in"), F.when(butt, "butt").otherwise("wall").alias("case"), F.when(butt, "committed").otherwise("withheld").alias("status"), F.when(~butt, "wall between, no door found").alias("reason"))
    more = doors.select("sheet_id", "a_id", "b_id", round2_fixed(F.col("length")).alias("length_lf"), round1(F.col("gap") * 12).alias("gap_in"), F.lit("door").alias("case"), F.lit("committed").alias("status"), F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(more)


def refusal(on: str, a: str, b: str, floors_a: int, floors_b: int, unscaled: list[str] = ()) -> str | None:
    """Why transitions between two finishes can't be derived onto a condition, or None: they land on a tag of their own, between two
    different finishes that have floors, on sheets with a scale."""
    if not a or not b:
        return "two finishes are needed"
    if a == b:
        return "a finish has no transition to itself"
    if on in (a, b):
        return "a transition needs a condition of its own"
    empty = next((tag for tag, n in ((a, floors_a), (b, floors_b)) if not n), None)
    if empty:
        return f"{empty} has no floors"
    return f"{', '.join(unscaled)} without a scale" if unscaled else None
