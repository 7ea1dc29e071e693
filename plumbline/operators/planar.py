"""The planar subdivision that a sheet's lines make: welded nodes, edges split where lines meet, faces with their holes and neighbours.

Which lines meet is a grid join over all sheets, so a crowded sheet is dealt over many tasks; what is left for a sheet's own task is linear in its edges.
There, points within the weld's reach become one node, every directed edge is followed by the next one clockwise at its end, and the cycles
of that permutation are the faces: counterclockwise ones are hulls, clockwise ones run around a connected piece of the drawing
and are a hole of the smallest hull around it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grid import meeting
from plumbline.plans.scratch import sheetwise

# Fixed value: ends nearer than this (px) are one corner.
WELD = 0.75


def welded(points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(node of each point, nodes): points joined by steps of at most reach are one node, at the first of them."""
    if not len(points):
        return np.zeros(0, int), points.reshape(0, 2)
    cell = np.floor(points / reach).astype(np.int64)
    cell -= cell.min(0) - 1
    wide = int(cell[:, 1].max()) + 2
    key = cell[:, 0] * wide + cell[:, 1]
    order = np.argsort(key, kind="stable")
    sorted_key, root = key[order], np.arange(len(points))
    pairs = []
    for step in (0, 1, wide - 1, wide, wide + 1):  # half of the cells around
        low, high = np.searchsorted(sorted_key, key + step, "left"), np.searchsorted(sorted_key, key + step, "right")
        n = high - low
        a = np.repeat(np.arange(len(points)), n)
        b = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[a]]
        near = (np.hypot(*(points[a] - points[b]).T) <= reach) & (a != b)
        pairs.append(np.column_stack([a[near], b[near]]))
    a, b = np.concatenate(pairs).T
    while len(a):
        p, q = root[a], root[b]
        if (p == q).all():
            break
        m = np.minimum(p, q)
        np.minimum.at(root, p, m)
        np.minimum.at(root, q, m)
        while (root[root] != root).any():
            root = root[root]
    firsts, node = np.unique(root, return_inverse=True)
    return node, points[firsts]


@dataclass
class Face:
    ring: np.ndarray
    holes: list[np.ndarray]
    area: float
    cycles: list[int]


class Plane:
    """nodes; half-edges (start, end, twin, line, next, cycle); faces; of each cycle its face, or -1 for outside."""

    def __init__(self, lines: np.ndarray, cuts: list[np.ndarray] | None = None, reach: float = WELD):
        """lines: (x1, y1, x2, y2). cuts: for each line the parameters at which it is split; None: wherever lines meet."""
        if cuts is None:
            cuts = all_cuts(lines, reach)
        at = [np.unique(np.concatenate([[0.0], np.clip(c, 0, 1), [1.0]])) for c in cuts]
        points = [a[:2] + (a[2:] - a[:2]) * t[:, None] for a, t in zip(lines, at)]
        node, self.nodes = welded(np.concatenate(points) if points else np.zeros((0, 2)), reach)
        line = np.repeat(np.arange(len(lines)), [len(t) for t in at]) if len(lines) else np.zeros(0, int)
        a, b, of = node[:-1], node[1:], line[:-1]
        inner = (line[:-1] == line[1:]) & (a != b) if len(line) else np.zeros(0, bool)
        a, b, of = a[inner], b[inner], of[inner]
        _, first = np.unique(np.minimum(a, b) * (len(self.nodes) + 1) + np.maximum(a, b), return_index=True)  # an edge that several lines draw is one
        a, b, of = a[first], b[first], of[first]
        n = len(a)
        self.start, self.end, self.line = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([of, of])
        self.twin = np.concatenate([np.arange(n) + n, np.arange(n)]) if n else np.zeros(0, int)
        way = self.nodes[self.end] - self.nodes[self.start]
        order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), self.start))
        place = np.empty(2 * n, int)
        place[order] = np.arange(2 * n)
        begins = np.searchsorted(self.start[order], np.arange(len(self.nodes) + 1))
        p, at_node = place[self.twin], self.end
        before = np.where(p == begins[at_node], begins[at_node + 1] - 1, p - 1)
        self.next = order[before] if n else np.zeros(0, int)
        self._walk()

    def _walk(self) -> None:
        cycle = np.full(len(self.next), -1)
        walks: list[list[int]] = []
        for h in range(len(self.next)):
            if cycle[h] < 0:
                walk = []
                while cycle[h] < 0:
                    cycle[h] = len(walks)
                    walk.append(h)
                    h = int(self.next[h])
                walks.append(walk)
        self.cycle = cycle
        p, q = self.nodes[self.start], self.nodes[self.end]
        twice = np.zeros(len(walks))
        np.add.at(twice, cycle, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1])
        self.areas, self.walks = twice / 2, walks
        least = 1e-9 * max(1.0, float(np.ptp(self.nodes, axis=0).max())) ** 2 if len(self.nodes) else 0.0
        hulls = [c for c in range(len(walks)) if self.areas[c] > least]
        hulls.sort(key=lambda c: (self.areas[c], c))
        rings = {c: self.nodes[self.start[walks[c]]] for c in range(len(walks)) if abs(self.areas[c]) > least}
        self.face_of = np.full(len(walks), -1)
        self.faces = []
        for k, c in enumerate(hulls):
            self.face_of[c] = k
            self.faces.append(Face(rings[c], [], float(self.areas[c]), [c]))
        boxes = np.array([[*rings[c].min(0), *rings[c].max(0)] for c in hulls]).reshape(-1, 4)
        component = self._components()
        for c in range(len(walks)):
            if c in rings and self.areas[c] > 0:
                continue
            corner = self.nodes[self.start[walks[c][0]]]
            around = np.flatnonzero((boxes[:, 0] < corner[0]) & (corner[0] < boxes[:, 2]) & (boxes[:, 1] < corner[1]) & (corner[1] < boxes[:, 3]))
            owner = next((k for k in around if component[self.start[walks[hulls[k]][0]]] != component[self.start[walks[c][0]]] and inside(self.faces[k].ring, *corner)), None)
            if owner is not None:
                self.face_of[c] = owner
                self.faces[owner].cycles.append(c)
                if c in rings:
                    self.faces[owner].holes.append(rings[c])
                    self.faces[owner].area += float(self.areas[c])

    def _components(self) -> np.ndarray:
        root = np.arange(len(self.nodes))
        while len(self.start):
            m = np.minimum(root[self.start], root[self.end])
            if (root[self.start] == root[self.end]).all():
                break
            np.minimum.at(root, root[self.start], m)
            np.minimum.at(root, root[self.end], m)
            while (root[root] != root).any():
                root = root[root]
        return root

    def counts(self) -> tuple[int, int, int, int]:
        """(nodes, edges, connected pieces, faces without the outside): nodes - edges + faces = pieces."""
        used = np.unique(self.start)
        return len(used), len(self.start) // 2, len(np.unique(self._components()[used])), len(self.faces)

    def sides(self) -> np.ndarray:
        """(face, face beyond, half-edge) of every half-edge; -1 is outside."""
        return np.column_stack([self.face_of[self.cycle], self.face_of[self.cycle[self.twin]], np.arange(len(self.cycle))])

    def at(self, x: float, y: float) -> int:
        """The face that holds a point, -1 for none: hulls are sorted by area, so the first is the innermost."""
        for k, f in enumerate(self.faces):
            if f.ring[:, 0].min() <= x <= f.ring[:, 0].max() and f.ring[:, 1].min() <= y <= f.ring[:, 1].max() and inside(f.ring, x, y):
                return -1 if any(inside(h, x, y) for h in f.holes) else k
        return -1

    def outline(self, faces: set[int]) -> list[np.ndarray]:
        """The rings around a set of faces, the largest first: half-edges whose other side isn't in the set, each followed by the next one clockwise that is."""
        mine = np.isin(self.face_of[self.cycle], list(faces))
        border = mine & ~mine[self.twin]
        rings, left = [], set(np.flatnonzero(border).tolist())
        while left:
            h = min(left)
            ring = []
            while h in left:
                left.discard(h)
                ring.append(self.nodes[self.start[h]])
                h = int(self.next[h])
                while not border[h]:  # over edges inside the set
                    h = int(self.next[self.twin[h]])
            rings.append(np.array(ring))
        size = lambda r: -abs(float(r[:, 0] @ np.roll(r[:, 1], -1) - r[:, 1] @ np.roll(r[:, 0], -1)))
        return sorted(rings, key=size)


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return bool((x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).sum() % 2)


def pair_cuts(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Parameters (n x 3, NaN for none) at which lines a are cut by lines b: where they cross, and beside b's ends within reach."""
    d, e, w = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    long, other = np.hypot(d[:, 0], d[:, 1]), np.hypot(e[:, 0], e[:, 1])
    det = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    skew = np.abs(det) > 1e-9 * long * other
    safe = np.where(skew, det, 1.0)
    t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / safe, (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / safe
    out = np.full((len(a), 3), np.nan)
    crossing = skew & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    out[crossing, 0] = t[crossing]
    ok = long > 0
    for k, end in ((1, b[:, :2]), (2, b[:, 2:])):
        p = end - a[:, :2]
        along = (p * d).sum(1) / np.where(ok, long * long, 1)
        off = np.abs(p[:, 0] * d[:, 1] - p[:, 1] * d[:, 0]) / np.where(ok, long, 1)
        near = ok & (off <= reach) & (along > 0) & (along < 1)
        out[near, k] = along[near]
    return out


def all_cuts(lines: np.ndarray, reach: float) -> list[np.ndarray]:
    """pair_cuts of a few lines with each other."""
    n = len(lines)
    a, b = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    a, b = a[a != b], b[a != b]
    found = pair_cuts(lines[a], lines[b], reach) if len(a) else np.zeros((0, 3))
    return [found[a == k][~np.isnan(found[a == k])] for k in range(n)]


def cut_lines(lines: DataFrame, reach: float = WELD) -> DataFrame:
    """(sheet_id, idx, line, cuts): each line (sheet_id, idx, x1, y1, x2, y2) with the parameters at which others of its sheet cut it.

    Lines with a null end are left out; so are repeated lines, and lines without length (their ends would cut nothing).
    """
    d = lambda c: F.col(c).cast("double").alias(c)
    rows = lines.select("sheet_id", "idx", F.array(*[d(c) for c in ("x1", "y1", "x2", "y2")]).alias("line")).where(~F.exists("line", lambda v: v.isNull() | F.isnan(v)) & ((F.col("line")[0] != F.col("line")[2]) | (F.col("line")[1] != F.col("line")[3])))
    rows = rows.groupBy("sheet_id", "line").agg(F.min("idx").alias("idx"))
    p = F.col("line")
    half = reach / 2 * 1.001
    boxes = rows.select("sheet_id", "idx", "line", (F.least(p[0], p[2]) - half).alias("x0"), (F.least(p[1], p[3]) - half).alias("y0"), (F.greatest(p[0], p[2]) + half).alias("x1"), (F.greatest(p[1], p[3]) + half).alias("y1"))
    met = meeting(boxes, boxes).where("a.idx < b.idx").select(F.col("a.sheet_id").alias("sheet_id"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.col("a.line").alias("p"), F.col("b.line").alias("q"))
    kinds = dict(rows.dtypes)

    def cut(frames):
        for f in frames:
            p, q = (np.array(f[c].tolist(), float).reshape(-1, 4) for c in ("p", "q"))
            out = []
            for mine, mine_line, other in (("a", p, q), ("b", q, p)):
                t = pair_cuts(mine_line, other, reach)
                row, col = np.nonzero(~np.isnan(t))
                out.append(pd.DataFrame({"sheet_id": f["sheet_id"].to_numpy()[row], "idx": f[mine].to_numpy()[row], "t": t[row, col]}))
            yield pd.concat(out)

    found = met.mapInPandas(cut, f"sheet_id {kinds['sheet_id']}, idx {kinds['idx']}, t double").groupBy(F.col("sheet_id").alias("c_sheet"), F.col("idx").alias("c_idx")).agg(F.collect_set("t").alias("cuts"))
    return rows.join(found, (F.col("sheet_id") == F.col("c_sheet")) & (F.col("idx") == F.col("c_idx")), "left").select("sheet_id", "idx", "line", F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))


def plane_of(frame: pd.DataFrame, reach: float = WELD) -> Plane:
    """The plane of a sheet's rows of cut_lines."""
    frame = frame.sort_values("idx")
    return Plane(np.array(frame["line"].tolist(), float).reshape(-1, 4), [np.asarray(c, float) for c in frame["cuts"]], reach)


def faces_of(lines: DataFrame, reach: float = WELD) -> DataFrame:
    """(sheet_id, face, area, ring, holes, neighbours, outside): the faces of each sheet's lines in px, by area; outside: whether one of its edges borders the open sheet."""
    cut = cut_lines(lines, reach)
    names = ["sheet_id", "face", "area", "ring", "holes", "neighbours", "outside"]

    def run(frame):
        plane, sheet = plane_of(frame, reach), frame["sheet_id"].iloc[0]
        sides = plane.sides()
        out = []
        for k, f in enumerate(plane.faces):
            beyond = sorted({int(b) for b in sides[sides[:, 0] == k, 1]} - {k})
            out.append((sheet, k, f.area, f.ring.tolist(), [h.tolist() for h in f.holes], [b for b in beyond if b >= 0], -1 in beyond))
        return pd.DataFrame(out, columns=names)

    return sheetwise(cut, run, f"sheet_id {dict(cut.dtypes)['sheet_id']}, face int, area double, ring array<array<double>>, holes array<array<array<double>>>, neighbours array<int>, outside boolean", "sheet_id")


def plane_counts(lines: DataFrame, reach: float = WELD) -> DataFrame:
    """(sheet_id, nodes, edges, pieces, faces) of each sheet's subdivision, the outside not counted."""
    cut = cut_lines(lines, reach)

    def run(frame):
        return pd.DataFrame([(frame["sheet_id"].iloc[0], *plane_of(frame, reach).counts())], columns=["sheet_id", "nodes", "edges", "pieces", "faces"])

    return sheetwise(cut, run, f"sheet_id {dict(cut.dtypes)['sheet_id']}, nodes int, edges int, pieces int, faces int", "sheet_id")
