"""Rooms grown over the faces of a sheet's lines: a face and the pieces of it that furniture and labels cut off, never past a wall.

Grown are the smallest neighbours first, each no larger than LARGEST_PIECE and all together no larger than half of the room's own
face (or LARGEST_PIECE); a narrow face, as wide as a wall, joins only where it touches the room on two of its faces. A pocket behind a narrow
face joins if it is small, wide somewhere, and leads nowhere else. Cells of which the drawing says that no door leads into them join whatever their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.planar import WELD, Plane, cut_lines, inside, plane_of
from plumbline.plans.scratch import sheetwise_pairs

# Square feet: the largest piece of a room that is grown into, and the largest pocket; feet: the width up to which a face is narrow.
LARGEST_PIECE, LARGEST_POCKET, NARROW = 30.0, 40.0, 0.75


def width_of(plane: Plane, k: int) -> float:
    """Twice a face's area over its perimeter: how wide it would be as a strip."""
    f = plane.faces[k]
    around = sum(float(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum()) for r in [f.ring, *f.holes])
    return 2 * f.area / around if around else 0.0


class Growth:
    """What a sheet's rooms share: neighbours, narrow, solid and doorless faces."""

    def __init__(self, plane: Plane, px_per_ft: float, solid: np.ndarray, doorless: np.ndarray):
        """solid, doorless: points inside faces that are wall material, and inside cells without a door."""
        self.plane, self.square = plane, px_per_ft * px_per_ft
        self.near: list[set[int]] = [set() for _ in plane.faces]
        for a, b, _ in plane.sides():
            if a >= 0 and b >= 0 and a != b:
                self.near[a].add(int(b))
        self.solid = {plane.at(*p) for p in solid}
        self.doorless = {plane.at(*p) for p in doorless} - self.solid
        self.narrow = {k for k in range(len(plane.faces)) if width_of(plane, k) < NARROW * px_per_ft}

    def area(self, k: int) -> float:
        return self.plane.faces[k].area

    def room(self, x: float, y: float) -> tuple[set[int], str]:
        """The faces of the room at a point, or none and why."""
        seed = next((k for k, f in enumerate(self.plane.faces) if k not in self.solid and inside(f.ring, x, y) and not any(inside(h, x, y) for h in f.holes)), -1)
        if seed < 0:
            return set(), "on a wall" if self.plane.at(x, y) in self.solid else "no lines close it"
        room, absorbed = {seed}, 0.0
        most = max(LARGEST_PIECE * self.square, self.area(seed) / 2)
        while True:
            around = {k for f in room for k in self.near[f]} - room - self.solid
            ready = [k for k in around if (k not in self.narrow or len(self.near[k] & room) > 1) and (k in self.doorless or self.area(k) <= LARGEST_PIECE * self.square)]
            if not ready:
                break
            k = min(ready, key=lambda k: (self.area(k), k))
            if k not in self.doorless:
                if absorbed + self.area(k) > most:
                    break
                absorbed += self.area(k)
            room.add(k)
        grows = True
        while grows:
            grows = False
            for mouth in sorted({k for f in room for k in self.near[f]} - room - self.solid):
                pocket = self.pocket(mouth, room) if mouth in self.narrow and mouth not in room else None
                if pocket:
                    room |= pocket
                    grows = True
        return room, ""

    def pocket(self, mouth: int, room: set[int]) -> set[int] | None:
        """The dead end behind a narrow face, if it is small and has a face that isn't narrow."""
        found, todo, total = {mouth}, [mouth], self.area(mouth)
        while todo:
            for k in self.near[todo.pop()] - found - room - self.solid:
                found.add(k)
                todo.append(k)
                total += self.area(k)
            if total > LARGEST_POCKET * self.square:
                return None
        return found if found - self.narrow else None


ROOM = "status string, reason string, faces int, area_sf double, ring array<array<double>>, holes array<array<array<double>>>"


def net_rooms(seeds: DataFrame, lines: DataFrame, sheets: DataFrame, marks: DataFrame | None = None, reach: float = WELD) -> DataFrame:
    """(sheet_id, id, status, reason, faces, area_sf, ring, holes) of the rooms at seeds (sheet_id, id, x, y in px).

    lines: (sheet_id, idx, x1, y1, x2, y2); sheets: (sheet_id, px_per_ft); marks: (sheet_id, kind, x, y), points in faces that are `solid` or in cells that are
    `doorless`. The area is that of the faces, less holes, in square feet. Seeds of sheets without lines or scale are refused. Rings are px.
    """
    d = lambda c: F.col(c).cast("double").alias(c)
    scales = sheets.select(F.col("sheet_id").alias("of_sheet"), F.col("px_per_ft").cast("double").alias("px_per_ft"))
    asked = seeds.select("sheet_id", "id", d("x"), d("y")).join(scales, F.col("sheet_id") == F.col("of_sheet"), "left").drop("of_sheet")
    kinds = dict(asked.dtypes)
    marked = asked.select("sheet_id", F.lit("seed").alias("kind"), "id", "x", "y", "px_per_ft")
    if marks is not None:
        marked = marked.unionByName(marks.select("sheet_id", "kind", F.lit(0).cast(kinds["id"]).alias("id"), d("x"), d("y"), F.lit(None).cast("double").alias("px_per_ft")))

    def run(mark: pd.DataFrame, line: pd.DataFrame) -> list[tuple]:
        out, growth = [], None
        mine = mark[mark["kind"] == "seed"]
        scale = mine["px_per_ft"].max() if len(mine) else None
        if len(mine) and len(line) and scale is not None and scale > 0:
            points = lambda kind: mark[mark["kind"] == kind][["x", "y"]].dropna().to_numpy()
            growth = Growth(plane_of(line, reach), scale, points("solid"), points("doorless"))
        sheet = mark["sheet_id"].iloc[0]
        for name, x, y in zip(*(mine[c].tolist() for c in ("id", "x", "y"))):
            faces, reason = growth.room(x, y) if growth else (set(), "no scale" if len(line) else "no lines close it")
            if reason:
                out.append((sheet, name, "refused", reason, 0, None, None, None))
                continue
            ring, *holes = growth.plane.outline(faces)
            out.append((sheet, name, "ok", "", len(faces), sum(map(growth.area, faces)) / growth.square, ring.tolist(), [h.tolist() for h in holes]))
        return out

    return sheetwise_pairs(marked, cut_lines(lines, reach), run, f"sheet_id {kinds['sheet_id']}, id {kinds['id']}, {ROOM}", "sheet_id")
