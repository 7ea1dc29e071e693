"""Walls of drawings without layers: two long parallel lines a wall's thickness apart are its faces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grid import meeting

# Thickness of walls, the least length of a face and the least overlap of two, in metres; the angle within which lines are parallel.
THIN_M, THICK_M, FACE_M, OVERLAP_M, DEGREES = 0.07, 0.35, 0.8, 0.8, 1.5


def wall_pairs(segments: DataFrame, sheets: DataFrame, thin: float = THIN_M, thick: float = THICK_M, face: float = FACE_M, overlap: float = OVERLAP_M) -> DataFrame:
    """(sheet_id, a_idx, b_idx, thickness_m, overlap_m, x1, y1, x2, y2) of the pairs of faces, and the middle line between them, in px.

    segments: (sheet_id, idx, x1, y1, x2, y2) without chords of curves and clip paths; sheets: (sheet_id, px_per_m). Offsets and overlaps are taken
    along the line of lower idx, offsets at the other's middle. Sheets without a scale have no walls.
    """
    scaled = segments.join(sheets.where("px_per_m > 0").select(F.col("sheet_id").alias("of_sheet"), "px_per_m"), F.col("sheet_id") == F.col("of_sheet"))
    m = F.col("px_per_m")
    long = scaled.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= face * m)
    reach = m * (thick / 2 * 1.001)
    box = {"x0": F.least("x1", "x2") - reach, "y0": F.least("y1", "y2") - reach, "right": F.greatest("x1", "x2") + reach, "bottom": F.greatest("y1", "y2") + reach}
    ends = F.struct("x1", "y1", "x2", "y2").alias("line")
    rows = long.withColumns(box).select("sheet_id", "idx", "px_per_m", ends, "x0", "y0", F.col("right").alias("x1"), F.col("bottom").alias("y1"))
    a, b = F.col("a.line"), F.col("b.line")
    size = lambda s: F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])
    ux, uy = (a["x2"] - a["x1"]) / size(a), (a["y2"] - a["y1"]) / size(a)

    def along(x: Column, y: Column) -> Column:
        return (x - a["x1"]) * ux + (y - a["y1"]) * uy

    def aside(x: Column, y: Column) -> Column:
        return (y - a["y1"]) * ux - (x - a["x1"]) * uy

    parallel = F.abs(ux * (b["y2"] - b["y1"]) - uy * (b["x2"] - b["x1"])) <= math.sin(math.radians(DEGREES)) * size(b)
    off = aside((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    one, two = along(b["x1"], b["y1"]), along(b["x2"], b["y2"])
    met = meeting(rows, rows).where((F.col("a.idx") < F.col("b.idx")) & parallel)
    found = met.select(F.col("a.sheet_id").alias("sheet_id"), F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), F.col("a.px_per_m").alias("m"), off.alias("off"), F.greatest(F.lit(0.0), F.least(one, two)).alias("low"), F.least(size(a), F.greatest(one, two)).alias("high"), a["x1"].alias("ax"), a["y1"].alias("ay"), ux.alias("ux"), uy.alias("uy"))
    wall = found.where((F.abs("off") >= thin * F.col("m")) & (F.abs("off") <= thick * F.col("m")) & (F.col("high") - F.col("low") >= overlap * F.col("m")))
    x = lambda t: F.col("ax") + F.col(t) * F.col("ux") - F.col("off") / 2 * F.col("uy")
    y = lambda t: F.col("ay") + F.col(t) * F.col("uy") + F.col("off") / 2 * F.col("ux")
    return wall.select("sheet_id", "a_idx", "b_idx", (F.abs("off") / F.col("m")).alias("thickness_m"), ((F.col("high") - F.col("low")) / F.col("m")).alias("overlap_m"), x("low").alias("x1"), y("low").alias("y1"), x("high").alias("x2"), y("high").alias("y2"))


def wall_faces(pairs: DataFrame) -> DataFrame:
    """(sheet_id, idx, thickness_m) of the segments that are faces of a wall, with the thinnest they belong to."""
    each = F.explode(F.array("a_idx", "b_idx")).alias("idx")
    return pairs.select("sheet_id", each, "thickness_m").groupBy("sheet_id", "idx").agg(F.min("thickness_m").alias("thickness_m"))
