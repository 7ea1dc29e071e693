"""Overlapping floors: candidate pairs by a grid, exact areas of rectangles, shared floor by union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import round2_plain
from plumbline.operators.grid import meeting

def touching_pairs(rects: DataFrame) -> DataFrame:
    """Pairs (a, b) of rectangles (sheet_id, id, x0, y0, x1, y1, ...) on one sheet whose boxes overlap, ids ascending."""
    met = meeting(rects, rects).where("a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
    others = [c for c in rects.columns if c != "sheet_id"]
    return met.select(F.col("a.sheet_id").alias("sheet_id"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in others])


def rectangle_collisions(rects: DataFrame, least_fraction: float = 0.05) -> DataFrame:
    """Overlapping pairs with the shared area, its fraction of the smaller, intersection over union, and whether both have one condition."""
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    high = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    pairs = touching_pairs(rects).withColumns({"shared": wide * high, "area_a": area("a"), "area_b": area("b")})
    noise = 64 * 2.220446049250313e-16 * F.greatest("area_a", "area_b")
    fraction = F.col("shared") / F.least("area_a", "area_b")
    kept = pairs.where((F.col("shared") > noise) & (fraction >= least_fraction))
    iou = F.col("shared") / F.greatest(F.lit(1e-9), F.col("area_a") + F.col("area_b") - F.col("shared"))
    return kept.select("sheet_id", "a_id", "b_id", round2_plain(F.col("shared")).alias("shared_sf"), (round2_plain(fraction * 100) / 100).alias("fraction_of_smaller"), (round2_plain(iou * 100) / 100).alias("iou"), (F.col("a_condition_id") == F.col("b_condition_id")).alias("same_condition"), "a_condition_id", "b_condition_id")


def collisions_by_condition(pairs: DataFrame) -> DataFrame:
    """How many pairs each condition is part of; a double trace of one condition counts once."""
    both = F.when(F.col("same_condition"), F.array("a_condition_id")).otherwise(F.array("a_condition_id", "b_condition_id"))
    return pairs.select(F.explode(both).alias("condition_id")).groupBy("condition_id").agg(F.count("*").alias("n"))


#: Rectangles that are painted on one compressed grid, and rectangles that a cell of a sheet holds about.
MOST_PAINTED, PER_CELL = 128, 64


def union_area(rects: np.ndarray) -> float:
    """Area of the union of rectangles (x0, y0, x1, y1): few are painted on the grid of their own coordinates, more are halved first."""
    rects = np.unique(rects[(rects[:, 2] > rects[:, 0]) & (rects[:, 3] > rects[:, 1])], axis=0)
    if not len(rects):
        return 0.0
    low, high = rects[:, :2].min(0), rects[:, 2:].max(0)
    if ((rects[:, :2] == low) & (rects[:, 2:] == high)).all(1).any():  # one covers all
        return float((high - low).prod())
    if len(rects) <= MOST_PAINTED:
        xs, ys = np.unique(rects[:, [0, 2]]), np.unique(rects[:, [1, 3]])
        painted = np.zeros((len(xs), len(ys)), bool)
        for a, b, c, d in zip(np.searchsorted(xs, rects[:, 0]), np.searchsorted(ys, rects[:, 1]), np.searchsorted(xs, rects[:, 2]), np.searchsorted(ys, rects[:, 3])):
            painted[a:c, b:d] = True
        return float(np.diff(xs) @ painted[:-1, :-1] @ np.diff(ys))
    for axis in np.argsort(low - high):  # the longer side first
        inner = np.unique(rects[:, [axis, axis + 2]])[1:-1]
        if len(inner):
            cut = inner[len(inner) // 2]
            below, above = rects.copy(), rects.copy()
            below[:, axis + 2], above[:, axis] = np.minimum(below[:, axis + 2], cut), np.maximum(above[:, axis], cut)
            return union_area(below) + union_area(above)
    return float((high - low).prod())


def shared_floor(rects: DataFrame) -> DataFrame:
    """Floor claimed more than once on each sheet: the sum of areas less the union's.

    Rectangles are cut at the cells of a grid that suits their sheet (about PER_CELL of them in a cell, which is no
    smaller than they are on average), unions are taken within cells, and sheets add up their cells' shares.
    """
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    some = rects.select("sheet_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where((wide > 0) & (high > 0))
    extent = lambda i: F.max(f"{i}1") - F.min(f"{i}0")
    grids = some.groupBy(F.col("sheet_id").alias("grid_sheet")).agg(F.greatest(F.sqrt(extent("x") * extent("y") * PER_CELL / F.count("*")), 2 * F.avg(F.greatest(wide, high))).alias("cell"))
    dealt = some.join(grids, F.col("sheet_id") == F.col("grid_sheet")).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / F.col("cell")), F.floor(F.col("x1") / F.col("cell")))))
    dealt = dealt.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / F.col("cell")), F.floor(F.col("y1") / F.col("cell")))))
    inside = lambda c, at, pick, by: pick(F.col(c), (F.col(at) + by) * F.col("cell"))
    cut = dealt.select("sheet_id", "cx", "cy", inside("x0", "cx", F.greatest, 0).alias("x0"), inside("y0", "cy", F.greatest, 0).alias("y0"), inside("x1", "cx", F.least, 1).alias("x1"), inside("y1", "cy", F.least, 1).alias("y1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def shared() -> pa.RecordBatch:
            r = np.concatenate(held)
            area = (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
            return pa.record_batch({"sheet_id": pa.array([key[0]], pa.int64()), "shared": pa.array([float(area.sum()) - union_area(r) if len(r) > 1 else 0.0])})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.array(batch[c]) for c in ("sheet_id", "cx", "cy")])
            boxes = np.column_stack([np.array(batch[c]) for c in ("x0", "y0", "x1", "y1")])
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for a, b in zip(first, np.append(first[1:], len(keys))):
                if key is not None and tuple(keys[a].tolist()) != key:
                    yield shared()
                    held = []
                key = tuple(keys[a].tolist())
                held.append(boxes[a:b])
        if held:
            yield shared()

    cells = cut.withColumn("sheet_id", F.col("sheet_id").cast("long")).repartition("sheet_id", "cx", "cy").sortWithinPartitions("sheet_id", "cx", "cy").mapInArrow(run, "sheet_id long, shared double")
    sums = cells.groupBy(F.col("sheet_id").alias("shared_sheet")).agg(F.sum("shared").alias("shared"))
    sheets = rects.select(F.col("sheet_id").cast("long").alias("sheet_id")).distinct()
    return sheets.join(sums, F.col("sheet_id") == F.col("shared_sheet"), "left").select("sheet_id", F.greatest(F.lit(0.0), F.coalesce("shared", F.lit(0.0))).alias("shared_floor_sf"))


def framed(shapes: DataFrame, sheets: DataFrame) -> DataFrame:
    """Shapes with their sheet's scale, and why a shape can't be measured: the sheet isn't there, or has no scale."""
    beside = sheets.select(F.col("sheet_id").alias("frame_sheet"), "units_per_px")
    joined = shapes.join(beside, F.col("sheet_id") == F.col("frame_sheet"), "left")
    reason = F.when(F.col("frame_sheet").isNull(), "sheet not loaded").when(F.coalesce(F.col("units_per_px"), F.lit(0.0)) <= 0, "sheet has no scale")
    return joined.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "measured").otherwise("unmeasured")).drop("frame_sheet")
