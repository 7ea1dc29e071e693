"""Boxes that meet, by a grid of many levels: an equi-join, however dense a sheet and however large a box.

A box lies on the level whose cells are as wide as its longer side, so it covers four cells at most. It is looked for on
its own level and on every coarser one that the other side uses, four cells each. A pair is kept in the cell of its
overlap's least corner alone, so none is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest level: points and slivers lie there.
FINEST = -12


def _level(box: Column) -> Column:
    size = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(2.0**FINEST))
    return F.ceil(F.log2(size)).cast("int")


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select(_level(F.col("box"))).distinct().collect() if r[0] is not None)  # a few dozen at most: powers of two


def _celled(rows: DataFrame, name: str) -> DataFrame:
    """rows with level, once for each cell of it that their box covers."""
    cell, box = F.pow(F.lit(2.0), F.col("level")), F.col(f"{name}_box")
    across = lambda low, high: F.explode(F.sequence(F.floor(box[low] / cell), F.floor(box[high] / cell)))
    return rows.withColumn("cx", across("x0", "x1")).withColumn("cy", across("y0", "y1"))


def _boxed(rows: DataFrame, sheet: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double").alias(c)
    box = F.struct(d("x0"), d("y0"), d("x1"), d("y1"))
    return rows.select(F.col(sheet).alias("on_sheet"), box.alias("box"), F.struct("*").alias("row")).where("on_sheet IS NOT NULL AND box.x0 <= box.x1 AND box.y0 <= box.y1")


def meeting(a: DataFrame, b: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """(a, b): the rows, as structs, of a and b on one sheet whose closed boxes (x0, y0, x1, y1) meet.

    Rows without a sheet, or with a null or inside-out box, meet nothing.
    """
    left, right = _boxed(a, sheet), _boxed(b, sheet)

    def own(rows: DataFrame, name: str) -> DataFrame:
        return _celled(rows.select("on_sheet", F.col("box").alias(f"{name}_box"), F.col("row").alias(name), _level(F.col("box")).alias("level")), name)

    def looking(rows: DataFrame, name: str, levels: list[int], itself: bool) -> DataFrame:
        mine = _level(F.col("box"))
        there = F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: (k >= mine) if itself else (k > mine))
        return _celled(rows.select("on_sheet", F.col("box").alias(f"{name}_box"), F.col("row").alias(name), F.explode(there).alias("level")), name)

    keys = ["on_sheet", "level", "cx", "cy"]
    # never broadcast: the planner's estimates don't count what the cells multiply, and a side may be far larger than they say
    merged = lambda df: df.hint("merge")
    met = looking(left, "a", _levels(right), True).join(merged(own(right, "b")), keys).select(*keys, "a", "b", "a_box", "b_box")
    met = met.unionByName(looking(right, "b", _levels(left), False).join(merged(own(left, "a")), keys).select(*keys, "a", "b", "a_box", "b_box"))
    p, q, cell = F.col("a_box"), F.col("b_box"), F.pow(F.lit(2.0), F.col("level"))
    meet = (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])
    corner = (F.floor(F.greatest(p["x0"], q["x0"]) / cell) == F.col("cx")) & (F.floor(F.greatest(p["y0"], q["y0"]) / cell) == F.col("cy"))
    return met.where(meet & corner).select("a", "b")


def boxed(rows: DataFrame, ring: str = "ring", margin: float = 0.0) -> DataFrame:
    """rows with the bounding box of a ring or line, widened by a margin."""
    ends = lambda i, pick, by: pick(F.transform(ring, lambda p: p[i])) + F.lit(by)
    return rows.withColumns({"x0": ends(0, F.array_min, -margin), "y0": ends(1, F.array_min, -margin), "x1": ends(0, F.array_max, margin), "y1": ends(1, F.array_max, margin)})
