"""Sheets joined along match lines: a stitch's members lie at offsets on one surface; their points and segments come together there,
each from the member whose part of the surface it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.scratch import shuffled

PREFIX = "stitch:"


def sane_stitches(members: DataFrame, most: int = 12) -> DataFrame:
    """Members (stitch_id, ord, key, dx, dy) of well-formed stitches, moved so that the least corner is (0, 0): two to most members, distinct
    sheets that are no stitches themselves, finite offsets. Any fault drops the whole stitch."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = F.col("key").isNotNull() & (F.col("key") != "") & ~F.col("key").startswith(PREFIX) & finite("dx") & finite("dy")
    judged = members.where(F.col("stitch_id").startswith(PREFIX)).groupBy("stitch_id").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.bool_and(sound).alias("sound"), F.min("dx").alias("least_x"), F.min("dy").alias("least_y"))
    good = judged.where((F.col("n") >= 2) & (F.col("n") <= most) & (F.col("keys") == F.col("n")) & F.col("sound"))
    return members.join(shuffled(good.select("stitch_id", "least_x", "least_y")), "stitch_id").select("stitch_id", "ord", "key", (F.col("dx") - F.col("least_x")).alias("dx"), (F.col("dy") - F.col("least_y")).alias("dy"))


def side_by_side(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """A fresh stitch's members (stitch_id, ord, key) flush from left to right, tops aligned; a sheet of unknown size takes no room."""
    before = Window.partitionBy("stitch_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.coalesce(F.col("width").cast("decimal(28,6)"), F.lit(0))
    joined = members.join(shuffled(sizes.select(F.col("sheet_id").alias("key"), "width")), "key", "left")
    return joined.select("stitch_id", "ord", "key", F.coalesce(F.sum(wide).over(before), F.lit(0)).cast("double").alias("dx"), F.lit(0.0).alias("dy"))


def member_boxes(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members with their box on the surface, and the box of it that they show: where neighbours overlap along the way they lie, each
    shows its half."""
    size = sizes.select(F.col("sheet_id").alias("key"), "width", "height")
    boxed = members.join(shuffled(size), "key", "left").select("stitch_id", "ord", "key", "dx", "dy", F.col("dx").alias("x0"), F.col("dy").alias("y0"), (F.col("dx") + F.coalesce("width", F.lit(0.0))).alias("x1"), (F.col("dy") + F.coalesce("height", F.lit(0.0))).alias("y1"))
    whole = Window.partitionBy("stitch_id")
    spread = lambda a, b: F.max((F.col(a) + F.col(b)) / 2).over(whole) - F.min((F.col(a) + F.col(b)) / 2).over(whole)
    across = boxed.withColumn("across", spread("x0", "x1") >= spread("y0", "y1"))
    low, high = F.when(F.col("across"), F.col("x0")).otherwise(F.col("y0")), F.when(F.col("across"), F.col("x1")).otherwise(F.col("y1"))
    way = Window.partitionBy("stitch_id").orderBy("low", "ord")
    ends = across.withColumns({"low": low, "high": high})
    nxt, last = F.lead("low").over(way), F.lag("high").over(way)
    top = F.when(nxt < F.col("high"), F.least(F.col("high"), (nxt + F.col("high")) / 2)).otherwise(F.col("high"))
    bottom = F.when(F.col("low") < last, F.greatest(F.col("low"), (F.col("low") + last) / 2)).otherwise(F.col("low"))
    cut = ends.withColumns({"top": top, "bottom": bottom})
    shown = lambda across_value, along: F.when(F.col("across"), across_value).otherwise(along)
    return cut.select("stitch_id", "ord", "key", "dx", "dy", "x0", "y0", "x1", "y1", shown(F.col("bottom"), F.col("x0")).alias("sx0"), shown(F.col("y0"), F.col("bottom")).alias("sy0"), shown(F.col("top"), F.col("x1")).alias("sx1"), shown(F.col("y1"), F.col("top")).alias("sy1"))


def extents(boxes: DataFrame) -> DataFrame:
    """(stitch_id, width, height) of the surface, to whole px; members without a size don't count."""
    return boxes.where("x1 > x0").groupBy("stitch_id").agg(F.ceil(F.max("x1")).cast("double").alias("width"), F.ceil(F.max("y1")).cast("double").alias("height"))


def member_at(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The member under each point (stitch_id, id, x, y): the last drawn of those that hold it, else the nearest."""
    met = points.join(shuffled(boxes.select("stitch_id", "ord", "key", "x0", "y0", "x1", "y1")), "stitch_id")  # a stitch has few members
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    dx, dy = (F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) for c in "xy")
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("out"), F.when(inside, -F.col("ord").cast("double")).otherwise(dx * dx + dy * dy).alias("by"), F.col("ord").alias("ord"), F.col("key").alias("key"))
    return met.groupBy("stitch_id", "id").agg(F.min(rank).alias("best")).select("stitch_id", "id", F.col("best.key").alias("key"))


def merged_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Members' points (sheet_id, x, y) on the surface, those that their member shows."""
    on = points.join(shuffled(boxes), F.col("sheet_id") == F.col("key")).withColumns({"px": F.col("x") + F.col("dx"), "py": F.col("y") + F.col("dy")})
    return on.where("px BETWEEN sx0 AND sx1 AND py BETWEEN sy0 AND sy1").select("stitch_id", "sheet_id", F.col("px").alias("x"), F.col("py").alias("y"))


def merged_segments(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Members' segments (sheet_id, idx, x1, y1, x2, y2) on the surface, whole: a segment is its member's if that shows its middle."""
    on = segments.join(shuffled(boxes.drop("x0", "y0", "x1", "y1")), F.col("sheet_id") == F.col("key"))
    moved = on.select("stitch_id", "sheet_id", "idx", *[(F.col(c) + F.col("dx" if c[0] == "x" else "dy")).alias(c) for c in ("x1", "y1", "x2", "y2")], "sx0", "sy0", "sx1", "sy1")
    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    return moved.where(middle("x").between(F.col("sx0"), F.col("sx1")) & middle("y").between(F.col("sy0"), F.col("sy1"))).select("stitch_id", "sheet_id", "idx", "x1", "y1", "x2", "y2")
