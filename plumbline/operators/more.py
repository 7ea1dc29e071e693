"""Smaller operators: exports, columns, regions, continuation, joins of text runs, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import contains, ring_within
from plumbline.operators.grid import boxed, meeting


def to_document(project: DataFrame, conditions: DataFrame, shapes: DataFrame) -> DataFrame:
    """One JSON document for each project, members in order, empty fields left out."""
    listed = lambda df, n: df.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c not in ("project_id", "ord")]).alias("r")))), lambda s: s["r"]).alias(n))
    joined = project.join(listed(conditions, "conditions"), "project_id", "left").join(listed(shapes, "shapes"), "project_id", "left")
    return joined.select("project_id", F.to_json(F.struct("schema", "conditions", "shapes"), {"ignoreNullFields": "true"}).alias("document"))


def visible_columns(columns: list[tuple[str, bool, bool]], hidden: set[str], shown: set[str]) -> list[str]:
    """Names of columns (name, locked, on by default) to show: locked ones always, others by preference, then by default."""
    return [name for name, locked, default in columns if locked or (name in shown or (default and name not in hidden))]


def custom_column(attrs: Column, key: str) -> Column:
    """A custom column's value from a map of attributes; blank is none."""
    return F.nullif(F.trim(attrs[key]), F.lit(""))


def in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """points (sheet_id, id, x, y) with whether a region of their sheet holds them."""
    at = points.select("sheet_id", "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    held = meeting(at, regions.select("sheet_id", "x0", "y0", "x1", "y1")).select(F.col("a.sheet_id").alias("sheet_id"), F.col("a.id").alias("id"), F.lit(True).alias("held")).distinct()
    return points.join(held, ["sheet_id", "id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def unique_parent(deducts: DataFrame, floors: DataFrame) -> DataFrame:
    """Each deduct's parent if its centre lies in exactly one floor of its sheet and condition; else none, with the count.

    deducts: (sheet_id, id, condition_id, x, y); floors: (sheet_id, id, condition_id, ring, x0, y0, x1, y1).
    """
    at = deducts.select("sheet_id", "id", "condition_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    inside = (F.col("a.condition_id") == F.col("b.condition_id")) & contains(F.col("b.ring"), F.col("a.x0"), F.col("a.y0"))
    met = meeting(at, floors.select("sheet_id", "id", "condition_id", "ring", "x0", "y0", "x1", "y1")).where(inside)
    found = met.groupBy(F.col("a.id").alias("found_id")).agg(F.count("*").alias("n"), F.min("b.id").alias("one"))
    rows = deducts.select("id").join(found, F.col("id") == F.col("found_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("id", n.alias("candidates"), F.when(n == 1, F.col("one")).otherwise(F.lit(-1)).alias("parent"))


def contained_rings(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner_id, outer_id) of rings (sheet_id, id, ring) whose points and their mean all lie in another ring of their sheet."""
    met = meeting(boxed(inner.select("sheet_id", "id", "ring")), boxed(outer.select("sheet_id", "id", "ring")))
    held = (F.col("a.id") != F.col("b.id")) & ring_within(F.col("a.ring"), F.col("b.ring"))
    return met.where(held).select(F.col("a.id").alias("inner_id"), F.col("b.id").alias("outer_id"))


def nearest_marker(tags: DataFrame, markers: DataFrame, reach: float = 2.5) -> DataFrame:
    """Each tag's nearest revision marker by the distance of their boxes, within reach heights of the tag."""
    by = reach * (F.col("y1") - F.col("y0"))
    t = tags.select("sheet_id", "ord", by.alias("reach"), F.struct("x0", "y0", "x1", "y1").alias("tag"), (F.col("x0") - by).alias("x0"), (F.col("y0") - by).alias("y0"), (F.col("x1") + by).alias("x1"), (F.col("y1") + by).alias("y1"))
    gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"b.{low}") - F.col(f"a.tag.{high}"), F.col(f"a.tag.{low}") - F.col(f"b.{high}"))
    dx, dy = gap("x0", "x1"), gap("y0", "y1")
    met = meeting(t, markers.select("sheet_id", "ord", "x0", "y0", "x1", "y1")).where(dx * dx + dy * dy <= F.col("a.reach") * F.col("a.reach"))
    best = met.select("a.sheet_id", F.col("a.ord").alias("ord"), F.struct((dx * dx + dy * dy).alias("d2"), F.col("b.ord").alias("m_ord")).alias("found")).groupBy("sheet_id", "ord").agg(F.min("found").alias("best"))
    return best.select("sheet_id", "ord", F.col("best.m_ord").alias("marker"))


def continuations(tables: DataFrame) -> DataFrame:
    """Each continued table's base: the last earlier table of its kind and base title. tables: (id, ord, kind, title)."""
    suffix = r"(?i)\s*[-(]?\s*(?:CONT(?:INUED|'?D|\.)?)\s*\)?$"
    base = F.regexp_replace(F.upper(F.trim("title")), suffix, "")
    continued = F.col("title").rlike(suffix)
    w = Window.partitionBy("kind", "base").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = tables.withColumns({"base": base, "continued": continued})
    return marked.withColumn("base_id", F.when(F.col("continued"), F.last(F.when(~F.col("continued"), F.col("id")), ignorenulls=True).over(w))).select("id", "continued", "base_id")


def read_text(spans: DataFrame, region: Column) -> DataFrame:
    """Text of each sheet within a region, spans in order, joined by spaces."""
    found = spans.where(region).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("ord", "str"))).alias("s"))
    return found.select("sheet_id", F.array_join(F.transform("s", lambda x: x["str"]), " ").alias("text"))


def joined_runs(spans: DataFrame, gap: float = 0.25) -> DataFrame:
    """Abutting text runs of a line joined: spans (sheet_id, line, ord, str, x0, x1, h) in x order, where the next begins within
    gap heights of where the last one ends; two digits never meet by joining."""
    w = Window.partitionBy("sheet_id", "line").orderBy("x0", "ord")
    last_end, last_str = F.lag("x1").over(w), F.lag("str").over(w)
    digits = last_str.rlike("[0-9]$") & F.col("str").rlike("^[0-9]")
    joins = (F.abs(F.col("x0") - last_end) <= gap * F.col("h")) & ~digits
    runs = spans.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("sheet_id", "line", "run").agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "str"))).alias("s"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return out.select("sheet_id", "line", "run", F.array_join(F.transform("s", lambda x: x["str"]), "").alias("text"), "x0", "x1")


def set_scale(label_upp: Column, calibrated_upp: Column, stated_upp: Column, copied_upp: Column) -> Column:
    """(units_per_px, source, reason): exactly one of four ways to set a sheet's scale, or a refusal."""
    ways = [("label", label_upp), ("calibrated", calibrated_upp), ("stated", stated_upp), ("copied", copied_upp)]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for _, c in ways), F.lit(0))
    value = F.coalesce(*[c for _, c in ways])
    source = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in ways])
    reason = F.when(n == 0, "no scale stated").when(n > 1, "more than one scale stated").when(~(value > 0), "scale must be positive")
    return F.struct(F.when(reason.isNull(), value).alias("units_per_px"), F.when(reason.isNull(), source).alias("source"), reason.alias("reason"))


def subtract_rectangle(pairs: DataFrame) -> DataFrame:
    """A rectangle less another: whole if they don't meet, gone if covered, one rectangle if a full side is cut, and refused
    where the rest isn't one rectangle."""
    l = {k: F.col(f"l_{k}") for k in ("x0", "y0", "x1", "y1")}  # noqa: E741
    w = {k: F.col(f"w_{k}") for k in ("x0", "y0", "x1", "y1")}
    apart = (w["x1"] <= l["x0"]) | (w["x0"] >= l["x1"]) | (w["y1"] <= l["y0"]) | (w["y0"] >= l["y1"])
    full_x, full_y = (w["x0"] <= l["x0"]) & (w["x1"] >= l["x1"]), (w["y0"] <= l["y0"]) & (w["y1"] >= l["y1"])
    low_x, high_x = w["x0"] <= l["x0"], w["x1"] >= l["x1"]
    low_y, high_y = w["y0"] <= l["y0"], w["y1"] >= l["y1"]
    status = F.when(apart, "whole").when(full_x & full_y, "gone").when((full_y & (low_x | high_x)) | (full_x & (low_y | high_y)), "trimmed").otherwise("refused")
    area = (l["x1"] - l["x0"]) * (l["y1"] - l["y0"])
    shared = (F.least(l["x1"], w["x1"]) - F.greatest(l["x0"], w["x0"])) * (F.least(l["y1"], w["y1"]) - F.greatest(l["y0"], w["y0"]))
    return pairs.select("id", status.alias("status"), F.when(status == "whole", area).when(status == "gone", 0.0).when(status == "trimmed", area - shared).otherwise(area).alias("area"))


def opening_size(text: Column) -> Column:
    """(width_m, height_m) of a schedule's opening such as 10x21 (dm), 1000x2100 (mm) or 1.0x2.1 (m)."""
    pattern = r"([0-9]+(?:[.,][0-9]+)?)\s*[xX×]\s*([0-9]+(?:[.,][0-9]+)?)"
    metres = lambda v: F.when(v >= 100, v / 1000.0).when(v >= 5, v / 10.0).otherwise(v)
    of = lambda i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(metres(of(1)).alias("width_m"), metres(of(2)).alias("height_m"))


def propagated(families: DataFrame, patches: DataFrame) -> DataFrame:
    """Material rows of variants after patches to their parents: (id, name, per); a row that was overridden here (local) or
    removed (tombstone) doesn't follow. families: (id, parent, name, per, local, tombstone)."""
    p = patches.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"), F.col("per").alias("p_per"))
    joined = families.join(p, (F.coalesce("parent", "id") == F.col("p_id")) & (F.col("name") == F.col("p_name")), "left")
    follows = F.col("p_id").isNotNull() & ~F.col("local") & ~F.col("tombstone")
    return joined.where(~F.col("tombstone")).select("id", "name", F.when(follows, F.col("p_per")).otherwise(F.col("per")).alias("per"))
