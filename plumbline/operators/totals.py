"""Quantities of conditions: base sums by any grouping, order quantities, grand totals, materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import material_quantity, number, or_else, round2_eps

MEASURES = ["floor", "wall", "border", "lf", "ea"]
#: Shapes in a task that adds them up by several keys.
TASK_ROWS = 250_000


def _sum(value: Column) -> Column:
    """Doubles are added as exact decimals, so that the order of rows can't show."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def base_sums(shapes: DataFrame, *keys: str | Column, net_cut_deducts: bool = True) -> DataFrame:
    """Floor, wall, border, lf and ea of shapes by keys, base and unrounded, in one aggregation.

    A deduct that was cut out of its parent (cuts_shape_id) isn't subtracted again, unless net_cut_deducts is False. A
    count of 0 or without a value is one unit. Other roles count in shape_count alone.
    """
    role, area, zero = F.col("measure_role"), F.coalesce(F.col("area_sf"), F.lit(0)), F.lit(0)
    deducts = (role == "deduct") & (F.col("cuts_shape_id").isNull() if net_cut_deducts else F.lit(True))
    return shapes.groupBy(*keys).agg(
        F.count("*").alias("shape_count"),
        _sum(F.when(role == "floor_area", area).when(deducts, -area).otherwise(zero)).alias("floor"),
        _sum(F.when(role == "surface_area", area).otherwise(zero)).alias("wall"),
        _sum(F.when(role == "linear", area).otherwise(zero)).alias("border"),
        _sum(F.when(role == "linear", F.coalesce(F.col("perimeter_lf"), zero)).otherwise(zero)).alias("lf"),
        _sum(F.when(role == "count", or_else(F.col("count"), 1)).otherwise(zero)).alias("ea"),
    )


def order_quantities(conditions: DataFrame, base: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Condition rows from base sums keyed by condition_id (and whatever else base is grouped by): multiplied, wasted, rounded."""
    beside = conditions.select("ord", "id", "finish_tag", "multiplier", "waste_pct")
    rows = beside.join(base, beside["id"] == base["condition_id"], "left" if keep_empty else "inner").drop("condition_id")
    times = or_else(F.col("multiplier"), 1)
    waste = F.greatest(F.lit(0.0), number(F.col("waste_pct")))
    keys = [c for c in base.columns if c not in ("condition_id", "shape_count", *MEASURES)]
    scaled = rows.select("ord", "id", "finish_tag", *keys, times.alias("multiplier"), waste.alias("waste_pct"), (1 + waste / 100).alias("w"), F.coalesce("shape_count", F.lit(0)).cast("long").alias("shape_count"), *[(F.coalesce(F.col(m), F.lit(0.0)) * times).alias(m) for m in MEASURES])
    full = scaled.withColumn("total", F.col("floor") + F.col("wall") + F.col("border"))
    r = lambda name: round2_eps(F.col(name))
    net = lambda name: round2_eps(F.col(name) * F.col("w"))
    return full.select(
        "ord", "id", "finish_tag", *keys, "multiplier", "waste_pct", "shape_count", r("floor").alias("floor_sf"), r("wall").alias("wall_sf"), r("border").alias("border_sf"), r("lf").alias("lf"), F.col("ea"), r("total").alias("total_sf"),
        net("floor").alias("floor_sf_net"), net("wall").alias("wall_sf_net"), net("border").alias("border_sf_net"), net("lf").alias("lf_net"), net("total").alias("total_sf_net"), round2_eps(F.col("total") * F.col("w") / 9.0).alias("sy_net"),
    )


def condition_totals(conditions: DataFrame, shapes: DataFrame) -> DataFrame:
    return order_quantities(conditions, base_sums(shapes, "condition_id"))


def sheet_totals(conditions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Base, unrounded rows by sheet and condition; shapes of unknown conditions are left out."""
    base = base_sums(shapes, "sheet_id", "condition_id")
    beside = conditions.select("ord", "id", "finish_tag", or_else(F.col("multiplier"), 1).alias("multiplier"))
    rows = base.join(beside, base["condition_id"] == beside["id"])
    return rows.select("sheet_id", "ord", "id", "finish_tag", "multiplier", "shape_count", F.col("floor").alias("floor_sf"), F.col("wall").alias("wall_sf"), F.col("border").alias("border_sf"), "lf", "ea")


def grouped_totals(conditions: DataFrame, shapes: DataFrame, *keys: str) -> DataFrame:
    """Order-aware condition rows within each group of shapes (sheet, label, author, or several)."""
    return order_quantities(conditions, base_sums(shapes, *keys, "condition_id"), keep_empty=False)


def trimmed_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def label_rank(label: Column, vocabulary: list[str]) -> Column:
    """Order of groups: the vocabulary's, then others, then none."""
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>"), label)
    return F.when(label.isNull(), F.lit(10**9)).when(place > 0, place).otherwise(F.lit(10**8)).cast("long")


def grand_totals(rows: DataFrame) -> DataFrame:
    """Sums of the rounded condition rows, rounded once more; ea as it is."""
    rounded = [round2_eps(_sum(F.col(c))).alias(c) for c in ("total_sf", "total_sf_net", "lf", "lf_net", "sy_net")]
    return rows.agg(*rounded, _sum(F.col("ea")).alias("ea"))


def all_groupings(conditions: DataFrame, shapes: DataFrame) -> DataFrame:
    """The five groupings of a report in one pass: base sums by all keys, which every coarser grouping adds up, order quantities after.

    Every grouping has the condition, so shapes are dealt by it once, to as many tasks as there are TASK_ROWS of them, and all sums stay there: a task's
    memory doesn't grow with the table.
    """
    sets = {"condition": [], "sheet": ["sheet_id"], "label": ["label"], "author": ["author"], "sheet_label": ["sheet_id", "label"]}
    keys = ["sheet_id", "label", "author", "condition_id"]
    tasks = max(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shapes.count() // TASK_ROWS))
    small = base_sums(shapes.repartition(tasks, "condition_id"), *keys)
    kinds = dict(small.dtypes)
    rows = [F.struct(F.lit(name).alias("grouping"), *[(F.col(k) if k in of else F.lit(None).cast(kinds[k])).alias(k) for k in keys[:3]]) for name, of in sets.items()]
    each = small.select("condition_id", "shape_count", *MEASURES, F.explode(F.array(*rows)).alias("of")).select("of.*", "condition_id", "shape_count", *MEASURES)
    added = each.groupBy(*keys, "grouping").agg(F.sum("shape_count").alias("shape_count"), *[_sum(F.col(m)).alias(m) for m in MEASURES])
    return order_quantities(conditions, added, keep_empty=False)


def condition_materials(conditions: DataFrame, shapes: DataFrame, materials: DataFrame, seams: DataFrame | None = None) -> DataFrame:
    """Quantities to buy for each condition and material, from measured times multiplier without waste. Unnamed rows go."""
    base = base_sums(shapes, "condition_id")
    if seams is not None:
        base = base.join(seams.groupBy(F.col("condition_id").alias("seam_id")).agg(_sum(F.col("seam_lf")).alias("seam")), F.col("condition_id") == F.col("seam_id"), "left").drop("seam_id")
    else:
        base = base.withColumn("seam", F.lit(0.0))
    rows = conditions.select("ord", "id", "multiplier").join(base, F.col("id") == F.col("condition_id"), "left").drop("condition_id")
    named = materials.where(F.coalesce(F.col("name"), F.lit("")) != "")
    full = rows.join(named, rows["id"] == named["condition_id"])
    times = or_else(F.col("multiplier"), 1)
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * times
    total = value("floor") + value("wall") + value("border")
    basis = F.when(F.col("basis") == "linear", value("lf")).when(F.col("basis") == "count", value("ea")).when(F.col("basis") == "seam_lf", value("seam")).otherwise(total)
    return full.select("ord", "id", "m_ord", "name", F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("basis", F.lit("area")).alias("basis"), round2_eps(basis).alias("basis_qty"), material_quantity(basis, F.col("per"), F.col("round")).alias("qty"))


def buy_list(materials: DataFrame) -> DataFrame:
    """Sums of the conditions' rounded quantities by name and unit."""
    return materials.groupBy("name", "unit").agg(round2_eps(_sum(F.col("qty"))).alias("qty"))


def floor_perimeters(shapes: DataFrame, *keys: str) -> DataFrame:
    return shapes.where("measure_role = 'floor_area'").groupBy(*keys).agg(_sum(F.coalesce(F.col("perimeter_lf"), F.lit(0))).alias("perimeter_lf"))


def vertical_wall(conditions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Floor perimeter times the condition's height and multiplier; 0 without a positive height."""
    perimeter = floor_perimeters(shapes, "condition_id")
    rows = conditions.join(perimeter, F.col("id") == F.col("condition_id"), "left")
    height = number(F.col("height_ft"))
    value = round2_eps(F.coalesce("perimeter_lf", F.lit(0.0)) * height * or_else(F.col("multiplier"), 1))
    return rows.select("id", F.when(height <= 0, F.lit(0.0)).otherwise(value).alias("vertical_sf"))


def tally(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
