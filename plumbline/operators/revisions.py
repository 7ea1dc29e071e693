"""Comparing two revisions of a takeoff: paired condition rows, sheets, materials, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import round2_eps

FIELDS = ["floor_sf", "wall_sf", "border_sf", "lf", "ea", "total_sf", "total_sf_net"]
SHEET_FIELDS = ["floor_sf", "wall_sf", "border_sf", "lf", "ea"]


def pair_rows(a: DataFrame, b: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Rows of a and b side by side: by id, the rest by tag in order, and who has no partner alone.

    Both hold id, finish_tag, ord, shape_count and the fields. Rows without a tag pair by id only. pair_key names a pair:
    the id, or tag:<tag>#<number> for those paired by tag.
    """
    keep = ["id", "finish_tag", "ord", "shape_count", *fields]
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in keep])
    left, right = side(a, "a"), side(b, "b")
    by_id = left.join(right, F.col("a_id") == F.col("b_id"), "full")
    matched = by_id.where("a_id IS NOT NULL AND b_id IS NOT NULL").withColumn("pair_key", F.col("b_id").cast("string"))

    def rest(df: DataFrame, s: str) -> DataFrame:
        tag = F.nullif(F.col(f"{s}_finish_tag"), F.lit(""))
        own = df.select(*[f"{s}_{c}" for c in keep])
        place = F.row_number().over(Window.partitionBy(f"{s}_finish_tag").orderBy(f"{s}_ord", f"{s}_id")) - 1
        return own.withColumn(f"{s}_n", F.when(tag.isNotNull(), place))

    alone_a = rest(by_id.where("b_id IS NULL"), "a")
    alone_b = rest(by_id.where("a_id IS NULL"), "b")
    same = (F.col("a_finish_tag") == F.col("b_finish_tag")) & (F.col("a_n") == F.col("b_n"))
    by_tag = alone_a.join(alone_b, same, "full")
    paired = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    key = F.when(paired, F.concat(F.lit("tag:"), "b_finish_tag", F.lit("#"), F.col("b_n").cast("string"))).otherwise(F.coalesce("b_id", "a_id").cast("string"))
    return matched.unionByName(by_tag.withColumn("pair_key", key).drop("a_n", "b_n"))


def _deltas(fields: list[str]) -> dict[str, Column]:
    return {f"d_{f}": round2_eps(F.coalesce(F.col(f"b_{f}"), F.lit(0.0)) - F.coalesce(F.col(f"a_{f}"), F.lit(0.0))) for f in fields}


def visible(name: str, value: Column) -> Column:
    return F.abs(value) >= (0.5 if name.endswith("ea") else 0.05)


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def diff_conditions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with signed deltas and a status; a lone row with nothing on it is unchanged, never added or removed."""
    paired = pair_rows(a, b).withColumns(_deltas(FIELDS))
    moved = _any([visible(f, F.col(f"d_{f}")) for f in FIELDS])
    substance = lambda s: (F.col(f"{s}_shape_count") > 0) | _any([visible(f, F.coalesce(F.col(f"{s}_{f}"), F.lit(0.0))) for f in FIELDS])
    status = (
        F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.when(moved, "changed").otherwise("unchanged"))
        .when(F.col("b_id").isNotNull(), F.when(substance("b"), "added").otherwise("unchanged"))
        .otherwise(F.when(substance("a"), "removed").otherwise("unchanged"))
    )
    return paired.select("pair_key", F.coalesce("b_finish_tag", "a_finish_tag").alias("finish_tag"), status.alias("status"), *[f"d_{f}" for f in FIELDS])


def diff_sheets(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: base sums by sheet_id. A sheet on one side alone is added or removed."""
    side = lambda df, s: df.select(F.col("sheet_id").alias(f"{s}_sheet"), *[round2_eps(F.col(f.removesuffix("_sf"))).alias(f"{s}_{f}") for f in SHEET_FIELDS])
    both = side(a, "a").join(side(b, "b"), F.col("a_sheet") == F.col("b_sheet"), "full").withColumns(_deltas(SHEET_FIELDS))
    moved = _any([visible(f, F.col(f"d_{f}")) for f in SHEET_FIELDS])
    status = F.when(F.col("a_sheet").isNull(), "added").when(F.col("b_sheet").isNull(), "removed").when(moved, "changed").otherwise("unchanged")
    return both.select(F.coalesce("b_sheet", "a_sheet").alias("sheet_id"), status.alias("status"), *[f"d_{f}" for f in SHEET_FIELDS])


def diff_materials(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: buy lists (name, unit, qty). Rows that are 0 on both sides go."""
    both = a.withColumnRenamed("qty", "a_q").join(b.withColumnRenamed("qty", "b_q"), ["name", "unit"], "full")
    delta = round2_eps(F.coalesce("b_q", F.lit(0.0)) - F.coalesce("a_q", F.lit(0.0)))
    status = F.when(F.col("a_q").isNull(), "added").when(F.col("b_q").isNull(), "removed").when(F.abs(delta) >= 0.005, "changed").otherwise("unchanged")
    out = both.select("name", "unit", F.coalesce("a_q", F.lit(0.0)).alias("a_qty"), F.coalesce("b_q", F.lit(0.0)).alias("b_qty"), delta.alias("delta"), status.alias("status"))
    return out.where((F.col("a_qty") != 0) | (F.col("b_qty") != 0))


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Base rows by sheet and condition of two snapshots: a change is what shows at one decimal; lone rows always count."""
    keys = ["sheet_id", "id"]
    side = lambda df, s: df.select(*keys, *[F.col(f).alias(f"{s}_{f}") for f in SHEET_FIELDS], F.lit(True).alias(f"has_{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    shown = lambda f: F.floor(F.abs(F.coalesce(F.col(f"b_{f}"), F.lit(0.0)) - F.coalesce(F.col(f"a_{f}"), F.lit(0.0))) * 10 + 0.5) != 0
    status = F.when(F.col("has_a").isNull(), "added").when(F.col("has_b").isNull(), "removed").when(_any([shown(f) for f in SHEET_FIELDS]), "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"))
