"""Measurement frames for the driver's tables: a fixed report, and a deterministic projection of order lines.

The projected frames are synthetic: they put the operators' logic to work at scale and mean nothing as drawings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ["floor_area", "deduct", "linear", "surface_area", "count"]
SHAPES = "id string, condition_id string, sheet_id string, measure_role string, height_ft double, area_sf double, perimeter_lf double, count double, cuts_shape_id string"
CONDITIONS = "ord int, id string, finish_tag string, multiplier double, waste_pct double"
MATERIALS = "condition_id string, m_ord int, name string, per double, basis string, unit string, round boolean"

# A small project with all roles, a comma in a tag, missing multiplier and waste, and a condition without shapes.
FIXED_CONDITIONS = [(0, "c1", "CT-1, honed", 1.0, 10.0), (1, "c2", "LVT-2", 2.0, 0.0), (2, "c3", "RB-1", None, 5.0), (3, "c4", "WT-1", 1.0, None), (4, "c5", "CNT", 1.0, None), (5, "c6", "PT-9", 1.0, 10.0)]
FIXED_SHAPES = [
    ("s1", "c1", "plan.pdf", "floor_area", None, 400.5, 80.0, None, None), ("s2", "c1", "plan.pdf", "floor_area", None, 200.0, 60.0, None, None), ("s3", "c1", "plan.pdf#2", "deduct", None, 53.6, 30.0, None, None),
    ("s4", "c2", "plan.pdf", "floor_area", None, 210.55, 58.0, None, None), ("s5", "c3", "plan.pdf", "linear", 0.33, 28.1, 84.3, None, None), ("s6", "c3", "plan.pdf#2", "linear", 0.33, 15.19, 45.55, None, None),
    ("s7", "c4", "plan.pdf#2", "surface_area", 9.0, 305.62, 33.96, None, None), ("s8", "c5", "plan.pdf", "count", None, None, None, 6.0, None), ("s9", "c5", "plan.pdf#2", "count", None, None, None, 0.0, None),
]
FIXED_MATERIALS = [("c1", 0, "Thinset", 95.0, "area", "bag", True), ("c1", 1, "Grout", 120.0, "area", "bag", False), ("c2", 0, "Adhesive", 700.0, "area", "gal", True), ("c5", 0, "Transition strip", 1.0, "count", "ea", True)]


def fixed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(FIXED_CONDITIONS, CONDITIONS), spark.createDataFrame(FIXED_SHAPES, SHAPES), spark.createDataFrame(FIXED_MATERIALS, MATERIALS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    role = F.when(line == 3, "deduct").when(line == 4, "linear").when(line == 5, "surface_area").when(line == 6, "count").otherwise("floor_area")
    page = F.col("l_orderkey") % 5
    sheet = F.concat(F.lit("plan"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".pdf"), F.when(page == 0, "").otherwise(F.concat(F.lit("#"), (page + 1).cast("string"))))
    cuts = F.when((role == "deduct") & (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05), F.lit("cut"))
    return lines(spark, sf_dir).select(
        F.col("l_partkey").alias("condition_id"), sheet.alias("sheet_id"), role.alias("measure_role"), F.col("l_extendedprice").cast("decimal(18,2)").alias("area_sf"), F.col("l_quantity").cast("decimal(18,2)").alias("perimeter_lf"),
        (F.col("l_quantity").cast("int") % 4).alias("count"), cuts.alias("cuts_shape_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("label"),
        F.concat(F.lit("est-"), (F.col("l_suppkey") % 4).cast("string")).alias("author"), F.col("l_shipdate").alias("ts"),
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type").alias("finish_tag"), (F.col("p_size") % 4).cast("double").alias("multiplier"), (F.col("p_size") % 13).cast("double").alias("waste_pct"),
        (F.col("p_size") % 11).cast("double").alias("height_ft"),
    )


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each condition; coverage 0, missing names and unrounded rows among them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    basis = F.element_at(F.array(F.lit("area"), F.lit("linear"), F.lit("count"), F.lit("seam_lf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    one = part.select(F.col("p_partkey").alias("condition_id"), F.lit(0).alias("m_ord"), F.col("p_brand").alias("name"), (F.col("p_size") % 7).cast("double").alias("per"), basis.alias("basis"), F.lit("bag").alias("unit"), F.lit(True).alias("round"))
    two = part.select(F.col("p_partkey").alias("condition_id"), F.lit(1).alias("m_ord"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("name"), (F.col("p_size") * 1.5).alias("per"), F.lit("area").alias("basis"), F.lit("gal").alias("unit"), (F.col("p_size") % 2 == 0).alias("round"))
    return one.unionByName(two)


#: The same frames in the oracle's SQL.
SQL = """
WITH shapes AS (
  SELECT l_partkey AS condition_id,
    'plan' || CAST(l_suppkey % 7 AS VARCHAR) || '.pdf' || CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE '#' || CAST(l_orderkey % 5 + 1 AS VARCHAR) END AS sheet_id,
    CASE l_linenumber WHEN 3 THEN 'deduct' WHEN 4 THEN 'linear' WHEN 5 THEN 'surface_area' WHEN 6 THEN 'count' ELSE 'floor_area' END AS measure_role,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS area_sf, CAST(l_quantity AS DECIMAL(18,2)) AS perimeter_lf, CAST(trunc(l_quantity) AS INT) % 4 AS count,
    CASE WHEN l_linenumber = 3 AND l_linestatus = 'F' AND l_tax > 0.05 THEN 'cut' END AS cuts_shape_id,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, 'est-' || CAST(l_suppkey % 4 AS VARCHAR) AS author, l_shipdate AS ts
  FROM lineitem),
conditions AS (
  SELECT p_partkey AS ord, p_partkey AS id, p_brand || '/' || p_type AS finish_tag, CAST(p_size % 4 AS DOUBLE) AS multiplier, CAST(p_size % 13 AS DOUBLE) AS waste_pct, CAST(p_size % 11 AS DOUBLE) AS height_ft FROM part),
materials AS (
  SELECT p_partkey AS condition_id, 0 AS m_ord, p_brand AS name, CAST(p_size % 7 AS DOUBLE) AS per, ['area','linear','count','seam_lf'][CAST(p_partkey % 4 + 1 AS INT)] AS basis, 'bag' AS unit, TRUE AS round FROM part
  UNION ALL
  SELECT p_partkey, 1, CASE WHEN p_size % 5 > 0 THEN p_type END, CAST(p_size AS DOUBLE) * 1.5, 'area', 'gal', p_size % 2 = 0 FROM part),
roles AS (
  SELECT *, CASE WHEN measure_role = 'floor_area' THEN area_sf WHEN measure_role = 'deduct' AND cuts_shape_id IS NULL THEN -area_sf ELSE 0 END AS r_floor,
    CASE WHEN measure_role = 'surface_area' THEN area_sf ELSE 0 END AS r_wall, CASE WHEN measure_role = 'linear' THEN area_sf ELSE 0 END AS r_border,
    CASE WHEN measure_role = 'linear' THEN perimeter_lf ELSE 0 END AS r_lf, CASE WHEN measure_role = 'count' THEN CASE WHEN coalesce(count, 0) = 0 THEN 1 ELSE count END ELSE 0 END AS r_ea
  FROM shapes)
"""
