"""Totals, groupings, materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query
from plumbline.functions.keys import sheet_file, sheet_label, sheet_order, sheet_page
from plumbline.operators import totals
from plumbline.plans import projection as p

R2 = "floor(({} + 2.220446049250313e-16) * 100 + 0.5) / 100".format
_SUMS = "CAST(sum(r_floor) AS DOUBLE) AS floor, CAST(sum(r_wall) AS DOUBLE) AS wall, CAST(sum(r_border) AS DOUBLE) AS border, CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea, count(*) AS shape_count"


def order_sql(base: str, keys: str = "", join: str = "LEFT") -> str:
    """Order-aware rows in the oracle's SQL from base sums named base."""
    k = f"{keys}, " if keys else ""
    v = lambda m: f"coalesce({m}, 0) * m"
    return f"""
SELECT ord, id, finish_tag, {k}m AS multiplier, greatest(0.0::DOUBLE, waste_pct) AS waste_pct, coalesce(shape_count, 0) AS shape_count, {R2(v("floor"))} AS floor_sf, {R2(v("wall"))} AS wall_sf, {R2(v("border"))} AS border_sf,
  {R2(v("lf"))} AS lf, {v("ea")} AS ea, {R2("t")} AS total_sf, {R2(v("floor") + " * w")} AS floor_sf_net, {R2(v("wall") + " * w")} AS wall_sf_net, {R2(v("border") + " * w")} AS border_sf_net, {R2(v("lf") + " * w")} AS lf_net,
  {R2("t * w")} AS total_sf_net, {R2("t * w / 9.0::DOUBLE")} AS sy_net
FROM (SELECT c.ord, c.id, c.finish_tag, c.waste_pct, b.*, CASE WHEN coalesce(c.multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE c.multiplier END AS m, 1 + greatest(0.0::DOUBLE, coalesce(c.waste_pct, 0)) / 100.0::DOUBLE AS w,
  coalesce(floor, 0) * CASE WHEN coalesce(c.multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE c.multiplier END + coalesce(wall, 0) * CASE WHEN coalesce(c.multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE c.multiplier END + coalesce(border, 0) * CASE WHEN coalesce(c.multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE c.multiplier END AS t
  FROM conditions c {join} JOIN {base} b ON b.condition_id = c.id)"""


BASE = f", base AS (SELECT condition_id, {_SUMS} FROM roles GROUP BY condition_id)"
ROWS = p.SQL + BASE + f", rows_ AS ({order_sql('base')})"


@query("A01_condition_totals", p.SQL + BASE + order_sql("base"))
def a01(spark, sf):
    return totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf))


FIXED_SQL = """
SELECT * FROM (VALUES ('CT-1, honed', 3, 1.0::DOUBLE, 10.0::DOUBLE, 546.9::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 546.9::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 601.59::DOUBLE, 0.0::DOUBLE, 66.84::DOUBLE),
 ('LVT-2', 1, 2.0, 0.0, 421.1, 0.0, 0.0, 421.1, 0.0, 0.0, 421.1, 0.0, 46.79), ('RB-1', 2, 1.0, 5.0, 0.0, 0.0, 43.29, 43.29, 129.85, 0.0, 45.45, 136.34, 5.05),
 ('WT-1', 1, 1.0, 0.0, 0.0, 305.62, 0.0, 305.62, 0.0, 0.0, 305.62, 0.0, 33.96), ('CNT', 2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 0.0, 0.0))
 AS t(finish_tag, shape_count, multiplier, waste_pct, floor_sf, wall_sf, border_sf, total_sf, lf, ea, total_sf_net, lf_net, sy_net)
"""


@query("A01_fixed_report", FIXED_SQL.replace("SELECT *", "SELECT finish_tag, CAST(shape_count AS BIGINT) AS shape_count, multiplier, waste_pct, floor_sf, wall_sf, border_sf, total_sf, lf, ea, total_sf_net, lf_net, sy_net"))
def a01_fixed(spark, sf):
    """The fixed project's report rows; the oracle is the expected report itself."""
    conditions, shapes, _ = p.fixed(spark)
    rows = totals.condition_totals(conditions, shapes).where("shape_count > 0")
    return rows.select("finish_tag", "shape_count", "multiplier", "waste_pct", "floor_sf", "wall_sf", "border_sf", "total_sf", "lf", "ea", "total_sf_net", "lf_net", "sy_net")


@query("A02_sheet_totals", p.SQL + f"""SELECT b.sheet_id, c.ord, c.id, c.finish_tag, CASE WHEN coalesce(c.multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE c.multiplier END AS multiplier, shape_count, floor AS floor_sf, wall AS wall_sf, border AS border_sf, lf, ea
FROM (SELECT sheet_id, condition_id, {_SUMS} FROM roles GROUP BY ALL) b JOIN conditions c ON b.condition_id = c.id""")
def a02(spark, sf):
    return totals.sheet_totals(p.conditions(spark, sf), p.shapes(spark, sf))


def _grouped(name: str, keys: list[str], expressions: str, trimmed: tuple[str, ...] = ()):
    keyed = ", ".join(keys)
    sql = p.SQL + f", base AS (SELECT {expressions}, condition_id, {_SUMS} FROM roles GROUP BY ALL)" + order_sql("base", keyed, "")

    @query(name, sql)
    def run(spark, sf):
        shapes = p.shapes(spark, sf).withColumns({c: totals.trimmed_or_null(F.col(c)) for c in trimmed})
        return totals.grouped_totals(p.conditions(spark, sf), shapes, *keys)


def register_grouped() -> None:
    _grouped("A03_by_sheet", ["sheet_id"], "sheet_id")
    _grouped("A04_by_label", ["label"], "nullif(trim(label), '') AS label", ("label",))
    _grouped("A05_by_author", ["author"], "nullif(trim(author), '') AS author", ("author",))
    _grouped("A06_by_sheet_and_label", ["sheet_id", "label"], "sheet_id, nullif(trim(label), '') AS label", ("label",))


@query("A06_all_groupings", p.SQL + f""", base AS (SELECT CASE grouping(sheet_id, label, author) WHEN 7 THEN 'condition' WHEN 3 THEN 'sheet' WHEN 5 THEN 'label' WHEN 6 THEN 'author' ELSE 'sheet_label' END AS grouping, sheet_id, label, author, condition_id, {_SUMS}
FROM roles GROUP BY GROUPING SETS ((condition_id), (sheet_id, condition_id), (label, condition_id), (author, condition_id), (sheet_id, label, condition_id)))""" + order_sql("base", "sheet_id, label, author, grouping", ""))
def a06_all(spark, sf):
    return totals.all_groupings(p.conditions(spark, sf), p.shapes(spark, sf))


@query("A04_label_order", p.SQL + "SELECT label, count(*) AS n, CAST(CASE WHEN label IS NULL THEN 1000000000 WHEN label = 'R' THEN 1 ELSE 100000000 END AS BIGINT) AS rank FROM shapes GROUP BY label")
def a04_order(spark, sf):
    """Labels in vocabulary order, others after, none last."""
    n = p.shapes(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("rank", totals.label_rank(F.col("label"), ["R", "Z"])).orderBy("rank", "label")


@query("A07_rows_by_custom_column", ROWS + "SELECT CASE WHEN c.k = '' THEN NULL ELSE c.k END AS value, count(*) AS n, CAST(sum(CAST(total_sf AS DECIMAL(28,2))) AS DOUBLE) AS total_sf FROM rows_ r JOIN (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS k FROM part) c ON c.p_partkey = r.id GROUP BY ALL")
def a07(spark, sf):
    """Condition rows by a custom column; blank values are unassigned."""
    rows = totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf))
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", totals.trimmed_or_null(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))).alias("value"))
    return rows.join(part, rows["id"] == part["p_partkey"]).groupBy("value").agg(F.count("*").alias("n"), F.sum(F.col("total_sf").cast("decimal(28,2)")).cast("double").alias("total_sf"))


_DSUM = "floor((CAST(sum(CAST({0} AS DECIMAL(28,6))) AS DOUBLE) + 2.220446049250313e-16) * 100 + 0.5) / 100 AS {0}".format


@query("A08_grand_totals", ROWS + f"SELECT {', '.join(_DSUM(c) for c in ('total_sf', 'total_sf_net', 'lf', 'lf_net', 'sy_net'))}, CAST(sum(CAST(ea AS DECIMAL(28,6))) AS DOUBLE) AS ea FROM rows_")
def a08(spark, sf):
    return totals.grand_totals(totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf)))


_MATERIALS = BASE + """, mats AS (SELECT c.ord, c.id, m.m_ord, m.name, coalesce(m.unit, '') AS unit, coalesce(m.basis, 'area') AS basis,
  CASE m.basis WHEN 'linear' THEN coalesce(lf, 0) * k WHEN 'count' THEN coalesce(ea, 0) * k WHEN 'seam_lf' THEN 0.0::DOUBLE ELSE coalesce(floor, 0) * k + coalesce(wall, 0) * k + coalesce(border, 0) * k END AS b, m.per, m.round
  FROM (SELECT *, CASE WHEN coalesce(multiplier, 0) = 0 THEN 1.0::DOUBLE ELSE multiplier END AS k FROM conditions) c LEFT JOIN base ON base.condition_id = c.id JOIN materials m ON m.condition_id = c.id WHERE coalesce(m.name, '') <> ''),
bought AS (SELECT ord, id, m_ord, name, unit, basis, floor((b + 2.220446049250313e-16) * 100 + 0.5) / 100 AS basis_qty,
  CASE WHEN round THEN CAST(ceil(CASE WHEN per > 0 THEN b / per ELSE 0 END - 1e-9) AS DOUBLE) + 0.0::DOUBLE ELSE floor((CASE WHEN per > 0 THEN b / per ELSE 0 END + 2.220446049250313e-16) * 100 + 0.5) / 100 END AS qty FROM mats)
"""


def _materials(spark, sf):
    return totals.condition_materials(p.conditions(spark, sf), p.shapes(spark, sf), p.materials(spark, sf))


@query("A09_condition_materials", p.SQL + _MATERIALS + "SELECT * FROM bought")
def a09(spark, sf):
    return _materials(spark, sf)


@query("A10_buy_list", p.SQL + _MATERIALS + f"SELECT name, unit, {_DSUM('qty')} FROM bought GROUP BY name, unit")
def a10(spark, sf):
    return totals.buy_list(_materials(spark, sf))


@query("A10_fixed_buy_list", "SELECT * FROM (VALUES ('Thinset', 'bag', 6.0::DOUBLE), ('Grout', 'bag', 4.56), ('Adhesive', 'gal', 1.0), ('Transition strip', 'ea', 7.0)) AS t(name, unit, qty)")
def a10_fixed(spark, sf):
    return totals.buy_list(totals.condition_materials(*p.fixed(spark)))


@query("A11_floor_perimeters", p.SQL + "SELECT sheet_id, condition_id, CAST(sum(perimeter_lf) AS DOUBLE) AS perimeter_lf FROM shapes WHERE measure_role = 'floor_area' GROUP BY ALL")
def a11(spark, sf):
    return totals.floor_perimeters(p.shapes(spark, sf), "sheet_id", "condition_id")


@query("A12_vertical_wall", p.SQL + f"SELECT c.id, CASE WHEN height_ft <= 0 THEN 0.0::DOUBLE ELSE {R2('coalesce(pl, 0) * height_ft * CASE WHEN multiplier = 0 THEN 1.0::DOUBLE ELSE multiplier END')} END AS vertical_sf FROM conditions c LEFT JOIN (SELECT condition_id, CAST(sum(perimeter_lf) AS DOUBLE) AS pl FROM shapes WHERE measure_role = 'floor_area' GROUP BY 1) s ON s.condition_id = c.id")
def a12(spark, sf):
    return totals.vertical_wall(p.conditions(spark, sf), p.shapes(spark, sf))


@query("A14_author_tally", p.SQL + "SELECT author, count(*) AS n FROM shapes GROUP BY author")
def a14(spark, sf):
    return totals.tally(p.shapes(spark, sf), F.col("author"), "author")


@query("A21_revision_sheet_rows", p.SQL + """SELECT sheet_id, count(*) AS shape_count, CAST(sum(CASE measure_role WHEN 'floor_area' THEN area_sf WHEN 'deduct' THEN -area_sf ELSE 0 END) AS DOUBLE) AS floor, CAST(sum(r_wall) AS DOUBLE) AS wall, CAST(sum(r_border) AS DOUBLE) AS border,
CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea FROM roles GROUP BY sheet_id""")
def a21(spark, sf):
    """Every deduct counts here, cut or not."""
    return totals.base_sums(p.shapes(spark, sf), "sheet_id", net_cut_deducts=False)


@query("A28_contribution_totals", ROWS + "SELECT finish_tag, multiplier, waste_pct, shape_count, total_sf, total_sf_net, ea FROM rows_ WHERE shape_count > 0")
def a28(spark, sf):
    return totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf)).where("shape_count > 0").select("finish_tag", "multiplier", "waste_pct", "shape_count", "total_sf", "total_sf_net", "ea")


@query("J01_shapes_with_conditions", p.SQL + "SELECT c.finish_tag, s.measure_role, count(*) AS n FROM shapes s LEFT JOIN conditions c ON c.id = s.condition_id GROUP BY ALL")
def j01(spark, sf):
    from plumbline.operators.summaries import with_condition

    return with_condition(p.shapes(spark, sf), p.conditions(spark, sf)).groupBy("finish_tag", "measure_role").agg(F.count("*").alias("n"))


@query("O01_sheet_order", p.SQL + "SELECT sheet_id, row_number() OVER (ORDER BY split_part(sheet_id, '#', 1), CAST(CASE WHEN contains(sheet_id, '#') THEN split_part(sheet_id, '#', 2) ELSE '1' END AS INT)) AS place FROM (SELECT DISTINCT sheet_id FROM shapes)")
def o01(spark, sf):
    from plumbline.plans.ranking import numbered

    sheets = p.shapes(spark, sf).select("sheet_id").distinct()
    keyed = sheets.select("sheet_id", *[c.alias(f"by_{i}") for i, c in enumerate(sheet_order(F.col("sheet_id")))])
    return numbered(keyed, "place", "by_0", "by_1", "by_2").select("sheet_id", "place")


@query("O02_sheet_keys", "SELECT * FROM (VALUES ('a#b.pdf#12', 'a#b.pdf', 12, 'a#b — p.12'), ('plan.PDF', 'plan.PDF', 1, 'plan'), ('#3', '#3', 1, '#3'), ('x#y', 'x#y', 1, 'x#y'), ('plan.pdf#1', 'plan.pdf', 1, 'plan')) AS t(sheet_id, file, page, label)")
def o02(spark, sf):
    keys = spark.createDataFrame([(k,) for k in ("a#b.pdf#12", "plan.PDF", "#3", "x#y", "plan.pdf#1")], "sheet_id string")
    s = F.col("sheet_id")
    return keys.select(s, sheet_file(s).alias("file"), sheet_page(s).alias("page"), sheet_label(s).alias("label"))


@query("P23_live_counter", ROWS + "SELECT id, finish_tag, total_sf, lf, ea FROM rows_ WHERE shape_count > 0")
def p23(spark, sf):
    return totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf)).where("shape_count > 0").select("id", "finish_tag", "total_sf", "lf", "ea")


@query("P09_waste_columns", ROWS + f"SELECT r.id, {R2('total_sf_net - total_sf')} AS waste_sf, {R2('lf_net - lf')} AS waste_lf FROM rows_ r")
def p09(spark, sf):
    from plumbline.functions.numeric import round2_eps

    rows = totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf))
    return rows.select("id", round2_eps(F.col("total_sf_net") - F.col("total_sf")).alias("waste_sf"), round2_eps(F.col("lf_net") - F.col("lf")).alias("waste_lf"))


@query("P10_metric_rows", ROWS + f"SELECT id, {R2('total_sf * 0.09290304::DOUBLE')} AS total_m2, {R2('total_sf_net * 0.09290304::DOUBLE')} AS total_m2_net, {R2('lf * 0.3048::DOUBLE')} AS m, ea FROM rows_")
def p10(spark, sf):
    from plumbline.functions.numeric import ft_to_m, round2_eps, sf_to_m2

    rows = totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf))
    return rows.select("id", round2_eps(sf_to_m2(F.col("total_sf"))).alias("total_m2"), round2_eps(sf_to_m2(F.col("total_sf_net"))).alias("total_m2_net"), round2_eps(ft_to_m(F.col("lf"))).alias("m"), "ea")


@query("P22_wall_heights", p.SQL + "SELECT condition_id, row_number() OVER (PARTITION BY condition_id ORDER BY ts, sheet_id, area_sf, perimeter_lf) AS place, CAST(coalesce(area_sf, perimeter_lf * 9) AS DOUBLE) AS area_sf FROM shapes WHERE measure_role = 'surface_area'")
def p22(spark, sf):
    from plumbline.operators.summaries import wall_breakdown

    walls = p.shapes(spark, sf).where("measure_role = 'surface_area'")
    return wall_breakdown(walls, ["ts", "sheet_id", "area_sf", "perimeter_lf"]).select("condition_id", "place", "area_sf")


@query("P21_multiplier_validity", "SELECT p_partkey AS id, p_size % 4 > 0 AS valid FROM part")
def p21(spark, sf):
    from plumbline.operators.summaries import valid_multiplier

    return p.conditions(spark, sf).select("id", valid_multiplier(F.col("multiplier")).alias("valid"))


register_grouped()
