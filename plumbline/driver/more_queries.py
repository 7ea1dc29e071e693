"""Smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.drawing_queries import _SPANS, spans
from plumbline.driver.geometry_queries import _RECTS, rects
from plumbline.driver.merge_queries import _PAIRS, _sides
from plumbline.driver.registry import query, table
from plumbline.driver.totals_queries import ROWS
from plumbline.operators import more, revisions, scope, totals
from plumbline.plans import projection as p
from plumbline.plans.ranking import numbered
from plumbline.sources.takeoff import csv_lines


@query("P11_custom_columns", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS value FROM part")
def p11(spark, sf):
    attrs = F.create_map(F.lit("room"), F.when(F.col("p_size") % 4 == 0, F.lit("  ")).otherwise(F.col("p_brand")), F.lit("x"), F.lit("y"))
    return table(spark, sf, "part").select("p_partkey", more.custom_column(attrs, "room").alias("value"))


@query("P08_visible_columns", ROWS + "SELECT id, finish_tag, total_sf, ea FROM rows_")
def p08(spark, sf):
    rows = totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf))
    names = more.visible_columns([("id", True, True), ("finish_tag", True, True), ("total_sf", False, True), ("lf", False, True), ("ea", False, False)], hidden={"lf"}, shown={"ea"})
    return rows.select(*names)


@query("J15_tags_in_tables", _SPANS + "SELECT sheet_id, ord AS id, sheet_id % 3 = 0 AND x0 BETWEEN 10 AND 40 AND y0 BETWEEN 10 AND 50 AS held FROM s")
def j15(spark, sf):
    s = spans(spark, sf)
    regions = s.where("sheet_id % 3 = 0").select("sheet_id", F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(50.0).alias("y1")).distinct()
    return more.in_regions(s.select("sheet_id", F.col("ord").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), regions).select("sheet_id", "id", "held")


@query("J13_deduct_parents", _RECTS + "SELECT d.id, count(f.id) AS candidates, CASE WHEN count(f.id) = 1 THEN min(f.id) ELSE -1 END AS parent FROM (SELECT *, (x0 + x1) / 2 + 0.25 AS cx, (y0 + y1) / 2 + 0.25 AS cy FROM r WHERE id % 3 = 0) d LEFT JOIN (SELECT * FROM r WHERE id % 3 > 0) f ON f.sheet_id = d.sheet_id AND f.condition_id = d.condition_id AND f.x0 < cx AND cx < f.x1 AND f.y0 < cy AND cy < f.y1 GROUP BY 1")
def j13(spark, sf):
    r = rects(spark, sf)
    deducts = r.where("id % 3 = 0").select("sheet_id", "id", "condition_id", ((F.col("x0") + F.col("x1")) / 2 + 0.25).alias("x"), ((F.col("y0") + F.col("y1")) / 2 + 0.25).alias("y"))
    floors = r.where("id % 3 > 0").withColumn("ring", F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1")))
    return more.unique_parent(deducts, floors)


@query("J18_nearest_revision_markers", _SPANS + """, d AS (SELECT t.sheet_id, t.ord, m.ord AS m_ord, power(greatest(0.0, m.x0 - t.x1, t.x0 - m.x1), 2) + power(greatest(0.0, m.y0 - t.y1, t.y0 - m.y1), 2) AS d2 FROM s t JOIN s m ON t.sheet_id = m.sheet_id AND t.ord % 2 = 0 AND m.ord % 2 = 1)
SELECT sheet_id, ord, m_ord AS marker FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, ord ORDER BY d2, m_ord) AS k FROM d WHERE d2 <= 225) WHERE k = 1""")
def j18(spark, sf):
    s = spans(spark, sf)
    return more.nearest_marker(s.where("ord % 2 = 0"), s.where("ord % 2 = 1"))


@query("J21_continued_tables", "SELECT p_partkey AS id, p_size % 3 > 0 AS continued, coalesce(CASE WHEN p_size % 3 > 0 THEN last_value(CASE WHEN p_size % 3 = 0 THEN p_partkey END IGNORE NULLS) OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, -1) AS base_id FROM part")
def j21(spark, sf):
    title = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, " (CONT.)").otherwise(" - continued"))
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("kind"), title.alias("title"))
    return more.continuations(t).withColumn("base_id", F.coalesce("base_id", F.lit(-1)))


@query("F14_region_text", _SPANS + "SELECT sheet_id, string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY ord) AS text FROM s WHERE x0 < 50 AND y1 > 20 GROUP BY 1")
def f14(spark, sf):
    return more.read_text(spans(spark, sf).withColumn("str", F.col("ord").cast("string")), (F.col("x0") < 50) & (F.col("y1") > 20))


@query("F12_joined_runs", "SELECT * FROM (VALUES (1, 1, 'SCALE 1:', 0.0::DOUBLE, 40.0::DOUBLE), (1, 2, '50', 40.5, 50.0), (2, 1, 'A-', 0.0, 10.0), (2, 2, '101', 20.0, 30.0), (3, 1, '12', 0.0, 10.0), (3, 2, '34', 10.5, 20.0)) AS v(line, run, text, x0, x1) WHERE NOT (line = 1) UNION ALL SELECT 1, 1, 'SCALE 1:', 0.0, 40.0 WHERE FALSE UNION ALL SELECT 1, 1, 'SCALE A1:50', 0.0, 50.0")
def f12(spark, sf):
    s = [(1, 1, 0, "SCALE ", 0.0, 30.0), (1, 1, 1, "A1:", 30.5, 40.0), (1, 1, 2, "50", 40.5, 50.0), (1, 2, 0, "A-", 0.0, 10.0), (1, 2, 1, "101", 20.0, 30.0), (1, 3, 0, "12", 0.0, 10.0), (1, 3, 1, "34", 10.5, 20.0)]
    df = spark.createDataFrame(s, "sheet_id int, line int, ord int, str string, x0 double, x1 double").withColumn("h", F.lit(8.0))
    return more.joined_runs(df).select("line", F.col("run").cast("int").alias("run"), "text", "x0", "x1")


@query("D13_set_scale", "SELECT o_orderkey, CASE WHEN n = 1 AND v > 0 THEN v END AS units_per_px, CASE WHEN n = 0 THEN 'no scale stated' WHEN n > 1 THEN 'more than one scale stated' WHEN NOT v > 0 THEN 'scale must be positive' ELSE '' END AS reason FROM (SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT AS n, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 5 AS DOUBLE) WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS v FROM orders)")
def d13(spark, sf):
    k, none = F.col("o_orderkey"), F.lit(None).cast("double")
    s = more.set_scale(F.when(k % 2 == 0, (F.col("o_custkey") % 5).cast("double")), F.when(k % 3 == 0, F.lit(0.5)), none, none)
    return table(spark, sf, "orders").select("o_orderkey", s["units_per_px"].alias("units_per_px"), F.coalesce(s["reason"], F.lit("")).alias("reason"))


@query("D03_subtracted_rectangles", _RECTS + """, p AS (SELECT a.id, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM r a JOIN r b ON b.id = a.id + 1 AND b.sheet_id = a.sheet_id),
q AS (SELECT *, CASE WHEN u1 <= x0 OR u0 >= x1 OR v1 <= y0 OR v0 >= y1 THEN 'whole' WHEN u0 <= x0 AND u1 >= x1 AND v0 <= y0 AND v1 >= y1 THEN 'gone' WHEN (v0 <= y0 AND v1 >= y1 AND (u0 <= x0 OR u1 >= x1)) OR (u0 <= x0 AND u1 >= x1 AND (v0 <= y0 OR v1 >= y1)) THEN 'trimmed' ELSE 'refused' END AS status FROM p)
SELECT id, status, CASE status WHEN 'gone' THEN 0.0 WHEN 'trimmed' THEN (x1 - x0) * (y1 - y0) - (least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)) ELSE (x1 - x0) * (y1 - y0) END AS area FROM q""")
def d03(spark, sf):
    r = rects(spark, sf)
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")]
    pairs = r.select("id", "sheet_id", *side("l")).join(r.select((F.col("id") - 1).alias("id"), "sheet_id", *side("w")), ["id", "sheet_id"])
    return more.subtract_rectangle(pairs)


@query("J10_candidate_overlaps", _RECTS + "SELECT a.id AS candidate, count(*) AS overlaps FROM r a JOIN r b ON a.sheet_id = b.sheet_id AND a.condition_id = b.condition_id AND a.id <> b.id AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) > 0 AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.05 GROUP BY 1")
def j10(spark, sf):
    """How many floors of its own condition a candidate would overlap."""
    pairs = scope.rectangle_collisions(rects(spark, sf)).where("same_condition")
    return pairs.select(F.explode(F.array("a_id", "b_id")).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("overlaps"))


@query("O03_collisions_ranked", _RECTS + ", p AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS m FROM r a JOIN r b ON a.sheet_id = b.sheet_id AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1), c AS (SELECT a_id, b_id, floor(s * 100 + 0.5) / 100 AS shared_sf FROM p WHERE s / m >= 0.05) SELECT row_number() OVER (ORDER BY shared_sf DESC, a_id, b_id) AS place, a_id, b_id, shared_sf FROM c")
def o03_ranked(spark, sf):
    """All overlaps with their place, the largest first."""
    found = scope.rectangle_collisions(rects(spark, sf)).select("a_id", "b_id", "shared_sf")
    return numbered(found, "place", F.desc("shared_sf"), "a_id", "b_id")


@query("F30_opening_sizes", "SELECT * FROM (VALUES ('10x21', 1.0::DOUBLE, 2.1::DOUBLE), ('1000 x 2100', 1.0, 2.1), ('0,9x2,1', 0.9, 2.1), ('door', NULL, NULL)) AS v(text, width_m, height_m)")
def f30(spark, sf):
    s = more.opening_size(F.col("text"))
    return spark.createDataFrame([(x,) for x in ("10x21", "1000 x 2100", "0,9x2,1", "door")], "text string").select("text", s["width_m"].alias("width_m"), s["height_m"].alias("height_m"))


@query("F31_sheet_labels", p.SQL + "SELECT DISTINCT sheet_id, CASE WHEN contains(sheet_id, '#') THEN replace(split_part(sheet_id, '#', 1), '.pdf', '') || ' — p.' || split_part(sheet_id, '#', 2) ELSE replace(sheet_id, '.pdf', '') END AS label FROM shapes")
def f31(spark, sf):
    from plumbline.functions.keys import sheet_label

    return p.shapes(spark, sf).select("sheet_id").distinct().withColumn("label", sheet_label(F.col("sheet_id")))


@query("F19_dimension_texts", "SELECT * FROM (VALUES ('12''-4\"', true), ('3'' - 0 1/2\"', true), ('12''', false), ('x 1''-2\"', false)) AS v(text, is_dimension)")
def f19(spark, sf):
    from plumbline.functions.text import dimension_text

    return spark.createDataFrame([(x,) for x in ("12'-4\"", "3' - 0 1/2\"", "12'", "x 1'-2\"")], "text string").select("text", dimension_text(F.col("text")).alias("is_dimension"))


@query("M12_propagated_variants", "SELECT p_partkey AS id, p_type AS name, CASE WHEN p_partkey % 3 <> 0 AND p_size % 10 = 0 THEN 99.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS per FROM part WHERE p_partkey % 7 <> 0")
def m12(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("parent"), F.col("p_type").alias("name"), F.col("p_size").cast("double").alias("per"), (F.col("p_partkey") % 3 == 0).alias("local"), (F.col("p_partkey") % 7 == 0).alias("tombstone"))
    patches = table(spark, sf, "part").select(F.lit(0).alias("id"), F.col("p_type").alias("name"), F.lit(99.0).alias("per")).distinct()
    return more.propagated(f, patches)


@query("S18_revision_csv", _PAIRS + "SELECT row_number() OVER (ORDER BY pair_key) AS place, CASE WHEN contains(k, ',') THEN '\"' || k || '\"' ELSE k END || ',' || CASE WHEN a_id IS NULL THEN 'B' WHEN b_id IS NULL THEN 'A' ELSE 'AB' END AS line FROM (SELECT *, pair_key AS k FROM pairs) UNION ALL SELECT 0, 'Key,Sides'")
def s18(spark, sf):
    rows = revisions.pair_rows(*_sides(spark, sf)).withColumn("sides", F.when(F.col("a_id").isNull(), "B").when(F.col("b_id").isNull(), "A").otherwise("AB"))
    return csv_lines(rows, [("pair_key", "Key", True), ("sides", "Sides", True)], ["pair_key"])


@query("S13_shapes_csv", "SELECT 0::BIGINT AS place, 'Order,Role,Area' AS line UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey), CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN o_custkey % 4 = 0 THEN 'deduct' ELSE 'floor_area' END || ',' || CASE WHEN o_custkey % 4 = 0 THEN '-' ELSE '' END || CAST(1 + o_custkey AS VARCHAR) FROM orders")
def s13(spark, sf):
    from plumbline.operators.records import shape_details

    role = F.when(F.col("o_custkey") % 4 == 0, "deduct").otherwise("floor_area")
    shapes = table(spark, sf, "orders").select("o_orderkey", role.alias("measure_role"), (F.col("o_custkey") + 1).alias("area_sf"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("method"))
    return csv_lines(shape_details(shapes), [("o_orderkey", "Order", False), ("measure_role", "Role", True), ("area_sf", "Area", False)], ["o_orderkey"])


@query("S14_project_documents", "SELECT CAST(c_nationkey AS VARCHAR) AS project_id, count(*) AS conditions FROM customer GROUP BY 1")
def s14(spark, sf):
    """Documents are written, then read back by their schema: members keep their counts."""
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("project_id"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("finish_tag"))
    docs = more.to_document(rows.select("project_id").distinct().withColumn("schema", F.lit("project.v1")), rows, rows.select("project_id", "ord", "id"))
    read = F.from_json("document", "schema string, conditions array<struct<id:string,finish_tag:string>>")
    return docs.select("project_id", F.size(read["conditions"]).cast("long").alias("conditions"))


@query("U09_merged_sheet_sets", "SELECT sheet_id, count(*) AS n, count(u) AS with_scale FROM (SELECT c_custkey AS sheet_id, c_acctbal AS u FROM customer UNION ALL SELECT o_custkey, NULL FROM orders) GROUP BY 1")
def u09(spark, sf):
    from plumbline.operators.summaries import merged_sheets

    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("sheet_id"), F.col("c_acctbal").alias("u"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("sheet_id"))
    return merged_sheets(a, b).groupBy("sheet_id").agg(F.count("*").alias("n"), F.count("u").alias("with_scale"))
