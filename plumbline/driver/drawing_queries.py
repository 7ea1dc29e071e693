"""Layers, tags, schedules, marks, commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.operators import commands, drawing

LAYERS = ["A-WALL-FULL", "A-WALL-DEMO", "x|S-COLS", "WALL", "A-FLOR-PATT", "23-- Yttervegger", "0", "Layer 12", "A-FURN", "M$0$DUCT", "", "235- Kledning", "30", "A-ANNO-DIMS", "FOUNDATION"]


@query("F22_layer_roles", """SELECT * FROM (VALUES ('A-WALL-FULL', 'boundary', 0.9::DOUBLE), ('A-WALL-DEMO', 'demolition', 0.95), ('x|S-COLS', 'structure', 0.85), ('WALL', 'boundary', 0.7), ('A-FLOR-PATT', 'finish-pattern', 0.9), ('23-- Yttervegger', 'boundary', 0.9),
('0', 'unknown', 0.0), ('Layer 12', 'unknown', 0.0), ('A-FURN', 'annotation', 0.65), ('M$0$DUCT', 'unknown', 0.2), ('', 'unknown', 0.0), ('235- Kledning', 'finish-pattern', 0.9), ('30', 'unknown', 0.2), ('A-ANNO-DIMS', 'annotation', 0.85), ('FOUNDATION', 'structure', 0.6)) AS v(name, role, confidence)""")
def f22(spark, sf):
    rows = spark.createDataFrame([(x,) for x in LAYERS], "name string").withColumn("r", drawing.layer_role(F.col("name")))
    return rows.select("name", "r.role", "r.confidence")


@query("F25_text_status", "SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 > 0 THEN 'partial' ELSE 'text_layer' END ELSE CASE WHEN o_orderkey % 2 > 0 THEN 'outlined' ELSE 'none' END END AS status FROM orders")
def f25(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", drawing.text_status(F.col("o_custkey") % 3, F.col("o_orderkey") % 2).alias("status"))


@query("F27_variant_tags", "SELECT p_partkey, trim(p_brand) AS base, trim(p_brand) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' – Level ' || CAST(p_size AS VARCHAR) END AS tag FROM part")
def f27(spark, sf):
    old = F.concat(F.lit(" "), "p_brand", F.lit(" – Old"))
    return table(spark, sf, "part").select("p_partkey", drawing.base_tag(old).alias("base"), drawing.variant_tag(old, F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Level "), F.col("p_size").cast("string")))).alias("tag"))


@query("F11_trace_confidence", """WITH f AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.90 ELSE 1 END::DOUBLE * CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE CASE p_partkey % 5 WHEN 1 THEN 0.95 WHEN 2 THEN 0.93 WHEN 3 THEN 0.85 ELSE 0.95 END END::DOUBLE * CASE WHEN p_size % 3 = 0 THEN 1 - least(0.25::DOUBLE, p_size / 100.0::DOUBLE) ELSE 1 END::DOUBLE
* CASE WHEN p_size % 7 = 0 THEN 1 - 0.03::DOUBLE * CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE least(1.0::DOUBLE, ((1 + p_size / 100.0::DOUBLE) - 1) / (1 + p_size / 100.0::DOUBLE) / 0.1) END ELSE 1 END::DOUBLE * CASE WHEN p_partkey % 4 = 0 THEN 1 - 0.5 * (p_size / 60.0::DOUBLE) ELSE 1 END::DOUBLE * CASE WHEN p_retailprice * 10 > 5000 THEN 1 - 0.35 * least(1.0::DOUBLE, (p_retailprice * 10 - 5000) / 45000.0::DOUBLE) ELSE 1 END::DOUBLE * CASE WHEN p_size < 8 THEN 0.9 ELSE 1 END::DOUBLE AS s,
(p_size % 2 = 0)::INT + (p_partkey % 5 < 4)::INT + (p_size % 3 = 0)::INT + (p_size % 7 = 0)::INT + (p_partkey % 4 = 0)::INT + (p_retailprice * 10 > 5000)::INT + (p_size < 8)::INT AS doubts FROM part) SELECT p_partkey, floor(s * 100 + 0.5) / 100 AS score, doubts FROM f""")
def f11(spark, sf):
    """Tiers that are stated, missing and unknown; swings with and without their growth; large rooms, coarse masks."""
    s, k = F.col("p_size"), F.col("p_partkey")
    tier = F.element_at(F.array(F.lit(None).cast("string"), F.lit("bounded"), F.lit("trapped"), F.lit("override"), F.lit("other")), (k % 5 + 1).cast("int"))
    growth = F.when(k % 3 != 0, 1 + s / 100.0)
    c = drawing.trace_confidence(s % 2 == 0, k % 5 < 4, tier, s % 3 == 0, s / 100.0, F.lit(0.0), s % 7 == 0, growth, F.when(k % 4 == 0, s / 60.0), F.col("p_retailprice") * 10, s.cast("double"))
    return table(spark, sf, "part").select("p_partkey", c["score"].alias("score"), F.size(c["factors"]).alias("doubts"))


@query("X03_building_mentions", "SELECT * FROM (VALUES ('BUILDING A FLOOR PLAN', 'A'), ('bldg. 12 and Building B2', '12,B2'), ('no buildings', ''), ('BUILDING OFFICE', '')) AS v(text, found)")
def x03(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("BUILDING A FLOOR PLAN", "bldg. 12 and Building B2", "no buildings", "BUILDING OFFICE")], "text string")
    return rows.select("text", F.array_join(drawing.building_mentions(F.col("text")), ",").alias("found"))


@query("X07_room_keys", "SELECT * FROM (VALUES ('134', '134', ''), ('12 B', '12B', ''), ('A-134', 'A-134', 'A'), ('P-2', '', ''), ('CR11-9', 'CR11-9', ''), ('C101', 'C101', ''), ('PT-2', '', ''), ('note', '', '')) AS v(text, key, building)")
def x07(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("134", "12 B", "A-134", "P-2", "CR11-9", "C101", "PT-2", "note")], "text string").withColumn("k", drawing.room_key(F.col("text"), ["A", "B"]))
    return rows.select("text", F.coalesce("k.key", F.lit("")).alias("key"), F.coalesce("k.building", F.lit("")).alias("building"))


@query("J19_resolved_rooms", """SELECT * FROM (VALUES ('101', 'resolved', '', 'FLOOR=CPT-1=carpet;WALL=PT-2'), ('102', 'unresolved', 'ambiguous: several buildings', ''), ('A-102', 'resolved', '', 'FLOOR=VCT-1=tile'), ('C-102', 'unresolved', 'listed under other buildings', ''),
('103', 'unresolved', 'no schedule row', ''), ('104', 'unresolved', 'ambiguous: several rows', ''), ('105', 'unresolved', 'row carries no finishes', '')) AS v(tag, status, reason, finishes)""")
def j19(spark, sf):
    asked = spark.createDataFrame([("101", None, "101"), ("102", None, "102"), ("A-102", "A", "102"), ("C-102", "C", "102"), ("103", None, "103"), ("104", None, "104"), ("105", None, "105")], "tag string, building string, number string")
    rows = spark.createDataFrame([(1, "101", None, "WALL", "PT-2"), (1, "101", None, "FLOOR", "CPT-1"), (2, "102", "A", "FLOOR", "VCT-1"), (3, "102", "B", "FLOOR", "CPT-1"), (4, "104", None, "FLOOR", "x"), (5, "104", None, "FLOOR", "y"), (6, "105", None, "NOTES", "z")], "row_id int, number string, building string, surface string, code string")
    finishes = spark.createDataFrame([("CPT-1", "carpet"), ("VCT-1", "tile")], "code string, definition string")
    return drawing.resolve_rooms(asked, rows, finishes).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("X13_condition_seeds", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'solid' WHEN 1 THEN 'horiz' WHEN 2 THEN 'grid' WHEN 3 THEN 'vert' ELSE 'solid' END AS hatch, CASE p_size % 6 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE 0 END::BIGINT AS waste_pct FROM part")
def x13(spark, sf):
    category = F.element_at(F.array(*[F.lit(k) for k in drawing.CATEGORY_HATCH]), F.col("p_size") % 6 + 1)
    return drawing.condition_seeds(table(spark, sf, "part").select("p_partkey", category.alias("category"))).drop("category")


_SPANS = "WITH s AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, o_orderkey AS ord, 'E' || CAST(o_custkey % 5 AS VARCHAR) AS mark, CAST(o_custkey % 97 AS DOUBLE) AS x0, CAST(o_custkey % 97 + 8 AS DOUBLE) AS x1, CAST(o_orderkey * 7 % 89 AS DOUBLE) AS y0, CAST(o_orderkey * 7 % 89 + 6 AS DOUBLE) AS y1 FROM orders)"


def spans(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    return table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("ord"), F.concat(F.lit(" e"), (c % 5).cast("string")).alias("str"), d(c % 97).alias("x0"), d(c % 97 + 8).alias("x1"), d(k * 7 % 89).alias("y0"), d(k * 7 % 89 + 6).alias("y1"))


@query("X19_mark_census", _SPANS + """, v AS (SELECT * FROM s WHERE ord % 2 = 1), m AS (SELECT * FROM s WHERE ord % 2 = 0 AND mark <> 'E4'), p AS (SELECT m.sheet_id, m.ord, arg_min(CAST(v.ord AS VARCHAR), v.ord) AS value FROM m JOIN v ON m.sheet_id = v.sheet_id AND abs(v.x0 - m.x0) <= 9 AND v.y0 >= m.y1 - 0.4 * 6.0 AND v.y0 <= m.y1 + 2.4 * 6.0 GROUP BY 1, 2)
SELECT m.sheet_id, m.ord, m.mark, CASE WHEN m.sheet_id % 3 = 0 AND (x0 + x1) / 2 BETWEEN 10 AND 40 AND (y0 + y1) / 2 BETWEEN 10 AND 50 THEN 'in_table' WHEN mark = 'E2' THEN 'ambiguous' WHEN value IS NOT NULL THEN 'counted' ELSE 'withheld' END AS outcome,
CASE WHEN NOT (m.sheet_id % 3 = 0 AND (x0 + x1) / 2 BETWEEN 10 AND 40 AND (y0 + y1) / 2 BETWEEN 10 AND 50) AND mark <> 'E2' THEN value END AS value,
CASE WHEN m.sheet_id % 3 = 0 AND (x0 + x1) / 2 BETWEEN 10 AND 40 AND (y0 + y1) / 2 BETWEEN 10 AND 50 THEN 'part of a schedule' WHEN mark = 'E2' THEN 'several tables define it' WHEN value IS NULL THEN 'no value beneath it' END AS reason FROM m LEFT JOIN p ON p.sheet_id = m.sheet_id AND p.ord = m.ord""")
def x19(spark, sf):
    s = spans(spark, sf)
    marks = spark.createDataFrame([("E0", "ok"), ("E1", "ok"), ("E2", "ambiguous"), ("E3", "ok")], "mark string, status string")
    regions = s.where("sheet_id % 3 = 0").select("sheet_id", F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(50.0).alias("y1")).distinct()
    values = s.where("ord % 2 = 1").withColumn("str", F.col("ord").cast("string"))
    return drawing.census(s.where("ord % 2 = 0"), marks, regions, values)


@query("J17_names_above_tags", _SPANS + """, n AS (SELECT * FROM s WHERE ord % 2 = 1 AND ord % 3 <> 0), t AS (SELECT * FROM s WHERE ord % 2 = 0), d AS (SELECT t.sheet_id, t.ord, t.y0 - n.y1 AS dy, n.ord AS n_ord FROM t JOIN n ON n.sheet_id = t.sheet_id AND t.y0 - n.y1 >= -0.2 * 6 AND t.y0 - n.y1 <= 2.2 * 6 AND n.x0 <= t.x1 + 6 AND n.x1 >= t.x0 - 6)
SELECT sheet_id, ord, 'ROOM ' || CAST(n_ord AS VARCHAR) AS name FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, ord ORDER BY dy, n_ord) AS k FROM d) WHERE k = 1""")
def j17(spark, sf):
    s = spans(spark, sf)
    names = s.where("ord % 2 = 1").withColumn("str", F.concat(F.when(F.col("ord") % 3 == 0, "room ").otherwise("ROOM "), F.col("ord").cast("string")))
    return drawing.names_above(s.where("ord % 2 = 0"), names)


@query("J30_weaker_tables", _SPANS + """, t AS (SELECT sheet_id, ord AS id, ord % 3 AS rank, x0, y0, x1, y1 FROM s) SELECT DISTINCT a.id FROM t a JOIN t b ON a.sheet_id = b.sheet_id AND (b.rank < a.rank OR (b.rank = a.rank AND b.id < a.id)) AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 24""")
def j30(spark, sf):
    return drawing.weaker_tables(spans(spark, sf).select("sheet_id", F.col("ord").alias("id"), (F.col("ord") % 3).alias("rank"), "x0", "y0", "x1", "y1"))


@query("O09_title_candidates", "SELECT sheet_id, ord FROM (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS sheet_id, o_orderkey AS ord, row_number() OVER (PARTITION BY floor(o_orderkey / 500) ORDER BY o_custkey % 31 DESC, o_orderkey) AS k FROM orders) WHERE k <= 40")
def o09(spark, sf):
    s = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("sheet_id"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 31).alias("h"))
    return drawing.title_candidates(s).select("sheet_id", "ord")


_PRINTS = """WITH f AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, o_orderkey AS id, CASE WHEN o_orderkey % 13 > 0 THEN (10.0 + o_custkey % 5) * 10.0 END::DOUBLE AS area, o_orderkey % 7 AS k, (10.0 + o_custkey % 5) * 10.0 * (1 + (o_custkey % 9 - 4) / 100.0::DOUBLE) AS m2 FROM orders),
p AS (SELECT *, CASE WHEN sheet_id % 5 = 0 AND id % 40 > 1 THEN 0 WHEN k = 0 THEN 0 WHEN k = 1 THEN 2 ELSE 1 END AS n, CASE WHEN k = 2 THEN 1 ELSE 0 END AS totals FROM f),
s AS (SELECT *, sum(CASE WHEN k = 3 THEN 2 * n ELSE n END) OVER (PARTITION BY sheet_id) AS on_sheet FROM p)
SELECT sheet_id, id, CASE WHEN area IS NULL OR on_sheet < 3 OR n = 0 THEN 'unverified' WHEN n = 2 AND abs(area - (m2 + 1)) <= 0.03 * (m2 + 1) + 0.05 THEN 'combined' WHEN abs(area - m2) <= 0.03 * m2 + 0.05 THEN 'verified' ELSE 'refused' END AS status,
CASE WHEN area IS NULL THEN 'no scale' WHEN on_sheet < 3 THEN 'no printed areas on the sheet' WHEN n = 0 THEN 'no printed area inside' WHEN n = 2 AND abs(area - (m2 + 1)) <= 0.03 * (m2 + 1) + 0.05 THEN '' WHEN abs(area - m2) <= 0.03 * m2 + 0.05 THEN '' WHEN n = 2 THEN 'several rooms'' areas inside, none agrees' ELSE 'printed area disagrees' END AS reason FROM s"""


@query("D15_printed_checks", _PRINTS)
def d15(spark, sf):
    """Rooms in a row on each sheet; most have their area printed, right or wrong, some a second one or a total, some none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    wide, at = d(10 + c % 5), d(k % 40 * 20)
    box = F.array(F.array(at, F.lit(0.0)), F.array(at + wide, F.lit(0.0)), F.array(at + wide, F.lit(10.0)), F.array(at, F.lit(10.0)))
    rows = table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("id"), c.alias("c"), box.alias("ring"), at.alias("x0"), F.lit(0.0).alias("y0"), (at + wide).alias("x1"), F.lit(10.0).alias("y1"), F.when(k % 13 > 0, wide * 10).alias("area_m2"))
    m2 = (F.col("x1") - F.col("x0")) * 10 * (1 + (F.col("c") % 9 - 4) / 100.0)
    stamp = lambda n, x, y, m: F.struct(F.lit(n).alias("n"), (F.col("x0") + x).alias("x"), F.lit(y).alias("y"), m.alias("m2"))
    one, none = stamp(0, 2.0, 2.0, m2), F.lit(None).cast("double")
    kind = F.col("id") % 7
    listed = F.when((F.col("sheet_id") % 5 == 0) & (F.col("id") % 40 > 1), F.array().cast("array<struct<n:int,x:double,y:double,m2:double>>")).when(kind == 0, F.array().cast("array<struct<n:int,x:double,y:double,m2:double>>"))
    listed = listed.when(kind == 1, F.array(one, stamp(1, 2.0, 8.0, F.lit(1.0)))).when(kind == 2, F.array(one, stamp(2, 8.0, 8.0, none))).when(kind == 3, F.array(one, one)).otherwise(F.array(one))  # the fourth kind is printed twice in one place
    stamps = rows.select("sheet_id", (F.col("id") * 10).alias("base"), F.posexplode(listed).alias("i", "s")).select("sheet_id", (F.col("base") + F.col("i")).alias("ord"), "s.x", "s.y", "s.m2")
    return drawing.printed_checks(rows.drop("c"), stamps, allow_sum=True).select("sheet_id", "id", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query("M04_edits_spare_ink", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 1 THEN 'untouched' WHEN o_custkey % 3 = 0 THEN 'refused' WHEN o_orderkey % 5 = 0 THEN 'deleted' ELSE 'edited' END AS outcome, CASE WHEN o_orderkey % 5 = 1 AND o_custkey % 3 <> 0 THEN 'new' ELSE o_orderstatus END AS label FROM orders")
def m04(spark, sf):
    orders = table(spark, sf, "orders")
    shapes = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3 == 0).alias("reviewed"), F.col("o_orderstatus").alias("label"))
    edits = orders.where("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "delete").otherwise("edit").alias("op"), F.lit("new").alias("label"))
    return commands.apply_edits(shapes, edits, ["label"]).select("id", "outcome", "label")


@query("M08_accepted_edits", "SELECT p_partkey AS id, coalesce(b, p_brand) AS finish_tag, coalesce(s, p_size) AS waste_pct FROM part LEFT JOIN (SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS b, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS INT) END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS s FROM orders WHERE o_orderkey % 7 > 2 GROUP BY 1) p ON p.o_custkey = p_partkey")
def m08(spark, sf):
    k = F.col("o_orderkey")
    proposals = table(spark, sf, "orders").select(F.col("o_custkey").alias("condition_id"), k.alias("seq"), (k % 7 > 2).alias("accepted"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("finish_tag"), F.when(k % 3 == 0, (k % 50).cast("int")).alias("waste_pct"))
    conditions = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("finish_tag"), F.col("p_size").alias("waste_pct"))
    return commands.accept_proposals(conditions, proposals, ["finish_tag", "waste_pct"])


@query("M10_material_edits", "SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['Grout', 'Thinset'] ELSE ['Grout'] END, ',') AS names FROM part")
def m10(spark, sf):
    edited = commands.edit_materials(F.array(F.lit("Primer"), F.lit("Grout")), F.lit("Primer"), F.when(F.col("p_size") % 2 == 0, F.lit("Thinset")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(edited, ",").alias("names"))


@query("M15_one_verdict_each", "SELECT o_custkey AS shape_id, o_orderkey AS seq, CASE WHEN o_custkey % 4 = 0 OR o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'refused' ELSE 'marked' END AS outcome FROM orders")
def m15(spark, sf):
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("shape_id"), F.col("o_orderkey").alias("seq"))
    return commands.one_verdict_each(new.where("shape_id % 4 = 0").select("shape_id"), new)


@query("M16_renamed_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Finished' ELSE o_orderstatus END AS label FROM orders")
def m16(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", commands.renamed(F.col("o_orderstatus"), "F", "Finished").alias("label"))


@query("M17_legacy_reviews", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'recorded' END WHEN o_custkey % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS state FROM orders")
def m17(spark, sf):
    from plumbline.operators.records import review_state

    reviewed = F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3 == 0)
    actor = F.when(F.col("o_orderkey") % 2 == 0, "agent").otherwise("human")
    return table(spark, sf, "orders").select("o_orderkey", review_state(commands.normalised_review(reviewed, actor)).alias("state"))


@query("D11_recalibrated", "SELECT o_orderkey AS id, o_custkey AS sheet_id, CASE WHEN o_orderkey % 4 = 0 THEN 'count' ELSE 'floor_area' END AS measure_role, o_totalprice * f * f AS area_sf, o_totalprice * f AS perimeter_lf, outcome FROM (SELECT *, CASE WHEN outcome = 'repriced' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'untouched' WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0) THEN 'refused' WHEN o_orderkey % 4 = 0 THEN 'untouched' ELSE 'repriced' END AS outcome FROM orders))")
def d11(spark, sf):
    k = F.col("o_orderkey")
    shapes = table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("sheet_id"), F.when(k % 4 == 0, "count").otherwise("floor_area").alias("measure_role"), F.col("o_totalprice").alias("area_sf"), F.col("o_totalprice").alias("perimeter_lf"), F.when(k % 9 == 0, True).alias("reviewed"))
    scales = shapes.where("sheet_id % 2 = 1").select("sheet_id").distinct().select("sheet_id", F.lit(0.5).alias("old_upp"), F.lit(1.0).alias("new_upp"))
    return commands.recalibrated(shapes, scales)


@query("D04_scope_merge", "SELECT o_orderkey AS a_id, o_custkey AS b_id, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'refused' WHEN o_orderkey % 3 <> 0 AND o_custkey % 2 <> 0 THEN 'undecided' WHEN (o_orderkey % 100) / 100.0 >= 0.98 THEN 'delete' ELSE 'trim' END AS action, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 <> 0 THEN o_orderkey WHEN o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_custkey END, -1) AS winner FROM orders")
def d04(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a_id"), F.col("o_custkey").alias("b_id"), (F.col("o_orderkey") % 3 == 0).alias("a_reviewed"), (F.col("o_custkey") % 2 == 0).alias("b_reviewed"), ((F.col("o_orderkey") % 100) / 100.0).alias("loser_share"))
    return commands.scope_merge(pairs).withColumn("winner", F.coalesce("winner", F.lit(-1)))


@query("X01_sheet_roles", """SELECT * FROM (VALUES (1, 'plan', 0.85::DOUBLE, 'FIRST FLOOR PLAN'), (2, 'schedule', 0.85, 'ROOM FINISH SCHEDULE'), (3, 'detail', 0.48, 'WALL DETAILS'), (4, 'unknown', 0.0, ''), (5, 'demolition', 0.9, 'DEMOLITION PLAN'), (6, 'legend', 0.4, 'FINISH LEGEND')) AS v(sheet_id, role, confidence, evidence)""")
def x01(spark, sf):
    from plumbline.operators.roles import sheet_roles

    sheets = spark.createDataFrame([(i, 1000.0, 800.0) for i in range(1, 7)], "sheet_id int, width double, height double")
    spans = [(1, 0, "FIRST FLOOR PLAN", 900.0, 700.0, 20.0), (1, 1, "WALL DETAILS", 100.0, 100.0, 30.0), (1, 2, "see finish plan for notes", 900.0, 750.0, 20.0), (2, 0, "ROOM FINISH SCHEDULE", 850.0, 600.0, 20.0), (3, 0, "WALL DETAILS", 200.0, 100.0, 30.0), (3, 1, "note", 10.0, 10.0, 10.0), (3, 2, "note", 10.0, 10.0, 10.0)]
    spans += [(4, 0, "hello", 10.0, 10.0, 10.0), (5, 0, "DEMOLITION PLAN", 950.0, 790.0, 20.0), (5, 1, "FLOOR PLAN", 620.0, 450.0, 10.0), (6, 0, "FINISH LEGEND", 100.0, 100.0, 10.0)]
    return sheet_roles(spark.createDataFrame(spans, "sheet_id int, ord int, str string, x double, y double, h double"), sheets).withColumn("confidence", F.round("confidence", 6))


@query("F21_room_labels", "SELECT * FROM (VALUES ('OFFICE 101', '101'), ('134A', '134A'), ('557 SF', ''), ('08 - 6231', ''), ('SHEET 12', ''), ('58''-5\"', ''), ('CORRIDOR', '')) AS v(text, number)")
def f21(spark, sf):
    from plumbline.operators.roles import room_seed

    rows = spark.createDataFrame([(x,) for x in ("OFFICE 101", "134A", "557 SF", "08 - 6231", "SHEET 12", "58'-5\"", "CORRIDOR")], "text string")
    return rows.select("text", F.coalesce(room_seed(F.col("text")), F.lit("")).alias("number"))
