"""Rings, lines, proposals, layers: what the other modules leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.geometry_queries import _RECTS, _RINGS, rects, rings
from plumbline.driver.registry import query, table
from plumbline.functions import curves
from plumbline.functions import geometry as g
from plumbline.operators import summaries as s


@query("G05_ring_distances", _RECTS + "SELECT id, sqrt(power(greatest(0.0, x0 - 120, 120 - x1), 2) + power(greatest(0.0, y0 - 130, 130 - y1), 2)) AS distance FROM r WHERE x1 < 120 OR y1 < 130")
def g05(spark, sf):
    """From a point beyond the rectangles."""
    ring = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    return rects(spark, sf).where("x1 < 120 OR y1 < 130").select("id", g.ring_distance(ring, F.lit(120.0), F.lit(130.0)).alias("distance"))


@query("G08_least_rectangles", _RECTS + "SELECT id, greatest(x1 - x0, y1 - y0) AS long_side, least(x1 - x0, y1 - y0) AS short_side FROM r")
def g08(spark, sf):
    ring = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    sides = rects(spark, sf).select("id", curves.rectangle_sides(ring).alias("s"))
    return sides.select("id", F.round(F.col("s")[0], 9).alias("long_side"), F.round(F.col("s")[1], 9).alias("short_side"))


@query("G10_reflected", "SELECT p_partkey, 1.0 - p_size / 100.0::DOUBLE AS x, p_size / 200.0::DOUBLE AS y FROM part")
def g10(spark, sf):
    ring = F.array(F.array(F.col("p_size") / 100.0, F.col("p_size") / 200.0))
    return table(spark, sf, "part").select("p_partkey", g.reflected(ring, "x")[0][0].alias("x"), g.reflected(ring, "x")[0][1].alias("y"))


@query("G11_snapped_angles", "SELECT p_partkey, CASE WHEN abs(a - 45 * round(a / 45)) <= 4 THEN 45 * round(a / 45) ELSE -999 END AS angle FROM (SELECT p_partkey, degrees(atan2(CAST(p_partkey % 23 + 1 AS DOUBLE), CAST(p_size AS DOUBLE))) AS a FROM part)")
def g11(spark, sf):
    dx, dy = F.col("p_size").cast("double"), (F.col("p_partkey") % 23 + 1).cast("double")
    angle = g.snapped_angle(dx, dy)
    return table(spark, sf, "part").select("p_partkey", F.when(angle % 45 == 0, angle).otherwise(F.lit(-999.0)).alias("angle"))


@query("G15_simplified_lines", "SELECT p_partkey, 3 AS kept FROM part")
def g15(spark, sf):
    """A right angle with points along its legs keeps its ends and its corner."""
    line = F.concat(F.transform(F.sequence(F.lit(0), F.col("p_size")), lambda i: F.array(i.cast("double"), F.lit(0.0))), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.array(F.col("p_size").cast("double"), i.cast("double"))))
    return table(spark, sf, "part").select("p_partkey", F.size(curves.simplify(line, 0.01)).alias("kept"))


@query("J12_contained_rings", _RECTS + "SELECT a.id AS inner_id, b.id AS outer_id FROM r a JOIN r b ON a.sheet_id = b.sheet_id AND a.id <> b.id AND b.x0 < a.x0 + 0.25 AND a.x1 - 0.25 < b.x1 AND b.y0 < a.y0 + 0.25 AND a.y1 - 0.25 < b.y1")
def j12(spark, sf):
    """Rings, a quarter smaller all round, within others of their sheet."""
    from plumbline.operators.more import contained_rings

    r = rects(spark, sf)
    box = lambda x0, y0, x1, y1: F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    inner = r.select("sheet_id", "id", box(F.col("x0") + 0.25, F.col("y0") + 0.25, F.col("x1") - 0.25, F.col("y1") - 0.25).alias("ring"))
    return contained_rings(inner, r.select("sheet_id", "id", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring")))


@query("W12_ring_edges", _RINGS + "SELECT count(*) AS edges FROM (SELECT unnest(ring) FROM r)")
def w12(spark, sf):
    return rings(spark, sf).agg(F.sum(F.size(g.edges(F.col("ring")))).cast("long").alias("edges"))


@query("O08_surface_order", "SELECT * FROM (VALUES ('FLOOR', 1), ('BASE', 2), ('WALLS N', 4), ('CEILING', 9)) AS v(surface, place)")
def o08(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("WALLS N", "NOTES", "CEILING", "FLOOR", "BASE")], "surface string")
    return rows.withColumn("place", s.surface_place(F.col("surface"))).where("place > 0").orderBy("place")


@query("O08_surfaces_of_parts", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 0 END AS place FROM part")
def o08_parts(spark, sf):
    surface = F.element_at(F.array(F.lit("FLOOR FINISH"), F.lit("WALLS N"), F.lit("CEILING"), F.lit("REMARKS")), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", s.surface_place(surface).alias("place"))


@query("A19_windows_by_type", "SELECT p_type AS type, count(*) AS n, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS widths FROM part GROUP BY 1")
def a19(spark, sf):
    found = s.windows_by_type(table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("width_mm")))
    return found.withColumn("widths", F.array_join("widths", ","))


@query("A22_base_by_sheet", "SELECT o_custkey % 50 AS sheet, count(*) AS rooms, count(*) FILTER (o_orderkey % 5 = 0) AS flagged, CAST(sum(CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS net_lf, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS unmeasured_lf FROM orders GROUP BY 1")
def a22(spark, sf):
    price, flagged = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 5 == 0
    return s.base_by_sheet(table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("sheet"), price.alias("gross_lf"), F.when(~flagged, price).alias("net_lf"), flagged.alias("flagged")))


@query("D08_stated_openings", "SELECT o_orderkey, CASE WHEN o_custkey % 40 >= 30 THEN NULL ELSE 30.0 - o_custkey % 40 END::DOUBLE AS base_lf, CASE WHEN o_custkey % 40 >= 30 THEN 'openings reach the perimeter' ELSE '' END AS reason FROM orders")
def d08(spark, sf):
    """Base with stated openings: perimeter less openings, refused where they reach it."""
    rooms = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("double").alias("openings_lf"), F.lit(30.0).alias("perimeter_lf"))
    return s.base_with_openings(rooms).select("o_orderkey", "base_lf", F.coalesce("reason", F.lit("")).alias("reason"))


@query("R08_order_lengths")
def r08(spark, sf):
    """Order footage is the furthest reach on the roll; held against nesting in the tests."""
    from plumbline.driver.other_queries import rooms
    from plumbline.operators import roll

    cuts = roll.roll_cuts(rooms(spark, sf), roll.Roll(length_ft=80.0))
    return cuts.groupBy("condition_id").agg(F.max(F.col("x") + F.col("run_max") - F.col("run_min")).alias("reach"), (F.max("roll") + 1).alias("rolls"))


@query("X11_schedules_by_kind", "SELECT asked, p_partkey FROM part, (VALUES ('vinduer', 2), ('vinduer', 3), ('Doors and windows', 1), ('Doors and windows', 2), ('Doors and windows', 3), ('fans', 4), ('room finishes', 0), ('materials', 5)) AS a(asked, k) WHERE p_size % 6 = k")
def x11(spark, sf):
    """What each keyword finds among tables of all kinds."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("room-finish", "door", "window", "door-window", "equipment", "finish")]), F.col("p_size") % 6 + 1)
    tables = table(spark, sf, "part").select("p_partkey", kind.alias("kind"))
    found = [s.find_schedules(tables, k).select(F.lit(k).alias("asked"), "p_partkey") for k in ("vinduer", "Doors and windows", "fans", "room finishes", "materials")]
    return s.merged_sheets(*found)


@query("X12_floor_tags", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS tag, CASE WHEN p_size % 5 = 0 THEN 'compound floor finish' ELSE '' END AS reason FROM part")
def x12(spark, sf):
    """A floor cell of several codes is never split between them."""
    cell = F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit("/X-1"))).otherwise(F.col("p_brand"))
    found = s.floor_tag(cell)
    return table(spark, sf, "part").select("p_partkey", found["tag"].alias("tag"), F.coalesce(found["reason"], F.lit("")).alias("reason"))


@query("X20_placed_counts", "SELECT user_id AS condition_id, count(*) + coalesce(max(k), 0) AS ea FROM events LEFT JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS k FROM customer) c ON c_custkey = user_id GROUP BY 1")
def x20(spark, sf):
    """Each placement is one unit beside what the condition had."""
    had = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("ea"))
    return s.placed_counts(table(spark, sf, "events").select(F.col("user_id").alias("condition_id")), had)


@query("X30_segment_roles", "SELECT o_orderkey AS idx, CASE WHEN o_custkey % 7 = 0 THEN 'hidden' WHEN o_custkey % 7 = 1 THEN 'boundary' WHEN o_custkey % 7 = 2 THEN 'annotation' ELSE 'unknown' END AS role FROM orders")
def x30(spark, sf):
    """Roles of segments by their layer, overrides first; hidden wins over any role."""
    layers = spark.createDataFrame([(0, "boundary", False, None), (1, "structure", True, "boundary"), (2, "annotation", True, None)], "layer_id int, role string, visible boolean, override string")
    segments = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 7).cast("int").alias("layer_id"))
    return s.segment_roles(segments, layers).select("idx", "role")


@query("M13_rfi_lifecycle", "SELECT user_id AS id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, count(*) AS changes, arg_max(event_type, event_id) = 'view' AS deleted FROM events GROUP BY 1")
def m13(spark, sf):
    """Views delete here; a deleted question keeps its last status."""
    op = F.when(F.col("event_type") == "view", "delete").otherwise("set")
    return s.rfi_states(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("status")))


@query("M05_undone_journal", "SELECT user_id AS session_id, event_id % 10 AS id, max(event_id) AS seq, arg_max(value, event_id) AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k > 3 GROUP BY 1, 2")
def m05(spark, sf):
    """State after the last three commands of each session are undone."""
    from plumbline.operators.records import last_entries, latest_state

    journal = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("id"), F.lit("set").alias("op"), F.col("value").alias("payload"), F.col("event_id").alias("seq"))
    undone = last_entries(journal, 3).select("session_id", "seq")
    return latest_state(journal.join(undone, ["session_id", "seq"], "left_anti"), "id")


@query("S17_rfi_log", "SELECT 0::BIGINT AS place, 'RFI,Status' AS line UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 'RFI-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ',' || c_mktsegment FROM customer WHERE c_custkey % 6 <> 0")
def s17(spark, sf):
    from plumbline.sources.takeoff import csv_lines

    live = table(spark, sf, "customer").where("c_custkey % 6 <> 0").withColumn("number", F.concat(F.lit("RFI-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))
    return csv_lines(live, [("number", "RFI", True), ("c_mktsegment", "Status", True)], ["c_custkey"])
