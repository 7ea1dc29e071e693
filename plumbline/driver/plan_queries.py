"""Rings, cut-outs, stitches, openings, roll goods: geometry of plans laid out from the parts and orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.driver.drawing_queries import _SPANS, spans
from plumbline.driver.geometry_queries import _RINGS, rings
from plumbline.driver.other_queries import _ROOMS, rooms
from plumbline.driver.records_queries import _SEGS, segments
from plumbline.driver.registry import query, table
from plumbline.functions import curves, outlines
from plumbline.functions import numeric as n
from plumbline.operators import cutouts, openings, overlay, records, roll, stitches, summaries, transitions
from plumbline.plans.scratch import spread


def box(x0, y0, x1, y1):
    d = lambda c: (c if hasattr(c, "cast") else F.lit(c)).cast("double")
    return F.array(*[F.array(d(a), d(b)) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


@query("F09_inches_up", "SELECT event_id, ceil(value * 12 - 1e-6) / 12.0::DOUBLE AS feet FROM events")
def f09(spark, sf):
    return table(spark, sf, "events").select("event_id", n.round_up_to_inch(F.col("value")).alias("feet"))


@query("F29_normal_text", "SELECT p_partkey, lower(p_brand) || ' fi ' || CAST(p_size AS VARCHAR) AS text FROM part")
def f29(spark, sf):
    """Compatibility forms, wide spaces and case folded."""
    from plumbline.functions.text import normal_text

    raw = F.concat(F.lit("  "), "p_brand", F.lit("  ﬁ\t"), F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９"))
    return table(spark, sf, "part").select("p_partkey", normal_text(raw).alias("text"))


@query("G06_hits", _RINGS + """, q AS (SELECT *, x + (p_size % 11) * 0.5 - 1 AS px, y + (p_partkey % 7) * 0.5 - 0.5 AS py FROM r), d AS (SELECT *, list_min(list_transform(range(1, len(ring) + 1), lambda i: sqrt(pow(px - (ring[i][1] + greatest(0, least(1, ((px - ring[i][1]) * (ring[i % len(ring) + 1][1] - ring[i][1]) + (py - ring[i][2]) * (ring[i % len(ring) + 1][2] - ring[i][2])) / (pow(ring[i % len(ring) + 1][1] - ring[i][1], 2) + pow(ring[i % len(ring) + 1][2] - ring[i][2], 2)))) * (ring[i % len(ring) + 1][1] - ring[i][1])), 2)
+ pow(py - (ring[i][2] + greatest(0, least(1, ((px - ring[i][1]) * (ring[i % len(ring) + 1][1] - ring[i][1]) + (py - ring[i][2]) * (ring[i % len(ring) + 1][2] - ring[i][2])) / (pow(ring[i % len(ring) + 1][1] - ring[i][1], 2) + pow(ring[i % len(ring) + 1][2] - ring[i][2], 2)))) * (ring[i % len(ring) + 1][2] - ring[i][2])), 2)))) AS away,
len(list_filter(range(1, len(ring) + 1), lambda i: (ring[i][2] > py) <> (ring[i % len(ring) + 1][2] > py) AND px < (ring[i % len(ring) + 1][1] - ring[i][1]) * (py - ring[i][2]) / (ring[i % len(ring) + 1][2] - ring[i][2]) + ring[i][1])) % 2 = 1 AS inside FROM q)
SELECT p_partkey, inside OR away < 0.3 AS hit FROM d""")
def g06(spark, sf):
    """Points about rings of floors: inside, or at an edge."""
    px, py = F.col("x") + (F.col("p_size") % 11) * 0.5 - 1, F.col("y") + (F.col("p_partkey") % 7) * 0.5 - 0.5
    none = F.lit(None).cast("array<array<array<double>>>")
    return rings(spark, sf).select("p_partkey", outlines.hit(F.lit("floor_area"), F.col("ring"), none, px, py, F.lit(0.3)).alias("hit"))


@query("G12_thinned_strokes", "SELECT p_partkey, CASE WHEN p_size < 2 THEN p_size + 1 ELSE 1 + (p_size - 1) // 3 + 1 END AS kept FROM part")
def g12(spark, sf):
    """Points a unit apart thinned to three apart, the ends kept."""
    stroke = F.transform(F.sequence(F.lit(0), F.col("p_size")), lambda i: F.array(i.cast("double"), F.lit(0.0)))
    return table(spark, sf, "part").select("p_partkey", F.size(outlines.thinned(stroke, 3.0)).cast("long").alias("kept"))


@query("G13_arcs", "SELECT p_partkey, round(pi() * p_size, 6) AS length, p_size::DOUBLE AS radius FROM part WHERE p_size > 0")
def g13(spark, sf):
    """Half circles through three points: their length, and their radius from the flattened points."""

    def run(frames):
        for frame in frames:
            out = []
            for k, r in zip(frame["p_partkey"], frame["p_size"]):
                a, b, c = np.array([float(r), 0.0]), np.array([0.0, float(r)]), np.array([-float(r), 0.0])
                flat = curves.flat_arc(a, b, c)
                out.append((k, round(curves.arc_length(a, b, c), 6), round(float(np.hypot(*flat.T).mean()), 6)))
            yield pd.DataFrame(out, columns=["p_partkey", "length", "radius"])

    return table(spark, sf, "part").where("p_size > 0").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, length double, radius double")


@query("G14_splines", "SELECT p_partkey, 8 * 3 + 1 AS points, true AS through FROM part")
def g14(spark, sf):
    """A curve through four points passes them all, eight pieces between neighbours."""

    def run(frames):
        for frame in frames:
            out = []
            for k, s in zip(frame["p_partkey"], frame["p_size"]):
                p = np.array([[0.0, 0.0], [s, 1.0], [s + 2.0, 5.0], [2.0 * s, k % 7]], float)
                found = curves.spline(p)
                out.append((k, len(found), bool(np.allclose(found[::8], p))))
            yield pd.DataFrame(out, columns=["p_partkey", "points", "through"])

    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).mapInPandas(run, "p_partkey long, points long, through boolean")


@query("G16_ring_samples", _ROOMS + "SELECT shape_id, CAST(2 * (ceil(w / 0.25) + ceil(h / 0.25)) AS BIGINT) AS samples, 5 AS corners FROM q")
def g16(spark, sf):
    """Samples a quarter foot apart, corners among them; without the collinear ones a closed path of four corners is left."""

    def run(frames):
        for frame in frames:
            out = []
            for i, ring in zip(frame["shape_id"], frame["ring"]):
                p = transitions.samples(np.array([list(q) for q in ring], float))
                out.append((i, len(p), len(transitions.without_collinear(np.append(p, p[:1], axis=0)))))
            yield pd.DataFrame(out, columns=["shape_id", "samples", "corners"])

    return spread(rooms(spark, sf).select("shape_id", "ring"), "shape_id").mapInPandas(run, "shape_id long, samples long, corners long")


# Stitches: ten parts to one, their sheets side by side, overlapping by a tenth of the first's width.
_STITCH = "WITH m AS (SELECT 'stitch:' || CAST(p_partkey // 10 AS VARCHAR) AS stitch_id, p_partkey AS ord, 's' || CAST(p_partkey AS VARCHAR) AS key, (p_partkey % 10) * 90.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, count(*) OVER (PARTITION BY p_partkey // 10) AS n, min(p_partkey % 10) OVER (PARTITION BY p_partkey // 10) AS first, max(p_partkey % 10) OVER (PARTITION BY p_partkey // 10) AS last FROM part), s AS (SELECT *, dx - first * 90 AS x FROM m WHERE n >= 2)"


def stitched(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    key = F.concat(F.lit("s"), k.cast("string"))
    members = part.select(F.concat(F.lit("stitch:"), F.floor(k / 10).cast("string")).alias("stitch_id"), k.alias("ord"), key.alias("key"), (k % 10 * 90.0).alias("dx"), F.lit(0.0).alias("dy"))
    sizes = part.select(key.alias("sheet_id"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    return stitches.member_boxes(stitches.sane_stitches(members), sizes), sizes


@query("G19_stitch_boxes", _STITCH + "SELECT stitch_id, key, x AS x0, x + 100 AS x1, CASE WHEN ord % 10 = first THEN x ELSE x + 5 END AS sx0, CASE WHEN ord % 10 = last THEN x + 100 ELSE x + 95 END AS sx1 FROM s")
def g19(spark, sf):
    """Members' boxes, and the halves of their overlaps that they show."""
    return stitched(spark, sf)[0].select("stitch_id", "key", "x0", "x1", "sx0", "sx1")


@query("G19_stitch_extents", _STITCH + "SELECT stitch_id, max(x) + 100 AS width, 80.0::DOUBLE AS height FROM s GROUP BY 1")
def g19_extents(spark, sf):
    return stitches.extents(stitched(spark, sf)[0])


@query("G19_members_at_points", _STITCH + "SELECT stitch_id, ord AS id, coalesce((SELECT arg_max(t.key, t.ord) FROM s t WHERE t.stitch_id = s.stitch_id AND s.x + 97 >= t.x AND s.x + 97 < t.x + 100), key) AS key FROM s")
def g19_points(spark, sf):
    """The topmost member under a point near each member's right end."""
    boxes, _ = stitched(spark, sf)
    points = boxes.select("stitch_id", F.col("ord").alias("id"), (F.col("x0") + 97).alias("x"), F.lit(40.0).alias("y"))
    return stitches.member_at(points, boxes)


@query("U11_merged_segments", _STITCH + ", g AS (SELECT s.*, unnest(range(0, 100, 10)) AS i FROM s) SELECT stitch_id, key AS sheet_id, i AS idx, x + i AS x1, x + i + 6 AS x2 FROM g WHERE x + i + 3 >= CASE WHEN ord % 10 = first THEN x ELSE x + 5 END AND x + i + 3 <= CASE WHEN ord % 10 = last THEN x + 100 ELSE x + 95 END")
def u11(spark, sf):
    """Ten segments of each sheet on the surface, each by the member that shows its middle."""
    boxes, sizes = stitched(spark, sf)
    lines = sizes.select("sheet_id", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10))).alias("idx")).select("sheet_id", F.col("idx").cast("long").alias("idx"), F.col("idx").cast("double").alias("x1"), F.lit(1.0).alias("y1"), (F.col("idx") + 6.0).alias("x2"), F.lit(1.0).alias("y2"))
    return stitches.merged_segments(lines, boxes).select("stitch_id", "sheet_id", "idx", "x1", "x2")


@query("U11_merged_points", _STITCH + "SELECT stitch_id, key AS sheet_id, x + 98 AS x FROM s WHERE ord % 10 = last UNION ALL SELECT stitch_id, key, x + 50 FROM s")
def u11_points(spark, sf):
    boxes, sizes = stitched(spark, sf)
    points = sizes.select("sheet_id", F.explode(F.array(F.lit(50.0), F.lit(98.0))).alias("x"), F.lit(10.0).alias("y"))
    return stitches.merged_points(points, boxes).select("stitch_id", "sheet_id", "x")


@query("G21_tidied_rings", "SELECT p_partkey, 4 AS points, ((90.0 + p_size) * 80)::DOUBLE AS area FROM part")
def g21(spark, sf):
    """Rectangles traced with points along their sides, a hair off: corners on drawn ends, nothing else left."""

    def run(frames):
        for frame in frames:
            out = []
            for k, s in zip(frame["p_partkey"], frame["p_size"]):
                w = 90.0 + s
                corners = np.array([[0, 0], [w, 0], [w, 80], [0, 80]], float)
                traced = np.array([[0.5, 0.2], [w / 2, 0.3], [w - 0.4, 0.1], [w + 0.2, 40], [w, 79.8], [w / 2, 80.2], [0.2, 80]], float)
                ring, _ = outlines.tidied(traced, corners, 2.0)
                out.append((k, len(ring), round(abs(cutouts.area(ring)), 6)))
            yield pd.DataFrame(out, columns=["p_partkey", "points", "area"])

    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).mapInPandas(run, "p_partkey long, points long, area double")


@query("G22_snapped_rings", "SELECT p_partkey, ((10.0 + p_size) * 20)::DOUBLE AS onto_ends, ((10.0 + p_size) * 20)::DOUBLE AS onto_lines FROM part")
def g22(spark, sf):
    """Corners a hair off, pulled onto drawn ends; edges moved onto drawn lines."""

    def run(frames):
        for frame in frames:
            out = []
            for k, s in zip(frame["p_partkey"], frame["p_size"]):
                w = 10.0 + s
                ends = np.array([[0, 0], [w, 0], [w, 20], [0, 20]], float)
                traced = ends + np.array([[0.5, 0.2], [-0.4, 0.3], [0.1, -0.2], [0.3, 0.1]])
                square = np.array([[0.3, 0.4], [w - 0.3, 0.4], [w - 0.3, 20.2], [0.3, 20.2]], float)
                lines = np.column_stack([ends, np.roll(ends, -1, axis=0)])
                out.append((k, round(abs(cutouts.area(outlines.snapped(traced, ends, 2.0, 0.5))), 6), round(abs(cutouts.area(outlines.onto_lines(square, lines, 1.0))), 6)))
            yield pd.DataFrame(out, columns=["p_partkey", "onto_ends", "onto_lines"])

    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).mapInPandas(run, "p_partkey long, onto_ends double, onto_lines double")


@query("D01_polygons", _RINGS + "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'unmeasured' ELSE 'measured' END AS status, CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'fewer than three points' ELSE 'no area' END ELSE '' END AS reason, round(CASE WHEN p_partkey % 11 = 0 THEN -1.0 WHEN p_partkey % 3 = 0 THEN w * h / 2 ELSE w * h + h END, 6) AS area FROM r")
def d01(spark, sf):
    """Rings with a point twice; some of two points, some on one line."""
    k = F.col("p_partkey")
    short = F.slice("ring", 1, 2)
    flat = F.transform("ring", lambda p: F.array(p[0] + 0.375 * p[1], p[0] + 0.375 * p[1]))
    ring = F.when((k % 11 == 0) & (k % 2 == 0), short).when(k % 11 == 0, flat).otherwise(F.concat(F.slice("ring", 1, 1), F.col("ring")))
    found = overlay.polygons(rings(spark, sf).select(k.alias("id"), ring.alias("ring")))
    return found.select("id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.round(F.coalesce("area", F.lit(-1.0)), 6).alias("area"))


_CUTS = _ROOMS + ", c AS (SELECT *, shape_id % 5 AS k FROM q)"


@query("D05_cut_floors", _CUTS + " SELECT shape_id AS id, CASE k WHEN 0 THEN 'untouched' WHEN 3 THEN 'refused' WHEN 4 THEN 'refused' ELSE 'cut' END AS status, CASE WHEN k = 1 THEN 1 ELSE 0 END AS holes, round(CASE k WHEN 1 THEN w * h - 1 WHEN 2 THEN w * h - 2 ELSE w * h END, 6) AS area, round(CASE k WHEN 1 THEN 2 * (w + h) + 4 ELSE 2 * (w + h) END, 6) AS perimeter FROM c")
def d05(spark, sf):
    """Rooms with a hole, a notch at a corner, a cut that would part them, one that would erase them, or none."""
    k = F.col("shape_id") % 5
    w, h = F.col("ring")[1][0], F.col("ring")[2][1]
    floors = rooms(spark, sf).select((F.col("shape_id") % 97).alias("group"), F.col("shape_id").alias("sheet_id"), F.col("shape_id").alias("id"), "ring", F.array().cast("array<array<array<double>>>").alias("holes"))
    made = F.when(k == 1, box(1, 1, 2, 2)).when(k == 2, box(-1, -1, 1, 2)).when(k == 3, box(w / 2, -1, w / 2 + 1, h + 1)).when(k == 4, box(-1, -1, w + 1, h + 1)).otherwise(box(500, 500, 501, 501))
    cuts = rooms(spark, sf).select(F.col("shape_id").alias("sheet_id"), F.lit(0).alias("ord"), made.alias("ring"))
    found = cutouts.cut_floors(floors.drop("group"), cuts)
    return found.select("id", "status", F.size("holes").alias("holes"), F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


@query("D05_crossing_cuts", _CUTS + " SELECT shape_id AS id, CASE WHEN k = 2 THEN 'refused' ELSE 'cut' END AS status, CASE WHEN k = 2 THEN 'nothing would be left' ELSE '' END AS reason, round(w * h - CASE k WHEN 2 THEN 0 WHEN 1 THEN 5 / 12.0 ELSE 0.5 END, 6) AS area FROM c")
def d05_crossing(spark, sf):
    """Cuts that cross themselves: bow ties in the room and over its edge, and a star whose arms leave only what it crosses twice, outside the room."""
    k = F.col("shape_id") % 5
    w, h = F.col("ring")[1][0], F.col("ring")[2][1]
    ring = lambda *p: F.array(*[F.array(*[(c if hasattr(c, "cast") else F.lit(c)).cast("double") for c in q]) for q in p])
    floors = rooms(spark, sf).select(F.col("shape_id").alias("sheet_id"), F.col("shape_id").alias("id"), "ring", F.array().cast("array<array<array<double>>>").alias("holes"))
    whole = ring((-1, -1), (w + 9, -1), (w + 9, h + 1), (w + 5, -2), (w + 7, h + 2), (w + 1, h + 1), (-1, h + 1))
    tie = F.when(k == 2, whole).when(k == 1, ring((-0.5, 1), (1, 2), (1, 1), (-0.5, 2))).otherwise(ring((1, 1), (2, 2), (2, 1), (1, 2)))
    found = cutouts.cut_floors(floors, rooms(spark, sf).select(F.col("shape_id").alias("sheet_id"), F.lit(0).alias("ord"), tie.alias("ring")))
    return found.select("id", "status", "reason", F.round("area", 6).alias("area"))


@query("D09_rule_seeds", _ROOMS + "SELECT shape_id AS deduct_id, shape_id AS container_id, greatest(25.0, ceil((shape_id % 9 + 1) * (shape_id % 9 + 1) / 2.0 / 5) * 5)::DOUBLE AS max_area_sf FROM q WHERE shape_id % 3 = 0 AND (shape_id % 9 + 1) * 0.5 + 0.5 < h AND (shape_id % 9 + 1) + 0.5 < w")
def d09(spark, sf):
    """Deducts inside a floor of their condition, with the cap of the rule that they found."""
    k = F.col("shape_id")
    size = (k % 9 + 1).cast("double")
    floors = rooms(spark, sf).select(k.alias("sheet_id"), k.alias("id"), "condition_id", "ring")
    deducts = rooms(spark, sf).where("shape_id % 3 = 0").select(k.alias("sheet_id"), (k + 10_000_000).alias("id"), "condition_id", box(0.5, 0.5, size + 0.5, size * 0.5 + 0.5).alias("ring"), (size * size / 2).alias("area_sf"))
    found = cutouts.rule_seeds(deducts, floors)
    return found.select((F.col("deduct_id") - 10_000_000).alias("deduct_id"), "container_id", "max_area_sf")


@query("D09_applied_rules", _ROOMS + "SELECT 1 AS rule_id, shape_id AS island_id, shape_id AS container_id FROM q WHERE condition_id % 2 = 0 AND (shape_id % 9 + 1) * (shape_id % 9 + 1) / 2.0 <= 25 AND (shape_id % 9 + 1) * 0.5 + 0.5 < h AND (shape_id % 9 + 1) + 0.5 < w AND shape_id % 4 <> 1")
def d09_applied(spark, sf):
    """A rule of every even condition proposes its islands, but for those that a deduct covers."""
    k = F.col("shape_id")
    size = (k % 9 + 1).cast("double")
    all_rooms = rooms(spark, sf)
    floors = all_rooms.select(k.alias("sheet_id"), k.alias("id"), F.pmod("condition_id", F.lit(2)).alias("condition_id"), "ring")
    islands = all_rooms.select(k.alias("sheet_id"), k.alias("id"), box(0.5, 0.5, size + 0.5, size * 0.5 + 0.5).alias("ring"), (size * size / 2).alias("area_sf"))
    deducts = all_rooms.where("shape_id % 4 = 1").select(k.alias("sheet_id"), k.alias("id"), box(0, 0, size + 1, size + 1).alias("ring"))
    rules = spark.createDataFrame([(1, 0, 25.0, True), (2, 1, 25.0, False)], "id int, condition_id long, max_area_sf double, active boolean")
    return cutouts.apply_rules(rules, floors, islands, deducts).select("rule_id", "island_id", "container_id")


@query("J22_shared_runs", "WITH n AS (SELECT p_partkey AS a_id, p_partkey + 1 AS b_id, p_size % 2 AS k, CAST(p_partkey % 5 + 4 AS DOUBLE) AS ha, CAST((p_partkey + 1) % 5 + 4 AS DOUBLE) AS hb FROM part WHERE p_partkey % 40 < 39 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part)) SELECT a_id, b_id, CASE WHEN k = 0 THEN 'butt' ELSE 'withheld' END AS status, round(least(ha, hb) + CASE WHEN k = 1 AND ha > hb THEN 0.5 / sqrt(3) ELSE 0 END, 4) AS length, CASE WHEN k = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS gap FROM n")
def j22(spark, sf):
    """Rooms of different depths in a row: neighbours that touch, or stand half a foot apart, with the feet they share. Beyond a shallower neighbour's corner a run
    goes on until the corner lies ahead of it at 60 degrees."""
    part, i = table(spark, sf, "part"), F.col("p_partkey") % 40
    high = (F.col("p_partkey") % 5 + 4).cast("double")
    x1 = i * 10.0 + 10.0 - F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5)
    found = transitions.transitions(part.select(F.floor(F.col("p_partkey") / 40).alias("sheet_id"), F.col("p_partkey").alias("id"), i.alias("condition_id"), box(i * 10.0, 0, x1, high).alias("ring")))
    return found.select("a_id", "b_id", "status", F.round("length", 4).alias("length"), F.round("gap", 9).alias("gap"))


@query("J23_doors_on_rings", _ROOMS + "SELECT shape_id AS door_id, shape_id AS ring_id FROM q WHERE shape_id % 3 < 2")
def j23(spark, sf):
    """Doors along a wall, a wall's thickness off, and across one."""
    k = F.col("shape_id")
    all_rooms = rooms(spark, sf).select(k.alias("sheet_id"), k.alias("id"), "ring")
    off = F.when(F.col("id") % 3 == 0, 0.0).otherwise(0.3)
    across = F.col("id") % 3 == 2
    doors = all_rooms.select("sheet_id", "id", F.lit(1.0).alias("x1"), F.when(across, 2.0).otherwise(off).alias("y1"), F.when(across, 1.0).otherwise(2.0).alias("x2"), F.when(across, 3.0).otherwise(off).alias("y2"))
    return openings.doors_on_rings(doors, all_rooms, 0.4)


@query("J24_marked_openings", "SELECT p_partkey AS sheet_id, 1 AS ord, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 1 END AS opening_id FROM part UNION ALL SELECT p_partkey, 2, CASE WHEN p_size % 3 = 0 THEN 1 END FROM part")
def j24(spark, sf):
    """Two marks by a window and a door: the window before a nearer door, each opening once, nothing out of reach."""
    part = table(spark, sf, "part")
    sheet = F.col("p_partkey").alias("sheet_id")
    s = F.col("p_size") % 3
    marks = part.select(sheet, F.lit(1).cast("long").alias("ord"), F.when(s == 2, 900.0).otherwise(50.0).alias("x"), F.lit(10.0).alias("y")).unionByName(part.select(sheet, F.lit(2).cast("long").alias("ord"), F.when(s == 0, 52.0).otherwise(700.0).alias("x"), F.lit(12.0).alias("y")))
    one = lambda i, kind, y: F.struct(F.lit(i).cast("long").alias("id"), F.lit(kind).alias("kind"), F.lit(20.0).alias("x1"), F.lit(y).alias("y1"), F.lit(80.0).alias("x2"), F.lit(y).alias("y2"))
    listed = F.when(s == 0, F.array(one(1, "door", 8.0), one(2, "window", 0.0))).otherwise(F.array(one(1, "window", 0.0)))
    found = openings.marked_openings(marks, part.select(sheet, F.explode(listed).alias("o")).select("sheet_id", "o.*"), 100.0)
    return found.select("sheet_id", F.col("ord").cast("int").alias("ord"), F.col("opening_id").cast("int").alias("opening_id"))


@query("J25_labelled_placements", _SPANS + """, p AS (SELECT sheet_id, ord, x0 + 5 AS x, y0 + 3 AS y FROM s WHERE ord % 3 = 0), m AS (SELECT sheet_id, ord, mark, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM s WHERE ord % 3 <> 0), d AS (SELECT p.sheet_id, p.ord AS id, m.mark, sqrt((m.cx - p.x) * (m.cx - p.x) + (m.cy - p.y) * (m.cy - p.y)) AS away, m.ord AS m_ord FROM p JOIN m ON m.sheet_id = p.sheet_id),
b AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, id ORDER BY away, m_ord) AS k FROM d WHERE away <= 24) SELECT p.sheet_id, p.ord AS id, b.mark AS label, CAST(floor(b.away + 0.5) AS BIGINT) AS distance_px FROM p LEFT JOIN b ON b.sheet_id = p.sheet_id AND b.id = p.ord AND b.k = 1""")
def j25(spark, sf):
    """Placements named by the nearest mark within three text heights."""
    s = spans(spark, sf).withColumn("str", F.upper(F.trim("str")))
    at = s.where("ord % 3 = 0").select("sheet_id", F.col("ord").alias("id"), (F.col("x0") + 5).alias("x"), (F.col("y0") + 3).alias("y"))
    return openings.labelled_placements(at, s.where("ord % 3 <> 0")).select("sheet_id", "id", "label", F.col("distance_px").cast("long").alias("distance_px"))


@query("X21_doors_from_swings", "SELECT p_partkey AS sheet_id, CASE WHEN p_size % 4 < 2 THEN 'door' ELSE 'rejected' END AS status, CASE p_size % 4 WHEN 2 THEN 'no leaf' WHEN 3 THEN 'over sweep' ELSE '' END AS reason, CASE WHEN p_size % 4 = 1 THEN 2 ELSE 1 END AS leaves, CASE WHEN p_size % 4 = 1 THEN 160.0 ELSE 80.0 END::DOUBLE AS width FROM part")
def x21(spark, sf):
    """Single leaves, pairs, swings without a leaf, and half circles."""
    part = table(spark, sf, "part")
    s = F.col("p_size") % 4
    arc = lambda cx, cy, a0, a1: F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.array(cx + 80.0 * F.cos(a0 + (a1 - a0) * i / 12.0), cy + 80.0 * F.sin(a0 + (a1 - a0) * i / 12.0)))
    half = np.pi / 2
    one, pair, wide = arc(100.0, 100.0, 0.0, half), F.array(arc(100.0, 100.0, 0.0, half), arc(260.0, 100.0, np.pi, half)), arc(100.0, 100.0, 0.0, np.pi)
    chains = F.when(s == 1, pair).when(s == 3, F.array(wide)).otherwise(F.array(one))
    line = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip(("x1", "y1", "x2", "y2"), v)])
    drawn = F.when(s == 0, F.array(line(100, 100, 100, 180))).when(s == 1, F.array(line(100, 100, 100, 180), line(260, 100, 260, 180))).otherwise(F.array(line(0, 0, 50, 0)))
    sheet = F.col("p_partkey").alias("sheet_id")
    found = openings.find_doors(part.select(sheet, F.explode(chains).alias("points")), part.select(sheet, F.explode(drawn).alias("l")).select("sheet_id", "l.*"), part.select(sheet, F.lit(100.0).alias("px_per_m")))
    return found.select("sheet_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), "leaves", F.round("width", 6).alias("width"))


@query("X22_windows", "SELECT p_partkey AS sheet_id, 1 AS id, 'V1' AS type, 1200 + p_size % 5 * 30 AS width_mm, CASE WHEN p_size % 5 * 30 <= 60 THEN 'agrees' ELSE 'differs' END AS check FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 1, 'unmarked ~' || CAST((1200 + p_size % 5 * 30 + 50) // 100 * 100 AS VARCHAR) || ' mm', 1200 + p_size % 5 * 30, 'no schedule width' FROM part WHERE p_size % 3 = 1")
def x22(spark, sf):
    """Marked windows against their schedule; on sheets without marks the glazed openings of exterior walls."""
    part = table(spark, sf, "part")
    sheet = F.col("p_partkey").alias("sheet_id")
    width = (1200 + F.col("p_size") % 5 * 30).cast("long")
    here = part.select(sheet, F.lit(1).cast("long").alias("id"), F.lit("window").alias("kind"), width.alias("width_mm"), (F.col("p_size") % 3 == 1).alias("exterior"))
    marks = part.where("p_size % 3 = 0").select(sheet, F.lit(1).cast("long").alias("ord"), F.lit("V1").alias("mark"))
    marked = marks.select("sheet_id", "ord", F.lit(1).cast("long").alias("opening_id"))
    found = openings.window_takeoff(here, marked, marks, spark.createDataFrame([("V1", 1200)], "mark string, width_mm long"))
    return found.select("sheet_id", F.col("id").cast("int").alias("id"), "type", F.col("width_mm").cast("int").alias("width_mm"), "check")


@query("D08_derived_base", "SELECT p_partkey AS id, 24.0::DOUBLE AS gross_m, CASE p_size % 4 WHEN 0 THEN 24.0 WHEN 1 THEN 23.1 WHEN 2 THEN 22.6 ELSE 24.0 END::DOUBLE AS net_m, CASE WHEN p_size % 4 = 3 THEN 'flagged' ELSE 'measured' END AS status FROM part")
def d08_derived(spark, sf):
    """Rooms of six metres square: closed, with a door, with an opening, and with something drawn in the gap."""
    part = table(spark, sf, "part")
    s = F.col("p_size") % 4
    sheet = F.col("p_partkey").alias("sheet_id")
    line = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip(("x1", "y1", "x2", "y2"), v)])
    sides = [line(8, 2, 8, 8), line(8, 8, 2, 8), line(2, 8, 2, 2)]
    south = F.when(s == 0, F.array(line(2, 2, 8, 2))).when(s == 1, F.array(line(2, 2, 4, 2), line(4.9, 2, 8, 2))).otherwise(F.array(line(2, 2, 4, 2), line(5.4, 2, 8, 2)))
    unpack = lambda c: part.select(sheet, F.explode(c).alias("l")).select("sheet_id", "l.*")
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    doors, ink = F.when(s == 1, F.array(line(4, 2, 4.9, 2))).otherwise(none), F.when(s == 3, F.array(line(4.2, 2.1, 5.2, 2.1))).otherwise(none)
    found = openings.derive_base(part.select(sheet, F.col("p_partkey").alias("id"), box(2, 2, 8, 8).alias("ring")), unpack(F.concat(F.array(*sides), south)), unpack(ink), unpack(doors))
    return found.select("id", F.round("gross_m", 1).alias("gross_m"), F.round("net_m", 1).alias("net_m"), "status")


@query("R02_run_extents", _ROOMS + "SELECT shape_id, 0.0::DOUBLE AS low, CASE WHEN w > 6 THEN h ELSE h END AS high FROM q")
def r02(spark, sf):
    """How far a room is met within its first six feet."""

    def run(frames):
        for frame in frames:
            found = [(i, *roll.run_extent(np.array([list(p) for p in ring], float), 0, 0.0, 6.0)) for i, ring in zip(frame["shape_id"], frame["ring"])]
            yield pd.DataFrame(found, columns=["shape_id", "low", "high"])

    return spread(rooms(spark, sf).select("shape_id", "ring")).mapInPandas(run, "shape_id long, low double, high double")


@query("R03_clipped_slabs", _ROOMS + "SELECT shape_id, round((least(w, 6.0) - 2.0) * h, 6) AS area FROM q WHERE w > 2")
def r03(spark, sf):
    """The part of a room between two and six feet."""

    def run(frames):
        for frame in frames:
            found = [(i, round(abs(cutouts.area(cutouts.clip_slab(np.array([list(p) for p in ring], float), 0, 2.0, 6.0))), 6)) for i, ring in zip(frame["shape_id"], frame["ring"])]
            yield pd.DataFrame(found, columns=["shape_id", "area"])

    return spread(rooms(spark, sf).select("shape_id", "ring")).mapInPandas(run, "shape_id long, area double")


_WAYS = _ROOMS + """, n AS (SELECT unnest(range(1, 41)) AS n), cap AS (SELECT n, CASE WHEN n = 1 THEN 138 ELSE 278 + (n - 2) * 140 END AS cap FROM n), l AS (SELECT q.*, (SELECT min(n) FROM cap WHERE cap >= q.w * 12 - 1e-6) AS ns, (SELECT min(n) FROM cap WHERE cap >= q.h * 12 - 1e-6) AS ew FROM q),
d AS (SELECT condition_id, sum(ns * (h + 0.5)) AS ns_ft, sum(ew * (w + 0.5)) AS ew_ft FROM l GROUP BY 1)"""


@query("R05_directions", _WAYS + "SELECT condition_id, CASE WHEN ns_ft <= ew_ft THEN 'ns' ELSE 'ew' END AS direction, least(ns_ft, ew_ft)::DOUBLE AS footage FROM d")
def r05(spark, sf):
    """The way that takes less footage, north and south where both take the same."""
    return roll.directions(roll.room_strips(rooms(spark, sf)))


@query("G20_layout_lanes", _WAYS + "SELECT l.condition_id, CAST(sum(CASE WHEN ns_ft <= ew_ft THEN ns ELSE ew END) AS BIGINT) AS cuts FROM l JOIN d ON d.condition_id = l.condition_id GROUP BY 1")
def g20(spark, sf):
    """Cuts of each condition's layout, nested."""
    return roll.roll_cuts(rooms(spark, sf)).groupBy("condition_id").agg(F.count("*").alias("cuts"))


@query("W09_lane_overlaps", _WAYS.replace("d AS (", "k AS (SELECT l.*, unnest(range(0, ns - 1)) AS lane FROM l WHERE ns > 1), d AS (") + "SELECT shape_id, lane, h AS overlap_lf FROM k")
def w09(spark, sf):
    """How far each pair of neighbouring lanes runs side by side."""
    return roll.seam_overlaps(roll.room_strips(rooms(spark, sf), roll.Roll(direction="ns"))).select("shape_id", "lane", "overlap_lf")


def roll_takeoff(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    w, h = (4 + F.col("p_size")) / 100.0, (5 + k % 26) / 100.0
    verts = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w, h), F.array(F.lit(0.0), h))
    shapes = part.select(k.alias("id"), F.floor(k / 4).alias("condition_id"), (k % 3).alias("sheet_id"), F.when(k % 7 == 0, "deduct").otherwise("floor_area").alias("measure_role"), verts.alias("verts_norm"))
    conditions = part.select(F.floor(k / 4).alias("id"), (F.floor(k / 4) % 2 == 0).alias("is_roll")).distinct()
    sheets = spark.createDataFrame([(0, 1000.0, 1000.0, 0.1), (1, 1000.0, 1000.0, 0.1), (2, 1000.0, 1000.0, None)], "sheet_id long, width double, height double, units_per_px double")
    return roll.takeoff_rooms(shapes, conditions, sheets)


@query("R09_takeoff_rooms", "SELECT p_partkey AS shape_id, p_partkey // 4 AS condition_id, ((4.0 + p_size) * (5 + p_partkey % 26))::DOUBLE AS area FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 < 2 AND p_partkey // 4 % 2 = 0")
def r09(spark, sf):
    """Floors of roll goods on scaled sheets, in feet."""
    from plumbline.functions.geometry import ring_area

    return roll_takeoff(spark, sf).select("shape_id", "condition_id", F.round(ring_area(F.col("ring")), 6).alias("area"))


@query("R10_seams_in_materials", _WAYS.replace("d AS (", "s AS (SELECT condition_id, sum(CASE WHEN ns > 1 THEN floor((ns - 1) * h * 100 + 0.5) / 100 ELSE 0 END) AS seam FROM l GROUP BY 1), d AS (") + "SELECT p_partkey AS id, CASE WHEN coalesce(seam, 0) = 0 THEN 0.0 ELSE ceil(seam / 10 - 1e-9) END::DOUBLE AS qty FROM part LEFT JOIN s ON s.condition_id = p_partkey")
def r10(spark, sf):
    """Weld rod by figured seams: a rod for ten feet."""
    from plumbline.operators import totals
    from plumbline.plans import projection as p

    sewn = roll.seams(roll.room_strips(rooms(spark, sf), roll.Roll(direction="ns")))
    conditions = p.conditions(spark, sf).withColumn("multiplier", F.lit(1.0))
    rods = conditions.select(F.col("id").alias("condition_id"), F.lit(0).alias("m_ord"), F.lit("Rod").alias("name"), F.lit(10.0).alias("per"), F.lit("seam_lf").alias("basis"), F.lit("ea").alias("unit"), F.lit(True).alias("round"))
    return totals.condition_materials(conditions, p.shapes(spark, sf), rods, sewn).select("id", "qty")


@query("R11_overridden_cuts", _ROOMS + """, n AS (SELECT unnest(range(1, 41)) AS n), cap AS (SELECT n, CASE WHEN n = 1 THEN 138 ELSE 278 + (n - 2) * 140 END AS cap FROM n), l AS (SELECT q.*, (SELECT min(n) FROM cap WHERE cap >= q.w * 12 - 1e-6) AS lanes FROM q)
SELECT shape_id, CASE WHEN lanes = 2 THEN 1.0 ELSE -0.25 END::DOUBLE AS run_min FROM l""")
def r11(spark, sf):
    """Stated runs of the first lane hold only while the room has the two lanes they were stated for."""
    strips = roll.room_strips(rooms(spark, sf), roll.Roll(direction="ns"))
    stated = rooms(spark, sf).select("shape_id", F.lit(0).cast("long").alias("lane"), F.lit(2).cast("long").alias("lanes"), F.lit(1.0).alias("run_min"), F.lit(3.0).alias("run_max"))
    return roll.with_overrides(strips, stated).where("lane = 0").select("shape_id", "run_min")


@query("P13_roll_columns", _WAYS + "SELECT p_partkey AS id, CASE WHEN d.condition_id IS NOT NULL AND p_size % 2 = 0 THEN least(ns_ft, ew_ft)::DOUBLE END AS roll_order_lf FROM part LEFT JOIN d ON d.condition_id = p_partkey")
def p13(spark, sf):
    """Roll columns beside condition rows, empty where a condition isn't roll goods; here a roll's order is its footage."""
    part = table(spark, sf, "part")
    figured = roll.directions(roll.room_strips(rooms(spark, sf))).join(part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("condition_id")), "condition_id", "left_semi")
    rolls = figured.select("condition_id", F.col("footage").alias("order_lf"), F.lit(1.0).alias("rolls"), F.lit(0.0).alias("order_qty"), F.lit(0.0).alias("seam_lf"))
    return summaries.with_roll_columns(part.select(F.col("p_partkey").alias("id")), rolls).select("id", "roll_order_lf")


@query("W05_longest_first", _SEGS + " SELECT sheet_id, idx, place FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY len DESC, idx) AS place FROM s) WHERE place <= 25")
def w05(spark, sf):
    """The longest segments of each sheet with their place."""
    return records.longest(segments(spark, sf), F.col("len"), 25).select("sheet_id", "idx", F.col("place").cast("long").alias("place"))


@query("O05_context_and_page", _SEGS + """, k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY len DESC, idx) AS place FROM s WHERE len >= 2), c AS (SELECT sheet_id, idx FROM k WHERE place <= 200) SELECT sheet_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY idx) AS n FROM c WHERE idx >= 300) WHERE n <= 40""")
def o05(spark, sf):
    """A page of what a sheet's context keeps."""
    kept = records.sheet_context(segments(spark, sf), F.col("len"), F.lit(True), cap=200).where("status = 'kept'")
    return records.page_after(kept, 300, 40).select("sheet_id", "idx")


@query("W07_hatch_families", "SELECT DISTINCT p_partkey // 40 AS sheet_id, 30 AS angle, 10 + p_partkey // 40 % 9 AS rows FROM part UNION ALL SELECT DISTINCT p_partkey // 40, 0, 12 FROM part")
def w07(spark, sf):
    """Hatching at thirty degrees and along the sheet, and walls that step too seldom."""
    sheet = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("sheet_id")).distinct()
    a = np.radians(30.0)
    rows = lambda many, f: F.transform(F.sequence(F.lit(0), many - 1), f)
    tilted = rows((10 + F.col("sheet_id") % 9).cast("int"), lambda i: F.struct((i * -6.0 * float(np.sin(a))).alias("x1"), (i * 6.0 * float(np.cos(a))).alias("y1"), (i * -6.0 * float(np.sin(a)) + 50 * float(np.cos(a))).alias("x2"), (i * 6.0 * float(np.cos(a)) + 50 * float(np.sin(a))).alias("y2")))
    level = rows(F.lit(12), lambda i: F.struct(F.lit(0.0).alias("x1"), (i * 4.0).alias("y1"), F.lit(90.0).alias("x2"), (i * 4.0).alias("y2")))
    walls = rows(F.lit(5), lambda i: F.struct((i * 20.0).alias("x1"), F.lit(0.0).alias("y1"), (i * 20.0).alias("x2"), F.lit(70.0).alias("y2")))
    lines = sheet.select("sheet_id", F.explode(F.concat(tilted, level, walls)).alias("l")).select("sheet_id", "l.*")
    return summaries.hatch_families(lines).select("sheet_id", "angle", F.col("rows").cast("int").alias("rows"))


@query("W10_ring_islands", """WITH f AS (SELECT user_id AS ring_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value > 30 AS flag FROM events), z AS (SELECT ring_id, min(i) FILTER (NOT flag) AS z FROM f GROUP BY 1),
t AS (SELECT f.ring_id, f.i, f.n, flag, (f.i - coalesce(z, 0) + f.n) % f.n AS p FROM f JOIN z ON z.ring_id = f.ring_id), g AS (SELECT *, p - row_number() OVER (PARTITION BY ring_id ORDER BY p) AS isle FROM t WHERE flag) SELECT ring_id, arg_min(i, p) AS first, count(*) AS n FROM g GROUP BY ring_id, isle""")
def w10(spark, sf):
    """Runs of high values around each user's ring of events, over its end too."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return summaries.ring_runs(table(spark, sf, "events").select(F.col("user_id").alias("ring_id"), place.cast("long").alias("i"), (F.col("value") > 30).alias("flag")))


@query("X16_swept_sets", "SELECT * FROM (VALUES (1, 'searched', 2), (2, 'searched', 2), (3, 'searched at the same size', 2), (4, 'skipped', 0), (5, 'skipped', 0)) AS v(sheet_id, status, matches)")
def x16(spark, sf):
    """A symbol over plans of its scale, of half of it, and of none; a schedule and an unknown sheet are skipped."""
    from plumbline.driver.overlay_queries import SYMBOL
    from plumbline.operators import sweep

    seed = sweep.fingerprint(SYMBOL * 4, (-100, -100, 100, 100))
    lines = []
    for sheet, size in ((1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 1.0)):
        for at in (100.0, 400.0):
            lines += [(sheet, *(float(v) for v in s * size + at)) for s in seed]
    segments_ = spark.createDataFrame(lines, "sheet_id long, x1 double, y1 double, x2 double, y2 double")
    sheets = spark.createDataFrame([(1, "plan", 0.2), (2, "plan", 0.1), (3, "plan", None), (4, "schedule", 0.2), (5, "unknown", 0.2)], "sheet_id long, role string, units_per_px double")
    found, judged = sweep.sweep_set(segments_, seed, 1, sheets)
    n_ = found.where("status = 'match'").groupBy(F.col("sheet_id").alias("of_sheet")).agg(F.count("*").alias("n"))
    return judged.join(n_, F.col("sheet_id") == F.col("of_sheet"), "left").select(F.col("sheet_id").cast("int").alias("sheet_id"), "status", F.coalesce("n", F.lit(0)).cast("int").alias("matches"))


@query("X17_counts_from_points", "SELECT p_partkey // 40 AS sheet_id, min(p_partkey) AS id, 4 AS segments, count(*) AS matches FROM part GROUP BY 1 HAVING count(*) > 1")
def x17(spark, sf):
    """A symbol pointed at on each sheet, drawn for every part of it."""
    from plumbline.driver.overlay_queries import SYMBOL
    from plumbline.operators import sweep

    seed = sweep.fingerprint(SYMBOL, (-10, -10, 10, 10))
    part = table(spark, sf, "part")
    sheet, i = F.floor(F.col("p_partkey") / 40), F.col("p_partkey") % 40
    at = lambda v, by: F.lit(float(v)) + by
    x, y = 100.0 + i % 8 * 60.0, 100.0 + F.floor(i / 8) * 60.0
    lines = F.array(*[F.struct(at(s[0], x).alias("x1"), at(s[1], y).alias("y1"), at(s[2], x).alias("x2"), at(s[3], y).alias("y2")) for s in seed])
    drawn = part.select(sheet.alias("sheet_id"), F.explode(lines).alias("l")).select("sheet_id", "l.*")
    first = part.groupBy(sheet.alias("sheet_id")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")).where("n > 1")
    j = F.col("id") % 40
    points = first.select("sheet_id", "id", (100.0 + j % 8 * 60.0).alias("x"), (100.0 + F.floor(j / 8) * 60.0).alias("y"))
    found = sweep.count_from_points(drawn, points, 12.0)
    return found.select("sheet_id", "id", F.col("segments").cast("int").alias("segments"), "matches")


@query("D10_enclosed_islands", "SELECT p_partkey AS id, (p_partkey % 6 + 1) * (p_partkey % 6 + 1) AS cells, ((p_partkey % 6 + 1) * (p_partkey % 6 + 1))::DOUBLE AS area, CAST(p_partkey % 40 * 30 + 6 AS DOUBLE) AS x0 FROM part WHERE p_partkey % 6 BETWEEN 1 AND 4 AND p_size % 4 > 0")
def d10(spark, sf):
    """Boxes of walls inside rooms: closed ones are islands, unless they are too small or too large; open ones belong to the room."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    side, left, sheet = (k % 6 + 1).cast("int"), (k % 40 * 30).cast("int"), F.floor(k / 40).alias("sheet_id")
    floors = part.select(sheet, k.alias("id"), box(left, 0, left + 20, 20).alias("ring"), F.lit(25).alias("most"))
    one = lambda y, a, b: F.struct(F.lit(y).cast("int").alias("y") if not hasattr(y, "cast") else y.cast("int").alias("y"), (left + a).cast("int").alias("x0"), (left + b).cast("int").alias("x1"))
    lids = F.array(one(5, 5, side + 7), one(side + 6, 5, F.when(F.col("p_size") % 4 > 0, side + 7).otherwise(6)))
    sides = F.flatten(F.transform(F.sequence(F.lit(6), side + 5), lambda y: F.array(F.struct(y.cast("int").alias("y"), (left + 5).cast("int").alias("x0"), (left + 6).cast("int").alias("x1")), F.struct(y.cast("int").alias("y"), (left + side + 6).cast("int").alias("x0"), (left + side + 7).cast("int").alias("x1")))))
    walls = part.select(sheet, F.explode(F.concat(lids, sides)).alias("w")).select("sheet_id", "w.*")
    from plumbline.functions.geometry import ring_area
    from plumbline.operators.islands import find_islands

    return find_islands(floors, walls).select("id", "cells", ring_area(F.col("ring")).alias("area"), F.array_min(F.transform("ring", lambda p: p[0])).alias("x0"))


def wall_lines(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    long, y = 50.0 + F.col("p_size") * 10, k % 40 * 1000.0
    one = lambda i, x, dy: F.struct((k * 2 + i).alias("idx"), F.lit(x).alias("x1"), (y + dy).alias("y1"), (long + x).alias("x2"), (y + dy).alias("y2"))
    lines = part.select(F.floor(k / 40).alias("sheet_id"), F.explode(F.array(one(0, 0.0, F.lit(0.0)), one(1, 20.0, k % 6 * 8.0))).alias("s")).select("sheet_id", "s.*")
    return lines, lines.select("sheet_id").distinct().withColumn("px_per_m", F.when(F.col("sheet_id") % 5 < 4, 100.0))


_WALLS = "WITH w AS (SELECT p_partkey * 2 AS a_idx, p_partkey * 2 + 1 AS b_idx, p_partkey // 40 AS sheet_id, 50.0 + p_size * 10 AS len, p_partkey % 6 * 8 AS off FROM part WHERE p_partkey // 40 % 5 < 4), f AS (SELECT * FROM w WHERE len - 20 >= 80 AND off BETWEEN 7 AND 35)"


@query("X24_wall_pairs", _WALLS + "SELECT sheet_id, a_idx, b_idx, (off / 100.0)::DOUBLE AS thickness_m, ((len - 20) / 100)::DOUBLE AS overlap_m, 20.0::DOUBLE AS x1, len::DOUBLE AS x2 FROM f")
def x24(spark, sf):
    """Pairs of lines: too near, too far, too short, or the faces of a wall."""
    from plumbline.operators.walls import wall_pairs

    return wall_pairs(*wall_lines(spark, sf)).select("sheet_id", "a_idx", "b_idx", "thickness_m", "overlap_m", "x1", "x2")


@query("X24_wall_faces", _WALLS + "SELECT sheet_id, unnest([a_idx, b_idx]) AS idx FROM f")
def x24_faces(spark, sf):
    from plumbline.operators.walls import wall_faces, wall_pairs

    return wall_faces(wall_pairs(*wall_lines(spark, sf))).select("sheet_id", "idx")
