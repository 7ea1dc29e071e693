"""Numbers, rings, text functions, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.functions import geometry as g
from plumbline.functions import numeric as n
from plumbline.functions import text as t
from plumbline.functions.keys import csv_cell, mark_key, natural_key, tag_key
from plumbline.operators import scope

R2 = "floor(({} + 2.220446049250313e-16) * 100 + 0.5) / 100".format


@query("F01_rounding", f"SELECT event_id, {R2('value')} AS eps, floor(value * 100 + 0.5) / 100 AS plain, floor(value * 10 + 0.5) / 10 AS one FROM events")
def f01(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", n.round2_eps(v).alias("eps"), n.round2_plain(v).alias("plain"), n.round1(v).alias("one"))


@query("F01_fixed_rounding", "SELECT * FROM (VALUES (1.005::DOUBLE, 1.0::DOUBLE), (2.125, 2.13), (-2.125, -2.13), (0.615, 0.61), (8.345, 8.35), (-1.005, -1.0), (10.235, 10.23), (1234567.875, 1234567.88)) AS v(value, fixed)")
def f01_fixed(spark, sf):
    rows = spark.createDataFrame([(x,) for x in (1.005, 2.125, -2.125, 0.615, 8.345, -1.005, 10.235, 1234567.875)], "value double")
    return rows.select("value", n.round2_fixed(F.col("value")).alias("fixed"))


@query("F02_unit_conversions", "SELECT event_id, value * 0.09290304::DOUBLE AS m2, value * 0.3048::DOUBLE AS m, value * 25.4::DOUBLE AS mm, value * 0.028316846592::DOUBLE AS m3, value / 27.0::DOUBLE AS cy FROM events")
def f02(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", n.sf_to_m2(v).alias("m2"), n.ft_to_m(v).alias("m"), n.in_to_mm(v).alias("mm"), n.cf_to_m3(v).alias("m3"), n.cf_to_cy(v).alias("cy"))


@query("F03_feet_and_inches", """SELECT c_custkey, CASE WHEN c_acctbal < 0 AND floor(abs(c_acctbal) * 12 + 0.5) > 0 THEN '-' ELSE '' END || CAST(CAST(floor(floor(abs(c_acctbal) * 12 + 0.5) / 12) AS BIGINT) AS VARCHAR) || '''-' || CAST(CAST(floor(abs(c_acctbal) * 12 + 0.5) AS BIGINT) % 12 AS VARCHAR) || '"' AS text FROM customer""")
def f03(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", n.feet_inches(F.col("c_acctbal")).alias("text"))


@query("F04_typed_lengths", """SELECT * FROM (VALUES ('12''-4"', 12.333333333333334::DOUBLE), ('12'' 6', 12.5), ('7''', 7.0), ('18"', 1.5), ('3 6', 3.5), ('2.25', 2.25), (' 10 ft 3 in ', 10.25)) AS v(typed, feet)""")
def f04(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("12'-4\"", "12' 6", "7'", '18"', "3 6", "2.25", " 10 ft 3 in ")], "typed string")
    return rows.select("typed", n.parse_length(F.col("typed")).alias("feet"))


@query("F04_refused_lengths", """SELECT * FROM (VALUES ('1e3', true), ('5'' 12"', true), ('', true), ('abc', true), ('4 13', true), ('5', false)) AS v(typed, refused)""")
def f04_refused(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("1e3", "5' 12\"", "", "abc", "4 13", "5")], "typed string")
    return rows.select("typed", F.isnan(n.parse_length(F.col("typed"))).alias("refused"))


@query("F05_check_verdicts", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN e <= 1 THEN 'match' WHEN e <= 5 THEN 'close' ELSE 'off' END AS verdict FROM (SELECT *, abs(floor((l_quantity * (1 + l_discount) - l_quantity) / l_quantity * 100.0::DOUBLE * 10 + 0.5) / 10) AS e FROM lineitem)")
def f05(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.check_verdict(q * (1 + F.col("l_discount")), q).alias("verdict"))


@query("F06_calibration", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 OR p_partkey % 3 > 0 THEN p_size / sqrt(CAST((p_size % 4) * (p_size % 4) * 9 + (p_partkey % 3) * (p_partkey % 3) * 16 AS DOUBLE)) END AS upp FROM part")
def f06(spark, sf):
    dx, dy = (F.col("p_size") % 4 * 3).cast("double"), (F.col("p_partkey") % 3 * 4).cast("double")
    pixels = F.sqrt(dx * dx + dy * dy)
    return table(spark, sf, "part").select("p_partkey", F.when(n.calibrated(F.col("p_size"), F.lit(0.0), F.lit(0.0), dx, dy).isNotNull(), F.col("p_size") / pixels).alias("upp"))


@query("F08_roll_quantities", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * w ELSE p_retailprice * w / 9.0::DOUBLE END AS qty, ceil(p_retailprice * 12 - 1e-6) / 12.0::DOUBLE AS to_inch FROM (SELECT *, CASE WHEN p_size % 6 = 0 THEN 12.0::DOUBLE ELSE CAST(p_size % 6 AS DOUBLE) END AS w FROM part)")
def f08(spark, sf):
    unit = F.element_at(F.array(F.lit("lf"), F.lit("sf"), F.lit("sy")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", n.roll_quantity(F.col("p_retailprice"), (F.col("p_size") % 6).cast("double"), unit).alias("qty"), n.round_up_to_inch(F.col("p_retailprice")).alias("to_inch"))


@query("F10_grout_coverage", "SELECT p_partkey, CASE WHEN j > 0 THEN 25.0::DOUBLE / (((l + 24.0::DOUBLE) / (l * 24.0::DOUBLE)) * 0.375::DOUBLE * j * 8.33::DOUBLE) ELSE 0.0 END AS coverage FROM (SELECT *, CAST(p_size AS DOUBLE) AS l, CAST(p_partkey % 4 AS DOUBLE) / 8 AS j FROM part)")
def f10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.grout_coverage(F.col("p_size").cast("double"), F.lit(24.0), F.lit(0.375), (F.col("p_partkey") % 4).cast("double") / 8, F.lit(25.0)).alias("coverage"))


@query("F13_find_text", "SELECT doc_id, length(text) AS size FROM documents WHERE contains(lower(text), 'licensed under')")
def f13(spark, sf):
    from plumbline.operators.summaries import find_text

    return find_text(table(spark, sf, "documents"), " Licensed Under ", "text").select("doc_id", F.length("text").cast("long").alias("size"))


@query("F15_canonical_tags", "SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS tag, upper(regexp_replace(' ' || p_name || ' 1 a', '\\s+', '', 'g')) AS mark FROM part")
def f15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tag_key(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("tag"), mark_key(F.concat(F.lit(" "), "p_name", F.lit(" 1 a"))).alias("mark"))


@query("F16_mark_shapes", "SELECT p_partkey, regexp_full_match(m, '[A-Z]{1,3}-?[0-9]{1,3}[A-Z]?') AS is_mark, regexp_full_match(v, '[0-9][0-9,]{0,6}') AS is_value FROM (SELECT p_partkey, substr(p_brand, 1, 1) || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || CAST(p_size * 37 AS VARCHAR) AS m, CAST(p_partkey * 7919 AS VARCHAR) AS v FROM part)")
def f16(spark, sf):
    mark = F.concat(F.substring("p_brand", 1, 1), F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), (F.col("p_size") * 37).cast("string"))
    return table(spark, sf, "part").select("p_partkey", t.mark_shape(mark).alias("is_mark"), t.value_shape((F.col("p_partkey") * 7919).cast("string")).alias("is_value"))


NOTES = ["SCALE: 1/8\" = 1'-0\"", "scale 1/8”=1′", "11/8\"=1'", "1-1/2\" = 1'-0\"", "A1 1:50", "ISO-A3/1:100", "1:500 site", "1\" = 20'-0\"", "M 1:1000 / 1:150", "no scale", "1:1250"]


@query("F17_scale_notes", """SELECT * FROM (VALUES (0, '1/8" = 1''-0"'), (1, '1/8" = 1''-0"'), (3, '1-1/2" = 1''-0"'), (4, '1:50'), (5, '1:100'), (6, '1:500'), (7, '1" = 20'''), (8, '1:150'), (8, '1:1000')) AS v(note, label)""")
def f17(spark, sf):
    """Scales named by each note: a small pattern table joined by match."""
    notes = spark.createDataFrame(list(enumerate(NOTES)), "note int, text string").withColumn("canon", t.canonical_scale_text(F.col("text")))
    scales = spark.createDataFrame(t.scale_patterns(), "place int, label string, upp double, pattern string")
    return notes.join(scales, F.expr("canon RLIKE pattern")).select("note", "label")


@query("F07_standard_scales", "SELECT 32 AS n, 1 / 0.125::DOUBLE / 144.0::DOUBLE AS eighth, 20 / 144.0::DOUBLE AS twenty, 100 / 12.0::DOUBLE / 144.0::DOUBLE AS hundred")
def f07(spark, sf):
    s = spark.createDataFrame(t.standard_scales(), "place int, label string, upp double")
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("upp")))
    return s.agg(F.count("*").cast("int").alias("n"), of('1/8" = 1\'-0"').alias("eighth"), of("1\" = 20'").alias("twenty"), of("1:100").alias("hundred"))


@query("F20_printed_areas", "SELECT * FROM (VALUES ('1,250 SF', 1250.0::DOUBLE), ('area 12.5 sq ft', 12.5), ('300 GSF', NULL), ('hello', NULL), ('10 m2', 107.63910416709722)) AS v(text, sf)")
def f20(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("1,250 SF", "area 12.5 sq ft", "300 GSF", "hello", "10 m2")], "text string")
    return rows.select("text", t.printed_area_sf(F.col("text")).alias("sf"))


@query("F26_material_kinds", "SELECT * FROM (VALUES ('Thin-set mortar', 'mortar'), ('GROUT bond', 'grout'), ('Contact glue trim', 'adhesive'), ('edge cap', 'trim'), ('Paint', '')) AS v(name, kind)")
def f26(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("Thin-set mortar", "GROUT bond", "Contact glue trim", "edge cap", "Paint")], "name string")
    return rows.select("name", t.material_kind(F.col("name")).alias("kind"))


@query("F32_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def f32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("S24_csv_cells", """SELECT p_partkey, CASE WHEN regexp_matches(v, '[",\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT p_partkey, CASE WHEN regexp_matches(s, '^[=+\\-@\\t]') THEN '''' || s ELSE s END AS v FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '-"' WHEN 2 THEN 'a,' WHEN 3 THEN '@' ELSE '' END || p_name AS s FROM part))""")
def s24(spark, sf):
    k = F.col("p_partkey") % 5
    text = F.concat(F.when(k == 0, "=").when(k == 1, '-"').when(k == 2, "a,").when(k == 3, "@").otherwise(""), "p_name")
    return table(spark, sf, "part").select("p_partkey", csv_cell(text).alias("cell"))


@query("O06_natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def o06(spark, sf):
    """Level names ordered by their numbers' values: 'L2' before 'L10'."""
    from plumbline.plans.ranking import numbered

    named = table(spark, sf, "part").select("p_partkey", natural_key(F.concat(F.lit("L"), F.col("p_size").cast("string"))).alias("level"))
    return numbered(named, "place", "level", "p_partkey").select("p_partkey", "place")


# Rings: an L of six points for each part, a triangle for each third.
_RING_SQL = "CASE WHEN p_partkey % 3 = 0 THEN [[x, y], [x + w, y], [x, y + h]] ELSE [[x, y], [x + w, y], [x + w, y + h], [x + 1, y + h], [x + 1, y + 2 * h], [x, y + 2 * h]] END"
_RINGS = f"WITH b AS (SELECT p_partkey, p_size, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(2 + p_size % 7 AS DOUBLE) AS w, CAST(1 + p_partkey % 5 AS DOUBLE) AS h FROM part), r AS (SELECT *, {_RING_SQL} AS ring FROM b)"


def rings(spark, sf):
    d = lambda c: c.cast("double")
    x, y, w, h = d(F.col("p_partkey") % 50), d(F.col("p_size")), d(2 + F.col("p_size") % 7), d(1 + F.col("p_partkey") % 5)
    pts = lambda *p: F.array(*[F.array(a, b) for a, b in p])
    ring = F.when(F.col("p_partkey") % 3 == 0, pts((x, y), (x + w, y), (x, y + h))).otherwise(pts((x, y), (x + w, y), (x + w, y + h), (x + 1, y + h), (x + 1, y + 2 * h), (x, y + 2 * h)))
    return table(spark, sf, "part").select("p_partkey", "p_size", ring.alias("ring"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("G01_ring_area_perimeter", _RINGS + """SELECT p_partkey, abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i][1] * ring[i % len(ring) + 1][2] - ring[i % len(ring) + 1][1] * ring[i][2]))) / 2 AS area,
list_sum(list_transform(range(1, len(ring) + 1), lambda i: sqrt((ring[i % len(ring) + 1][1] - ring[i][1]) * (ring[i % len(ring) + 1][1] - ring[i][1]) + (ring[i % len(ring) + 1][2] - ring[i][2]) * (ring[i % len(ring) + 1][2] - ring[i][2])))) AS perimeter FROM r""")
def g01(spark, sf):
    return rings(spark, sf).select("p_partkey", g.ring_area(F.col("ring")).alias("area"), g.ring_perimeter(F.col("ring")).alias("perimeter"))


@query("G02_open_length", _RINGS + "SELECT p_partkey, list_sum(list_transform(range(1, len(ring)), lambda i: sqrt((ring[i + 1][1] - ring[i][1]) * (ring[i + 1][1] - ring[i][1]) + (ring[i + 1][2] - ring[i][2]) * (ring[i + 1][2] - ring[i][2])))) AS length FROM r")
def g02(spark, sf):
    return rings(spark, sf).select("p_partkey", g.open_length(F.col("ring")).alias("length"))


@query("G03_holed_area", _RINGS + "SELECT p_partkey, greatest(0.0::DOUBLE, CASE WHEN p_partkey % 3 = 0 THEN w * h / 2 ELSE w * h + h END - 0.25 * p_size) AS area FROM r")
def g03(spark, sf):
    hole = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.0)), F.array(F.lit(0.5), F.col("p_size") * 0.5), F.array(F.lit(0.0), F.col("p_size") * 0.5))
    return rings(spark, sf).select("p_partkey", g.holed_area(F.col("ring"), F.array(hole)).alias("area"))


@query("G04_point_in_polygon", _RINGS + ", q AS (SELECT *, x + 0.75 AS px, y + h * 0.75 AS py FROM r) SELECT p_partkey, len(list_filter(range(1, len(ring) + 1), lambda i: (ring[i][2] > py) <> (ring[i % len(ring) + 1][2] > py) AND px < (ring[i % len(ring) + 1][1] - ring[i][1]) * (py - ring[i][2]) / (ring[i % len(ring) + 1][2] - ring[i][2]) + ring[i][1])) % 2 = 1 AS inside FROM q")
def g04(spark, sf):
    return rings(spark, sf).select("p_partkey", g.contains(F.col("ring"), F.col("x") + 0.75, F.col("y") + F.col("h") * 0.75).alias("inside"))


@query("G07_self_crossing", "SELECT p_partkey, p_size % 2 = 0 AS crossing FROM part")
def g07(spark, sf):
    """Squares, and bow ties for even sizes."""
    p = lambda a, b: F.array(F.lit(float(a)), F.lit(float(b)))
    ring = F.when(F.col("p_size") % 2 == 0, F.array(p(0, 0), p(2, 2), p(2, 0), p(0, 2))).otherwise(F.array(p(0, 0), p(2, 0), p(2, 2), p(0, 2)))
    return table(spark, sf, "part").select("p_partkey", g.self_crossing(ring).alias("crossing"))


@query("G09_centroids", _RINGS + "SELECT p_partkey, list_sum(list_transform(ring, lambda p: p[1])) / len(ring) AS cx, list_sum(list_transform(ring, lambda p: p[2])) / len(ring) AS cy FROM r")
def g09(spark, sf):
    cx, cy = g.centroid(F.col("ring"))
    return rings(spark, sf).select("p_partkey", cx.alias("cx"), cy.alias("cy"))


@query("G17_shape_metrics_roles", _RINGS + """, m AS (SELECT p_partkey, p_partkey % 4 AS role, CASE WHEN p_partkey % 3 = 0 THEN w * h / 2 ELSE w * h + h END AS area, list_sum(list_transform(range(1, len(ring)), lambda i: sqrt((ring[i + 1][1] - ring[i][1]) ** 2 + (ring[i + 1][2] - ring[i][2]) ** 2))) AS line, sqrt((ring[len(ring)][1] - ring[1][1]) ** 2 + (ring[len(ring)][2] - ring[1][2]) ** 2) AS last FROM r)
SELECT p_partkey, CASE role WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN area * 4 WHEN 2 THEN (line * 2 + 3) * 4 / 12 ELSE line * 2 * 9 END AS area_sf, CASE role WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN (line + last) * 2 WHEN 2 THEN line * 2 + 3 ELSE line * 2 END AS perimeter_lf, CASE WHEN role = 0 THEN 1.0::DOUBLE END AS count FROM m""")
def g17_roles(spark, sf):
    """All parts, in four roles: counts, areas, runs four inches thick with three feet of drops, and surfaces nine feet high."""
    k = F.col("p_partkey") % 4
    role = F.when(k == 0, "count").when(k == 1, "floor_area").when(k == 2, "linear").otherwise("surface_area")
    m = g.shape_metrics(role, F.col("ring"), F.lit(None).cast("array<array<array<double>>>"), F.lit(2.0), F.lit(9.0), F.lit(4.0), F.lit(3.0))
    return rings(spark, sf).select("p_partkey", m["area_sf"].alias("area_sf"), m["perimeter_lf"].alias("perimeter_lf"), m["count"].alias("count"))


@query("G18_vertical_legs", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0::DOUBLE, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 25 ELSE l_discount END) + greatest(0.0::DOUBLE, l_tax) AS legs FROM lineitem")
def g18(spark, sf):
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") - 25)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", g.legs(own, F.lit(None).cast("double"), F.col("l_discount"), F.col("l_tax")).alias("legs"))


# Rectangles: forty orders to a sheet.
_RECTS = "WITH r AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, o_orderkey AS id, o_custkey % 5 AS condition_id, CAST(o_custkey % 97 AS DOUBLE) AS x0, CAST(o_orderkey * 7 % 89 AS DOUBLE) AS y0, CAST(o_custkey % 97 + 1 + o_custkey % 23 AS DOUBLE) AS x1, CAST(o_orderkey * 7 % 89 + 1 + o_orderkey % 19 AS DOUBLE) AS y1 FROM orders)"


def rects(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    return table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("id"), (c % 5).alias("condition_id"), d(c % 97).alias("x0"), d(k * 7 % 89).alias("y0"), d(c % 97 + 1 + c % 23).alias("x1"), d(k * 7 % 89 + 1 + k % 19).alias("y1"))


_OVER = _RECTS + """, p AS (SELECT a.sheet_id, a.id AS a_id, b.id AS b_id, a.condition_id AS a_condition_id, b.condition_id AS b_condition_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab
FROM r a JOIN r b ON a.sheet_id = b.sheet_id AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
c AS (SELECT sheet_id, a_id, b_id, floor(s * 100 + 0.5) / 100 AS shared_sf, floor(s / least(aa, ab) * 100 * 100 + 0.5) / 100 / 100 AS fraction_of_smaller, floor(s / greatest(1e-9::DOUBLE, aa + ab - s) * 100 * 100 + 0.5) / 100 / 100 AS iou, a_condition_id = b_condition_id AS same_condition, a_condition_id, b_condition_id FROM p WHERE s / least(aa, ab) >= 0.05)
"""


@query("J09_floor_collisions", _OVER + "SELECT * FROM c")
def j09(spark, sf):
    return scope.rectangle_collisions(rects(spark, sf))


@query("A15_collisions_by_condition", _OVER + "SELECT condition_id, count(*) AS n FROM (SELECT a_condition_id AS condition_id FROM c UNION ALL SELECT b_condition_id FROM c WHERE NOT same_condition) GROUP BY 1")
def a15(spark, sf):
    return scope.collisions_by_condition(scope.rectangle_collisions(rects(spark, sf)))


@query("A16_shared_floor", _RECTS + """, xs AS (SELECT sheet_id, x, lead(x) OVER (PARTITION BY sheet_id ORDER BY x) AS nx FROM (SELECT sheet_id, x0 AS x FROM r UNION SELECT sheet_id, x1 FROM r)), ys AS (SELECT sheet_id, y, lead(y) OVER (PARTITION BY sheet_id ORDER BY y) AS ny FROM (SELECT sheet_id, y0 AS y FROM r UNION SELECT sheet_id, y1 FROM r)),
u AS (SELECT xs.sheet_id, sum((nx - x) * (ny - y)) AS area FROM xs JOIN ys ON xs.sheet_id = ys.sheet_id WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.sheet_id = xs.sheet_id AND r.x0 <= x AND r.x1 >= nx AND r.y0 <= y AND r.y1 >= ny) GROUP BY 1)
SELECT r.sheet_id, CASE WHEN count(*) > 1 THEN greatest(0.0::DOUBLE, sum((x1 - x0) * (y1 - y0)) - max(u.area)) ELSE 0.0 END AS shared_floor_sf FROM r JOIN u ON u.sheet_id = r.sheet_id GROUP BY 1""")
def a16(spark, sf):
    return scope.shared_floor(rects(spark, sf))


@query("J02_unmeasured_shapes", "SELECT o_orderkey AS id, CASE WHEN s.k IS NULL THEN 'sheet not loaded' WHEN s.u <= 0 THEN 'sheet has no scale' END AS reason, CASE WHEN s.u > 0 THEN 'measured' ELSE 'unmeasured' END AS status FROM orders LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS u FROM customer WHERE c_custkey % 10 <> 0) s ON s.k = o_custkey")
def j02(spark, sf):
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sheet_id"))
    sheets = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("sheet_id"), F.col("c_acctbal").alias("units_per_px"))
    return scope.framed(shapes, sheets).select("id", "reason", "status")


@query("J11_points_in_floors", _RECTS + ", q AS (SELECT sheet_id, id, x0 + 0.5 AS px, y0 + 0.5 AS py FROM r) SELECT q.id FROM q WHERE EXISTS (SELECT 1 FROM r f WHERE f.sheet_id = q.sheet_id AND f.condition_id = 1 AND f.x0 < px AND px < f.x1 AND f.y0 < py AND py < f.y1) AND NOT EXISTS (SELECT 1 FROM r d WHERE d.sheet_id = q.sheet_id AND d.condition_id = 2 AND d.x0 < px AND px < d.x1 AND d.y0 < py AND py < d.y1)")
def j11(spark, sf):
    """Points in some floor and in no deduct."""
    r = rects(spark, sf)
    ring = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    points = r.select("sheet_id", "id", (F.col("x0") + 0.5).alias("px"), (F.col("y0") + 0.5).alias("py"))
    of = lambda c, s: r.where(f"condition_id = {c}").select(F.col("sheet_id").alias(f"{s}_sheet"), ring.alias(s), *[F.col(k).alias(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")])
    inside = lambda s: (F.col("sheet_id") == F.col(f"{s}_sheet")) & F.col("px").between(F.col(f"{s}_x0"), F.col(f"{s}_x1")) & F.col("py").between(F.col(f"{s}_y0"), F.col(f"{s}_y1")) & g.contains(F.col(s), F.col("px"), F.col("py"))
    return points.join(of(1, "floor"), inside("floor"), "left_semi").join(of(2, "deduct"), inside("deduct"), "left_anti").select("id")


@query("P04_segments_in_region", "SELECT o_orderkey AS idx FROM orders WHERE CAST(o_custkey % 97 AS DOUBLE) <= 60 AND CAST(o_custkey % 97 + 5 AS DOUBLE) >= 40 AND CAST(o_orderkey % 89 AS DOUBLE) BETWEEN 20 AND 70")
def p04(spark, sf):
    """Horizontal strokes that meet a region without an endpoint in it, too."""
    x, y = (F.col("o_custkey") % 97).cast("double"), (F.col("o_orderkey") % 89).cast("double")
    return table(spark, sf, "orders").where(g.segment_meets_box(x, y, x + 5, y, 40.0, 20.0, 60.0, 70.0)).select(F.col("o_orderkey").alias("idx"))
