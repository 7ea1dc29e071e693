"""Text rules of drawings over texts made from the parts' columns; the rules' special cases are in the queries over fixed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.functions import numeric as n
from plumbline.functions import text as t
from plumbline.operators import drawing, more
from plumbline.operators.roles import room_seed, sheet_roles

def part(spark, sf):
    return table(spark, sf, "part")


def columns():
    return F.col("p_partkey"), F.col("p_size")


def pick(by, *texts):
    """The text at by, modulo how many there are."""
    return F.element_at(F.array(*[x if hasattr(x, "cast") else F.lit(x) for x in texts]), (by % len(texts) + 1).cast("int"))


def joined(*pieces):
    return F.concat(*[(x if hasattr(x, "cast") else F.lit(x)).cast("string") for x in pieces])


@query("F04_typed_lengths_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + (p_partkey % 12) / 12.0::DOUBLE WHEN 1 THEN p_size / 12.0::DOUBLE ELSE p_size + 0.5 END::DOUBLE AS feet FROM part")
def f04(spark, sf):
    key, size = columns()
    typed = pick(key, joined(size, "'-", key % 12, '"'), joined(size, '"'), joined(" ", size, " ft 6 in"))
    return part(spark, sf).select("p_partkey", n.parse_length(typed).alias("feet"))


@query("F12_joined_runs_parts", "SELECT p_partkey AS sheet_id, 'S' || CAST(p_size AS VARCHAR) || '-101' AS text, 0.0::DOUBLE AS x0, 30.0::DOUBLE AS x1 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'S' || CAST(p_size AS VARCHAR), 0.0, 10.0 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, '-101', 25.0, 30.0 FROM part WHERE p_partkey % 2 = 1")
def f12(spark, sf):
    """Marks in two runs that touch, or stand apart."""
    key, size = columns()
    one = lambda i, text, x0, x1: F.struct(F.lit(i).alias("ord"), text.alias("str"), x0.alias("x0"), F.lit(x1).alias("x1"))
    runs = F.array(one(0, joined("S", size), F.lit(0.0), 10.0), one(1, F.lit("-101"), F.when(key % 2 == 0, 10.5).otherwise(25.0), 30.0))
    spans = part(spark, sf).select(key.alias("sheet_id"), F.explode(runs).alias("r")).select("sheet_id", F.lit(1).alias("line"), "r.*", F.lit(8.0).alias("h"))
    return more.joined_runs(spans).select("sheet_id", "text", "x0", "x1")


@query("F17_scale_notes_parts", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1:50' WHEN 1 THEN '1:100' WHEN 2 THEN '1/8\" = 1''-0\"' END AS label FROM part WHERE p_size % 4 < 3")
def f17(spark, sf):
    """Notes with a scale among other words."""
    key, size = columns()
    notes = part(spark, sf).select("p_partkey", t.canonical_scale_text(joined(pick(size, "SCALE 1:50", "SCALE 1:100", 'SCALE: 1/8" = 1\'-0"', "NOT TO SCALE"), " REV ", pick(key, "A", "B"))).alias("canon"))
    scales = F.broadcast(spark.createDataFrame(t.scale_patterns(), "place int, label string, upp double, pattern string"))
    return notes.join(scales, F.expr("canon RLIKE pattern")).select("p_partkey", "label")


@query("F19_dimension_texts_parts", "SELECT p_partkey, p_size % 2 = 0 AS is_dimension FROM part")
def f19(spark, sf):
    key, size = columns()
    return part(spark, sf).select("p_partkey", t.dimension_text(F.when(size % 2 == 0, joined(size, "'-", key % 12, '"')).otherwise(joined("ROOM ", key))).alias("is_dimension"))


@query("F20_printed_areas_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 37.0 WHEN 1 THEN p_size * 10.763910416709722 END::DOUBLE AS sf FROM part")
def f20(spark, sf):
    """Square feet with thousands marks, square metres, and gross areas that don't count."""
    key, size = columns()
    text = pick(key, joined(F.format_number(size * 37, 0), " SF"), joined(size, " m2"), joined(size, " GSF"))
    return part(spark, sf).select("p_partkey", t.printed_area_sf(text).alias("sf"))


@query("F21_room_labels_parts", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(100 + p_partkey % 900 AS VARCHAR) ELSE '' END AS number FROM part")
def f21(spark, sf):
    key, size = columns()
    return part(spark, sf).select("p_partkey", F.coalesce(room_seed(F.when(size % 2 == 0, joined("OFFICE ", 100 + key % 900)).otherwise(joined(key, " SF"))), F.lit("")).alias("number"))


@query("F22_layer_roles_parts", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'boundary' ELSE 'unknown' END AS role, CASE p_partkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.9 WHEN 2 THEN 0.0 ELSE 0.2 END::DOUBLE AS confidence FROM part")
def f22(spark, sf):
    """Layers of referenced drawings, walls, and names that say nothing."""
    key, _ = columns()
    name = pick(key, joined("x", key, "|S-COLS"), "A-WALL-FULL", joined("Layer ", key), joined("M$", key, "$DUCT"))
    return part(spark, sf).withColumn("r", drawing.layer_role(name)).select("p_partkey", "r.role", "r.confidence")


@query("F26_material_kinds_parts", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'mortar' WHEN 1 THEN 'grout' WHEN 2 THEN 'adhesive' ELSE '' END AS kind FROM part")
def f26(spark, sf):
    key, size = columns()
    return part(spark, sf).select("p_partkey", t.material_kind(joined(pick(size, "Thin-set mortar", "GROUT", "Contact glue", "Paint"), " ", key)).alias("kind"))


@query("F30_opening_sizes_parts", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN (8 + p_partkey % 7) / 10.0 END::DOUBLE AS width_m, CASE WHEN p_size % 3 < 2 THEN 2.1 END::DOUBLE AS height_m FROM part")
def f30(spark, sf):
    """Sizes in decimetres, millimetres, and none."""
    key, size = columns()
    s = more.opening_size(pick(size, joined(8 + key % 7, "x21"), joined((8 + key % 7) * 100, " x 2100"), "door"))
    return part(spark, sf).select("p_partkey", F.round(s["width_m"], 6).alias("width_m"), F.round(s["height_m"], 6).alias("height_m"))


@query("X03_building_mentions_parts", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN substr('ABCDE', p_partkey % 5 + 1, 1) WHEN 1 THEN CAST(1 + p_partkey % 90 AS VARCHAR) || ',B2' ELSE '' END AS found FROM part")
def x03(spark, sf):
    key, size = columns()
    letter = F.substring(F.lit("ABCDE"), (key % 5 + 1).cast("int"), F.lit(1))
    text = pick(size, joined("BUILDING ", letter, " FLOOR PLAN"), joined("bldg. ", 1 + key % 90, " and Building B2"), joined("BUILDING OFFICE ", key))
    return part(spark, sf).select("p_partkey", F.array_join(drawing.building_mentions(text), ",").alias("found"))


@query("X07_room_keys_parts", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(100 + p_partkey % 800 AS VARCHAR) WHEN 1 THEN CAST(100 + p_partkey % 800 AS VARCHAR) || 'B' WHEN 2 THEN 'A-' || CAST(100 + p_partkey % 800 AS VARCHAR) ELSE '' END AS key, CASE WHEN p_size % 4 = 2 THEN 'A' ELSE '' END AS building FROM part")
def x07(spark, sf):
    """Plain numbers, with a letter, of a building, and finish marks."""
    key, size = columns()
    number = 100 + key % 800
    k = drawing.room_key(pick(size, number.cast("string"), joined(number, " B"), joined("A-", number), joined("PT-", key % 9 + 1)), ["A", "B"])
    return part(spark, sf).withColumn("k", k).select("p_partkey", F.coalesce("k.key", F.lit("")).alias("key"), F.coalesce("k.building", F.lit("")).alias("building"))


@query("X01_sheet_roles_parts", "SELECT p_partkey AS sheet_id, CASE p_size % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'schedule' WHEN 2 THEN 'demolition' ELSE 'unknown' END AS role, CASE p_size % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM part")
def x01(spark, sf):
    """Titles in the corner of each sheet."""
    key, size = columns()
    sheets = part(spark, sf).select(key.alias("sheet_id"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    title = pick(size, "FIRST FLOOR PLAN", "ROOM FINISH SCHEDULE", "DEMOLITION PLAN", "hello")
    one = lambda i, text, x, y, h: F.struct(F.lit(i).alias("ord"), (text if hasattr(text, "cast") else F.lit(text)).alias("str"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(h).alias("h"))
    spans = part(spark, sf).select(key.alias("sheet_id"), F.explode(F.array(one(0, title, 930.0, 760.0, 20.0), one(1, "note", 10.0, 10.0, 10.0), one(2, joined("Rev ", key), 20.0, 30.0, 10.0))).alias("s")).select("sheet_id", "s.*")
    return sheet_roles(spans, sheets).select("sheet_id", "role", F.round("confidence", 6).alias("confidence"))


_TITLES = [("PLANTEGNING", "plan", 0.85), ("DØRSKJEMA", "schedule", 0.85), ("RIVEPLAN", "demolition", 0.9), ("FASADE NORD", "elevation", 0.7), ("SNITT A-A", "detail", 0.6), ("GRUNDRISS", "plan", 0.85), ("SJEKKLISTE", "unknown", 0.0), ("2. ETASJE", "plan", 0.7)]


@query("X01_european_titles", "SELECT p_partkey AS sheet_id, " + ", ".join(f"CASE p_size % 8 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END{cast} AS {name}" for name, cast, values in (("role", "", [f"'{r}'" for _, r, _ in _TITLES]), ("confidence", "::DOUBLE", [c for *_, c in _TITLES]))) + " FROM part")
def x01_european(spark, sf):
    """Norwegian and German titles in the corner of each sheet; the name of a storey is a title only because the sheet has Nordic text."""
    key, size = columns()
    sheets = part(spark, sf).select(key.alias("sheet_id"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    title = F.element_at(F.array(*[F.lit(t) for t, _, _ in _TITLES]), (size % 8 + 1).cast("int"))
    one = lambda i, text, x, y, h: F.struct(F.lit(i).alias("ord"), text.alias("str"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(h).alias("h"))
    spans = part(spark, sf).select(key.alias("sheet_id"), F.explode(F.array(one(0, title, 930.0, 760.0, 20.0), one(1, F.lit("Målestokk"), 10.0, 10.0, 10.0), one(2, joined("Nr ", key), 20.0, 30.0, 10.0))).alias("s")).select("sheet_id", "s.*")
    return sheet_roles(spans, sheets).select("sheet_id", "role", F.round("confidence", 6).alias("confidence"))


@query("J19_resolved_rooms_parts", "SELECT p_partkey AS tag, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'ambiguous: several rows' WHEN 2 THEN 'no schedule row' ELSE 'row carries no finishes' END AS reason, CASE WHEN p_size % 4 = 0 THEN 'FLOOR=' || p_brand || '=' || p_type ELSE '' END AS finishes FROM part")
def j19(spark, sf):
    """Rooms with a row, two rows, none, or a row without finishes; codes have a type for their definition."""
    key, _ = columns()
    parts = part(spark, sf)
    number = key.cast("string")
    asked = parts.select(number.alias("tag"), F.lit(None).cast("string").alias("building"), number.alias("number"))
    row = lambda where, times, surface: parts.where(where).select((key * 2 + times).alias("row_id"), number.alias("number"), F.lit(None).cast("string").alias("building"), F.lit(surface).alias("surface"), joined(F.col("p_brand"), "/", key).alias("code"))
    rows = row("p_size % 4 < 2", 0, "FLOOR").unionByName(row("p_size % 4 = 1", 1, "FLOOR")).unionByName(row("p_size % 4 = 3", 0, "NOTES"))
    finishes = parts.select(joined(F.col("p_brand"), "/", key).alias("code"), F.col("p_type").alias("definition"))
    found = drawing.resolve_rooms(asked, rows, finishes)
    return found.select(F.col("tag").cast("long").alias("tag"), F.coalesce("reason", F.lit("")).alias("reason"), F.regexp_replace("finishes", "/[0-9]+", "").alias("finishes"))
