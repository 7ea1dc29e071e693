"""What drawings say: layers, schedules, marks, tags, rooms, and how far a trace can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import contains
from plumbline.functions.keys import mark_key
from plumbline.functions.numeric import round2_fixed, round2_plain
from plumbline.functions.text import layer_tokens
from plumbline.operators.grid import meeting
from plumbline.operators.records import NEAR, mark_pairs

# Words of layer names by role, in order of precedence, and leading discipline letters.
DEMOLITION = ["DEMO", "DEMOL", "DEMOLITION", "REMV", "REMOVE"]
PATTERN = ["PATT", "PATTERN", "PATTERNS", "HATCH", "HATCHING", "POCHE"]
ANNOTATION = ["ANNO", "TEXT", "DIM", "DIMS", "NOTE", "NOTES", "SYMB", "SYMBOL", "IDEN", "TAG", "TAGS", "TTLB", "TITLEBLOCK", "LEGN", "LEGEND", "SHBD", "NPLT", "PLOT", "GRID", "GRIDS", "LEVL", "REVS", "REV"]
FIXTURES = ["FURN", "FURNITURE", "EQPM", "EQUIP", "EQUIPMENT", "CASE", "CASW", "CASEWORK", "MILL", "MILLWORK", "PLMB", "PFIX", "APPL", "SPCL", "SEAT", "SEATING"]
STRUCTURE = ["COLS", "COL", "COLUMN", "COLUMNS", "BEAM", "BEAMS", "BRACE", "FNDN", "FOUNDATION", "JOIS", "JOIST", "SLAB"]
BOUNDARY = ["WALL", "WALLS", "PRHT", "FULL", "PART", "PARTN", "PARTITION", "PARTITIONS", "GLAZ", "GLAZING", "STOR", "STOREFRONT", "CWMG", "OTLN", "OUTLINE", "OUTLINES", "RM", "ROOM", "ROOMS", "AREA", "AREAS", "DOOR", "DOORS", "DR", "WNDW", "WIND", "WINDOW", "WINDOWS"]
DISCIPLINES = ["A", "S", "M", "E", "P", "F", "C", "L", "T", "I", "Q", "G", "H", "V", "W", "X", "Z"]
SURFACES = ["FLOOR", "BASE", "WALL", "WALLS", "NORTH", "SOUTH", "EAST", "WEST", "CEILING", "WAINSCOT"]
CATEGORY_HATCH = {"floor": "solid", "base": "horiz", "wall": "grid", "transition": "vert", "ceiling": "solid", "other": "solid"}
CATEGORY_WASTE = {"floor": 5, "base": 10, "wall": 10, "transition": 0, "ceiling": 0, "other": 0}


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def layer_role(name: Column) -> Column:
    """(role, confidence) of a layer by its name; demolition and patterns come before what they are drawn on.

    A name that doesn't lead with a discipline letter is trusted 0.2 less, but not below 0.5. Numbered building-part
    codes name a role where no word does; unnamed and default layers say nothing.
    """
    plain = F.trim(F.coalesce(name, F.lit("")))
    tokens = layer_tokens(name)
    first = F.try_element_at(tokens, F.lit(1))
    conforming = F.coalesce(first.isin(DISCIPLINES), F.lit(False)) & (F.size(tokens) > 1)
    graded = lambda base: F.when(conforming, F.lit(base)).otherwise(F.lit(max(0.5, round(base - 0.2, 10))))
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.cast("double").alias("confidence"))
    has = lambda words: F.arrays_overlap(tokens, _words(words))
    code = F.regexp_extract(plain, r"^([2-8][0-9]{1,3})[\s_-]+[^\s_-]", 1)
    two, three = F.substring(code, 1, 2), F.substring(code, 1, 3)
    part = F.when(three.isin("235", "246"), "finish-pattern").when(two.isin("23", "24", "28", "86"), "boundary").when(two == "22", "structure").when(two == "25", "finish-pattern").otherwise("annotation")
    return (
        F.when((plain == "") | (plain == "0") | plain.rlike(r"(?i)^layer\s*[0-9]*$") | (F.size(tokens) == 0), role("unknown", F.lit(0.0)))
        .when(has(DEMOLITION), role("demolition", graded(0.95)))
        .when(has(PATTERN), role("finish-pattern", graded(0.9)))
        .when(has(ANNOTATION), role("annotation", graded(0.85)))
        .when((first == "S") & (F.size(tokens) > 1), role("structure", F.lit(0.85)))
        .when(has(STRUCTURE), role("structure", graded(0.8)))
        .when(has(BOUNDARY), role("boundary", graded(0.9)))
        .when(has(FIXTURES), role("annotation", graded(0.65)))
        .when(code != "", F.struct(part.alias("role"), F.lit(0.9).alias("confidence")))
        .otherwise(role("unknown", F.lit(0.2)))
    )


def text_status(spans: Column, words: Column) -> Column:
    """Where a sheet's text is: in its text layer, drawn as linework, both, or nowhere."""
    return F.when(spans > 0, F.when(words > 0, "partial").otherwise("text_layer")).otherwise(F.when(words > 0, "outlined").otherwise("none"))


def base_tag(tag: Column) -> Column:
    """What a variant's tag has before its label."""
    return F.trim(F.substring_index(F.coalesce(tag, F.lit("")), " – ", 1))


def variant_tag(tag: Column, label: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text == "", base_tag(tag)).otherwise(F.concat(base_tag(tag), F.lit(" – "), text))


def building_mentions(text: Column) -> Column:
    """Designators that a short text names as buildings."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b(?:BUILDING|BLDG\.?)\s+([A-Z][0-9]?|[0-9]{1,2})\b"), F.lit(1))
    return F.when(F.length(text) <= 80, found).otherwise(F.array().cast("array<string>"))


def room_key(text: Column, buildings: list[str]) -> Column:
    """(key, building) of a room schedule's first cell; null if it isn't a key. Qualified keys need a building that the set names."""
    key = F.regexp_replace(F.upper(text), "[^A-Z0-9-]", "")
    qualified = r"^([A-Z]{1,2})-([0-9]{1,3}[A-Z]{0,2})$"
    none = F.lit(None).cast("string")
    return F.when(key.rlike(r"^[0-9]{1,3}[A-Z]{0,2}$") | key.rlike(r"^[A-Z]{1,3}(?:[0-9]{1,3}-[0-9]{1,3}|[0-9]{3})[A-Z]?$"), F.struct(key.alias("key"), none.alias("building"))).when(
        key.rlike(qualified) & F.regexp_extract(key, qualified, 1).isin(buildings), F.struct(key.alias("key"), F.regexp_extract(key, qualified, 1).alias("building"))
    )


def answers_for(key: Column, mark: Column) -> Column:
    """Whether a row's key answers for a mark: equal, or one of the parts of a compound key."""
    return (mark_key(key) == mark_key(mark)) | F.array_contains(F.split(mark_key(key), "/"), mark_key(mark))


def resolve_rooms(asked: DataFrame, rows: DataFrame, finishes: DataFrame) -> DataFrame:
    """Finishes of each asked room number, in surface order, or why there is no answer.

    asked: (tag, building or null, number); rows: (number, building or null, surface, code) of room-finish schedules, one
    row_id for each schedule row; finishes: (code, definition). One row with a status for each tag: resolved, or
    unresolved with its reason; several schedule rows for one room are never chosen between.
    """
    keyed = rows.groupBy("row_id", "number", "building").agg(F.collect_list(F.struct("surface", "code")).alias("cells"))
    met = asked.join(keyed.select("row_id", F.col("number").alias("row_number"), F.col("building").alias("row_building"), "cells"), F.col("number") == F.col("row_number"), "left")
    fits = F.col("row_id").isNotNull() & (F.col("building").isNull() | F.col("building").eqNullSafe(F.col("row_building")))
    counted = met.groupBy("tag").agg(
        F.count("row_id").alias("candidates"), F.count_if(fits).alias("n"), F.count_distinct(F.when(fits, F.col("row_building"))).alias("buildings"), F.first("building", True).alias("wanted"), F.min(F.when(fits, F.col("row_id"))).alias("row")
    )
    reason = (
        F.when((F.col("n") == 0) & (F.col("candidates") == 0), "no schedule row")
        .when(F.col("n") == 0, "listed under other buildings")
        .when((F.col("n") > 1) & (F.col("buildings") > 1), "ambiguous: several buildings")
        .when(F.col("n") > 1, "ambiguous: several rows")
    )
    judged = counted.select("tag", reason.alias("reason"), F.when(reason.isNull(), F.col("row")).alias("chosen"))
    cells = rows.select(F.col("row_id").alias("cell_row"), "surface", "code")
    detail = judged.join(cells, F.col("chosen") == F.col("cell_row"), "left").join(finishes.select(F.col("code").alias("def_code"), "definition"), F.col("code") == F.col("def_code"), "left")
    rank = F.array_position(_words(SURFACES), F.element_at(F.split("surface", " "), 1))
    listed = detail.groupBy("tag", "reason").agg(F.array_sort(F.collect_list(F.when(rank > 0, F.struct(rank.alias("rank"), "surface", F.concat_ws("=", "surface", "code", "definition").alias("text"))))).alias("found"))
    empty = F.size("found") == 0
    return listed.select("tag", F.when(F.col("reason").isNull() & ~empty, "resolved").otherwise("unresolved").alias("status"), F.coalesce("reason", F.when(empty, "row carries no finishes")).alias("reason"), F.array_join(F.transform("found", lambda f: f["text"]), ";").alias("finishes"))


def census(spans: DataFrame, marks: DataFrame, regions: DataFrame, values: DataFrame) -> DataFrame:
    """Every drawn occurrence of a mark, with what became of it: in_table, ambiguous, counted or withheld, and the reason why it isn't counted.

    spans, values: (sheet_id, ord, str, x0, y0, x1, y1); marks: (mark, status); regions: schedule areas (sheet_id, x0, y0, x1, y1).
    """
    drawn = spans.withColumn("m", mark_key(F.col("str"))).join(marks.select(F.col("mark"), F.col("status").alias("mark_status")), F.col("m") == F.col("mark"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centres = drawn.select("sheet_id", "ord", cx.alias("x0"), cy.alias("y0"), cx.alias("x1"), cy.alias("y1"))
    held = meeting(centres, regions.select("sheet_id", "x0", "y0", "x1", "y1")).select(F.col("a.sheet_id").alias("t_sheet"), F.col("a.ord").alias("t_ord")).distinct()
    paired = mark_pairs(drawn.select("sheet_id", "ord", "x0", "y0", "x1", "y1"), values).select(F.col("sheet_id").alias("p_sheet"), F.col("ord").alias("p_ord"), "value")
    all_ = drawn.join(held, (F.col("sheet_id") == F.col("t_sheet")) & (F.col("ord") == F.col("t_ord")), "left").join(paired, (F.col("sheet_id") == F.col("p_sheet")) & (F.col("ord") == F.col("p_ord")), "left")
    outcome = F.when(F.col("t_ord").isNotNull(), "in_table").when(F.col("mark_status") == "ambiguous", "ambiguous").when(F.col("value").isNotNull(), "counted").otherwise("withheld")
    why = F.when(outcome == "in_table", "part of a schedule").when(outcome == "ambiguous", "several tables define it").when(outcome == "withheld", "no value beneath it")
    return all_.select("sheet_id", "ord", "mark", outcome.alias("outcome"), F.when(outcome == "counted", F.col("value")).alias("value"), why.alias("reason"))


#: Places that a census lists for each mark: counted ones, and withheld ones.
LISTED_COUNTED, LISTED_WITHHELD = 150, 60


def census_report(counted: DataFrame, most_counted: int = LISTED_COUNTED, most_withheld: int = LISTED_WITHHELD) -> DataFrame:
    """For each mark its whole counts, by sheet and in all, and the places that a report lists: so many counted and withheld ones
    at most, in order of sheet and span; elided says how many more there are. counted: census() rows."""
    w = Window.partitionBy("mark", "outcome").orderBy("sheet_id", "ord")
    cap = F.when(F.col("outcome") == "counted", most_counted).when(F.col("outcome") == "withheld", most_withheld).otherwise(0)
    placed = counted.withColumn("place", F.row_number().over(w)).withColumn("listed", F.col("place") <= cap)
    by_sheet = placed.groupBy("mark", "sheet_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("counted", "withheld", "ambiguous", "in_table")],
        *[F.array_sort(F.collect_list(F.when(F.col("listed") & (F.col("outcome") == o), F.col("ord")))).alias(f"{o}_at") for o in ("counted", "withheld")],
    )
    every = F.sum
    over = Window.partitionBy("mark")
    totals = {f"{o}_total": every(o).over(over) for o in ("counted", "withheld")}
    shown = by_sheet.withColumns(totals)
    return shown.withColumns({"counted_elided": F.greatest(F.lit(0), F.col("counted_total") - most_counted), "withheld_elided": F.greatest(F.lit(0), F.col("withheld_total") - most_withheld)})


def names_above(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Each room tag's name: the nearest upper-case text above it, from 0.2 heights below its head to 2.2 above, that overlaps it sideways."""
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    t = tags.select("sheet_id", "ord", F.col("y0").alias("head"), h.alias("h"), F.col("x0").alias("left"), F.col("x1").alias("right"), (F.col("x0") - h - NEAR).alias("x0"), (F.col("y0") - 2.2 * h - NEAR).alias("y0"), (F.col("x1") + h + NEAR).alias("x1"), (F.col("y0") + 0.2 * h + NEAR).alias("y1"))
    n = names.where("str = upper(str)").select("sheet_id", "ord", F.col("str").alias("name"), "x0", F.col("y1").alias("y0"), "x1", "y1")
    dy, height = F.col("a.head") - F.col("b.y1"), F.col("a.h")
    near = (dy >= -0.2 * height) & (dy <= 2.2 * height) & (F.col("b.x0") <= F.col("a.right") + height) & (F.col("b.x1") >= F.col("a.left") - height)
    met = meeting(t, n).where(near).select("a.sheet_id", "a.ord", F.struct(dy.alias("dy"), F.col("b.ord").alias("n_ord"), F.col("b.name").alias("name")).alias("found"))
    return met.groupBy("sheet_id", "ord").agg(F.min("found").alias("best")).select("sheet_id", "ord", F.col("best.name").alias("name"))


def weaker_tables(tables: DataFrame) -> DataFrame:
    """Tables of which half or more lies in a stronger one on the same sheet (rank: lower is stronger; ties to the lower id)."""
    a, b = F.col("a"), F.col("b")
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    smaller = F.least((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    stronger = (b["rank"] < a["rank"]) | ((b["rank"] == a["rank"]) & (b["id"] < a["id"]))
    return meeting(tables, tables).where(stronger & (wide * high >= 0.5 * smaller) & (smaller > 0)).select(a["id"].alias("id")).distinct()


def condition_seeds(rows: DataFrame) -> DataFrame:
    """Schedule rows (finish_tag, category) with the hatch and waste that their category starts with."""
    of = lambda table: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])[F.col("category")]
    return rows.withColumns({"hatch": of(CATEGORY_HATCH), "waste_pct": of(CATEGORY_WASTE).cast("long")})


# What each doubt about a traced room costs.
RASTER, COARSE, WEDGE, CURVE, SOLE_PASSAGE, PASSAGE, OVERSIZE = 0.90, 0.90, 0.97, 0.5, 0.85, 0.99, 0.35
HATCH_TIERS = {"bounded": 0.95, "trapped": 0.93, "override": 0.85}
SEAL_UNSAID, SEAL_MOST, WEDGE_FULL, PLAUSIBLE_SF, ABSURD_SF, LEAST_PX_PER_FOOT = 0.10, 0.25, 0.10, 5_000.0, 50_000.0, 8.0


def _between(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def trace_confidence(raster: Column, hatched: Column, hatch_tier: Column, sealed: Column, virtual_share: Column, passage_share: Column, wedged: Column, wedge_growth: Column, curve_share: Column, area_sf: Column, px_per_foot: Column) -> Column:
    """(score to two decimals, factors) of a traced room: each doubt is a factor below one, and named.

    A hatch-filtered trace without a tier, or with one that isn't known, counts as bounded. wedge_growth: area after a
    door's swing was annexed over the area before; without it a swing costs its whole share.
    """
    tier = F.coalesce(F.create_map(*[F.lit(x) for k, v in HATCH_TIERS.items() for x in (k, v)])[F.coalesce(hatch_tier, F.lit("bounded"))], F.lit(HATCH_TIERS["bounded"]))
    seal = 1 - F.coalesce(_between(virtual_share, 0.0, SEAL_MOST), F.lit(SEAL_UNSAID))
    passage = F.when(passage_share >= 1, SOLE_PASSAGE).otherwise(PASSAGE)
    annexed = F.when(wedge_growth > 1, (wedge_growth - 1) / F.when(wedge_growth > 1, wedge_growth).otherwise(F.lit(1.0)))
    wedge = 1 - (1 - WEDGE) * _between(F.coalesce(annexed / WEDGE_FULL, F.lit(1.0)), 0.0, 1.0)
    curve = 1 - CURVE * _between(curve_share, 0.0, 1.0)
    over = 1 - OVERSIZE * _between((area_sf - PLAUSIBLE_SF) / (ABSURD_SF - PLAUSIBLE_SF), 0.0, 1.0)
    doubts = [
        (raster, F.lit(RASTER), "raster-traced"), (hatched, tier, "hatch-filtered"), (sealed, seal, "sealed-opening"), (passage_share > 0, passage, "passage"), (wedged, wedge, "door-swing-crossed"),
        (curve_share > 0, curve, "curve-bounded"), (area_sf > PLAUSIBLE_SF, over, "oversize-for-one-room"), ((px_per_foot > 0) & (px_per_foot < LEAST_PX_PER_FOOT), F.lit(COARSE), "coarse-mask"),
    ]
    score = F.lit(1.0)
    for applies, factor, _ in doubts:
        score = score * F.when(F.coalesce(applies, F.lit(False)), factor).otherwise(F.lit(1.0))
    named = F.array_compact(F.array(*[F.when(F.coalesce(applies, F.lit(False)), F.lit(name)) for applies, _, name in doubts]))
    return F.struct(round2_fixed(score).alias("score"), named.alias("factors"))


def title_candidates(spans: DataFrame, most: int = 40) -> DataFrame:
    """The tallest spans of each sheet, which may be its title: a top-k by design."""
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("h"), "ord"))
    return spans.withColumn("place", place).where(F.col("place") <= most)


# How far a measured floor may lie from a printed area (share and square metres), stamps that make a sheet one that tags its rooms.
PRINT_SHARE, PRINT_M2, LEAST_STAMPS = 0.03, 0.05, 3


def agrees(measured_m2: Column, printed_m2: Column) -> Column:
    return F.abs(measured_m2 - printed_m2) <= PRINT_SHARE * printed_m2 + PRINT_M2


def printed_checks(floors: DataFrame, stamps: DataFrame, allow_sum: bool = False) -> DataFrame:
    """Each floor against the room areas printed inside its ring: (id, status, reason, printed_m2).

    floors: (sheet_id, id, ring, x0, y0, x1, y1, area_m2 or null without a scale); stamps: (sheet_id, ord, x, y, m2 or
    null for a printed total). verified: a stamp inside agrees. combined: only where sums are allowed, several stamps and
    no total lie inside, and their sum agrees. unverified: no scale, fewer than LEAST_STAMPS rooms' stamps on the sheet, or none
    inside. Else refused, and why: one stamp disagrees, or several of which none agrees. A stamp printed twice in one place
    counts once.
    """
    near = F.struct(F.floor(F.col("x") / 4), F.floor(F.col("y") / 4), "m2")
    distinct = stamps.groupBy("sheet_id", near.alias("place")).agg(F.min(F.struct("ord", "x", "y", "m2")).alias("s")).select("sheet_id", "s.*")
    on_sheet = stamps.groupBy(F.col("sheet_id").alias("stamped_sheet")).agg(F.count("m2").alias("stamps_on_sheet"))
    points = distinct.select("sheet_id", "m2", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    inside = meeting(floors.select("sheet_id", "id", "ring", "area_m2", "x0", "y0", "x1", "y1"), points).where(contains(F.col("a.ring"), F.col("b.x0"), F.col("b.y0")))
    fits = F.when(agrees(F.col("a.area_m2"), F.col("b.m2")), F.col("b.m2"))
    found = inside.groupBy(F.col("a.id").alias("found_id")).agg(F.count("b.m2").alias("n"), F.count_if(F.col("b.m2").isNull()).alias("totals"), F.sum(F.col("b.m2").cast("decimal(28,6)")).cast("double").alias("sum_m2"), F.min(fits).alias("match_m2"))
    rows = floors.join(found, F.col("id") == F.col("found_id"), "left").join(on_sheet, F.col("sheet_id") == F.col("stamped_sheet"), "left")
    n, summed = F.coalesce("n", F.lit(0)), agrees(F.col("area_m2"), F.col("sum_m2")) & (F.col("totals") == 0) & F.lit(allow_sum)
    combined = (n > 1) & F.coalesce(summed, F.lit(False))
    result = lambda s, r, m=None: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"), (F.lit(None) if m is None else m).cast("double").alias("printed_m2"))
    judged = (
        F.when(F.col("area_m2").isNull(), result("unverified", "no scale"))
        .when(F.coalesce("stamps_on_sheet", F.lit(0)) < LEAST_STAMPS, result("unverified", "no printed areas on the sheet"))
        .when(n == 0, result("unverified", "no printed area inside"))
        .when(combined, result("combined", None, round2_plain(F.col("sum_m2"))))
        .when(F.col("match_m2").isNotNull(), result("verified", None, F.col("match_m2")))
        .when(n > 1, result("refused", "several rooms' areas inside, none agrees"))
        .otherwise(result("refused", "printed area disagrees"))
    )
    return rows.select("sheet_id", "id", judged.alias("j")).select("sheet_id", "id", "j.*")
