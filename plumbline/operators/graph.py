"""A drawing set as one graph: its sheets' roles and buildings, schedules over all sheets, rooms and why they are rooms; and
what a mark drawn on a plan resolves to.

Each member is a frame of its own, keyed by sheet and span. Sheets are read in parallel; only a set's vocabulary (buildings,
sheet numbers: a few names) is gathered in between. Sheets may be of several sets: each has its own vocabulary and schedules, and no number of
one answers for another's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.drawing import building_mentions, names_above
from plumbline.operators.grid import meeting
from plumbline.operators.more import nearest_marker
from plumbline.operators.sheetinfo import callouts, revision_markers
from plumbline.operators.tables import SURFACES, extract_tables
from plumbline.plans.scratch import kept

# Words beside numbers that name no room; roles of sheets whose numbers aren't room tags, and how sure that must be.
NOT_ROOMS = ["NUMBER", "NO", "NAME", "MARK", "SYMBOL", "CODE", "TYPE", "QTY", "SIZE", "TOTAL", "SHEET", "DATE", "SCALE", "REV", "REVISION", "DESCRIPTION", "REMARKS", "COMMENTS", "DETAIL", "ROOM"]
SILENT_ROLES, SURE = ["schedule", "legend", "elevation", "detail"], 0.6
CONTINUES = r"[\s\-–—:.,(]*(?:CONTINUATION|CONTINUED|CONT['’]?D?)[\s.)]*$"


def one_set(set_of: Column | None) -> Column:
    """The set of a sheet; without one, all sheets are of set 0."""
    return F.lit(0).cast("long") if set_of is None else set_of.cast("long")


def number_of(key: Column) -> Column:
    """The number of a room key or tag: A-134 and 134 both answer for 134."""
    plain = F.upper(F.regexp_replace(key, r"\s+", ""))
    qualified = r"^[A-Z]{1,2}-([0-9]{1,3}[A-Z]{0,2})$"
    return F.when(plain.rlike(qualified), F.regexp_extract(plain, qualified, 1)).otherwise(plain)


def sheet_buildings(spans: DataFrame) -> DataFrame:
    """(sheet_id, building) of sheets that name exactly one building."""
    named = spans.select("sheet_id", F.explode(building_mentions(F.col("str"))).alias("building"))
    return named.groupBy("sheet_id").agg(F.count_distinct("building").alias("n"), F.min("building").alias("building")).where("n = 1").drop("n")


def room_tags(spans: DataFrame, buildings: list[str] | dict, sheet_numbers: list[str] | dict, markers: DataFrame, set_of: Column | None = None) -> DataFrame:
    """(sheet_id, ord, tag, name, building, revision) of numbers that may be rooms: two or three digits and a letter, or so after a
    building that the set names (dictionaries by set, where set_of tells a sheet's). The name is the nearest line of capitals stacked above; the revision the nearest marker's."""
    t = F.trim("str")
    qualified = r"^([A-Z]{1,2})-([0-9]{2,3}[A-Z]?)$"
    plain = t.rlike("^[0-9]{2,3}[A-Z]?$")
    by_set = lambda names: names if isinstance(names, dict) else {0: names}
    known = {f"{k}/{b}" for k, names in by_set(buildings).items() for b in names}
    sheets_of = {f"{k}/{n}" for k, names in by_set(sheet_numbers).items() for n in names if any(f"{k}/{n[:i]}" in known for i in (1, 2))}  # no other number can be a tag's
    here = lambda text: F.concat_ws("/", one_set(set_of).cast("string"), text)
    of_building = F.upper(t).rlike(qualified) & here(F.regexp_extract(F.upper(t), qualified, 1)).isin(sorted(known)) & ~here(F.regexp_replace(F.upper(t), "[^A-Z0-9]", "")).isin(sorted(sheets_of))
    drawn = markers.where("drawn").select(F.col("sheet_id").alias("m_sheet"), F.col("ord").alias("m_ord"))
    boxes = spans.select("sheet_id", "ord", "str", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    is_tag = plain | of_building
    tags = boxes.where(is_tag).join(drawn, (F.col("sheet_id") == F.col("m_sheet")) & (F.col("ord") == F.col("m_ord")), "left_anti")
    tags = tags.withColumn("building", F.when(of_building, F.regexp_extract(F.upper(t), qualified, 1)))
    name = F.upper(F.regexp_replace(t, r"\s+", " "))
    names = boxes.where(~is_tag & ~t.rlike("[a-z]") & name.rlike("^[A-Z][A-Z .'’/&-]+$") & ~name.isin(NOT_ROOMS))
    above = names_above(tags, names).select(F.col("sheet_id").alias("n_sheet"), F.col("ord").alias("n_ord"), "name")
    marked = boxes.join(markers.select(F.col("sheet_id").alias("m_sheet"), F.col("ord").alias("m_ord"), "rev"), (F.col("sheet_id") == F.col("m_sheet")) & (F.col("ord") == F.col("m_ord")))
    near = nearest_marker(tags, marked).select(F.col("sheet_id").alias("r_sheet"), F.col("ord").alias("r_ord"), F.col("marker"))
    revised = near.join(markers.select(F.col("sheet_id").alias("m_sheet"), F.col("ord").alias("m_ord"), F.col("rev").alias("revision")), (F.col("r_sheet") == F.col("m_sheet")) & (F.col("marker") == F.col("m_ord")))
    joined = tags.join(above, (F.col("sheet_id") == F.col("n_sheet")) & (F.col("ord") == F.col("n_ord")), "left").join(revised, (F.col("sheet_id") == F.col("r_sheet")) & (F.col("ord") == F.col("r_ord")), "left")
    return joined.select("sheet_id", "ord", t.alias("tag"), F.coalesce("name", F.lit("")).alias("name"), "building", "revision")


def joined_tables(cells: DataFrame, set_of: Column | None = None) -> DataFrame:
    """Cells of extract_tables() with table_id (sheet and number) and base_id: a continued table's base is the last earlier table of
    its set and kind, of the same base title if there is one; without one it stands for itself."""
    tables = cells.where("row_no IS NOT NULL").select("sheet_id", "table_no", "kind", "title").distinct()
    title = F.upper(F.regexp_replace(F.trim(F.coalesce("title", F.lit(""))), r"\s+", " "))
    base = F.trim(F.regexp_replace(F.regexp_replace(title, CONTINUES, ""), r"[\s\-–—:.,()]+$", ""))
    marked = tables.withColumns({"table_id": F.format_string("%d/%d", "sheet_id", "table_no"), "of_set": one_set(set_of), "continued": title.contains("SCHEDULE") & title.rlike(CONTINUES), "base": base})
    before = lambda *keys: Window.partitionBy(*keys).orderBy("sheet_id", "table_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~F.col("continued"), F.col("table_id"))
    found = F.coalesce(F.last(own, ignorenulls=True).over(before("of_set", "kind", "base")), F.last(own, ignorenulls=True).over(before("of_set", "kind")))
    linked = marked.withColumn("base_id", F.when(F.col("continued"), F.coalesce(found, F.col("table_id"))).otherwise(F.col("table_id")))
    return cells.drop("kind", "title").join(linked.select("sheet_id", "table_no", "kind", "title", "table_id", "base_id"), ["sheet_id", "table_no"])


def schedule_rows(cells: DataFrame, buildings: DataFrame, set_of: Column | None = None) -> DataFrame:
    """A row for each schedule row: (set_id, row_id, kind, base_id, sheet_id, title, key, number, building, revision, cells map). The building is
    the row's own, else the one its table's title names, else the sheet's."""
    in_title = building_mentions(F.col("title"))
    rows = cells.where("row_no IS NOT NULL").groupBy("kind", "base_id", "table_id", "sheet_id", "title", "row_no", "key").agg(F.first("building", True).alias("own"), F.first("revision", True).alias("revision"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "text")))).alias("cells"))
    beside = buildings.select(F.col("sheet_id").alias("b_sheet"), F.col("building").alias("of_sheet"))
    joined = rows.join(beside, F.col("sheet_id") == F.col("b_sheet"), "left")
    building = F.coalesce("own", F.when(F.size(in_title) == 1, in_title[0]), "of_sheet")
    return joined.select(one_set(set_of).alias("set_id"), F.concat_ws("/", "table_id", "row_no").alias("row_id"), "kind", "base_id", "sheet_id", "title", "key", number_of(F.col("key")).alias("number"), building.alias("building"), "revision", "cells")


def build_graph(spans: DataFrame, segments: DataFrame, roles: DataFrame, numbers: DataFrame, set_of: Column | None = None) -> dict[str, DataFrame]:
    """The members of the set, or of the sets that set_of(sheet_id) tells: buildings, sheets, cells, rows, rooms, unmatched, callouts, revisions.

    spans: (sheet_id, ord, str, x, y, w, h, rot); segments: (sheet_id, x1, y1, x2, y2); roles: (sheet_id, role, confidence);
    numbers: (sheet_id, sheet_number). Where the set has a room-finish schedule, it alone says which numbers are rooms; else a name
    drawn with a number does. Others are unmatched, with the reason.
    """
    of_set = one_set(set_of)
    named = spans.select(of_set.alias("set_id"), F.explode(building_mentions(F.col("str"))).alias("b")).distinct()
    known, sheet_numbers = {}, {}  # by set: its buildings, designators of two characters; its sheets
    for r in named.orderBy("set_id", "b").collect():
        known.setdefault(r["set_id"], []).append(r["b"])
    for r in numbers.where("sheet_number IS NOT NULL").select(of_set.alias("set_id"), F.regexp_replace(F.upper("sheet_number"), "[^A-Z0-9]", "").alias("n")).distinct().collect():
        sheet_numbers.setdefault(r["set_id"], []).append(r["n"])
    buildings = sheet_buildings(spans)
    markers = kept(revision_markers(spans, segments))
    cells = kept(joined_tables(extract_tables(spans, known, sheet_numbers, of_set), of_set))
    rows = kept(schedule_rows(cells, buildings, of_set))
    silent = roles.where(F.col("role").isin(SILENT_ROLES) & (F.col("confidence") >= SURE)).select(F.col("sheet_id").alias("silent_sheet"))
    beside = buildings.select(F.col("sheet_id").alias("b_sheet"), F.col("building").alias("of_sheet"))
    tags = room_tags(spans, known, sheet_numbers, markers, of_set).join(silent, F.col("sheet_id") == F.col("silent_sheet"), "left_anti").join(beside, F.col("sheet_id") == F.col("b_sheet"), "left")
    tags = tags.select("sheet_id", "ord", "tag", "name", F.coalesce("building", "of_sheet").alias("building"), "revision", number_of(F.col("tag")).alias("number"))
    in_rooms = rows.where("kind = 'room-finish'")
    scheduled, listing = in_rooms.select(F.col("set_id").alias("l_set"), F.col("number").alias("listed")).distinct(), in_rooms.select(F.col("set_id").alias("s_set")).distinct()
    judged = tags.join(scheduled, (of_set == F.col("l_set")) & (F.col("number") == F.col("listed")), "left").join(listing, of_set == F.col("s_set"), "left")
    has_schedule = F.col("s_set").isNotNull()
    by_name, by_row = F.col("name") != "", F.col("listed").isNotNull()
    how = F.when(by_row & by_name, "name+schedule").when(by_row, "schedule").when(by_name & ~has_schedule, "name")
    why = F.when(~has_schedule, "no name, no schedule").when(by_name, "named but not scheduled").otherwise("neither named nor scheduled")
    judged = kept(judged.withColumns({"corroboration": how, "reason": F.when(how.isNull(), why)}).drop("l_set", "listed", "s_set"))
    return {
        "buildings": spans.sparkSession.createDataFrame([(k, b) for k, names in known.items() for b in names], "set_id long, building string"), "sheets": roles.join(beside, F.col("sheet_id") == F.col("b_sheet"), "left").select("sheet_id", "role", "confidence", F.col("of_sheet").alias("building")),
        "cells": cells, "rows": rows, "rooms": judged.where("corroboration IS NOT NULL").drop("reason"), "unmatched": judged.where("corroboration IS NULL").drop("corroboration"), "callouts": callouts(spans), "revisions": markers,
    }


def answers(key: Column, mark: Column) -> Column:
    plain = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    return F.array_distinct(F.concat(F.array(plain(key)), F.split(plain(key), "/"))), plain(mark)


def resolve_tags(asked: DataFrame, rows: DataFrame, buildings: DataFrame) -> DataFrame:
    """What each asked mark (tag; set_id, where there are several sets) resolves to: (set_id, tag, status, reason, kind, row_id, finishes).

    A door or window mark is its schedule's row; a room number its room-finish row, whose surfaces' finishes come in order, each
    with its definition where a finish schedule has its code. Several rows for a mark, rows of several buildings for an unqualified
    one, and a building that the set doesn't name are refused with a reason, never chosen between.
    """
    plain = F.upper(F.regexp_replace("tag", r"\s+", ""))
    qualified = r"^([A-Z]{1,2})-([0-9]{1,3}[A-Z]{0,2})$"
    is_qualified = plain.rlike(qualified)
    want = asked.select(one_set(F.col("set_id") if "set_id" in asked.columns else None).alias("set_id"), "tag", plain.alias("mark")).distinct().withColumns({"wanted": F.when(is_qualified, F.regexp_extract(plain, qualified, 1)), "number": number_of(F.col("tag"))})
    keys, _ = answers(F.col("key"), F.col("key"))
    opening = rows.where(F.col("kind").isin("door", "window", "door-window")).select(F.col("set_id").alias("o_set"), F.explode(keys).alias("key_mark"), F.col("row_id").alias("item"), F.col("kind").alias("item_kind")).distinct()
    items = want.join(opening, (F.col("set_id") == F.col("o_set")) & (F.col("mark") == F.col("key_mark"))).groupBy(F.col("set_id").alias("i_set"), F.col("tag").alias("i_tag")).agg(F.count("*").alias("items"), F.min("item").alias("item"), F.min("item_kind").alias("item_kind"))
    room = rows.where("kind = 'room-finish'").select(F.col("set_id").alias("r_set"), F.col("number").alias("r_number"), F.col("row_id").alias("room_row"), F.col("building").alias("r_building"))
    met = want.join(room, (F.col("set_id") == F.col("r_set")) & (F.col("number") == F.col("r_number")), "left")
    fits = F.col("room_row").isNotNull() & (F.col("wanted").isNull() | F.col("wanted").eqNullSafe(F.col("r_building")))
    rooms = met.groupBy("set_id", "tag", "wanted").agg(F.count("room_row").alias("listed"), F.count_if(fits).alias("n"), F.count_distinct(F.when(fits, F.col("r_building"))).alias("of_buildings"), F.min(F.when(fits, F.col("room_row"))).alias("room_row"))
    set_names = buildings.select(F.col("set_id").alias("b_set"), F.col("building").alias("set_building")).distinct()
    naming, listing = set_names.select(F.col("b_set").alias("n_set")).distinct(), rows.where("kind = 'room-finish'").select(F.col("set_id").alias("s_set")).distinct()
    joined = rooms.join(items, (F.col("set_id") == F.col("i_set")) & (F.col("tag") == F.col("i_tag")), "left").join(set_names, (F.col("set_id") == F.col("b_set")) & (F.col("wanted") == F.col("set_building")), "left")
    joined = joined.join(naming, F.col("set_id") == F.col("n_set"), "left").join(listing, F.col("set_id") == F.col("s_set"), "left")
    none_named, has_rooms = F.col("n_set").isNull(), F.col("s_set").isNotNull()
    item = F.coalesce("items", F.lit(0))
    reason = (
        F.when((item > 1) | ((item == 1) & (F.col("listed") > 0)), "ambiguous: several schedule rows")
        .when(item == 1, F.lit(None))
        .when(~has_rooms, "no room-finish schedule")
        .when(F.col("wanted").isNotNull() & (F.col("n") == 0) & none_named, "the set names no buildings")
        .when(F.col("wanted").isNotNull() & (F.col("n") == 0) & F.col("set_building").isNull(), "the set names no such building")
        .when((F.col("n") == 0) & (F.col("listed") > 0), "listed under other buildings")
        .when(F.col("n") == 0, "no schedule row")
        .when((F.col("n") > 1) & (F.col("of_buildings") > 1), "ambiguous: several buildings")
        .when(F.col("n") > 1, "ambiguous: several schedule rows")
    )
    judged = joined.select("set_id", "tag", reason.alias("reason"), F.when(item == 1, F.col("item_kind")).otherwise("room-finish").alias("kind"), F.when(reason.isNull(), F.when(item == 1, F.col("item")).otherwise(F.col("room_row"))).alias("row_id"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SURFACES]), F.element_at(F.split("surface", " "), 1))
    cells = rows.where("kind = 'room-finish'").select(F.col("set_id").alias("c_set"), F.col("row_id").alias("c_row"), F.explode("cells").alias("surface", "text")).withColumn("rank", rank).where("rank > 0 AND trim(text) <> ''")
    code = F.regexp_replace(F.upper("text"), "[^A-Z0-9-]", "")
    definitions = rows.where("kind = 'finish'").select(F.col("set_id").alias("d_set"), F.explode(keys).alias("def_code"), F.struct("sheet_id", "row_id", "cells").alias("d")).groupBy("d_set", "def_code").agg(F.min(F.struct("d.sheet_id", "d.row_id")).alias("first"), F.count("*").alias("defined"))
    detail = cells.withColumn("code", code).join(definitions, (F.col("c_set") == F.col("d_set")) & (F.col("code") == F.col("def_code")), "left")
    finishes = detail.groupBy("c_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "surface", F.trim("text").alias("code"), F.col("first.row_id").alias("definition")))), lambda f: F.struct(f["surface"].alias("surface"), f["code"].alias("code"), f["definition"].alias("definition"))).alias("finishes"))
    out = judged.join(finishes, F.col("row_id") == F.col("c_row"), "left")
    bare = F.col("reason").isNull() & (F.col("kind") == "room-finish") & F.col("finishes").isNull()
    why = F.coalesce("reason", F.when(bare, "row carries no finishes"))
    return out.select("set_id", "tag", F.when(why.isNull(), "resolved").otherwise("unresolved").alias("status"), why.alias("reason"), F.when(why.isNull(), F.col("kind")).alias("kind"), F.when(why.isNull(), F.col("row_id")).alias("row_id"), F.when(why.isNull(), F.col("finishes")).alias("finishes"))


def sweep_row(tag: str, rows: DataFrame, spans: DataFrame, roles: DataFrame, regions: DataFrame, matches: DataFrame) -> DataFrame:
    """What becomes of a schedule row's mark on plan sheets: (sheet_id, ord or null, x, y, outcome, carries).

    matches: (sheet_id, x, y, reach) where the marker's linework was found (sweep()); spans (sheet_id, ord, str, x, y, w, h); regions:
    (sheet_id, x0, y0, x1, y1) of schedules. A place of the linework counts if the mark's own text lies within reach;
    with another row's mark it is excluded, and says which; with none it is withheld. Text without linework is text_only, within a schedule in_table.
    A tag that no row, or several, have is refused.
    """
    mark = re.sub(r"\s+", "", tag.upper())
    keys, _ = answers(F.col("key"), F.col("key"))
    marks = rows.select("row_id", F.explode(keys).alias("mark")).distinct()
    n = marks.where(F.col("mark") == mark).count()
    if n != 1:
        raise ValueError(f"{n} schedule rows answer for {mark}; one is needed")
    plans = roles.where("role = 'plan'").select(F.col("sheet_id").alias("plan_sheet"))
    text = spans.withColumn("mark", F.upper(F.regexp_replace("str", r"\s+", ""))).join(marks.select("mark").distinct(), "mark").join(plans, F.col("sheet_id") == F.col("plan_sheet"), "left_semi")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    at = text.select("sheet_id", "ord", "mark", cx.alias("x0"), cy.alias("y0"), cx.alias("x1"), cy.alias("y1"))
    found = matches.join(plans, F.col("sheet_id") == F.col("plan_sheet"), "left_semi").select("sheet_id", "x", "y", "reach", (F.col("x") - F.col("reach")).alias("x0"), (F.col("y") - F.col("reach")).alias("y0"), (F.col("x") + F.col("reach")).alias("x1"), (F.col("y") + F.col("reach")).alias("y1"))
    near = meeting(found, at)
    within = F.hypot(F.col("b.x0") - F.col("a.x"), F.col("b.y0") - F.col("a.y")) <= F.col("a.reach")
    carried = near.where(within).groupBy(F.col("a.sheet_id").alias("c_sheet"), F.col("a.x").alias("c_x"), F.col("a.y").alias("c_y")).agg(F.bool_or(F.col("b.mark") == mark).alias("own"), F.min(F.when(F.col("b.mark") != mark, F.col("b.mark"))).alias("other"), F.min(F.when(F.col("b.mark") == mark, F.col("b.ord"))).alias("ord"))
    placed = found.join(carried, (F.col("sheet_id") == F.col("c_sheet")) & (F.col("x") == F.col("c_x")) & (F.col("y") == F.col("c_y")), "left")
    outcome = F.when(F.col("own"), "counted").when(F.col("other").isNotNull(), "excluded").otherwise("withheld")
    drawn = placed.select("sheet_id", "ord", "x", "y", outcome.alias("outcome"), F.when(~F.coalesce("own", F.lit(False)), F.col("other")).alias("carries"))
    held = meeting(at.where(F.col("mark") == mark), regions.select("sheet_id", "x0", "y0", "x1", "y1")).select(F.col("a.sheet_id").alias("h_sheet"), F.col("a.ord").alias("h_ord")).distinct()
    counted = near.where(within & (F.col("b.mark") == mark)).select(F.col("b.sheet_id").alias("u_sheet"), F.col("b.ord").alias("u_ord")).distinct()
    loose = at.where(F.col("mark") == mark).join(counted, (F.col("sheet_id") == F.col("u_sheet")) & (F.col("ord") == F.col("u_ord")), "left_anti").join(held, (F.col("sheet_id") == F.col("h_sheet")) & (F.col("ord") == F.col("h_ord")), "left")
    rest = loose.select("sheet_id", "ord", F.col("x0").alias("x"), F.col("y0").alias("y"), F.when(F.col("h_ord").isNotNull(), "in_table").otherwise("text_only").alias("outcome"), F.lit(None).cast("string").alias("carries"))
    return drawn.unionByName(rest)
