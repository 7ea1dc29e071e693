"""Counts, classes and listings of a project's records: what reports and tools say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import round2_fixed
from plumbline.operators.drawing import SURFACES


def exact(value: Column) -> Column:
    """Doubles added as decimals, so that the order of rows can't show."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def list_shapes(shapes: DataFrame, conditions: DataFrame, wanted: Column | None = None, tags: list[str] | None = None) -> DataFrame:
    """Shapes with their condition's tag and review state, those that wanted and tags choose. A tag that no condition has is refused by name."""
    beside = conditions.select(F.col("id").alias("of_condition"), "finish_tag")
    if tags is not None:
        known = {r["finish_tag"] for r in beside.where(F.col("finish_tag").isin(tags)).select("finish_tag").distinct().collect()}
        missing = sorted(set(tags) - known)
        if missing:
            some = [r["finish_tag"] for r in beside.select("finish_tag").distinct().orderBy("finish_tag").limit(20).collect()]
            raise ValueError(f"no condition {', '.join(missing)}; there are {', '.join(some)}")
    joined = shapes.join(beside, F.col("condition_id") == F.col("of_condition")).drop("of_condition")
    if tags is not None:
        joined = joined.where(F.col("finish_tag").isin(tags))
    return joined if wanted is None else joined.where(wanted)


def with_condition(shapes: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every shape with its condition's tag; null where the condition is gone (an orphan, which reports leave out)."""
    return shapes.join(conditions.select(F.col("id").alias("of_condition"), "finish_tag"), F.col("condition_id") == F.col("of_condition"), "left").withColumn("orphan", F.col("of_condition").isNull()).drop("of_condition")


def markup_tags(markups: DataFrame, conditions: DataFrame) -> DataFrame:
    """Markups with the tag of the condition they belong to; empty without one."""
    beside = conditions.select(F.col("id").alias("of_condition"), F.col("finish_tag").alias("tag_of"))
    return markups.join(beside, F.col("condition_id") == F.col("of_condition"), "left").withColumn("finish_tag", F.coalesce("tag_of", F.lit(""))).drop("of_condition", "tag_of")


def captured_labels(shapes: DataFrame, conditions: DataFrame) -> DataFrame:
    """Shapes with the label of their finish's condition; of several conditions with one finish the last counts, shapes without one are left out."""
    labels = conditions.groupBy(F.col("finish").alias("of_finish")).agg(F.max_by("label", "ord").alias("label"))
    return shapes.join(labels, F.col("finish") == F.col("of_finish")).drop("of_finish")


def live(rows: DataFrame) -> DataFrame:
    """Rows that weren't deleted; a missing flag is none."""
    return rows.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def columns_with_values(rows: DataFrame, optional: list[str]) -> list[str]:
    """Names of rows' columns, of the optional ones only those in which some row has a value (not null, blank or 0): one pass."""
    filled = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull() & ~F.trim(F.col(c).cast("string")).rlike(r"^0+(\.0+)?$"), F.lit(False))
    found = rows.agg(*[F.bool_or(filled(c)).alias(c) for c in optional]).first()
    return [c for c in rows.columns if c not in optional or found[c]]


def valid_multiplier(multiplier: Column) -> Column:
    """Absent, or a finite number above 0."""
    return multiplier.isNull() | (~F.isnan(multiplier) & (multiplier > 0) & (multiplier < float("inf")))


def wall_breakdown(walls: DataFrame, order: list[str], default_height: float | Column = 9.0) -> DataFrame:
    """Wall runs of each condition, numbered in order, with their area, or length times height where it wasn't measured."""
    place = F.row_number().over(Window.partitionBy("condition_id").orderBy(*order)).cast("long")
    height = default_height if isinstance(default_height, Column) else F.lit(default_height)
    area = F.coalesce(F.col("area_sf").cast("double"), F.col("perimeter_lf").cast("double") * height)
    return walls.withColumn("place", place).withColumn("area_sf", area)


def ordinals(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with their number (n) within the group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))


def surface_place(surface: Column) -> Column:
    """Where a surface stands in a row of finishes, by its first word; 0 if it is none."""
    return F.array_position(F.array(*[F.lit(s) for s in SURFACES]), F.element_at(F.split(surface, " "), 1)).cast("int")


def find_text(spans: DataFrame, query: str, text: str = "str") -> DataFrame:
    """Spans that hold the query, whatever its case; a blank one is refused."""
    wanted = query.strip().lower()
    if not wanted:
        raise ValueError("the query must not be empty")
    return spans.where(F.instr(F.lower(F.col(text)), F.lit(wanted)) > 0)


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields' canonical JSON, absent ones included."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def distinct_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, middle): the distinct values' count and the median of all (of an even count the mean of the middle two)."""
    return rows.groupBy(group).agg(F.count_distinct(value).alias("n"), F.percentile(value, 0.5).alias("middle"))


def weighted_median(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, middle): the least value up to which half of the weight lies."""
    w = Window.partitionBy(group).orderBy(value)
    whole = Window.partitionBy(group)
    d = F.col(weight).cast("decimal(28,9)")
    run = rows.withColumns({"upto": F.sum(d).over(w), "whole": F.sum(d).over(whole)})
    return run.where("upto * 2 >= whole").groupBy(group).agg(F.min(value).alias("middle"))


def segments_per_layer(segments: DataFrame, layers: DataFrame) -> DataFrame:
    """(sheet_id, layer_id, name, n) of every layer, those without a segment too; segments without a layer count under none."""
    counted = segments.groupBy("sheet_id", F.col("layer_idx").alias("layer_id")).agg(F.count("*").alias("found"))
    full = layers.select("sheet_id", "layer_id", "name").join(counted, ["sheet_id", "layer_id"], "left").select("sheet_id", "layer_id", "name", F.coalesce("found", F.lit(0)).alias("n"))
    loose = counted.where("layer_id IS NULL").select("sheet_id", "layer_id", F.lit(None).cast("string").alias("name"), F.col("found").alias("n"))
    return full.unionByName(loose)


def segment_roles(segments: DataFrame, layers: DataFrame) -> DataFrame:
    """Segments with the role of their layer: hidden layers before any role, an override before the name's, unknown without a layer.

    layers: (layer_id, role, visible, override), one row each; segments: (idx, layer_id).
    """
    role = F.when(~F.coalesce("visible", F.lit(True)), "hidden").otherwise(F.coalesce("override", "role", F.lit("unknown")))
    beside = layers.select(F.col("layer_id").alias("of_layer"), role.alias("layer_role"))
    return segments.join(beside, F.col("layer_id") == F.col("of_layer"), "left").withColumn("role", F.coalesce("layer_role", F.lit("unknown"))).drop("of_layer", "layer_role")


def doors_by_width(doors: DataFrame) -> DataFrame:
    """(double_leaf, width_mm, n): widths rounded to 100 mm, a pair of leaves by its one leaf's."""
    width = (F.floor(F.col("width_mm") / 100 + 0.5) * 100).cast("long")
    return doors.groupBy("double_leaf", width.alias("width_mm")).agg(F.count("*").alias("n"))


def windows_by_type(windows: DataFrame) -> DataFrame:
    """(type, n, widths): how many windows of each type, and which widths they have."""
    return windows.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("width_mm")).alias("widths"))


def wall_classes(runs: DataFrame) -> DataFrame:
    """(side, class, runs, gross, net, openings) of wall runs (side, class, gross_m2, openings_m2 or null, openings): net area is withheld where any opening's height is unknown."""
    unknown = F.count_if(F.col("openings_m2").isNull() & (F.col("openings") > 0))
    gross, cut = exact(F.col("gross_m2")), exact(F.coalesce("openings_m2", F.lit(0)))
    return runs.groupBy("side", "class").agg(F.count("*").alias("runs"), gross.alias("gross_m2"), F.sum("openings").cast("long").alias("openings"), F.when(unknown == 0, (F.sum(F.col("gross_m2").cast("decimal(28,6)")) - F.sum(F.coalesce("openings_m2", F.lit(0)).cast("decimal(28,6)"))).cast("double")).alias("net_m2"), cut.alias("openings_m2"))


def base_by_sheet(rooms: DataFrame) -> DataFrame:
    """(sheet, rooms, flagged, net_lf, unmeasured_lf) of derived base: rooms (sheet, gross_lf, net_lf or null, flagged); what wasn't measured counts by its gross."""
    open_ = F.col("net_lf").isNull()
    return rooms.groupBy("sheet").agg(F.count("*").alias("rooms"), F.count_if("flagged").alias("flagged"), exact(F.coalesce("net_lf", F.lit(0))).alias("net_lf"), exact(F.when(open_, F.col("gross_lf")).otherwise(0)).alias("unmeasured_lf"))


def base_with_openings(rooms: DataFrame) -> DataFrame:
    """Base of rooms whose openings are stated: perimeter less openings to two decimals, refused where they reach it; without a statement, none."""
    stated, whole = F.col("openings_lf"), F.col("perimeter_lf")
    reason = F.when(stated.isNull(), "openings not stated").when(stated < 0, "openings are negative").when(stated >= whole, "openings reach the perimeter")
    return rooms.withColumns({"base_lf": F.when(reason.isNull(), round2_fixed(whole - stated)), "reason": reason})


# Words by which a kind of schedule is asked for.
_SCHEDULE_WORDS = [("room-finish", "room"), ("equipment", "equip|mechanical|mep|hvac|plumb|electr|fan|pump|heater|unit|valve|diffuser|grille|fixture|device"), ("finish", "finish|material|product|code|mark")]
_DOOR_WORDS, _WINDOW_WORDS, _OPENING_WORDS = "door|dør|dor|dörr|tür|port", "window|vindu|fönster|fenster|glass", "opening|åpning"


def schedule_kinds(asked: str) -> list[str]:
    """Kinds of tables that answer for a keyword; a combined door and window schedule answers for either."""
    import re

    k = asked.strip().lower()
    door, window = re.search(_DOOR_WORDS, k), re.search(_WINDOW_WORDS, k)
    if (door and window) or re.search(_OPENING_WORDS, k):
        return ["door", "window", "door-window"]
    if door or window:
        return ["door" if door else "window", "door-window"]
    return [next((kind for kind, words in _SCHEDULE_WORDS if re.search(words, k)), k)]


def find_schedules(tables: DataFrame, asked: str) -> DataFrame:
    """The tables (kind, ...) that a keyword asks for."""
    return tables.where(F.col("kind").isin(schedule_kinds(asked)))


def floor_tag(cell: Column) -> Column:
    """(tag, reason) of a room's floor cell: none stated, and several finishes in one cell, are reasons; hyphens don't part."""
    code = F.trim(F.coalesce(cell, F.lit("")))
    several = code.rlike(r"(?i)[/,]|\bOR\b")
    reason = F.when(code == "", "no floor finish stated").when(several, "compound floor finish")
    return F.struct(F.when(reason.isNull(), code).alias("tag"), reason.alias("reason"))


def placed_counts(placements: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition_id, ea): units of each condition after its new placements (condition_id), beside those it had (id, ea); each placement is one."""
    added = placements.groupBy("condition_id").agg(F.count("*").alias("added"))
    had = conditions.select(F.col("id").alias("of_condition"), F.col("ea").alias("had"))
    return added.join(had, F.col("condition_id") == F.col("of_condition"), "left").select("condition_id", (F.col("added") + F.coalesce("had", F.lit(0))).alias("ea"))


def rfi_states(entries: DataFrame) -> DataFrame:
    """(id, status, changes, deleted) of RFIs after their entries (id, seq, op, status): the last status stands; a deleted one stays with its number reserved."""
    said = F.when(F.col("op") != "delete", F.col("seq"))
    return entries.groupBy("id").agg(F.max_by("status", said).alias("status"), F.count("*").alias("changes"), (F.max_by("op", "seq") == "delete").alias("deleted"))


def scale_overrides(sheets: DataFrame) -> DataFrame:
    """Sheets (sheet_id, local_upp, remote_upp, local_work, remote_work) with whether remote's whole sheet replaces the local one:
    the scales differ, and both sides have measured work (counts are exempt) on it."""
    differ = F.col("local_upp").isNotNull() & F.col("remote_upp").isNotNull() & (F.col("local_upp") != F.col("remote_upp"))
    return sheets.withColumn("remote_takes_sheet", differ & (F.col("local_work") > 0) & (F.col("remote_work") > 0))


def merged_sheets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Sheets of several documents one under the other; columns that one lacks are null."""
    out = first
    for more in others:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def load_plans(catalog: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets of a set after more plans (path, pages) are loaded: a row for each page with its key (file name, and # and number from the second on),
    status and reason; a file whose name is loaded already, or twice among the new ones, is refused.

    catalog: (file, sheet_id) of what is loaded.
    """
    name = F.element_at(F.split("path", r"[/\\\\]"), -1)
    named = sheets.select("path", "pages", name.alias("file"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("path"))
    taken = catalog.select(F.col("file").alias("taken_file")).distinct()
    judged = named.withColumn("n", place).join(taken, F.col("file") == F.col("taken_file"), "left")
    reason = F.when(F.col("taken_file").isNotNull(), "file name already loaded").when(F.col("n") > 1, "file name given twice").when(F.col("pages") < 1, "no pages")
    page = F.explode(F.when(reason.isNull(), F.sequence(F.lit(1), F.col("pages"))).otherwise(F.array(F.lit(None).cast("int"))))
    rows = judged.withColumn("reason", reason).withColumn("page", page)
    key = F.when(F.col("page") > 1, F.concat("file", F.lit("#"), F.col("page").cast("string"))).when(F.col("page") == 1, F.col("file"))
    return rows.select("path", "file", key.alias("sheet_id"), F.when(F.col("reason").isNull(), "loaded").otherwise("refused").alias("status"), "reason")


def region_items(spans: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Positioned text whose origin lies in a closed region, in order."""
    return spans.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("sheet_id", "ord", "str", "x", "y")


def with_roll_columns(rows: DataFrame, rolls: DataFrame) -> DataFrame:
    """Condition rows with the columns of roll_report(); null where a condition isn't roll goods. Without any roll goods the rows stay as they are."""
    if rolls.isEmpty():
        return rows
    named = rolls.select(F.col("condition_id").alias("of_condition"), F.col("order_lf").alias("roll_order_lf"), F.col("rolls").alias("roll_count"), F.col("order_qty").alias("roll_order_qty"), F.col("seam_lf").alias("roll_seam_lf"))
    return rows.join(named, F.col("id") == F.col("of_condition"), "left").drop("of_condition")


def with_group_column(shown: list[str], every: list[str], group_by: str | None) -> list[str]:
    """Columns of a grouped report: the custom column it is grouped by is among them, even if it is hidden."""
    key = f"custom:{group_by}"
    return shown if not group_by or key in shown or key not in every else [*shown, key]


# What a scanned schedule's rows start with, by category.
SUGGESTED = {"floor": True, "base": True, "wall": True, "transition": True, "ceiling": False, "other": False}


def scanned_rows(rows: DataFrame) -> DataFrame:
    """Rows of a schedule read by a model (ord, finish_tag, section, category, description, suggested), made safe: no tag, no row; the first of each
    tag stays; a category that isn't known is other, and what isn't said to be suggested follows from it."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    category = F.when(F.lower(text("category")).isin(list(SUGGESTED)), F.lower(text("category"))).otherwise("other")
    plain = rows.select("ord", text("finish_tag").alias("finish_tag"), F.upper(text("section")).alias("section"), category.alias("category"), text("description").alias("description"), "suggested")
    place = F.row_number().over(Window.partitionBy("finish_tag").orderBy("ord"))
    default = F.create_map(*[F.lit(x) for k, v in SUGGESTED.items() for x in (k, v)])[F.col("category")]
    return plain.where("finish_tag <> ''").withColumn("place", place).where("place = 1").withColumn("suggested", F.coalesce("suggested", default)).drop("place")


def ring_runs(flags: DataFrame) -> DataFrame:
    """(ring_id, first, n) of the maximal runs of true flags (ring_id, i, flag) around each ring: a run may go over its end, and then begins before it."""
    w = Window.partitionBy("ring_id").orderBy("i")
    all_ = Window.partitionBy("ring_id")
    marked = flags.withColumns({"size": F.count("*").over(all_), "held": F.sum(F.col("flag").cast("int")).over(all_), "isle": F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    wraps = F.when((F.col("isle") == F.col("size") - F.col("held")) & (F.col("held") < F.col("size")), F.lit(0)).otherwise(F.col("isle"))  # what follows the last false is one with what precedes the first
    joined = marked.where("flag").withColumn("run", wraps)
    lead = F.when((F.col("run") == 0) & (F.col("isle") > 0), F.col("i")).otherwise(F.when(F.col("run") > 0, F.col("i")))
    return joined.groupBy("ring_id", "run").agg(F.coalesce(F.min(lead), F.min("i")).alias("first"), F.count("*").alias("n")).select("ring_id", "first", "n")


def hatch_families(segments: DataFrame, least: int = 10, slack: float = 0.15) -> DataFrame:
    """(sheet_id, angle, first, pitch, rows) of hatching: parallel lines (angle to a degree) whose distances from the origin step by one pitch, to within a
    share slack, least times or more. segments: (sheet_id, x1, y1, x2, y2)."""
    turn = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    angle = F.pmod(F.round(turn), F.lit(180.0))
    a = F.radians(angle)
    offset = F.round(-F.sin(a) * F.col("x1") + F.cos(a) * F.col("y1"), 3)
    lines = segments.select("sheet_id", angle.cast("int").alias("angle"), offset.alias("offset")).distinct()
    w = Window.partitionBy("sheet_id", "angle").orderBy("offset")
    stepped = lines.withColumn("step", F.col("offset") - F.lag("offset").over(w))
    last = F.lag("step").over(w)
    breaks = F.when(F.col("step").isNull() | last.isNull() | (F.abs(F.col("step") - last) > slack * last), 1).otherwise(0)
    runs = stepped.withColumn("run", F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("step IS NOT NULL")
    found = runs.groupBy("sheet_id", "angle", "run").agg(F.count("*").alias("steps"), F.percentile("step", 0.5).alias("pitch"), F.min(F.col("offset") - F.col("step")).alias("first"))
    return found.where(F.col("steps") + 1 >= least).select("sheet_id", "angle", "first", F.round("pitch", 3).alias("pitch"), (F.col("steps") + 1).alias("rows"))
