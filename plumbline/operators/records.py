"""Lists of records: sheets, segments, shapes, RFIs, proposals, reviews, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.grid import meeting
from plumbline.plans.ranking import numbered
from plumbline.plans.scratch import kept, shuffled

# Defaults of the drawing context.
MIN_LENGTH, CONTEXT_CAP = 2.0, 65_000
#: How much wider than its rule a box is that pairs are looked for in: the rule itself decides.
NEAR = 1e-6


def sheet_index(sheets: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every sheet with its count of shapes (0 without any) and whether it has a scale."""
    counted = shapes.groupBy(F.col("sheet_id").alias("counted_sheet")).agg(F.count("*").alias("n"))
    joined = sheets.join(counted, F.col("sheet_id") == F.col("counted_sheet"), "left")
    return joined.select("sheet_id", (F.coalesce(F.col("units_per_px"), F.lit(0.0)) > 0).alias("scale_set"), F.coalesce("n", F.lit(0)).alias("shape_count"))


def in_region(x0: Column, y0: Column, x1: Column, y1: Column, rx0, ry0, rx1, ry1) -> Column:
    """Closed boxes that meet."""
    return (x0 <= rx1) & (x1 >= rx0) & (y0 <= ry1) & (y1 >= ry0)


def sheet_context(segments: DataFrame, length: Column, region: Column, least: float = MIN_LENGTH, cap: int = CONTEXT_CAP) -> DataFrame:
    """Segments of a sheet within a region, the short ones dropped, the longest kept up to cap per sheet; every row says why it isn't kept.

    status: kept, outside, short or cap. Ties of length go to the lower idx. The cap is the feature; nothing is lost
    silently, since dropped rows stay with their reason.
    """
    long_enough = segments.withColumn("length", length).withColumn("status", F.when(~region, "outside").when(F.col("length") < least, "short"))
    place = F.row_number().over(Window.partitionBy("sheet_id", F.col("status").isNull()).orderBy(F.desc("length"), "idx"))
    return long_enough.withColumn("place", place).withColumn("status", F.coalesce("status", F.when(F.col("place") > cap, "cap").otherwise("kept"))).drop("place")


def longest(segments: DataFrame, length: Column, most: int) -> DataFrame:
    """The longest segments of each sheet with their place, ties to the lower idx: a top-k by design."""
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("length"), "idx"))
    return segments.withColumn("length", length).withColumn("place", place).where(F.col("place") <= most)


def page_after(segments: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next limit segments of each sheet from idx cursor on: keyset paging, whatever lies before isn't read again."""
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy("idx"))
    return segments.where(F.col("idx") >= cursor).withColumn("place", place).where(F.col("place") <= limit).drop("place")


def work_actor(method: Column, actor: Column) -> Column:
    return F.when(actor == "agent", "agent").when(actor == "human", "human").when(method.isin("manual", "trace"), "human").when(method.isNotNull(), "agent").otherwise("unknown")


def review_state(reviewed: Column) -> Column:
    """Reviewed by a person, pending, or merely recorded: three states, absence is one of them."""
    return F.when(reviewed, "reviewed").when(~reviewed, "pending").otherwise("recorded")


def matches(query: str, *columns: Column) -> Column:
    """Whether any column holds the query, whatever its case; an empty query matches all."""
    wanted = query.strip().lower()
    found = F.lit(not wanted)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted))
    return found


def first_hits(hits: DataFrame, order: str, most: int = 200) -> DataFrame:
    """The first hits in order with their place and the count of all (total), so that a reader sees what was left out: the cap is the feature."""
    total = hits.count()
    return numbered(hits.orderBy(order).limit(most), "place", order).withColumn("total", F.lit(total).cast("long"))


def shape_details(shapes: DataFrame) -> DataFrame:
    """Rows as exported: deducts negative, counts at least one, methods named."""
    role = F.col("measure_role")
    return shapes.withColumns({
        "area_sf": F.when(role == "deduct", -F.col("area_sf")).otherwise(F.col("area_sf")), "count": F.when(role == "count", F.coalesce("count", F.lit(1))), "method": F.coalesce("method", F.lit("untracked")),
    })


def needs_metrics(area: Column, perimeter: Column, count: Column, role: Column, vertices: Column) -> Column:
    """Whether a shape's figures must be computed: something is missing (0 isn't), and there are points enough."""
    enough = vertices >= F.when(role.isin("linear", "surface_area"), 2).when(role == "count", 1).otherwise(3)
    missing = F.when(role == "count", count.isNull()).when(role == "linear", perimeter.isNull()).otherwise(area.isNull())
    return enough & missing


def next_numbers(issued: DataFrame, drafts: DataFrame, order: str, prefix: str = "RFI-") -> DataFrame:
    """Numbers of drafts in order, after the greatest trailing number issued: RFI-001 and so on."""
    greatest = issued.agg(F.coalesce(F.max(F.regexp_extract("number", r"([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("m")).first()["m"]
    text = F.col("rfi_place").cast("string")
    placed = numbered(drafts, "rfi_place", order, first=greatest + 1)
    return placed.withColumn("number", F.concat(F.lit(prefix), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).drop("rfi_place")


def rfi_sheets(rfis: DataFrame, markups: DataFrame) -> DataFrame:
    """Live RFIs with their count of markups and the distinct sheets in order of appearance."""
    ranked = markups.groupBy("rfi_id", "sheet_id").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    each = ranked.groupBy(F.col("rfi_id").alias("marked_rfi")).agg(F.sum("n").alias("markup_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "sheet_id"))), lambda s: s["sheet_id"]), ";").alias("sheets"))
    live = rfis.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    joined = live.join(each, F.col("id") == F.col("marked_rfi"), "left")
    return joined.select("id", F.coalesce("markup_count", F.lit(0)).alias("markup_count"), F.coalesce("sheets", F.lit("")).alias("sheets"))


def pending_by_proposal(shapes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Pending shapes by proposal: described batches, undescribed ones, loose ones; empty ones don't appear."""
    counted = shapes.where(~F.col("reviewed")).groupBy(F.col("proposal_id").alias("p")).agg(F.count("*").alias("n"))
    joined = counted.join(proposals.select(F.col("id").alias("described"), "title"), F.col("p") == F.col("described"), "left")
    kind = F.when(F.col("p").isNull(), "loose").when(F.col("described").isNull(), "undescribed").otherwise("described")
    return joined.select(F.col("p").alias("proposal_id"), kind.alias("kind"), "title", "n")


def last_entries(journal: DataFrame, n: int) -> DataFrame:
    """Each session's last n entries, latest first: what an undo of n steps reverts."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return journal.withColumn("step", place).where(F.col("step") <= n)


def latest_state(journal: DataFrame, key: str) -> DataFrame:
    """State of each record after all its commands: the last entry wins, a delete removes it."""
    last = journal.groupBy("session_id", key).agg(F.max_by(F.struct("op", "payload", "seq"), "seq").alias("last"))
    return last.where("last.op <> 'delete'").select("session_id", key, F.col("last.payload").alias("payload"), F.col("last.seq").alias("seq"))


def carried_forward(rows: DataFrame, group: str, order: list[str], header: Column, name: str) -> DataFrame:
    """Each row with the last header before it."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(upto))


def subpaths(segments: DataFrame) -> DataFrame:
    """Number of the stroke that each segment belongs to: a new one begins where a segment doesn't start at the last one's end."""
    w = Window.partitionBy("sheet_id").orderBy("idx")
    joins = (F.lag("x2").over(w) == F.col("x1")) & (F.lag("y2").over(w) == F.col("y1"))
    return segments.withColumn("breaks", F.when(joins, 0).otherwise(1)).withColumn("subpath", F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("breaks")


def descendants(edges: DataFrame, most_depth: int = 20) -> DataFrame:
    """(root, id, depth) of all variants below each root, level by level; a cycle ends at the depth bound without repeats."""
    pairs = kept(edges.select("child", "parent"))
    tops = pairs.select(F.col("parent").alias("root")).distinct()
    # a join for each level: recursive SQL gives up at a million rows
    level = kept(tops.join(shuffled(pairs.select(F.col("child").alias("root"))), "root", "left_anti").select("root", F.col("root").alias("id"), F.lit(0).alias("depth")))
    out = level
    for depth in range(1, most_depth + 1):
        level = kept(level.join(shuffled(pairs), F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def nearest_within(points: DataFrame, anchors: DataFrame, radius: float) -> DataFrame:
    """The nearest anchor within radius of each point on its sheet: anchors are dealt to grid cells of that size, points look in nine."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.withColumn("o", around).withColumn("cx", F.floor(F.col("x") / radius) + F.col("o.i")).withColumn("cy", F.floor(F.col("y") / radius) + F.col("o.j"))
    held = anchors.select(F.col("sheet_id").alias("a_sheet"), F.col("id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / radius).alias("ax_cell"), F.floor(F.col("y") / radius).alias("ay_cell"))
    met = asked.join(held, (F.col("sheet_id") == F.col("a_sheet")) & (F.col("cx") == F.col("ax_cell")) & (F.col("cy") == F.col("ay_cell")))
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    near = met.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    best = near.groupBy("id").agg(F.min(F.struct("d2", "anchor_id")).alias("best"))
    return best.select("id", F.col("best.anchor_id").alias("anchor_id"), F.sqrt("best.d2").alias("distance"))


def mark_pairs(marks: DataFrame, values: DataFrame) -> DataFrame:
    """Each mark with the first value drawn beneath it: within its width (or 1.5 heights) sideways, and from 0.4 heights above its foot to 2.4 below."""
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(6.0))
    cx = (F.col("x0") + F.col("x1")) / 2
    reach = F.greatest(F.col("x1") - F.col("x0"), 1.5 * h)
    low, high = F.col("y1") - 0.4 * h, F.col("y1") + 2.4 * h
    m = marks.select("sheet_id", "ord", cx.alias("cx"), reach.alias("reach"), low.alias("low"), high.alias("high"), (cx - reach - NEAR).alias("x0"), (low - NEAR).alias("y0"), (cx + reach + NEAR).alias("x1"), (high + NEAR).alias("y1"))
    v = values.select("sheet_id", "ord", "str", cx.alias("x0"), "y0", cx.alias("x1"), F.col("y0").alias("y1"))
    beneath = (F.abs(F.col("b.x0") - F.col("a.cx")) <= F.col("a.reach")) & F.col("b.y0").between(F.col("a.low"), F.col("a.high"))
    return meeting(m, v).where(beneath).groupBy(F.col("a.sheet_id").alias("sheet_id"), F.col("a.ord").alias("ord")).agg(F.min_by("b.str", "b.ord").alias("value"))


def row_marks(rows: DataFrame) -> DataFrame:
    """Marks of schedule rows: a compound key gives each of its parts; status says whether one table alone defines it."""
    part = F.explode(F.split(F.upper(F.regexp_replace("key", r"\s+", "")), "/"))
    marks = rows.select(part.alias("mark"), "table_id").where("mark <> ''")
    n = marks.groupBy("mark").agg(F.countDistinct("table_id").alias("tables"))
    return n.withColumn("status", F.when(F.col("tables") > 1, "ambiguous").otherwise("ok"))


def corroborated(tags: DataFrame, schedule: DataFrame, has_schedule: bool = True) -> DataFrame:
    """Numbered tags as rooms or not, with the reason: the schedule is the authority where there is one, a drawn name is not enough then."""
    numbers = schedule.select(F.col("number").alias("listed")).distinct()
    joined = tags.join(numbers, F.col("number") == F.col("listed"), "left")
    named, listed = F.trim("name") != "", F.col("listed").isNotNull()
    room = listed | (named if not has_schedule else F.lit(False))
    how = F.when(listed & named, "name+schedule").when(listed, "schedule").when(room, "name")
    why = F.when(room, F.lit(None)).when(F.lit(not has_schedule), "no name, no schedule").when(named, "named but not scheduled").otherwise("neither named nor scheduled")
    return joined.select("id", F.when(room, "room").otherwise("unmatched").alias("status"), how.alias("corroboration"), why.alias("reason"))


def thickness_classes(runs):
    """Class in mm of each wall run (width_m, length_m of one sheet, as arrays): widths in order, a new class where one lies more
    than 30 mm above the class's first; named by the length-weighted median to 10 mm."""
    import numpy as np

    width, length = runs
    order = np.argsort(width, kind="stable")
    out = np.zeros(len(width), np.int64)
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (width[order[end]] - width[order[start]]) * 1000 > 30:
            members = order[start:end]
            run = np.cumsum(length[members])
            middle = width[members[int(np.argmax(run >= run[-1] / 2))]]
            out[members] = int(np.floor(middle * 100 + 0.5)) * 10
            start = end
    return out


def classed_runs(runs: DataFrame) -> DataFrame:
    """runs: (sheet_id, id, width_m, length_m)."""
    import pandas as pd

    def per_sheet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        return pd.DataFrame({"sheet_id": frame["sheet_id"], "id": frame["id"], "class_mm": thickness_classes((frame["width_m"].to_numpy(), frame["length_m"].to_numpy()))})

    return runs.select("sheet_id", "id", "width_m", "length_m").groupBy("sheet_id").applyInPandas(per_sheet, "sheet_id long, id long, class_mm long")


def text_rows(spans: DataFrame, share: float = 0.35, least: float = 3.0, default_height: float = 8.0) -> DataFrame:
    """Rows of text on each sheet: spans by (y, x); a new row begins where y leaves the open row's mean by more than max(share * h, least)."""
    import pandas as pd

    def per_sheet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["str"].str.strip() != ""].sort_values(["y", "x", "ord"], kind="stable")
        row, n, total, out = -1, 0, 0.0, []
        for y, h in zip(frame["y"], frame["h"]):
            if not n or abs(y - total / n) > max((h or default_height) * share, least):
                row, n, total = row + 1, 0, 0.0
            n, total = n + 1, total + y
            out.append(row)
        return pd.DataFrame({"sheet_id": frame["sheet_id"], "ord": frame["ord"], "row": out})

    return spans.select("sheet_id", "ord", "str", "x", "y", "h").groupBy("sheet_id").applyInPandas(per_sheet, "sheet_id long, ord long, row long")
