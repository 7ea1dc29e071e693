"""Commands of a working session as new versions of its tables: measuring and committing, proposals, condition edits, notes,
verdicts, the material library, and the journal that undoes them.

A command is a row; many are applied at once. What a command refuses stays, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import holed_area, holed_perimeter, legs, open_length
from plumbline.functions.keys import tag_key
from plumbline.functions.numeric import round2_fixed
from plumbline.operators.grid import boxed, meeting

# The fewest points of a shape of each role, and knobs of a condition.
LEAST_POINTS = {"count": 1, "linear": 2, "surface_area": 2, "floor_area": 3, "deduct": 3}
KNOBS = ["waste_pct", "multiplier", "height_ft", "rise_ft", "drop_ft"]
ACTORS = ["agent", "estimator", "reviewer"]


def points_needed(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in LEAST_POINTS.items() for x in (k, v)])[role], F.lit(1))


def quantities(role: Column, ring: Column, holes: Column, upp: Column, height: Column, vertical: Column) -> Column:
    """(area_sf, perimeter_lf, count, plan_lf, vertical_lf) as a session records them, to two decimals: a linear run has no area, and says
    its plan and vertical feet only where it has a leg."""
    none = F.lit(None).cast("double")
    line = open_length(ring) * upp
    result = lambda area, perimeter, count=none, plan=none, up=none: F.struct(area.alias("area_sf"), perimeter.alias("perimeter_lf"), count.alias("count"), plan.alias("plan_lf"), up.alias("vertical_lf"))
    leg = vertical > 0
    return (
        F.when(role == "count", result(none, none, F.lit(1.0)))
        .when(role == "linear", result(F.lit(0.0), round2_fixed(line + vertical), none, F.when(leg, round2_fixed(line)), F.when(leg, round2_fixed(vertical))))
        .when(role == "surface_area", result(round2_fixed(line * F.coalesce(height, F.lit(0.0))), round2_fixed(line)))
        .otherwise(result(round2_fixed(holed_area(ring, holes) * upp * upp), round2_fixed(holed_perimeter(ring, holes) * upp)))
    )


def measure(asked: DataFrame, sheets: DataFrame, conditions: DataFrame) -> DataFrame:
    """Measurements (id, sheet_id, role, ring in px, holes, tag or null, height_ft, rise_ft, drop_ft) with status and reason, and the
    quantities of those that can be measured: the sheet has a scale (counts need none), points are enough, and a surface has a height,
    its own or its condition's."""
    frames = sheets.select(F.col("sheet_id").alias("of_sheet"), F.col("units_per_px").alias("upp"))
    knobs = conditions.select(tag_key(F.col("finish_tag")).alias("of_tag"), *[F.col(k).alias(f"c_{k}") for k in ("height_ft", "rise_ft", "drop_ft")])
    rows = asked.join(frames, F.col("sheet_id") == F.col("of_sheet"), "left").join(knobs, tag_key(F.col("tag")) == F.col("of_tag"), "left")
    height = F.coalesce(F.col("height_ft"), F.col("c_height_ft"))
    reason = (
        F.when(F.col("of_sheet").isNull(), "sheet not loaded")
        .when(F.size("ring") < points_needed(F.col("role")), "too few points")
        .when((F.col("role") != "count") & ~F.coalesce(F.col("upp") > 0, F.lit(False)), "sheet has no scale")
        .when((F.col("role") == "surface_area") & ~F.coalesce(height > 0, F.lit(False)), "surface has no height")
    )
    q = quantities(F.col("role"), F.col("ring"), F.col("holes"), F.coalesce("upp", F.lit(0.0)), height, legs(F.col("rise_ft"), F.col("drop_ft"), F.col("c_rise_ft"), F.col("c_drop_ft")))
    out = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "measured").otherwise("refused"))
    return out.withColumn("q", F.when(F.col("reason").isNull(), q)).select(*asked.columns, "status", "reason", "q.*")


def commit(asked: DataFrame, shapes: DataFrame, checks: DataFrame, open_proposal: str | None = None, least_overlap: float = 0.05) -> DataFrame:
    """Measured shapes (id, sheet_id, tag, role, ring, actor, method, assignment) as they are committed: status, reason and stamps.

    A floor is refused where its printed area disagrees (checks: printed_checks()), or where it shares at least least_overlap of the
    smaller with a floor of its condition (shapes: committed ones, with ring and tag, measured by polygon_collisions). An agent's work is pending (reviewed false), belongs to the open
    proposal, and asserts its assignment unless it states a source; a person's has no flag.
    """
    from plumbline.operators.overlay import polygon_collisions

    floors = lambda df, side: df.where("role = 'floor_area'").select("sheet_id", F.concat(F.lit(side), F.col("id").cast("string")).alias("id"), tag_key(F.col("tag")).alias("condition_id"), "ring")
    pairs = polygon_collisions(floors(asked, "n").unionByName(floors(shapes, "o")), least_overlap).where("same_condition AND left(a_id, 1) <> left(b_id, 1)")
    taken = pairs.select(F.substring(F.greatest("a_id", "b_id"), 1, 1).alias("side"), F.when(F.col("a_id").startswith("n"), F.col("a_id")).otherwise(F.col("b_id")).alias("new")).select(F.expr("substring(new, 2)").alias("taken_id")).distinct()
    verdict = checks.select(F.col("id").cast("string").alias("check_id"), F.col("status").alias("check_status"), F.col("reason").alias("check_reason"))
    key = F.col("id").cast("string")
    rows = asked.join(taken, key == F.col("taken_id"), "left").join(verdict, key == F.col("check_id"), "left")
    reason = F.when(F.col("check_status") == "refused", F.col("check_reason")).when(F.col("taken_id").isNotNull(), "shares floor already measured")
    agent = F.col("actor") == "agent"
    stamped = rows.withColumn("reason", reason).withColumns({
        "status": F.when(F.col("reason").isNull(), "committed").otherwise("refused"), "reviewed": F.when(agent, F.lit(False)), "proposal_id": F.when(agent, F.lit(open_proposal).cast("string")), "assignment": F.coalesce("assignment", F.when(agent, "asserted")),
        "check": F.when(F.col("role") == "floor_area", F.coalesce("check_status", F.lit("unverified"))),
    })
    return stamped.drop("taken_id", "check_id", "check_status", "check_reason")


def fold_proposals(journal: DataFrame) -> DataFrame:
    """(proposal_id, label, rationale, withdrawn) after a journal's entries (seq, op, proposal_id, label, rationale); a proposal without label or
    rationale is refused: it has no row."""
    opened = journal.where("op = 'propose' AND trim(coalesce(label, '')) <> '' AND trim(coalesce(rationale, '')) <> ''").groupBy("proposal_id").agg(F.min_by(F.struct(F.trim("label").alias("label"), F.trim("rationale").alias("rationale"), "seq"), "seq").alias("p"))
    gone = journal.where("op = 'withdraw'").select(F.col("proposal_id").alias("gone_id"), "seq").groupBy("gone_id").agg(F.min("seq").alias("gone_seq"))
    joined = opened.join(gone, (F.col("proposal_id") == F.col("gone_id")) & (F.col("gone_seq") > F.col("p.seq")), "left")
    return joined.select("proposal_id", "p.label", "p.rationale", F.col("gone_seq").isNotNull().alias("withdrawn"))


def proposal_rows(proposals: DataFrame, shapes: DataFrame) -> DataFrame:
    """Proposals with how many of their shapes (proposal_id, reviewed) are pending and accepted."""
    accepted = F.coalesce(F.col("reviewed"), F.lit(False))
    n = shapes.where("proposal_id IS NOT NULL").groupBy(F.col("proposal_id").alias("of_proposal")).agg(F.count_if(~accepted).alias("pending"), F.count_if(accepted).alias("accepted"))
    return proposals.join(n, F.col("proposal_id") == F.col("of_proposal"), "left").withColumns({"pending": F.coalesce("pending", F.lit(0)), "accepted": F.coalesce("accepted", F.lit(0))}).drop("of_proposal")


def withdraw(shapes: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Shapes without the pending ones of withdrawn proposals (proposal_id): accepted ones are ink and stay."""
    gone = withdrawn.select(F.col("proposal_id").alias("gone_id")).distinct()
    joined = shapes.join(gone, F.col("proposal_id") == F.col("gone_id"), "left")
    return joined.where(F.col("gone_id").isNull() | F.coalesce(F.col("reviewed"), F.lit(False))).drop("gone_id")


def revise(shapes: DataFrame, replacement: DataFrame, proposals: DataFrame) -> DataFrame:
    """Shapes after proposals are revised: all pending shapes of a proposal give way to its replacement (proposal_id, ring, role, ...),
    which is taken whole or not at all: a proposal that is withdrawn or unknown, or with any shape of too few points, is left as it was."""
    bad = F.size("ring") < points_needed(F.col("role"))
    judged = replacement.groupBy(F.col("proposal_id").alias("of_proposal")).agg(F.bool_or(bad).alias("bad"))
    open_ = proposals.where("NOT withdrawn").select(F.col("proposal_id").alias("open_id"))
    ok = judged.join(open_, F.col("of_proposal") == F.col("open_id")).where("NOT bad").select(F.col("of_proposal").alias("proposal_id"))
    fresh = replacement.join(ok, "proposal_id", "left_semi").withColumn("reviewed", F.lit(False))
    return withdraw(shapes, ok).unionByName(fresh, allowMissingColumns=True)


def edit_conditions(conditions: DataFrame, edits: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions, shapes) after edits (seq, finish_tag and knobs, null: unchanged): the last value of each knob stands. A changed rise or
    drop prices the condition's linear runs anew: a run's own legs win, a derived run takes none.

    conditions also gets outcome: edited, or refused where an edit names no knob, or a multiplier that isn't positive; edits of unknown
    tags change nothing. shapes: (id, condition_id, measure_role, plan_lf, rise_ft, drop_ft, derived, perimeter_lf, vertical_lf).
    """
    says = F.coalesce(*[F.col(k).cast("string") for k in KNOBS]).isNotNull()
    sound = F.col("multiplier").isNull() | (F.col("multiplier") > 0)
    last = edits.where(says & sound).groupBy(tag_key(F.col("finish_tag")).alias("of_tag")).agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("seq"))).alias(f"new_{k}") for k in KNOBS])
    bad = edits.where(~(says & sound)).select(tag_key(F.col("finish_tag")).alias("bad_tag")).distinct()
    joined = conditions.join(last, tag_key(F.col("finish_tag")) == F.col("of_tag"), "left").join(bad, tag_key(F.col("finish_tag")) == F.col("bad_tag"), "left")
    outcome = F.when(F.col("of_tag").isNotNull(), "edited").when(F.col("bad_tag").isNotNull(), "refused").otherwise("untouched")
    new = joined.select(*[c for c in conditions.columns if c not in KNOBS], *[F.coalesce(f"new_{k}", k).alias(k) for k in KNOBS], outcome.alias("outcome"), (F.col("new_rise_ft").isNotNull() | F.col("new_drop_ft").isNotNull()).alias("reflow"))
    return new.drop("reflow"), reflowed(shapes, new.where("reflow"))


def reflowed(shapes: DataFrame, conditions: DataFrame) -> DataFrame:
    """Shapes with the linear runs of these conditions (id, rise_ft, drop_ft) priced anew from their plan feet and legs."""
    c = conditions.select(F.col("id").alias("of_condition"), F.col("rise_ft").alias("c_rise"), F.col("drop_ft").alias("c_drop"))
    joined = shapes.join(c, (F.col("condition_id") == F.col("of_condition")) & (F.col("measure_role") == "linear"), "left")
    up = F.when(F.coalesce(F.col("derived"), F.lit(False)), F.lit(0.0)).otherwise(legs(F.col("rise_ft"), F.col("drop_ft"), F.col("c_rise"), F.col("c_drop")))
    hit = F.col("of_condition").isNotNull()
    priced = {"perimeter_lf": F.when(hit, round2_fixed(F.col("plan_lf") + up)).otherwise(F.col("perimeter_lf")), "vertical_lf": F.when(hit, F.when(up > 0, round2_fixed(up))).otherwise(F.col("vertical_lf"))}
    return joined.select(*[priced[c].alias(c) if c in priced else F.col(c) for c in shapes.columns])


def propose_edits(conditions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Condition-edit proposals (seq, finish_tag, new_tag, rationale and knobs) that stand: one a condition, the last; others are refused with the
    reason: unknown condition, no rationale, nothing that differs, or a tag that another condition has."""
    c = conditions.select(F.col("id").alias("condition_id"), tag_key(F.col("finish_tag")).alias("own_key"), *[F.col(k).alias(f"c_{k}") for k in KNOBS])
    other = conditions.select(tag_key(F.col("finish_tag")).alias("other_key"), F.col("id").alias("other_id"))
    joined = proposals.join(c, tag_key(F.col("finish_tag")) == F.col("own_key"), "left").join(other, tag_key(F.col("new_tag")) == F.col("other_key"), "left")
    differs = F.lit(False)
    for k in KNOBS:
        differs = differs | (F.col(k).isNotNull() & ~F.col(k).eqNullSafe(F.col(f"c_{k}")))
    renamed = F.col("new_tag").isNotNull() & (tag_key(F.col("new_tag")) != F.col("own_key"))
    reason = (
        F.when(F.col("condition_id").isNull(), "no such condition").when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no rationale").when(renamed & F.col("other_id").isNotNull() & (F.col("other_id") != F.col("condition_id")), "tag is taken")
        .when(~(differs | renamed), "nothing differs")
    )
    judged = joined.withColumn("reason", reason)
    last = F.max(F.when(F.col("reason").isNull(), F.col("seq"))).over(Window.partitionBy("condition_id"))
    status = F.when(F.col("reason").isNotNull(), "refused").when(F.col("seq") < last, "replaced").otherwise("pending")
    return judged.withColumn("status", status).select(*proposals.columns, "condition_id", "status", "reason")


# What each kind of note needs to be placed.
NOTE_NEEDS = {"cloud": ["rect"], "highlight": ["rect"], "text": ["at"], "bubble": ["at"], "callout": ["at", "target"], "arrow": ["from", "to"], "dimension": ["from", "to"]}


def annotate(asked: DataFrame, sheets: DataFrame) -> DataFrame:
    """Notes (id, sheet_id, type, text, at, target, rect, from, to, condition_id) with status, reason and a dimension's length: each kind needs its
    points, and a dimension a sheet with a scale. Points are [x, y] in px, rect an array of two."""
    frames = sheets.select(F.col("sheet_id").alias("of_sheet"), F.col("units_per_px").alias("upp"))
    rows = asked.join(frames, F.col("sheet_id") == F.col("of_sheet"), "left")
    reason = F.when(F.col("of_sheet").isNull(), "sheet not loaded").when(~F.col("type").isin(list(NOTE_NEEDS)), "unknown type")
    for kind, needs in NOTE_NEEDS.items():
        for need in needs:
            reason = reason.when((F.col("type") == kind) & F.col(f"`{need}`").isNull(), f"{kind} needs {need}")
    reason = reason.when((F.col("type") == "dimension") & ~F.coalesce(F.col("upp") > 0, F.lit(False)), "sheet has no scale")
    a, b = F.col("`from`"), F.col("`to`")
    feet = round2_fixed(F.hypot(b[0] - a[0], b[1] - a[1]) * F.col("upp"))
    judged = rows.withColumn("reason", reason)
    return judged.select(*[F.col(f"`{c}`") for c in asked.columns], F.when(F.col("reason").isNull(), "placed").otherwise("refused").alias("status"), "reason", F.when((F.col("type") == "dimension") & F.col("reason").isNull(), feet).alias("length_lf"))


def edit_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes (id, text, rfi_id, condition_id) after edits (seq, id, text, condition_id; null: unchanged, "": detached) with outcome: edited,
    linked, refused (it belongs to an RFI's question) or untouched. The last edit of each field stands."""
    last = edits.groupBy(F.col("id").alias("e_id")).agg(F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("e_text"), F.max_by("condition_id", F.when(F.col("condition_id").isNotNull(), F.col("seq"))).alias("e_condition"))
    joined = notes.join(last, F.col("id") == F.col("e_id"), "left")
    asked = F.col("e_text").isNotNull() & ~F.col("e_text").eqNullSafe(F.col("text"))
    held = F.coalesce(F.col("rfi_id"), F.lit("")) != ""
    outcome = F.when(asked & held, "refused").when(asked, "edited").when(F.col("e_condition").isNotNull(), "linked").otherwise("untouched")
    text = F.when(asked & ~held, F.col("e_text")).otherwise(F.col("text"))
    rest = [c for c in notes.columns if c not in ("text", "condition_id")]
    return joined.select(*rest, text.alias("text"), F.coalesce("e_condition", "condition_id").alias("condition_id"), outcome.alias("outcome"))


def list_notes(notes: DataFrame, conditions: DataFrame, verdicts: DataFrame, shapes: DataFrame) -> DataFrame:
    """Notes and verdicts as one listing: (kind, id, sheet_id, condition, text); a verdict's condition is its shape's."""
    tag = conditions.select(F.col("id").alias("of_condition"), "finish_tag")
    a = notes.join(tag, F.col("condition_id") == F.col("of_condition"), "left").select(F.lit("note").alias("kind"), "id", "sheet_id", F.coalesce("finish_tag", F.lit("")).alias("condition"), F.coalesce("text", F.lit("")).alias("text"))
    on = shapes.select(F.col("id").alias("of_shape"), F.col("condition_id").alias("shape_condition")).join(tag, F.col("shape_condition") == F.col("of_condition"), "left")
    b = verdicts.join(on, F.col("shape_id") == F.col("of_shape"), "left").select(F.lit("verdict").alias("kind"), "id", "sheet_id", F.coalesce("finish_tag", F.lit("")).alias("condition"), F.coalesce("text", F.lit("")).alias("text"))
    return a.unionByName(b)


def fold_verdicts(existing: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, refused) after commands (seq, op add/delete/replace, id, actor, sheet_id, shape_id, text): the last command of an id decides; an
    actor that isn't known is refused, and so is a second verdict on a shape."""
    known = F.col("actor").isin(ACTORS) | (F.col("op") == "delete")
    last = commands.where(known).groupBy("id").agg(F.max_by(F.struct("op", "actor", "sheet_id", "shape_id", "text", "seq"), "seq").alias("c"))
    kept = existing.join(last.select("id"), "id", "left_anti").select("id", "actor", "sheet_id", "shape_id", "text", F.lit(-1).cast("long").alias("seq"))
    new = last.where("c.op <> 'delete'").select("id", "c.actor", "c.sheet_id", "c.shape_id", "c.text", F.col("c.seq").cast("long").alias("seq"))
    place = F.row_number().over(Window.partitionBy(F.coalesce(F.col("shape_id").cast("string"), F.concat(F.lit("none:"), F.col("id").cast("string")))).orderBy("seq", "id"))
    ranked = kept.unionByName(new).withColumn("place", place)
    refused = ranked.where("place > 1").select("id", F.lit("shape has a verdict").alias("reason")).unionByName(commands.where(~known).select("id", F.lit("unknown actor").alias("reason")))
    return ranked.where("place = 1").drop("place", "seq"), refused


LIBRARY_FIELDS = ["name", "unit", "per", "basis", "round", "note"]


def library_state(lines: DataFrame, library: DataFrame) -> DataFrame:
    """Lines (id, lib_id and fields) with the names of the fields that differ from their library entry (overridden); a missing basis is area,
    missing rounding is on, a missing number 0, missing text empty. Lines without an entry override nothing."""
    entry = library.select(F.col("id").alias("of_entry"), *[F.col(f).alias(f"l_{f}") for f in LIBRARY_FIELDS])
    joined = lines.join(entry, F.col("lib_id") == F.col("of_entry"), "left")
    blank = {"per": F.lit(0.0), "basis": F.lit("area"), "round": F.lit(True)}
    differs = [F.when(F.col("of_entry").isNotNull() & (F.coalesce(F.col(f), blank.get(f, F.lit(""))) != F.coalesce(F.col(f"l_{f}"), blank.get(f, F.lit("")))), F.lit(f)) for f in LIBRARY_FIELDS]
    return joined.withColumn("overridden", F.array_compact(F.array(*differs))).drop("of_entry", *[f"l_{f}" for f in LIBRARY_FIELDS])


def push_library(lines: DataFrame, library: DataFrame) -> DataFrame:
    """Lines with all fields of their library entry, those without one as they are."""
    entry = library.select(F.col("id").alias("of_entry"), *[F.col(f).alias(f"l_{f}") for f in LIBRARY_FIELDS])
    joined = lines.join(entry, F.col("lib_id") == F.col("of_entry"), "left")
    linked = F.col("of_entry").isNotNull()
    return joined.select(*[F.when(linked, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) if c in LIBRARY_FIELDS else F.col(c) for c in lines.columns])


def revert_fields(lines: DataFrame, library: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines with the asked fields (id, field) put back to their library entry's. Rate and note belong together: either brings both back."""
    fields = asked.groupBy(F.col("id").alias("of_line")).agg(F.collect_set("field").alias("fields"))
    both = F.when(F.arrays_overlap("fields", F.array(F.lit("per"), F.lit("note"))), F.array_union("fields", F.array(F.lit("per"), F.lit("note")))).otherwise(F.col("fields"))
    wanted = fields.select("of_line", both.alias("fields"))
    entry = library.select(F.col("id").alias("of_entry"), *[F.col(f).alias(f"l_{f}") for f in LIBRARY_FIELDS])
    joined = lines.join(wanted, F.col("id") == F.col("of_line"), "left").join(entry, F.col("lib_id") == F.col("of_entry"), "left")
    back = lambda f: F.col("of_entry").isNotNull() & F.coalesce(F.array_contains("fields", f), F.lit(False))
    return joined.select(*[F.when(back(c), F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) if c in LIBRARY_FIELDS else F.col(c) for c in lines.columns])


def duplicate_conditions(conditions: DataFrame, asked: DataFrame) -> DataFrame:
    """Twins of conditions (asked: finish_tag, label), with status and reason: a twin's tag is its source's and the label, and no other's. Twins follow
    their source (variant_of) and share its family."""
    from plumbline.operators.drawing import variant_tag

    source = conditions.select(F.col("id").alias("variant_of"), tag_key(F.col("finish_tag")).alias("of_tag"), F.col("finish_tag").alias("source_tag"), "family_id")
    rows = asked.join(source, tag_key(F.col("finish_tag")) == F.col("of_tag"), "left").withColumn("tag", variant_tag(F.col("source_tag"), F.col("label")))
    taken = conditions.select(tag_key(F.col("finish_tag")).alias("taken")).distinct()
    once = F.row_number().over(Window.partitionBy(tag_key(F.col("tag"))).orderBy("label"))
    judged = rows.withColumn("again", once).join(taken, tag_key(F.col("tag")) == F.col("taken"), "left")
    reason = F.when(F.col("variant_of").isNull(), "no such condition").when(F.trim(F.coalesce("label", F.lit(""))) == "", "no label").when(F.col("taken").isNotNull() | (F.col("again") > 1), "tag is taken")
    return judged.select("finish_tag", "label", "tag", "variant_of", F.coalesce("family_id", F.col("variant_of").cast("string")).alias("family_id"), F.when(reason.isNull(), "minted").otherwise("refused").alias("status"), reason.alias("reason"))


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, distance) of points (sheet_id, id, x, y) of a sheet within radius of each other, ids ascending."""
    rows = points.select("sheet_id", "id", "x", "y")
    box = rows.withColumns({"x0": F.col("x") - radius / 2, "y0": F.col("y") - radius / 2, "x1": F.col("x") + radius / 2, "y1": F.col("y") + radius / 2})
    away = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return meeting(box, box).where((F.col("a.id") < F.col("b.id")) & (away <= radius)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), away.alias("distance"))


__all__ = ["annotate", "boxed", "commit", "duplicate_conditions", "edit_conditions", "edit_notes", "fold_proposals", "fold_verdicts", "library_state", "list_notes", "measure", "near_pairs", "proposal_rows", "propose_edits", "push_library", "quantities", "reflowed", "revert_fields", "revise", "withdraw"]
