"""Three-way merge of keyed records, and merging an imported takeoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.keys import tag_key
from plumbline.plans.scratch import shuffled


def stamp(updated: Column, created: Column) -> Column:
    """The comparable edit time: ISO text, compared as text."""
    return F.coalesce(F.nullif(updated, F.lit("")), F.nullif(created, F.lit("")), F.lit(""))


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """The merged records with what was decided about each key.

    Each side holds key, body (the record in canonical form, without any preserved loser) and stamp. Added on one side:
    kept. Deleted against untouched: deleted; against edited: the edit stays. Edited on both: the later stamp wins, ties
    go to remote, the loser is kept beside it. decision: kept, local, remote, deleted or conflict; deleted rows stay in
    the result with a null body, so that a caller sees them.
    """
    side = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), F.col("body").alias(f"{s}_body"), F.col("stamp").alias(f"{s}_stamp"))
    b, l, r = side(base, "b"), side(local, "l"), side(remote, "r")
    both = l.join(r, F.col("l_key") == F.col("r_key"), "full").withColumn("k", F.coalesce("r_key", "l_key"))
    every = both.join(b, F.col("k") == F.col("b_key"), "full").withColumn("k", F.coalesce("k", "b_key"))
    has = {s: F.col(f"{s}_key").isNotNull() for s in "blr"}
    touched = {s: ~F.col(f"{s}_body").eqNullSafe(F.col("b_body")) for s in "lr"}
    equal = F.col("l_body").eqNullSafe(F.col("r_body"))
    fight = F.when(F.col("l_stamp") > F.col("r_stamp"), "local").otherwise("remote")
    added = F.when(has["l"] & has["r"], F.when(equal, "kept").otherwise(F.concat(F.lit("conflict:"), fight))).when(has["l"], "local").otherwise("remote")
    decision = (
        F.when(~has["b"], added)
        .when(~has["l"] & ~has["r"], "deleted")
        .when(~has["l"], F.when(touched["r"], "remote").otherwise("deleted"))
        .when(~has["r"], F.when(touched["l"], "local").otherwise("deleted"))
        .when(~touched["l"] & ~touched["r"], "kept")
        .when(~touched["l"], "remote")
        .when(~touched["r"], "local")
        .when(equal, "kept")
        .otherwise(F.concat(F.lit("conflict:"), fight))
    )
    out = every.withColumn("d", decision)
    local_wins = F.col("d").isin("local", "conflict:local")
    body = F.when(F.col("d") == "deleted", F.lit(None)).when(local_wins, F.col("l_body")).otherwise(F.coalesce("r_body", "l_body"))
    loser = F.when(F.col("d") == "conflict:local", F.col("r_body")).when(F.col("d") == "conflict:remote", F.col("l_body"))
    return out.select(F.col("k").alias(key), body.alias("body"), loser.alias("merge_loser"), F.substring_index("d", ":", 1).alias("decision"), F.when(F.col("d").startswith("conflict"), F.substring_index("d", ":", -1)).alias("winner"))


def merge_scalar(base: Column, local: Column, remote: Column) -> Column:
    """The side that changed since the base; remote if both or neither did."""
    return F.when(~local.eqNullSafe(base) & remote.eqNullSafe(base), local).otherwise(remote)


def reimported_sheets(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Sheets on which both sides deleted records of the base and both added others: (sheet_id, four counts). All hold id, sheet_id."""
    flags = lambda df, s: df.select("id", F.col("sheet_id").alias(f"{s}_sheet"), F.lit(1).alias(s))
    every = flags(base, "b").join(flags(local, "l"), "id", "full").join(flags(remote, "r"), "id", "full")
    sheet = F.coalesce("b_sheet", "r_sheet", "l_sheet")
    no = lambda s: F.col(s).isNull()
    yes = lambda s: F.col(s).isNotNull()
    counts = every.groupBy(sheet.alias("sheet_id")).agg(
        F.count_if(yes("b") & no("l")).alias("local_deleted"), F.count_if(yes("b") & no("r")).alias("remote_deleted"), F.count_if(no("b") & yes("l")).alias("local_added"), F.count_if(no("b") & yes("r")).alias("remote_added")
    )
    return counts.where("local_deleted > 0 AND remote_deleted > 0 AND local_added > 0 AND remote_added > 0")


def same_payload(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same (key, body) rows, repeats counted."""
    marked = a.select("id", "body", F.lit(1).alias("n")).unionByName(b.select("id", "body", F.lit(-1).alias("n")))
    left_over = marked.groupBy("id", "body").agg(F.sum("n").alias("n")).where("n <> 0")
    return left_over.agg((F.count("*") == 0).alias("same"))


def import_conditions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming condition: matched to a current one (or an earlier incoming one) by tag, or added, under the first free
    id if its own is taken: id~2, id~3 and so on. current, incoming: (id, ord, finish_tag).

    Only conditions whose ids or their numbered forms clash are looked at one after the other, those of one stem in a task.
    """
    mine = current.groupBy(tag_key(F.coalesce(F.col("finish_tag"), F.lit(""))).alias("k")).agg(F.max_by("id", "ord").cast("string").alias("current_id"))
    theirs = incoming.select(F.col("id").cast("string").alias("incoming_id"), F.col("ord").alias("incoming_ord"), tag_key(F.coalesce(F.col("finish_tag"), F.lit(""))).alias("tag"))
    joined = theirs.join(mine, F.col("tag") == F.col("k"), "left")
    first = Window.partitionBy("tag").orderBy("incoming_ord", "incoming_id")
    leads = joined.withColumn("lead", F.row_number().over(first))
    matched = leads.where("current_id IS NOT NULL").select("incoming_id", "tag", F.lit("matched").alias("outcome"), F.col("current_id").alias("target_id"))
    added = leads.where("current_id IS NULL AND lead = 1").select(F.col("incoming_id"), "incoming_ord", "tag")
    stem = lambda c: F.regexp_replace(c, "(~[0-9]+)+$", "")
    taken = current.select(stem(F.col("id").cast("string")).alias("stem"), F.lit(None).cast("long").alias("place"), F.col("id").cast("string").alias("wanted"))
    asked = added.select(stem(F.col("incoming_id")).alias("stem"), F.col("incoming_ord").cast("long").alias("place"), F.col("incoming_id").alias("wanted"))

    def named(frame):
        import pandas as pd

        held = set(frame.loc[frame["place"].isna(), "wanted"])
        out = []
        for wanted in frame[frame["place"].notna()].sort_values(["place", "wanted"])["wanted"]:
            target, n = wanted, 2
            while target in held:
                target, n = f"{wanted}~{n}", n + 1
            held.add(target)
            out.append((wanted, target))
        return pd.DataFrame(out, columns=["wanted", "target_id"])

    clashing = asked.join(taken.select("stem").distinct(), "stem", "left_semi")
    stems = clashing.select("stem").distinct()
    fresh = asked.join(stems, "stem", "left_anti").select("wanted", F.col("wanted").alias("target_id"))
    renamed = taken.join(stems, "stem", "left_semi").unionByName(clashing).groupBy("stem").applyInPandas(named, "wanted string, target_id string")
    new = added.join(fresh.unionByName(renamed), F.col("incoming_id") == F.col("wanted")).select("incoming_id", "tag", F.lit("added").alias("outcome"), "target_id")
    followers = leads.where("current_id IS NULL AND lead > 1").select("incoming_id", "tag").join(new.select(F.col("tag").alias("n_tag"), F.col("target_id")), F.col("tag") == F.col("n_tag"))
    rest = followers.select("incoming_id", "tag", F.lit("matched").alias("outcome"), "target_id")
    return matched.unionByName(new).unionByName(rest).select("incoming_id", "outcome", "target_id")


def import_new(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key isn't there yet; importing twice adds nothing."""
    return incoming.dropDuplicates([key]).join(shuffled(current.select(key)), key, "left_anti")


def reparented(conditions: DataFrame, named: DataFrame) -> DataFrame:
    """Added conditions (id, variant_of, ...) under their target ids: a variant follows its parent if that was added too, else it is
    detached and keeps its materials as its own (detached is true). named: import_conditions()."""
    target = lambda p: named.select(F.col("incoming_id").alias(f"{p}_of"), F.col("outcome").alias(f"{p}_outcome"), F.col("target_id").alias(f"{p}_target"))
    mine = conditions.join(target("own"), F.col("id").cast("string") == F.col("own_of")).where("own_outcome = 'added'")
    both = mine.join(target("parent"), F.col("variant_of").cast("string") == F.col("parent_of"), "left")
    follows = F.col("parent_outcome") == "added"
    rest = [c for c in conditions.columns if c not in ("id", "variant_of")]
    return both.select(F.col("own_target").alias("id"), F.when(follows, F.col("parent_target")).alias("variant_of"), (F.col("variant_of").isNotNull() & ~F.coalesce(follows, F.lit(False))).alias("detached"), *rest)


def import_takeoff(current: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The project after an import, and a note of what happened. Both hold sheets (sheet_id, units_per_px), conditions (id, ord,
    finish_tag, multiplier, variant_of), shapes (id, sheet_id, condition_id, measure_role, reviewed) and, if they like, markups, rfis,
    proposals and approvals (id, ...).

    Into a project without work (shapes, markups, approvals, scales) the import replaces it. Else it adds: the operator's conditions,
    scales and records win; new ones come under free ids, shapes follow their conditions. Refused as a whole (an exception, nothing
    imported): a multiplier that isn't positive, or new measured shapes on a sheet whose scales disagree. Importing again adds
    nothing.
    """
    from plumbline.operators.summaries import valid_multiplier

    bad = [r["finish_tag"] for r in incoming["conditions"].where(~valid_multiplier(F.col("multiplier"))).select("finish_tag").limit(20).collect()]
    if bad:
        raise ValueError(f"multiplier must be positive: {', '.join(map(str, bad))}; nothing was imported")
    extras = [m for m in ("markups", "rfis", "proposals", "approvals") if m in incoming]
    fresh = import_new(current["shapes"], incoming["shapes"])
    scales = current["sheets"].where("units_per_px > 0").select("sheet_id", F.col("units_per_px").alias("own"))
    other = incoming["sheets"].groupBy(F.col("sheet_id").alias("their_sheet")).agg(F.max("units_per_px").alias("theirs"))
    used = fresh.where("measure_role <> 'count'").select("sheet_id").distinct().join(scales, "sheet_id").join(other, F.col("sheet_id") == F.col("their_sheet"), "left")
    wide = ~F.coalesce((F.col("theirs") > 0) & (F.abs(F.col("own") - F.col("theirs")) <= 1e-9 * F.greatest("own", "theirs")), F.lit(False))
    conflict = used.where(wide).select("sheet_id").orderBy("sheet_id").limit(20).collect()
    if conflict:
        raise ValueError(f"scales conflict on {', '.join(str(r['sheet_id']) for r in conflict)}; nothing was imported")
    work = [current["shapes"], current.get("markups"), current.get("approvals"), scales]
    pending = F.count_if(~F.coalesce(F.col("reviewed"), F.lit(True)))
    if all(df is None or df.isEmpty() for df in work):
        n = incoming["shapes"].agg(F.count("*"), pending).first()
        return dict(incoming), {"replaced": True, "shapes_added": n[0], "shapes_pending": n[1], "conditions_added": incoming["conditions"].count(), "conditions_merged": 0}
    named = import_conditions(current["conditions"], incoming["conditions"])
    lookup = named.select(F.col("incoming_id").alias("of_condition"), F.col("target_id"))
    shapes = fresh.join(lookup, F.col("condition_id").cast("string") == F.col("of_condition"), "left").withColumn("condition_id", F.coalesce("target_id", F.col("condition_id").cast("string"))).drop("of_condition", "target_id")
    out = {
        "conditions": current["conditions"].withColumns({"id": F.col("id").cast("string"), "variant_of": F.col("variant_of").cast("string")}).unionByName(reparented(incoming["conditions"], named).drop("detached"), allowMissingColumns=True),
        "shapes": current["shapes"].withColumn("condition_id", F.col("condition_id").cast("string")).unionByName(shapes, allowMissingColumns=True),
        "sheets": current["sheets"].unionByName(import_new(current["sheets"], incoming["sheets"].where("units_per_px IS NOT NULL"), "sheet_id"), allowMissingColumns=True),
    }
    for member in extras:
        new = import_new(current[member], incoming[member]) if member in current else incoming[member]
        out[member] = current[member].unionByName(new, allowMissingColumns=True) if member in current else new
    n, kinds = fresh.agg(F.count("*"), pending).first(), {r["outcome"]: r["count"] for r in named.groupBy("outcome").count().collect()}
    return out, {"replaced": False, "shapes_added": n[0], "shapes_pending": n[1], "conditions_added": kinds.get("added", 0), "conditions_merged": kinds.get("matched", 0)}


def scale_conflicts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sheets calibrated on both sides by scales further apart than one part in a billion: any of them refuses an import."""
    both = current.select("sheet_id", F.col("units_per_px").alias("current_upp")).join(incoming.select("sheet_id", F.col("units_per_px").alias("incoming_upp")), "sheet_id")
    wide = F.abs(F.col("current_upp") - F.col("incoming_upp")) > 1e-9 * F.greatest(F.abs("current_upp"), F.abs("incoming_upp"))
    return both.where(wide)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a key, the first of each."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("place", place).where("place = 1").drop("place")
