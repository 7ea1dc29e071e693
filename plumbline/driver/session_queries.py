"""Commands of sessions, imports, sync, archives and other sources and sinks, over orders and parts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from plumbline.driver.drawing_queries import _SPANS, spans
from plumbline.driver.plan_queries import box
from plumbline.driver.registry import query, table
from plumbline.operators import merge, summaries, sync, totals, workspace
from plumbline.plans import projection as p
from plumbline.plans.scratch import kept, scratch
from plumbline.sources import archive, workbook
from plumbline.sources.takeoff import exploded, parse_documents, write_guarded
from plumbline.streaming import capture


def part(spark, sf):
    return table(spark, sf, "part").withColumns({"k": F.col("p_partkey"), "s": F.col("p_size").cast("long")})


_VERDICTS = """WITH k AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AND ((p_partkey % 5 = 0 AND p_partkey % 4 <> 0) OR p_partkey % 3 <> 0) AS stands FROM part), o AS (SELECT a.k, a.k - 1 AS shape, coalesce(b.stands, false) AS held FROM k a LEFT JOIN k b ON b.k = a.k - 1 WHERE a.k % 2 = 1)"""


def verdicts(spark, sf):
    k = F.col("k")

    def row(seq, op, actor, shape):
        who = F.lit(actor) if isinstance(actor, str) else actor
        return (F.lit(seq).cast("long") + k * 10).alias("seq"), F.lit(op).alias("op"), k.alias("id"), who.alias("actor"), F.lit(1).alias("sheet_id"), shape.alias("shape_id"), F.lit("t").alias("text")

    parts = part(spark, sf)
    existing = parts.where("k % 2 = 0").select(k.alias("id"), F.lit("agent").alias("actor"), F.lit(1).alias("sheet_id"), k.alias("shape_id"), F.lit("t").alias("text"))
    gone, changed, added = parts.where("k % 3 = 0 AND k % 2 = 0"), parts.where("k % 5 = 0 AND k % 2 = 0"), parts.where("k % 2 = 1")
    actor = F.when(k % 4 == 0, "stranger").otherwise("reviewer")
    commands = gone.select(*row(1, "delete", "agent", k)).unionByName(changed.select(*row(2, "replace", actor, k))).unionByName(added.select(*row(3, "add", "estimator", k - 1)))
    return workspace.fold_verdicts(existing, commands)


@query("M02_folded_verdicts", _VERDICTS + "SELECT k AS id, CASE WHEN k % 5 = 0 AND k % 4 <> 0 THEN 'reviewer' ELSE 'agent' END AS actor, k AS shape_id FROM k WHERE stands UNION ALL SELECT k, 'estimator', shape FROM o WHERE NOT held")
def m02(spark, sf):
    """Verdicts after their commands: one on a shape, known actors only, the last command of each."""
    return verdicts(spark, sf)[0].select("id", "actor", "shape_id")


@query("M02_refused_verdicts", _VERDICTS + "SELECT k AS id, 'shape has a verdict' AS reason FROM o WHERE held UNION ALL SELECT k, 'unknown actor' FROM k WHERE k % 20 = 0")
def m02_refused(spark, sf):
    return verdicts(spark, sf)[1]


@query("M03_committed_shapes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'refused' WHEN p_partkey % 6 = 1 THEN 'refused' ELSE 'committed' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 'prints another area' WHEN p_partkey % 6 = 1 THEN 'shares floor already measured' ELSE '' END AS reason, CASE WHEN p_partkey % 2 = 0 THEN 'P1' ELSE '' END AS proposal_id, CASE WHEN p_partkey % 2 = 0 THEN 'asserted' ELSE '' END AS assignment FROM part")
def m03(spark, sf):
    """Floors by agents and persons: some disagree with their stamp, some lie on a committed floor of their condition."""
    parts, k = part(spark, sf), F.col("k")
    asked = parts.select(k.alias("id"), (k % 50).alias("sheet_id"), F.lit("cpt-1").alias("tag"), F.lit("floor_area").alias("role"), box(k * 20, 0, k * 20 + 10, 10).alias("ring"), F.when(k % 2 == 0, "agent").otherwise("estimator").alias("actor"), F.lit("draw").alias("method"), F.lit(None).cast("string").alias("assignment"))
    there = parts.where("k % 6 = 1 OR k % 6 = 3").select((k + 10_000_000).alias("id"), (k % 50).alias("sheet_id"), F.when(k % 6 == 1, " CPT-1").otherwise("CPT-2").alias("tag"), F.lit("floor_area").alias("role"), box(k * 20 + 2, 0, k * 20 + 9, 10).alias("ring"))
    checks = parts.where("k % 4 = 0").select(k.alias("id"), F.lit("refused").alias("status"), F.lit("prints another area").alias("reason"))
    found = workspace.commit(asked, there, checks, "P1")
    return found.select("id", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "proposal_id", "assignment")])


@query("M06_measured", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN 'no scale' WHEN p_partkey % 3 = 2 AND p_partkey % 2 = 0 THEN 'no height' ELSE 'measured' END AS status, CASE WHEN p_partkey % 5 = 4 OR (p_partkey % 3 = 2 AND p_partkey % 2 = 0) THEN -1.0 WHEN p_partkey % 3 = 0 THEN p_size * 4.0 WHEN p_partkey % 3 = 1 THEN 0.0 ELSE (2 + 2 * p_size) * 9.0 END::DOUBLE AS area_sf, CASE WHEN p_partkey % 5 = 4 OR (p_partkey % 3 = 2 AND p_partkey % 2 = 0) THEN -1.0 WHEN p_partkey % 3 = 0 THEN 2.0 * p_size + 8 WHEN p_partkey % 3 = 1 THEN 2.0 + 2 * p_size + 3 ELSE 2.0 + 2 * p_size END::DOUBLE AS perimeter_lf FROM part")
def m06(spark, sf):
    """Floors, runs with a rise, and walls, on scaled sheets and others."""
    parts, k, s = part(spark, sf), F.col("k"), F.col("s").cast("double")
    role = F.when(k % 3 == 0, "floor_area").when(k % 3 == 1, "linear").otherwise("surface_area")
    at = lambda *xy: F.array(*[F.array(F.lit(a).cast("double") if not hasattr(a, "cast") else a, F.lit(b).cast("double") if not hasattr(b, "cast") else b) for a, b in xy])
    ring = F.when(k % 3 == 0, box(0, 0, s * 2, 8)).otherwise(at((0, 0), (4, 0), (4, s * 4)))
    asked = parts.select(k.alias("id"), (k % 5).alias("sheet_id"), role.alias("role"), ring.alias("ring"), F.array().cast("array<array<array<double>>>").alias("holes"), F.when(k % 2 == 1, "wt-1").alias("tag"), F.lit(None).cast("double").alias("height_ft"), F.lit(3.0).alias("rise_ft"), F.lit(None).cast("double").alias("drop_ft"))
    sheets = spark.createDataFrame([(i, 0.5 if i < 4 else None) for i in range(5)], "sheet_id long, units_per_px double")
    conditions = spark.createDataFrame([("WT-1", 9.0, None, None)], "finish_tag string, height_ft double, rise_ft double, drop_ft double")
    found = workspace.measure(asked, sheets, conditions)
    status = F.when(F.col("reason") == "sheet has no scale", "no scale").when(F.col("reason") == "surface has no height", "no height").otherwise(F.col("status"))
    return found.select("id", status.alias("status"), F.coalesce("area_sf", F.lit(-1.0)).alias("area_sf"), F.coalesce("perimeter_lf", F.lit(-1.0)).alias("perimeter_lf"))


def proposals(spark, sf):
    c = F.col("c_custkey")
    customer = table(spark, sf, "customer")
    opened = customer.select((c * 2).alias("seq"), F.lit("propose").alias("op"), c.alias("proposal_id"), F.when(c % 7 == 0, " ").otherwise(F.col("c_name")).alias("label"), F.lit("as drawn").alias("rationale"))
    gone = customer.where("c_custkey % 3 = 0").select((c * 2 + 1).alias("seq"), F.lit("withdraw").alias("op"), c.alias("proposal_id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("rationale"))
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("proposal_id"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    return workspace.fold_proposals(opened.unionByName(gone)), shapes


@query("M07_proposal_rows", "SELECT c_custkey AS proposal_id, c_name AS label, c_custkey % 3 = 0 AS withdrawn, count(o_orderkey) FILTER (o_orderstatus <> 'F') AS pending, count(o_orderkey) FILTER (o_orderstatus = 'F') AS accepted FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY ALL")
def m07(spark, sf):
    """Proposals with a label, and what of theirs is pending and accepted."""
    folded, shapes = proposals(spark, sf)
    return workspace.proposal_rows(folded, shapes).select("proposal_id", "label", "withdrawn", "pending", "accepted")


@query("M07_revised_shapes", "WITH r AS (SELECT c_custkey AS c, c_custkey % 4 = 0 AND c_custkey % 8 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AS taken FROM customer) SELECT o_custkey AS proposal_id, count(*) FILTER (NOT taken OR o_orderstatus = 'F') + max(CASE WHEN taken THEN 1 ELSE 0 END) AS shapes FROM orders JOIN r ON c = o_custkey GROUP BY 1, taken HAVING shapes > 0 UNION ALL SELECT c, 1 FROM r WHERE taken AND c NOT IN (SELECT o_custkey FROM orders)")
def m07_revised(spark, sf):
    """Replacements of open proposals, taken whole; one with a ring of two points isn't."""
    folded, shapes = proposals(spark, sf)
    c = F.col("c_custkey")
    ring = F.when(c % 8 == 0, F.slice(box(0, 0, 5, 5), 1, 2)).otherwise(box(0, 0, 5, 5))
    fresh = table(spark, sf, "customer").where("c_custkey % 4 = 0").select((-c).alias("id"), c.alias("proposal_id"), F.lit("floor_area").alias("role"), ring.alias("ring"))
    return workspace.revise(shapes, fresh, folded).groupBy("proposal_id").agg(F.count("*").alias("shapes"))


def knobs(spark, sf):
    d = lambda v: F.lit(v).cast("double")
    conditions = part(spark, sf).select(F.col("k").alias("id"), F.concat(F.lit("T-"), F.col("k").cast("string")).alias("finish_tag"), d(0).alias("waste_pct"), d(1).alias("multiplier"), d(None).alias("height_ft"), d(1).alias("rise_ft"), d(None).alias("drop_ft"))
    tag = F.concat(F.lit(" t-"), F.col("k").cast("string")).alias("finish_tag")
    edit = lambda seq, **v: (F.lit(seq).alias("seq"), tag, *[d(v.get(c)).alias(c) for c in workspace.KNOBS])
    parts = part(spark, sf)
    edits = parts.where("k % 2 = 0").select(*edit(1, waste_pct=5, rise_ft=2)).unionByName(parts.where("k % 4 = 0").select(*edit(2, rise_ft=4))).unionByName(parts.where("k % 3 = 0").select(*edit(3, multiplier=-1))).unionByName(parts.where("k % 5 = 0").select(*edit(4)))
    k = F.col("k")
    shapes = parts.select(k.alias("id"), k.alias("condition_id"), F.when(k % 7 == 0, "floor_area").otherwise("linear").alias("measure_role"), F.col("s").cast("double").alias("plan_lf"), F.when(k % 11 == 0, 0.5).alias("rise_ft"), d(None).alias("drop_ft"), (k % 13 == 0).alias("derived"), (F.col("s") + 1.0).alias("perimeter_lf"), d(1).alias("vertical_lf"))
    return workspace.edit_conditions(conditions, edits, shapes)


@query("M09_edited_conditions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS waste_pct, CASE WHEN p_partkey % 4 = 0 THEN 4.0 WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS rise_ft, CASE WHEN p_partkey % 2 = 0 THEN 'edited' WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'refused' ELSE 'untouched' END AS outcome FROM part")
def m09(spark, sf):
    """The last value of each knob; edits that name none, or a multiplier below 0, are refused."""
    return knobs(spark, sf)[0].select("id", "waste_pct", "rise_ft", "outcome")


@query("D12_reflowed_runs", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 OR p_partkey % 7 = 0 THEN p_size + 1.0 WHEN p_partkey % 13 = 0 THEN p_size WHEN p_partkey % 11 = 0 THEN p_size + 0.5 WHEN p_partkey % 4 = 0 THEN p_size + 4.0 ELSE p_size + 2.0 END::DOUBLE AS perimeter_lf FROM part")
def d12(spark, sf):
    """Runs after their condition's rise was edited: their own legs win, derived runs take none."""
    return knobs(spark, sf)[1].select("id", "perimeter_lf")


@query("M11_reverted_fields", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 100.0 ELSE p_size END::DOUBLE AS per, CASE WHEN p_partkey % 3 = 0 THEN 'by the roll' ELSE 'own' END AS note, CASE WHEN p_partkey % 3 = 1 THEN 'gal' ELSE 'ea' END AS unit FROM part")
def m11(spark, sf):
    """Lines with their rate, or their unit, put back to the library's: the rate brings its note along."""
    k = F.col("k")
    lines = part(spark, sf).select(k.alias("id"), F.lit("L1").alias("lib_id"), F.lit("Glue").alias("name"), F.lit("ea").alias("unit"), F.col("s").cast("double").alias("per"), F.lit("area").alias("basis"), F.lit(True).alias("round"), F.lit("own").alias("note"))
    library = spark.createDataFrame([("L1", "Glue", "gal", 100.0, "area", True, "by the roll")], "id string, name string, unit string, per double, basis string, round boolean, note string")
    asked = part(spark, sf).where("k % 3 < 2").select(k.alias("id"), F.when(k % 3 == 0, "per").otherwise("unit").alias("field"))
    return workspace.revert_fields(lines, library, asked).select("id", "per", "note", "unit")


@query("M11_overridden_fields", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size <> 10 THEN 'per' END, CASE WHEN p_partkey % 2 = 0 THEN 'basis' END) AS overridden FROM part")
def m11_overridden(spark, sf):
    """Fields that differ from the library's entry; a missing basis is area."""
    k = F.col("k")
    lines = part(spark, sf).select(k.alias("id"), F.lit("L1").alias("lib_id"), F.lit("Glue").alias("name"), F.lit("gal").alias("unit"), F.col("s").cast("double").alias("per"), F.when(k % 2 == 0, "perimeter").alias("basis"), F.lit(None).cast("boolean").alias("round"), F.lit("").alias("note"))
    library = spark.createDataFrame([("L1", "Glue", "gal", 10.0, "area", True, None)], "id string, name string, unit string, per double, basis string, round boolean, note string")
    return workspace.library_state(lines, library).select("id", F.concat_ws(",", "overridden").alias("overridden"))


@query("M14_notes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 = 0 THEN 'sheet has no scale' WHEN p_partkey % 4 = 1 AND p_partkey % 3 = 0 THEN 'callout needs target' WHEN p_partkey % 4 = 3 THEN 'unknown type' ELSE '' END AS reason, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN p_size * 2.5 ELSE -1.0 END::DOUBLE AS length_lf FROM part")
def m14(spark, sf):
    """Dimensions, callouts, clouds and something else, placed or refused."""
    k, s = F.col("k"), F.col("s").cast("double")
    at = lambda x, y: F.array(x, y)
    zero = F.lit(0.0)
    none = F.lit(None).cast("array<double>")
    asked = part(spark, sf).select(k.alias("id"), (k % 5).alias("sheet_id"), F.element_at(F.array(*[F.lit(t) for t in ("dimension", "callout", "cloud", "stamp")]), (k % 4 + 1).cast("int")).alias("type"), F.lit("t").alias("text"), at(zero, zero).alias("at"), F.when(k % 3 == 0, none).otherwise(at(zero, zero)).alias("target"), F.array(at(zero, zero), at(s, s)).alias("rect"), at(zero, zero).alias("from"), at(s * 3, s * 4).alias("to"), k.alias("condition_id"))
    sheets = spark.createDataFrame([(i, 0.5 if i else None) for i in range(5)], "sheet_id long, units_per_px double")
    return workspace.annotate(asked, sheets).select("id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("length_lf", F.lit(-1.0)).alias("length_lf"))


@query("M14_edited_notes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'second' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS condition_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'refused' WHEN o_orderkey % 3 = 0 THEN 'edited' WHEN o_orderkey % 5 = 0 THEN 'linked' ELSE 'untouched' END AS outcome FROM orders")
def m14_edited(spark, sf):
    """Texts edited twice, and notes detached; what asks an RFI's question keeps its text."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    notes = orders.select(k.alias("id"), F.col("o_orderpriority").alias("text"), F.when(k % 4 == 0, "R1").alias("rfi_id"), F.col("o_custkey").cast("string").alias("condition_id"))
    none = F.lit(None).cast("string")
    edit = lambda where, seq, text, condition: orders.where(where).select(F.lit(seq).alias("seq"), k.alias("id"), text.cast("string").alias("text"), condition.cast("string").alias("condition_id"))
    edits = edit("o_orderkey % 3 = 0", 1, F.lit("first"), none).unionByName(edit("o_orderkey % 3 = 0", 2, F.lit("second"), none)).unionByName(edit("o_orderkey % 5 = 0", 3, none, F.lit("")))
    return workspace.edit_notes(notes, edits).select("id", "text", "condition_id", "outcome")


@query("M14_listed_notes", "SELECT 'note' AS kind, o_orderkey AS id, coalesce(c_name, '') AS condition FROM orders LEFT JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'verdict', l_orderkey * 10 + l_linenumber, coalesce(c_name, '') FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def m14_listed(spark, sf):
    """Notes with their condition's tag, verdicts with their shape's."""
    orders = table(spark, sf, "orders")
    notes = orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("sheet_id"), F.col("o_custkey").alias("condition_id"), F.col("o_orderpriority").alias("text"))
    marks = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit(1).alias("sheet_id"), F.col("l_orderkey").alias("shape_id"), F.lit("t").alias("text"))
    conditions = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("finish_tag"))
    shapes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("condition_id"))
    return workspace.list_notes(notes, conditions, marks, shapes).select("kind", "id", "condition")


_STATES = "WITH s AS (SELECT p_partkey AS project_id, p_partkey % 2 = 0 AS touched, CASE WHEN p_partkey % 3 = 0 THEN 5 + p_partkey % 4 END AS target, p_size % 5 + 3 AS remote, 5 AS synced, p_size % 7 = 0 AS other, p_partkey % 11 <> 0 AS reachable FROM part)"


@query("T03_sync_actions", _STATES + """, a AS (SELECT *, CASE WHEN target IS NOT NULL AND NOT reachable THEN 'wait' WHEN NOT reachable THEN 'idle' WHEN remote = target THEN 'landed' WHEN target IS NOT NULL AND remote = target - 1 THEN 'push' WHEN target IS NOT NULL AND ((remote = synced AND other) OR remote > synced) THEN 'merge' WHEN target IS NOT NULL THEN 'adopt' WHEN remote = synced AND other THEN 'merge' WHEN remote > synced THEN CASE WHEN touched THEN 'merge' ELSE 'adopt' END WHEN remote < synced THEN 'adopt' WHEN touched THEN 'push' ELSE 'idle' END AS action FROM s)
SELECT project_id, action, CASE WHEN action <> 'merge' THEN '' WHEN remote = synced AND other THEN 'empty' ELSE 'synced' END AS merge_base, action = 'adopt' AND touched AS backup FROM a""")
def t03(spark, sf):
    """Projects with and without a push under way, behind, ahead, or forked."""
    k, s = F.col("k"), F.col("s")
    target = F.when(k % 3 == 0, 5 + k % 4)
    rows = part(spark, sf).select(k.alias("project_id"), (k % 2 == 0).alias("touched"), F.lit(5).cast("long").alias("synced_rev"), target.alias("marker_target"), (target - 1).alias("marker_base"), (s % 5 + 3).alias("remote_rev"), F.when(s % 7 == 0, "y").otherwise("x").alias("remote_hash"), F.lit(5).cast("long").alias("base_rev"), F.lit("x").alias("base_hash"), (k % 11 != 0).alias("reachable"))
    return sync.sync_actions(rows).select("project_id", "action", F.coalesce("merge_base", F.lit("")).alias("merge_base"), "backup")


@query("T06_streamed_journals", "SELECT user_id AS session_id, event_type AS id, max(event_id) AS seq, arg_max(value, event_id) AS payload FROM events GROUP BY ALL")
def t06(spark, sf):
    """Journals read as a stream, folded to the last entry of each record."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    rows = stream.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("id"), F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.col("value").alias("payload"))
    return capture.drained(capture.folded(rows), "folded_journals", "complete").select("session_id", "id", "seq", "payload")


@query(
    "T06_undone_journals",
    """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
f AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS height FROM e),
g AS (SELECT *, min(height) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM f),
l AS (SELECT user_id, event_id % 10 AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS payload FROM g WHERE event_type <> 'purchase' AND coalesce(later >= height, TRUE) GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS session_id, 'r' || id AS id, seq, payload FROM l""",
)
def t06_undone(spark, sf):
    """Journals with state of their own: every purchase undoes the entry before it that is still there. The SQL counts the open entries instead: one stays if their number never falls below its own again."""
    from plumbline.streaming import sessions

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    undo = F.col("event_type") == "purchase"
    rows = stream.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(undo, "undo").otherwise("set").alias("op"), F.when(~undo, F.concat(F.lit("r"), (F.col("event_id") % 10).cast("string"))).alias("id"), F.when(~undo, F.col("event_type")).alias("payload"))
    return sessions.records(capture.drained(sessions.journals(rows), "undone_journals", "update"))


@query(
    "T04_expired_presence",
    "WITH d AS (SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) AS state FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS device, last_seen, state, last_seen + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE AS stale FROM d",
)
def t04_expired(spark, sf):
    """Devices whose timers found them silent for three beats of two hours, without a row of theirs."""
    from plumbline.streaming import sessions

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    beats = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").select(F.col("user_id").alias("device"), "ts", F.col("event_type").alias("state"))
    seen = capture.drained(sessions.expiring_presence(beats, 7200.0), "expired_presence", "update")
    last = seen.groupBy("device").agg(F.max("last_seen").alias("last_seen"), F.max_by("state", "last_seen").alias("state"), F.max(F.struct("last_seen", "stale")).alias("final"))
    return last.select("device", "last_seen", "state", F.col("final.stale").alias("stale"))


@query("S19_capture_lines", "SELECT '{\"event_id\":' || CAST(event_id AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN ',\"event_type\":\"' || event_type || '\"' ELSE '' END || '}' AS value FROM events")
def s19(spark, sf):
    """Captures as lines of JSON; empty fields are left out."""
    return capture.jsonl(table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("event_type")))


@query("S20_mirror", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def s20(spark, sf):
    """A mirror written over an older one."""
    path = f"{scratch(spark)}/mirror"
    events = table(spark, sf, "events")
    capture.mirror(events, path)
    capture.mirror(events.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S23_guarded_export", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def s23(spark, sf):
    """An export over an earlier one."""
    path = f"{scratch(spark)}/export"
    events = table(spark, sf, "events")
    write_guarded(events, path)
    write_guarded(events.where("event_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S01_loaded_plans", "SELECT p_partkey AS part, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 1 THEN 'refused' ELSE 'loaded' END AS status, CASE WHEN p_partkey % 7 = 1 THEN 1 WHEN p_partkey % 5 = 0 THEN 1 ELSE p_size % 3 + 1 END AS pages FROM part")
def s01(spark, sf):
    """Plans of one to three pages: some are loaded already, some come twice."""
    k = F.col("k")
    name = F.concat(F.lit("plan"), k.cast("string"), F.lit(".pdf"))
    parts = part(spark, sf)
    catalog = parts.where("k % 7 = 1").select(name.alias("file"), name.alias("sheet_id"))
    sheets = parts.select(F.concat(F.lit("/b/"), name).alias("path"), F.when(k % 5 == 0, 0).otherwise(F.col("s") % 3 + 1).cast("int").alias("pages"))
    found = summaries.load_plans(catalog, sheets)
    number = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    return found.groupBy(number.alias("part"), "status").agg(F.count("*").alias("pages"))


@query("S04_region_text", _SPANS + "SELECT sheet_id, ord, mark AS str FROM s WHERE x0 BETWEEN 10 AND 400 AND y0 BETWEEN 10 AND 400")
def s04(spark, sf):
    """Text that begins in a region."""
    rows = spans(spark, sf).withColumns({"str": F.upper(F.trim("str")), "x": F.col("x0"), "y": F.col("y0")})
    return summaries.region_items(rows, 10.0, 10.0, 400.0, 400.0).select("sheet_id", "ord", "str")


@query("S07_project_texts", "SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS finish_tag FROM part")
def s07(spark, sf):
    """Documents held as text: another schema's, and no document at all, are refused."""
    k = F.col("k")
    good = F.to_json(F.struct(F.lit("takeoff.v1").alias("schema"), F.array(F.struct(k.cast("string").alias("id"), F.col("p_brand").alias("finish_tag"))).alias("conditions")))
    text = F.when(k % 8 == 0, F.lit("[broken")).when(k % 8 == 4, F.regexp_replace(good, "takeoff", "another")).otherwise(good)
    docs = parse_documents(part(spark, sf).select(k.alias("part"), text.alias("document")), tag_prefix="takeoff.")
    return docs.select("part", "status", F.coalesce(F.col("conditions")[0]["finish_tag"], F.lit("")).alias("finish_tag").alias("tag"), "schema").select("part", "status", F.when(F.col("status") == "ok", F.col("tag")).otherwise("").alias("finish_tag"))


@query("S08_archives", "SELECT p_partkey AS part, CASE WHEN p_partkey % 5 = 0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 = 0 THEN 'not an archive' ELSE '' END AS reason, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS project_name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size % 3 END AS plans FROM part")
def s08(spark, sf):
    """Archives packed and read back; some files aren't archives."""

    def packed(frames):
        for f in frames:
            data = [b"no" if k % 5 == 0 else archive.pack(json.dumps({"conditions": []}), {f"p{i}.pdf": b"%PDF" for i in range(s % 3)}, brand) for k, s, brand in zip(f["p_partkey"], f["p_size"], f["p_brand"])]
            yield pd.DataFrame({"part": f["p_partkey"], "content": data})

    files = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand").mapInPandas(packed, "part long, content binary")
    found = archive.read_archives(files)
    return found.select("part", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "project_name")], F.coalesce(F.size("plans"), F.lit(0)).alias("plans")).withColumn("plans", F.greatest("plans", F.lit(0)))


@query("S12_workbook_cells", "SELECT 'Conditions' AS tab, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS row, 'B' AS col, n_name AS value FROM nation UNION ALL SELECT 'Regions', CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS BIGINT), 'B', r_name FROM region UNION ALL SELECT 'Conditions', 1, 'B', 'n_name' UNION ALL SELECT 'Regions', 1, 'B', 'r_name'")
def s12(spark, sf):
    """A workbook of two tabs, written and read back."""
    data = workbook.workbook({"Conditions": table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "Regions": table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")})
    cells = [(tab, row, workbook.column_name(col - 1), text) for tab, row, col, text in workbook.read_cells(data)]
    return spark.createDataFrame(cells, "tab string, row long, col string, value string").where("col = 'B'")


_LAYER = "CASE WHEN p_partkey % 9 = 0 THEN 'PL-UNTAGGED' ELSE 'PL-' || replace(upper(p_brand), '#', '#') || '-' || CAST(p_size AS VARCHAR) END"


@query("S15_entities", f"SELECT p_partkey AS shape_id, CASE WHEN p_partkey % 3 = 2 THEN 'skipped' ELSE 'drawn' END AS status, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE {_LAYER} || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-LINEAR' END END AS layer, CASE WHEN p_partkey % 3 = 2 THEN -1.0 ELSE 50.0 END::DOUBLE AS top FROM part")
def s15(spark, sf):
    """Measured shapes as entities on layers of their tags; a sheet without a scale has none."""
    k, s = F.col("k"), F.col("s")
    shapes = part(spark, sf).select(k.alias("id"), (k % 3).alias("sheet_id"), k.alias("condition_id"), F.when(s % 2 == 0, "floor_area").otherwise("linear").alias("measure_role"), box(0, 0, 0.5, 0.5).alias("verts_norm"), F.lit(None).cast("array<array<array<double>>>").alias("holes_norm"), F.lit(None).cast("long").alias("cuts_shape_id"))
    tag = F.when(k % 9 == 0, " ").otherwise(F.concat(F.col("p_brand"), F.lit("/"), s.cast("string")))
    sheets = spark.createDataFrame([(0, 100.0, 100.0, 0.5), (1, 100.0, 100.0, 0.5), (2, 100.0, 100.0, None)], "sheet_id long, width double, height double, units_per_px double")
    found = archive.entities(shapes, part(spark, sf).select(k.alias("id"), tag.alias("finish_tag")), sheets)
    return found.select("shape_id", "status", F.coalesce("layer", F.lit("")).alias("layer"), F.coalesce(F.array_max(F.transform("points", lambda q: q[1])), F.lit(-1.0)).alias("top"))


@query("U08_imported_takeoffs", "SELECT o_orderkey % 2 = 0 AS theirs, count(*) AS shapes FROM orders GROUP BY 1")
def u08(spark, sf):
    """Odd orders' shapes are there; a takeoff of all of them is imported, twice: what is new comes once."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    shapes = orders.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("sheet"), (k % 5).cast("string")).alias("sheet_id"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("condition_id"), F.lit("floor_area").alias("measure_role"), F.lit(None).cast("boolean").alias("reviewed"))
    conditions = spark.createDataFrame([(f"c{i}", i, f"T-{i}", 1.0, None) for i in range(7)], "id string, ord long, finish_tag string, multiplier double, variant_of string")
    sheets = spark.createDataFrame([(f"sheet{i}", 0.1) for i in range(5)], "sheet_id string, units_per_px double")
    both = {"sheets": sheets, "conditions": conditions}
    once, _ = merge.import_takeoff({**both, "shapes": shapes.where(F.substring("id", 2, 20).cast("long") % 2 == 1)}, {**both, "shapes": shapes})
    again, _ = merge.import_takeoff({member: kept(rows) for member, rows in once.items()}, {**both, "shapes": shapes})
    return again["shapes"].groupBy((F.substring("id", 2, 20).cast("long") % 2 == 0).alias("theirs")).agg(F.count("*").alias("shapes"))


@query("O07_vocabulary_first", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1000000000 ELSE 100000000 END AS place FROM part")
def o07(spark, sf):
    """Values in their vocabulary's order, others after it, none last."""
    values = F.when(F.col("s") % 4 < 3, F.concat(F.lit("v"), (F.col("s") % 4).cast("string")))
    return part(spark, sf).select("p_partkey", totals.label_rank(values, ["v2", "v1"]).alias("place"))


@query("P14_group_columns", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'qty,custom:Phase' ELSE 'qty' END AS shown FROM part")
def p14(spark, sf):
    """The column a report is grouped by is shown with it, even if hidden; one that doesn't exist isn't."""
    asked = {0: "Phase", 1: None, 2: "Gone"}
    shown = {i: ",".join(summaries.with_group_column(["qty"], ["qty", "custom:Phase"], by)) for i, by in asked.items()}
    listed = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])
    return part(spark, sf).select("p_partkey", listed[(F.col("s") % 3).cast("int")].alias("shown"))


@query("X14_scanned_rows", "WITH r AS (SELECT p_partkey AS ord, upper(p_brand) AS finish_tag, CASE p_size % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'ceiling' ELSE 'other' END AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 5 <> 0) SELECT ord, category, category = 'floor' AS suggested FROM r WHERE n = 1")
def x14(spark, sf):
    """Rows of a schedule as a model read them: blank tags go, the first of a tag stays, unknown categories are other."""
    k, s = F.col("k"), F.col("s")
    read = part(spark, sf).select(k.alias("ord"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("finish_tag"), F.lit("a").alias("section"), F.when(s % 3 == 0, " Floor").when(s % 3 == 1, "CEILING").otherwise("roof").alias("category"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("boolean").alias("suggested"))
    return summaries.scanned_rows(read).select("ord", "category", "suggested")
