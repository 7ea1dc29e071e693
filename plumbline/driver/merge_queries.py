"""Revisions, merges, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.driver.totals_queries import R2, order_sql
from plumbline.operators import merge, revisions, totals
from plumbline.plans import projection as p

# Revision A holds the lines shipped before SPLIT; its conditions are all but each seventh, under other ids for each third.
SPLIT = "1995-06-17"
_SUMS = "CAST(sum(r_floor) AS DOUBLE) AS floor, CAST(sum(r_wall) AS DOUBLE) AS wall, CAST(sum(r_border) AS DOUBLE) AS border, CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea, count(*) AS shape_count"


def _sides(spark, sf):
    shapes, conditions = p.shapes(spark, sf), p.conditions(spark, sf)
    old = shapes.where(F.col("ts") < F.lit(SPLIT).cast("timestamp"))
    a = totals.condition_totals(conditions, old).where("id % 7 <> 0").withColumn("id", F.when(F.col("id") % 3 == 0, F.col("id") + 1_000_000_000).otherwise(F.col("id")))
    b = totals.condition_totals(conditions, shapes).where("id % 11 <> 0")
    return a, b


_AB = (
    p.SQL
    + f""", base_b AS (SELECT condition_id, {_SUMS} FROM roles GROUP BY condition_id), base_a AS (SELECT condition_id, {_SUMS} FROM roles WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY condition_id),
a AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN id + 1000000000 ELSE id END AS id) FROM ({order_sql("base_a")}) WHERE id % 7 <> 0), b AS (SELECT * FROM ({order_sql("base_b")}) WHERE id % 11 <> 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY finish_tag ORDER BY ord, id) - 1 AS n FROM a WHERE id NOT IN (SELECT id FROM b)), rb AS (SELECT *, row_number() OVER (PARTITION BY finish_tag ORDER BY ord, id) - 1 AS n FROM b WHERE id NOT IN (SELECT id FROM a)),
"""
)
_F = revisions.FIELDS
_COLS = ", ".join([*[f"a.{c} AS a_{c}" for c in ("id", "finish_tag", "shape_count", *_F)], *[f"b.{c} AS b_{c}" for c in ("id", "finish_tag", "shape_count", *_F)]])
_PAIRS = _AB + f"""pairs AS (SELECT CAST(b.id AS VARCHAR) AS pair_key, {_COLS} FROM a JOIN b ON a.id = b.id
 UNION ALL SELECT CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'tag:' || b.finish_tag || '#' || CAST(b.n AS VARCHAR) ELSE CAST(coalesce(b.id, a.id) AS VARCHAR) END, {_COLS} FROM ra a FULL JOIN rb b ON a.finish_tag = b.finish_tag AND a.n = b.n)
"""
_D = ", ".join(f"{R2(f'(coalesce(b_{f}, 0) - coalesce(a_{f}, 0))')} AS d_{f}" for f in _F)
_VIS = lambda pre: " OR ".join(f"abs(coalesce({pre}{f}, 0)) >= {0.5 if f == 'ea' else 0.05}" for f in _F)


@query("J03_paired_rows", _PAIRS + "SELECT pair_key, coalesce(a_id, -1) AS a_id, coalesce(b_id, -1) AS b_id FROM pairs")
def j03(spark, sf):
    return revisions.pair_rows(*_sides(spark, sf)).select("pair_key", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("a_id", "b_id")])


@query("U01_revision_diff", _PAIRS + f""", d AS (SELECT *, {_D} FROM pairs)
SELECT pair_key, coalesce(b_finish_tag, a_finish_tag) AS finish_tag, CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN CASE WHEN {_VIS('d_')} THEN 'changed' ELSE 'unchanged' END
 WHEN b_id IS NOT NULL THEN CASE WHEN b_shape_count > 0 OR {_VIS('b_')} THEN 'added' ELSE 'unchanged' END ELSE CASE WHEN a_shape_count > 0 OR {_VIS('a_')} THEN 'removed' ELSE 'unchanged' END END AS status, {', '.join('d_' + f for f in _F)} FROM d""")
def u01(spark, sf):
    return revisions.diff_conditions(*_sides(spark, sf))


_RAW = "CAST(sum(CASE measure_role WHEN 'floor_area' THEN area_sf WHEN 'deduct' THEN -area_sf ELSE 0 END) AS DOUBLE) AS floor_sf, CAST(sum(r_wall) AS DOUBLE) AS wall_sf, CAST(sum(r_border) AS DOUBLE) AS border_sf, CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea"
_SF = revisions.SHEET_FIELDS
_SD = ", ".join(f"{R2(f'({R2(f'coalesce(b.{f}, 0)')} - {R2(f'coalesce(a.{f}, 0)')})')} AS d_{f}" for f in _SF)
_SV = " OR ".join(f"abs(d_{f}) >= {0.5 if f == 'ea' else 0.05}" for f in _SF)


@query("U01_sheet_diff", p.SQL + f""", a AS (SELECT sheet_id, {_RAW} FROM roles WHERE ts < TIMESTAMP '{SPLIT}' AND sheet_id <> 'plan3.pdf' GROUP BY 1), b AS (SELECT sheet_id, {_RAW} FROM roles WHERE sheet_id <> 'plan5.pdf' AND NOT (sheet_id = 'plan1.pdf' AND ts >= TIMESTAMP '{SPLIT}') GROUP BY 1),
d AS (SELECT coalesce(b.sheet_id, a.sheet_id) AS sheet_id, a.sheet_id AS sa, b.sheet_id AS sb, {_SD} FROM a FULL JOIN b ON a.sheet_id = b.sheet_id)
SELECT sheet_id, CASE WHEN sa IS NULL THEN 'added' WHEN sb IS NULL THEN 'removed' WHEN {_SV} THEN 'changed' ELSE 'unchanged' END AS status, {', '.join('d_' + f for f in _SF)} FROM d""")
def u01_sheets(spark, sf):
    shapes = p.shapes(spark, sf)
    old = F.col("ts") < F.lit(SPLIT).cast("timestamp")
    a = totals.base_sums(shapes.where(old & (F.col("sheet_id") != "plan3.pdf")), "sheet_id", net_cut_deducts=False)
    b = totals.base_sums(shapes.where((F.col("sheet_id") != "plan5.pdf") & ~((F.col("sheet_id") == "plan1.pdf") & ~old)), "sheet_id", net_cut_deducts=False)
    return revisions.diff_sheets(a, b)


def _lists(spark, sf):
    shapes, conditions, materials = p.shapes(spark, sf), p.conditions(spark, sf), p.materials(spark, sf)
    old = shapes.where(F.col("ts") < F.lit(SPLIT).cast("timestamp"))
    return totals.buy_list(totals.condition_materials(conditions.where("id % 50 <> 0"), old, materials)), totals.buy_list(totals.condition_materials(conditions, shapes, materials.where("name <> 'Brand#1'")))


def _list_sql(name: str, rows: str, conditions: str, materials: str) -> str:
    return f"""{name}_base AS (SELECT condition_id, {_SUMS} FROM roles WHERE {rows} GROUP BY condition_id), {name} AS (SELECT name, unit, floor((CAST(sum(CAST(qty AS DECIMAL(28,6))) AS DOUBLE) + 2.220446049250313e-16) * 100 + 0.5) / 100 AS qty FROM (
 SELECT name, coalesce(unit, '') AS unit, CASE WHEN round THEN ceil(CASE WHEN per > 0 THEN b / per ELSE 0 END - 1e-9) ELSE floor((CASE WHEN per > 0 THEN b / per ELSE 0 END + 2.220446049250313e-16) * 100 + 0.5) / 100 END AS qty FROM (
  SELECT m.*, CASE m.basis WHEN 'linear' THEN coalesce(lf, 0) * k WHEN 'count' THEN coalesce(ea, 0) * k WHEN 'seam_lf' THEN 0.0::DOUBLE ELSE coalesce(floor, 0) * k + coalesce(wall, 0) * k + coalesce(border, 0) * k END AS b
  FROM (SELECT *, CASE WHEN multiplier = 0 THEN 1.0::DOUBLE ELSE multiplier END AS k FROM conditions WHERE {conditions}) c LEFT JOIN {name}_base s ON s.condition_id = c.id JOIN materials m ON m.condition_id = c.id WHERE coalesce(m.name, '') <> '' AND {materials})) GROUP BY 1, 2)"""


@query("U01_material_diff", p.SQL + ", " + _list_sql("a", f"ts < TIMESTAMP '{SPLIT}'", "id % 50 <> 0", "TRUE") + ", " + _list_sql("b", "TRUE", "TRUE", "name <> 'Brand#1'") + f""", d AS (SELECT coalesce(b.name, a.name) AS name, coalesce(b.unit, a.unit) AS unit, a.qty AS a_q, b.qty AS b_q, {R2('(coalesce(b.qty, 0) - coalesce(a.qty, 0))')} AS delta FROM a FULL JOIN b ON a.name = b.name AND a.unit = b.unit)
SELECT name, unit, coalesce(a_q, 0) AS a_qty, coalesce(b_q, 0) AS b_qty, delta, CASE WHEN a_q IS NULL THEN 'added' WHEN b_q IS NULL THEN 'removed' WHEN abs(delta) >= 0.005 THEN 'changed' ELSE 'unchanged' END AS status FROM d WHERE coalesce(a_q, 0) <> 0 OR coalesce(b_q, 0) <> 0""")
def u01_materials(spark, sf):
    return revisions.diff_materials(*_lists(spark, sf))


@query("U02_snapshot_diff", p.SQL + f""", s AS (SELECT sheet_id, condition_id AS id, ts, r_floor, r_wall, r_border, r_lf, r_ea FROM roles),
a AS (SELECT sheet_id, id, CAST(sum(r_floor) AS DOUBLE) AS floor_sf, CAST(sum(r_wall) AS DOUBLE) AS wall_sf, CAST(sum(r_border) AS DOUBLE) AS border_sf, CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea FROM s WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1, 2),
b AS (SELECT sheet_id, id, CAST(sum(r_floor) AS DOUBLE) AS floor_sf, CAST(sum(r_wall) AS DOUBLE) AS wall_sf, CAST(sum(r_border) AS DOUBLE) AS border_sf, CAST(sum(r_lf) AS DOUBLE) AS lf, CAST(sum(r_ea) AS DOUBLE) AS ea FROM s WHERE id % 13 <> 0 GROUP BY 1, 2)
SELECT coalesce(b.sheet_id, a.sheet_id) AS sheet_id, coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN {' OR '.join(f'floor(abs(b.{f} - a.{f}) * 10 + 0.5) <> 0' for f in _SF)} THEN 'changed' ELSE 'unchanged' END AS status
FROM a FULL JOIN b ON a.sheet_id = b.sheet_id AND a.id = b.id""")
def u02(spark, sf):
    conditions, shapes = p.conditions(spark, sf), p.shapes(spark, sf)
    a = totals.sheet_totals(conditions, shapes.where(F.col("ts") < F.lit(SPLIT).cast("timestamp")))
    return revisions.diff_snapshots(a, totals.sheet_totals(conditions, shapes).where("id % 13 <> 0"))


# Three sides of the orders: local and remote each drop, edit and add some.
def _three(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"), F.concat(F.lit("plan"), F.col("o_custkey") % 7).alias("sheet_id"))
    edit = lambda df, n, mark, days: df.withColumn("stamp", F.when(F.col("id") % n == 0, F.concat("stamp", F.lit(days))).otherwise(F.col("stamp"))).withColumn("body", F.when(F.col("id") % n == 0, F.concat("body", F.lit(mark))).otherwise(F.col("body")))
    base = orders.where("id % 17 <> 0")
    local = edit(orders.where("id % 5 <> 0"), 3, "!", "T2")
    remote = edit(edit(orders.where("id % 7 <> 0"), 4, "?", "T1"), 12, "!", "T3")
    return base, local, remote


_THREE = """
WITH o AS (SELECT o_orderkey AS id, o_orderstatus || '|' || CAST(o_custkey AS VARCHAR) AS body, strftime(o_orderdate, '%Y-%m-%d') AS stamp, 'plan' || CAST(o_custkey % 7 AS VARCHAR) AS sheet_id FROM orders),
b AS (SELECT * FROM o WHERE id % 17 <> 0), l AS (SELECT id, CASE WHEN id % 3 = 0 THEN body || '!' ELSE body END AS body, CASE WHEN id % 3 = 0 THEN stamp || 'T2' ELSE stamp END AS stamp, sheet_id FROM o WHERE id % 5 <> 0),
r AS (SELECT id, body || CASE WHEN id % 4 = 0 THEN '?' ELSE '' END || CASE WHEN id % 12 = 0 THEN '!' ELSE '' END AS body, stamp || CASE WHEN id % 4 = 0 THEN 'T1' ELSE '' END || CASE WHEN id % 12 = 0 THEN 'T3' ELSE '' END AS stamp, sheet_id FROM o WHERE id % 7 <> 0),
k AS (SELECT id FROM b UNION SELECT id FROM l UNION SELECT id FROM r),
j AS (SELECT k.id, b.body AS bb, l.body AS lb, r.body AS rb, l.stamp AS ls, r.stamp AS rs FROM k LEFT JOIN b USING (id) LEFT JOIN l USING (id) LEFT JOIN r USING (id)),
d AS (SELECT *, CASE WHEN lb IS NULL AND rb IS NULL THEN 'deleted' WHEN bb IS NULL AND lb IS NULL THEN 'remote' WHEN bb IS NULL AND rb IS NULL THEN 'local' WHEN lb IS NULL THEN CASE WHEN rb <> bb THEN 'remote' ELSE 'deleted' END WHEN rb IS NULL THEN CASE WHEN lb <> bb THEN 'local' ELSE 'deleted' END
  WHEN lb = rb THEN 'kept' WHEN bb IS NOT NULL AND lb = bb THEN 'remote' WHEN bb IS NOT NULL AND rb = bb THEN 'local' WHEN ls > rs THEN 'conflict:local' ELSE 'conflict:remote' END AS c FROM j)
"""


@query("U03_three_way_merge", _THREE + """SELECT id, CASE c WHEN 'deleted' THEN NULL WHEN 'local' THEN lb WHEN 'conflict:local' THEN lb ELSE coalesce(rb, lb) END AS body, CASE c WHEN 'conflict:local' THEN rb WHEN 'conflict:remote' THEN lb END AS merge_loser, split_part(c, ':', 1) AS decision,
CASE WHEN c LIKE 'conflict%' THEN split_part(c, ':', 2) END AS winner FROM d""")
def u03(spark, sf):
    return merge.three_way(*_three(spark, sf))


@query("J28_three_way_outer_join", _THREE + "SELECT bb IS NOT NULL AS in_base, lb IS NOT NULL AS in_local, rb IS NOT NULL AS in_remote, count(*) AS n FROM j GROUP BY ALL")
def j28(spark, sf):
    b, l, r = (df.select("id", F.lit(True).alias(n)) for df, n in zip(_three(spark, sf), ("in_base", "in_local", "in_remote")))
    every = b.join(l, "id", "full").join(r, "id", "full")
    names = ["in_base", "in_local", "in_remote"]
    return every.groupBy(*[F.coalesce(n, F.lit(False)).alias(n) for n in names]).agg(F.count("*").alias("n"))


@query("U04_scalar_merge", _THREE + "SELECT id, CASE WHEN lb IS DISTINCT FROM bb AND rb IS NOT DISTINCT FROM bb THEN lb ELSE rb END AS value FROM j")
def u04(spark, sf):
    b, l, r = _three(spark, sf)
    side = lambda df, n: df.select("id", F.col("body").alias(n))
    every = side(b, "b").join(side(l, "l"), "id", "full").join(side(r, "r"), "id", "full")
    return every.select("id", merge.merge_scalar(F.col("b"), F.col("l"), F.col("r")).alias("value"))


@query("U06_reimport_signature", _THREE + """SELECT * FROM (SELECT coalesce(b.sheet_id, r.sheet_id, l.sheet_id) AS sheet_id, count(*) FILTER (b.id IS NOT NULL AND l.id IS NULL) AS local_deleted, count(*) FILTER (b.id IS NOT NULL AND r.id IS NULL) AS remote_deleted, count(*) FILTER (b.id IS NULL AND l.id IS NOT NULL) AS local_added,
count(*) FILTER (b.id IS NULL AND r.id IS NOT NULL) AS remote_added FROM k LEFT JOIN b ON b.id = k.id LEFT JOIN l ON l.id = k.id LEFT JOIN r ON r.id = k.id GROUP BY 1) WHERE local_deleted > 0 AND remote_deleted > 0 AND local_added > 0 AND remote_added > 0""")
def u06(spark, sf):
    return merge.reimported_sheets(*_three(spark, sf))


@query("U07_payload_equality", _THREE + "SELECT (SELECT count(*) FROM (SELECT id, body FROM b EXCEPT ALL SELECT id, body FROM l)) + (SELECT count(*) FROM (SELECT id, body FROM l EXCEPT ALL SELECT id, body FROM b)) = 0 AS same")
def u07(spark, sf):
    b, l, _ = _three(spark, sf)
    return merge.same_payload(b, l)


@query("U05_scale_geometry_override", "SELECT 'plan' || CAST(c_nationkey AS VARCHAR) AS sheet_id, max(c_acctbal) AS remote_upp, min(c_acctbal) AS local_upp, count(*) > 1 AND max(c_acctbal) <> min(c_acctbal) AS remote_takes_sheet FROM customer GROUP BY 1")
def u05(spark, sf):
    """Sheets whose scales differ with work on both sides take remote's whole sheet; here both sides' scales come from customers."""
    from plumbline.operators.summaries import scale_overrides

    sheets = table(spark, sf, "customer").groupBy(F.concat(F.lit("plan"), F.col("c_nationkey")).alias("sheet_id")).agg(F.max("c_acctbal").alias("remote_upp"), F.min("c_acctbal").alias("local_upp"), (F.count("*") - 1).alias("local_work"), F.count("*").alias("remote_work"))
    return scale_overrides(sheets).select("sheet_id", "remote_upp", "local_upp", "remote_takes_sheet")


_IMPORT = """WITH cur AS (SELECT p_partkey AS id, p_partkey AS ord, p_brand || '/' || p_type AS finish_tag FROM part WHERE p_partkey % 4 <> 0), inc AS (SELECT p_partkey AS id, p_partkey AS ord, ' ' || lower(p_brand) || '/' || p_type || CASE WHEN p_size > 25 THEN '' ELSE CAST(p_size AS VARCHAR) END AS finish_tag FROM part WHERE p_partkey % 3 = 0)
"""


def _import(spark, sf):
    part = table(spark, sf, "part")
    current = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.concat_ws("/", "p_brand", "p_type").alias("finish_tag"))
    incoming = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), F.lower("p_brand"), F.lit("/"), "p_type", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_size").cast("string"))).alias("finish_tag"))
    return current, incoming


@query("J06_import_by_tag", _IMPORT + """, m AS (SELECT upper(trim(finish_tag)) AS k, arg_max(id, ord) AS cid FROM cur GROUP BY 1), j AS (SELECT i.id, i.ord, upper(trim(i.finish_tag)) AS k, m.cid, row_number() OVER (PARTITION BY upper(trim(i.finish_tag)) ORDER BY i.ord, CAST(i.id AS VARCHAR)) AS lead FROM inc i LEFT JOIN m ON m.k = upper(trim(i.finish_tag))),
t AS (SELECT *, CASE WHEN id IN (SELECT id FROM cur) THEN CAST(id AS VARCHAR) || '~2' ELSE CAST(id AS VARCHAR) END AS fresh FROM j)
SELECT CAST(t.id AS VARCHAR) AS incoming_id, CASE WHEN t.cid IS NULL AND t.lead = 1 THEN 'added' ELSE 'matched' END AS outcome, coalesce(CAST(t.cid AS VARCHAR), f.fresh) AS target_id FROM t LEFT JOIN t f ON f.k = t.k AND f.lead = 1""")
def j06(spark, sf):
    return merge.import_conditions(*_import(spark, sf))


@query("J07_import_new_rows", _IMPORT + "SELECT id, finish_tag FROM inc WHERE id NOT IN (SELECT id FROM cur)")
def j07(spark, sf):
    current, incoming = _import(spark, sf)
    return merge.import_new(current, incoming).select("id", "finish_tag")


@query("J08_scale_conflicts", """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS sheet_id, abs(s_acctbal) / 1000 + 0.001::DOUBLE AS u FROM supplier), c AS (SELECT sheet_id, u, u * CASE WHEN CAST(sheet_id AS BIGINT) % 3 = 0 THEN 1.0000001::DOUBLE WHEN CAST(sheet_id AS BIGINT) % 3 = 1 THEN 1.0000000000001::DOUBLE ELSE 1.0::DOUBLE END AS v FROM s WHERE CAST(sheet_id AS BIGINT) % 5 <> 0)
SELECT sheet_id, u AS current_upp, v AS incoming_upp FROM c WHERE abs(u - v) > 1e-9 * greatest(abs(u), abs(v))""")
def j08(spark, sf):
    key = F.col("s_suppkey")
    mine = table(spark, sf, "supplier").select(key.cast("string").alias("sheet_id"), (F.abs("s_acctbal") / 1000 + F.lit(0.001)).alias("units_per_px"), key)
    theirs = mine.where("s_suppkey % 5 <> 0").withColumn("units_per_px", F.col("units_per_px") * F.when(key % 3 == 0, F.lit(1.0000001)).when(key % 3 == 1, F.lit(1.0000000000001)).otherwise(F.lit(1.0)))
    return merge.scale_conflicts(mine, theirs)


@query("U10_distinct_marks", "SELECT DISTINCT upper(regexp_replace(p_brand, '\\s+', '', 'g')) AS mark FROM part")
def u10(spark, sf):
    from plumbline.functions.keys import mark_key

    return table(spark, sf, "part").select(mark_key(F.col("p_brand")).alias("mark")).distinct()


@query("P20_first_id_wins", "SELECT o_custkey AS id, o_orderkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey % 9 <> 0) WHERE k = 1")
def p20(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("id"), F.col("o_orderkey").alias("ord"))
    return merge.first_of(rows, "id", "ord")
