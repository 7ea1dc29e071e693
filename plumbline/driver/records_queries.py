"""Sheets, segments, records, journals, marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.operators import records as r
from plumbline.operators import summaries as s
from plumbline.plans import projection as p
from plumbline.plans.ranking import numbered


@query("P01_sheet_index", p.SQL + "SELECT s.sheet_id, coalesce(s.u, 0) > 0 AS scale_set, coalesce(n, 0) AS shape_count FROM (SELECT 'plan' || CAST(s_suppkey AS VARCHAR) || '.pdf' AS sheet_id, s_acctbal AS u FROM supplier) s LEFT JOIN (SELECT sheet_id, count(*) AS n FROM shapes GROUP BY 1) c ON c.sheet_id = s.sheet_id")
def p01(spark, sf):
    sheets = table(spark, sf, "supplier").select(F.concat(F.lit("plan"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("sheet_id"), F.col("s_acctbal").alias("units_per_px"))
    return r.sheet_index(sheets, p.shapes(spark, sf))


@query("P02_list_shapes", p.SQL + "SELECT s.sheet_id, c.finish_tag, s.measure_role, CAST(s.area_sf AS DOUBLE) AS area_sf, s.label FROM shapes s JOIN conditions c ON c.id = s.condition_id WHERE s.measure_role <> 'count'")
def p02(spark, sf):
    rows = s.list_shapes(p.shapes(spark, sf), p.conditions(spark, sf), F.col("measure_role") != "count")
    return rows.select("sheet_id", "finish_tag", "measure_role", F.col("area_sf").cast("double").alias("area_sf"), "label")


@query("P03_spans_in_region", "SELECT o_orderkey FROM orders WHERE o_custkey % 97 <= 50 AND o_custkey % 97 + 4 >= 30 AND o_orderkey % 89 <= 40 AND o_orderkey % 89 + 2 >= 20")
def p03(spark, sf):
    x, y = F.col("o_custkey") % 97, F.col("o_orderkey") % 89
    return table(spark, sf, "orders").where(r.in_region(x, y, x + 4, y + 2, 30, 20, 50, 40)).select("o_orderkey")


_SEGS = "WITH s AS (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS sheet_id, o_orderkey AS idx, CAST(o_custkey % 97 AS DOUBLE) AS x1, CAST(o_orderkey % 89 AS DOUBLE) AS y1, CAST(o_custkey % 7 AS DOUBLE) AS len FROM orders)"


def segments(spark, sf):
    return table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("sheet_id"), F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 97).cast("double").alias("x1"), (F.col("o_orderkey") % 89).cast("double").alias("y1"), (F.col("o_custkey") % 7).cast("double").alias("len"))


@query("P05_sheet_context", _SEGS + """, k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY len DESC, idx) AS place FROM s WHERE x1 < 80 AND len >= 2)
SELECT s.sheet_id, s.idx, CASE WHEN s.x1 >= 80 THEN 'outside' WHEN s.len < 2 THEN 'short' WHEN k.place > 100 THEN 'cap' ELSE 'kept' END AS status FROM s LEFT JOIN k ON k.sheet_id = s.sheet_id AND k.idx = s.idx""")
def p05(spark, sf):
    return r.sheet_context(segments(spark, sf), F.col("len"), F.col("x1") < 80, cap=100).select("sheet_id", "idx", "status")


@query("P05_context_ledger", _SEGS + """, k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY len DESC, idx) AS place FROM s WHERE x1 < 80 AND len >= 2)
SELECT s.sheet_id, count(*) FILTER (s.x1 >= 80) AS outside, count(*) FILTER (s.x1 < 80 AND s.len < 2) AS short, count(*) FILTER (k.place > 100) AS cap, count(*) FILTER (k.place <= 100) AS kept, count(*) AS total FROM s LEFT JOIN k ON k.sheet_id = s.sheet_id AND k.idx = s.idx GROUP BY 1""")
def p05_ledger(spark, sf):
    rows = r.sheet_context(segments(spark, sf), F.col("len"), F.col("x1") < 80, cap=100)
    return rows.groupBy("sheet_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("outside", "short", "cap", "kept")], F.count("*").alias("total"))


@query("P06_segment_page", _SEGS + "SELECT sheet_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY idx) AS k FROM s WHERE idx >= 700) WHERE k <= 64")
def p06(spark, sf):
    return r.page_after(segments(spark, sf), 700, 64).select("sheet_id", "idx")


_P07 = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN -l_extendedprice ELSE l_extendedprice END AS area_sf, CASE WHEN l_linenumber = 6 THEN coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, 1) END AS count, CASE WHEN l_tax > 0.04 THEN l_returnflag ELSE 'untracked' END AS method FROM lineitem"


@query("P07_shape_details", _P07)
def p07(spark, sf):
    role = F.when(F.col("l_linenumber") == 3, "deduct").when(F.col("l_linenumber") == 6, "count").otherwise("floor_area")
    shapes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", role.alias("measure_role"), F.col("l_extendedprice").alias("area_sf"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("count"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("method"))
    return r.shape_details(shapes).drop("measure_role")


@query("P12_spec_column_if_any", p.SQL + "SELECT id, finish_tag, CASE WHEN (SELECT max(waste_pct) FROM conditions) > 0 THEN waste_pct END AS spec FROM conditions")
def p12(spark, sf):
    """The column is there only if some row has a value; a column of blanks and one of zeros go."""
    rows = p.conditions(spark, sf).select("id", "finish_tag", F.col("waste_pct").alias("spec"), F.lit(" ").alias("labor"), F.lit(0.0).alias("mark_up"))
    return rows.select(*s.columns_with_values(rows, ["spec", "labor", "mark_up"]))


@query("P15_review_search", "SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high')) AND o_custkey % 3 = 1")
def p15(spark, sf):
    return table(spark, sf, "orders").where(r.matches(" High ", F.col("o_orderpriority"), F.col("o_orderstatus")) & (r.review_state(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 == 2)) == "pending")).select("o_orderkey")


@query("P16_review_states", "SELECT CASE o_custkey % 3 WHEN 2 THEN 'reviewed' WHEN 1 THEN 'pending' ELSE 'recorded' END AS state, CASE WHEN o_custkey % 5 = 0 THEN 'agent' WHEN o_custkey % 5 = 1 THEN 'human' WHEN o_custkey % 7 = 0 THEN 'human' WHEN o_custkey % 7 = 1 THEN 'agent' ELSE 'unknown' END AS actor, count(*) AS n FROM orders GROUP BY ALL")
def p16(spark, sf):
    c = F.col("o_custkey")
    actor = F.when(c % 5 == 0, "agent").when(c % 5 == 1, "human")
    method = F.when(c % 7 == 0, "manual").when(c % 7 == 1, "sweep")
    return table(spark, sf, "orders").groupBy(r.review_state(F.when(c % 3 > 0, c % 3 == 2)).alias("state"), r.work_actor(method, actor).alias("actor")).agg(F.count("*").alias("n"))


@query("P18_live_rfis", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 4 <> 0")
def p18(spark, sf):
    deleted = F.when(F.col("o_custkey") % 4 == 0, True).when(F.col("o_custkey") % 4 == 1, False)
    return s.live(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), deleted.alias("deleted"))).select("id")


@query("P19_needs_metrics", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity % 5 >= CASE WHEN l_linenumber = 4 THEN 2 WHEN l_linenumber = 6 THEN 1 ELSE 3 END AND (CASE WHEN l_linenumber = 4 THEN l_tax < 0.03 ELSE l_tax >= 0.05 END) AS needed FROM lineitem")
def p19(spark, sf):
    role = F.when(F.col("l_linenumber") == 4, "linear").when(F.col("l_linenumber") == 6, "count").otherwise("floor_area")
    some = F.when(F.col("l_tax") < 0.05, F.lit(0.0))
    run = F.when(F.col("l_tax") >= 0.03, F.lit(0.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.needs_metrics(some, run, some, role, F.col("l_quantity") % 5).alias("needed"))


@query("W06_rfi_numbers_whole", "SELECT o_orderkey, 'RFI-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS number FROM (SELECT o_orderkey, (SELECT max(c_custkey % 50) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)")
def w06_whole(spark, sf):
    """All orders as drafts."""
    issued = table(spark, sf, "customer").select(F.concat(F.lit("RFI-"), F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "0")).alias("number"))
    return r.next_numbers(issued, table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


_RFI = "WITH m AS (SELECT o_custkey AS rfi_id, 'plan' || CAST(o_orderkey % 5 AS VARCHAR) AS sheet_id, o_orderkey AS ord FROM orders), g AS (SELECT rfi_id, sheet_id, count(*) AS n, min(ord) AS f FROM m GROUP BY 1, 2)"


@query("J05_rfi_markups", _RFI + " SELECT c_custkey AS id, coalesce(CAST(n AS BIGINT), 0) AS markup_count, coalesce(s, '') AS sheets FROM customer LEFT JOIN (SELECT rfi_id, sum(n) AS n, string_agg(sheet_id, ';' ORDER BY f) AS s FROM g GROUP BY 1) x ON x.rfi_id = c_custkey WHERE c_custkey % 6 <> 0")
def j05(spark, sf):
    markups = table(spark, sf, "orders").select(F.col("o_custkey").alias("rfi_id"), F.concat(F.lit("plan"), (F.col("o_orderkey") % 5).cast("string")).alias("sheet_id"), F.col("o_orderkey").alias("ord"))
    rfis = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 == 0, True).alias("deleted"))
    return r.rfi_sheets(rfis, markups)


@query("J04_markup_tags", "SELECT o_orderkey, coalesce(p_brand, '') AS finish_tag FROM orders LEFT JOIN part ON p_partkey = o_custkey")
def j04(spark, sf):
    conditions = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("finish_tag"))
    return s.markup_tags(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("condition_id")), conditions).drop("condition_id")


@query("A25_pending_by_proposal", "SELECT CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 END AS VARCHAR) AS proposal_id, CASE WHEN o_custkey % 3 = 0 THEN 'loose' WHEN n_nationkey IS NULL THEN 'undescribed' ELSE 'described' END AS kind, n_name AS title, count(*) AS n FROM orders LEFT JOIN nation ON n_nationkey = CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 END WHERE o_orderkey % 2 = 0 GROUP BY ALL")
def a25(spark, sf):
    shapes = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 100).cast("string").alias("proposal_id"), (F.col("o_orderkey") % 2 == 1).alias("reviewed"))
    return r.pending_by_proposal(shapes, table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title")))


@query("A20_mark_census_caps", """WITH e AS (SELECT event_type AS mark, user_id AS sheet_id, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'withheld' WHEN 1 THEN 'counted' ELSE 'in_table' END AS outcome FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY mark, outcome ORDER BY sheet_id, ord) AS place FROM e),
g AS (SELECT mark, sheet_id, count(*) FILTER (outcome = 'counted') AS counted, count(*) FILTER (outcome = 'withheld') AS withheld, coalesce(string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) FILTER (outcome = 'counted' AND place <= 150), '') AS counted_at, coalesce(string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) FILTER (outcome = 'withheld' AND place <= 60), '') AS withheld_at FROM k GROUP BY 1, 2)
SELECT *, CAST(sum(counted) OVER (PARTITION BY mark) AS BIGINT) AS counted_total, greatest(CAST(sum(counted) OVER (PARTITION BY mark) AS BIGINT) - 150, 0) AS counted_elided, greatest(CAST(sum(withheld) OVER (PARTITION BY mark) AS BIGINT) - 60, 0) AS withheld_elided FROM g""")
def a20(spark, sf):
    """Counts are whole, by sheet and in all; only the lists of places are capped, and what they leave out is said."""
    from plumbline.operators.drawing import census_report

    outcome = F.element_at(F.array(F.lit("withheld"), F.lit("counted"), F.lit("in_table")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = census_report(table(spark, sf, "events").select(F.col("event_type").alias("mark"), F.col("user_id").alias("sheet_id"), F.col("event_id").alias("ord"), outcome.alias("outcome")))
    listed = [F.array_join(f"{o}_at", ",").alias(f"{o}_at") for o in ("counted", "withheld")]
    return rows.select("mark", "sheet_id", "counted", "withheld", *listed, "counted_total", "counted_elided", "withheld_elided")


@query("A24_segments_per_layer", "WITH c AS (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS sheet_id, CASE WHEN o_custkey % 9 < 7 THEN o_custkey % 9 END AS layer_id, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT s.sheet_id, r_regionkey * 2 AS layer_id, r_name AS name FROM (SELECT DISTINCT sheet_id FROM c) s, region) SELECT l.*, coalesce(c.n, 0) AS n FROM l LEFT JOIN c ON c.sheet_id = l.sheet_id AND c.layer_id = l.layer_id UNION ALL SELECT sheet_id, NULL, NULL, n FROM c WHERE layer_id IS NULL")
def a24(spark, sf):
    """Every layer of each sheet, used or not, and the segments on none; layers come from regions."""
    c = F.col("o_custkey") % 9
    segments = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("sheet_id"), F.when(c < 7, c).alias("layer_idx"))
    layers = table(spark, sf, "region").select((F.col("r_regionkey") * 2).cast("long").alias("layer_id"), F.col("r_name").alias("name"))
    each = F.explode(F.array(*[F.struct(F.lit(r["layer_id"]).alias("layer_id"), F.lit(r["name"]).alias("name")) for r in layers.collect()]))  # the regions
    return s.segments_per_layer(segments, segments.select("sheet_id").distinct().select("sheet_id", each.alias("l")).select("sheet_id", "l.layer_id", "l.name"))


@query("A26_sheets_by_level", "SELECT 'L' || CAST(p_size AS VARCHAR) AS level, count(*) AS sheets, dense_rank() OVER (ORDER BY p_size) AS place FROM part GROUP BY p_size")
def a26(spark, sf):
    from plumbline.functions.keys import natural_key

    levels = table(spark, sf, "part").groupBy(F.concat(F.lit("L"), F.col("p_size").cast("string")).alias("level")).agg(F.count("*").alias("sheets"))
    return numbered(levels.withColumn("by_value", natural_key(F.col("level"))), "place", "by_value").drop("by_value")


@query("A27_medians", "SELECT event_type, count(DISTINCT value) AS n, median(value) AS middle FROM events GROUP BY 1")
def a27(spark, sf):
    return s.distinct_median(table(spark, sf, "events"), "event_type", "value")


@query("A27_weighted_medians", "SELECT event_type, min(value) AS middle FROM (SELECT event_type, value, sum(user_id) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(user_id) OVER (PARTITION BY event_type) AS whole FROM events) WHERE upto * 2 >= whole GROUP BY 1")
def a27_weighted(spark, sf):
    return s.weighted_median(table(spark, sf, "events"), "event_type", "value", "user_id")


@query("A18_doors_by_width", "SELECT CAST(floor(l_quantity * 37 / 100 + 0.5) * 100 AS BIGINT) AS width_mm, l_linenumber = 2 AS double_leaf, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL")
def a18(spark, sf):
    doors = table(spark, sf, "lineitem").where("l_linenumber < 3").select((F.col("l_quantity") * 37).alias("width_mm"), (F.col("l_linenumber") == 2).alias("double_leaf"))
    return s.doors_by_width(doors)


@query("A17_wall_classes", "WITH r AS (SELECT l_partkey % 500 AS side, l_linenumber AS class, CAST(l_extendedprice AS DECIMAL(18,2)) AS g, CASE WHEN l_tax <= 0.0799 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS o, CAST(l_quantity % 3 AS BIGINT) AS k FROM lineitem) SELECT side, class, count(*) AS runs, CAST(sum(g) AS DOUBLE) AS gross_m2, CAST(sum(k) AS BIGINT) AS openings, CASE WHEN count(*) FILTER (o IS NULL AND k > 0) = 0 THEN CAST(sum(g) - sum(coalesce(o, 0)) AS DOUBLE) END AS net_m2, CAST(sum(coalesce(o, 0)) AS DOUBLE) AS openings_m2 FROM r GROUP BY ALL")
def a17(spark, sf):
    """Net is withheld where any opening's height is unknown (here: the highest tax)."""
    d = lambda c: F.col(c).cast("decimal(18,2)")
    runs = table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("side"), F.col("l_linenumber").alias("class"), d("l_extendedprice").alias("gross_m2"), F.when(F.col("l_tax") <= 0.0799, d("l_quantity")).alias("openings_m2"), (F.col("l_quantity") % 3).cast("long").alias("openings"))
    return s.wall_classes(runs)


@query("O04_find_text_limited", "SELECT doc_id, total, k AS place FROM (SELECT doc_id, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE contains(lower(text), 'rights reserved')) WHERE k <= 200")
def o04(spark, sf):
    """The first 200 hits with the count of all: the cap is the feature."""
    return r.first_hits(s.find_text(table(spark, sf, "documents"), "Rights reserved", "text"), "doc_id").select("doc_id", "total", "place")


@query("W01_ordinals", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part")
def w01(spark, sf):
    return s.ordinals(table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey").drop("p_brand")


@query("W03_section_headers", "SELECT event_id, last_value(CASE WHEN value > 95 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def w03(spark, sf):
    return r.carried_forward(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.when(F.col("value") > 95, F.col("event_type")), "section").select("event_id", "section")


@query("W08_subpaths", "WITH s AS (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS sheet_id, o_orderkey AS idx, o_custkey % 2 AS x1, (o_custkey + o_orderkey) % 2 AS x2 FROM orders), b AS (SELECT *, CASE WHEN lag(x2) OVER (PARTITION BY sheet_id ORDER BY idx) = x1 THEN 0 ELSE 1 END AS k FROM s) SELECT sheet_id, idx, CAST(sum(k) OVER (PARTITION BY sheet_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS subpath FROM b")
def w08(spark, sf):
    lines = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("sheet_id"), F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 2).alias("x1"), F.lit(0).alias("y1"), ((F.col("o_custkey") + F.col("o_orderkey")) % 2).alias("x2"), F.lit(0).alias("y2"))
    return r.subpaths(lines).select("sheet_id", "idx", F.col("subpath").cast("long").alias("subpath"))


@query("W11_undo_stack", "SELECT user_id AS session_id, event_id AS seq, k AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
def w11(spark, sf):
    journal = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"))
    return r.last_entries(journal, 5).withColumn("step", F.col("step").cast("long"))


@query("M01_journal_fold", "SELECT user_id AS session_id, k AS id, payload, seq FROM (SELECT user_id, event_id % 10 AS k, arg_max(value, event_id) AS payload, max(event_id) AS seq, arg_max(event_type, event_id) AS op FROM events GROUP BY 1, 2) WHERE op <> 'click'")
def m01(spark, sf):
    """Records after all commands; clicks delete here."""
    journal = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("id"), F.when(F.col("event_type") == "click", "delete").otherwise("set").alias("op"), F.col("value").alias("payload"), F.col("event_id").alias("seq"))
    return r.latest_state(journal, "id")


@query("J14_mark_values", """WITH m AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, o_orderkey AS ord, CAST(o_custkey % 97 AS DOUBLE) AS x0, CAST(o_custkey % 97 + 8 AS DOUBLE) AS x1, CAST(o_orderkey * 7 % 89 AS DOUBLE) AS y0, CAST(o_orderkey * 7 % 89 + 6 AS DOUBLE) AS y1 FROM orders)
SELECT a.sheet_id, a.ord, arg_min(CAST(b.ord AS VARCHAR), b.ord) AS value FROM m a JOIN m b ON a.sheet_id = b.sheet_id AND a.ord % 2 = 0 AND b.ord % 2 = 1 AND abs((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) <= 9 AND b.y0 >= a.y1 - 0.4 * 6.0 AND b.y0 <= a.y1 + 2.4 * 6.0 GROUP BY 1, 2""")
def j14(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    spans = table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("ord"), k.cast("string").alias("str"), d(c % 97).alias("x0"), d(c % 97 + 8).alias("x1"), d(k * 7 % 89).alias("y0"), d(k * 7 % 89 + 6).alias("y1"))
    return r.mark_pairs(spans.where("ord % 2 = 0"), spans.where("ord % 2 = 1"))


@query("J16_row_marks", "SELECT mark, count(DISTINCT t) AS tables, CASE WHEN count(DISTINCT t) > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM (SELECT unnest(string_split(upper(regexp_replace(p_brand || ' / E' || CAST(p_partkey AS VARCHAR), '\\s+', '', 'g')), '/')) AS mark, p_size % 3 AS t FROM part) WHERE mark <> '' GROUP BY 1")
def j16(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_brand", F.lit(" / E"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_size") % 3).alias("table_id"))
    return r.row_marks(rows)


@query("J20_corroborated_rooms", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NOT NULL THEN 'room' ELSE 'unmatched' END AS status, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'name+schedule' ELSE 'schedule' END END AS corroboration, CASE WHEN c_custkey IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'named but not scheduled' ELSE 'neither named nor scheduled' END END AS reason FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) c ON c_custkey = o_custkey")
def j20(spark, sf):
    tags = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("number"), F.when(F.col("o_orderkey") % 2 == 0, "OFFICE").otherwise(" ").alias("name"))
    return r.corroborated(tags, table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("number")))


@query("J26_nearest_endpoint", """WITH p AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, o_orderkey AS id, CAST(o_custkey % 97 AS DOUBLE) AS x, CAST(o_orderkey * 7 % 89 AS DOUBLE) AS y FROM orders),
d AS (SELECT a.id, b.id AS anchor_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT id, anchor_id, sqrt(d2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, anchor_id) AS k FROM d WHERE d2 <= 400) WHERE k = 1""")
def j26(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points = table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("id"), (c % 97).cast("double").alias("x"), (k * 7 % 89).cast("double").alias("y"))
    return r.nearest_within(points.where("id % 2 = 0"), points.where("id % 2 = 1"), 20.0)


@query("J27_variants_below", "WITH RECURSIVE e AS (SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey > 2), b(root, id, depth) AS (SELECT DISTINCT parent, parent, 0 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT b.root, e.child, b.depth + 1 FROM b JOIN e ON e.parent = b.id WHERE b.depth < 20) SELECT * FROM b")
def j27(spark, sf):
    edges = table(spark, sf, "part").where("p_partkey > 2").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return r.descendants(edges)


@query("J29_captured_labels", "SELECT o_orderkey AS id, p_type AS label FROM orders JOIN (SELECT p_brand, arg_max(p_type, p_partkey) AS p_type FROM part GROUP BY 1) c ON c.p_brand = 'Brand#' || CAST(o_custkey % 40 AS VARCHAR)")
def j29(spark, sf):
    """The last of conditions with one finish gives the label; shapes without one are skipped."""
    conditions = table(spark, sf, "part").select(F.col("p_brand").alias("finish"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")).alias("finish"))
    return s.captured_labels(shapes, conditions).select("id", "label")


@query("W02_text_rows")
def w02(spark, sf):
    """Running means don't fit SQL; held against a loop in the tests."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spans = table(spark, sf, "orders").select(F.floor(k / 40).alias("sheet_id"), k.alias("ord"), F.col("o_orderstatus").alias("str"), (c % 97).cast("double").alias("x"), (k * 7 % 89 * 2.5).cast("double").alias("y"), (c % 4 * 6).cast("double").alias("h"))
    return r.text_rows(spans)


@query("W04_thickness_classes")
def w04(spark, sf):
    runs = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("sheet_id"), F.col("o_orderkey").alias("id"), (F.lit(0.06) + (F.col("o_custkey") % 200) / 1000.0).cast("double").alias("width_m"), F.col("o_totalprice").alias("length_m"))
    return r.classed_runs(runs)
