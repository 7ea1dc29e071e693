"""Roll goods, streams, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.driver.registry import query, table
from plumbline.driver.totals_queries import ROWS
from plumbline.operators import roll, totals
from plumbline.plans import projection as p
from plumbline.plans.scratch import scratch
from plumbline.sources.takeoff import csv_lines, report_json
from plumbline.streaming import capture

# Rooms: a rectangle for each part, of up to fifty by thirty feet, several to a condition.
_ROOMS = "WITH q AS (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS condition_id, p_partkey AS shape_id, CAST(4 + p_size AS DOUBLE) AS w, CAST(5 + p_partkey % 26 AS DOUBLE) AS h FROM part)"


def rooms(spark, sf):
    w, h, z = (4 + F.col("p_size")).cast("double"), (5 + F.col("p_partkey") % 26).cast("double"), F.lit(0.0)
    ring = F.array(F.array(z, z), F.array(w, z), F.array(w, h), F.array(z, h))
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 4).alias("condition_id"), F.col("p_partkey").alias("shape_id"), ring.alias("ring"))


@query("R01_lane_counts", """WITH n AS (SELECT unnest(range(1, 41)) AS n), c AS (SELECT n, CASE WHEN n = 1 THEN 144 - 6 ELSE 2 * (144 - 5) + (n - 2) * (144 - 4) END AS cap FROM n) SELECT p_partkey, min(n) AS lanes FROM part JOIN c ON cap >= p_size * 12 - 1e-6 GROUP BY 1""")
def r01(spark, sf):
    """Lanes of a room: the fewest whose capacities cover its width; one row for each width."""
    widths = spark.createDataFrame([(w, roll.lane_count(w * 12, roll.Roll())) for w in range(1, 101)], "w int, lanes long")
    return table(spark, sf, "part").join(widths, F.col("p_size") == F.col("w")).select("p_partkey", "lanes")


@query("R04_strips_of_rectangles", _ROOMS + """, n AS (SELECT unnest(range(1, 41)) AS n), cap AS (SELECT n, CASE WHEN n = 1 THEN 138 ELSE 278 + (n - 2) * 140 END AS cap FROM n), l AS (SELECT q.*, (SELECT min(n) FROM cap WHERE cap >= q.w * 12 - 1e-6) AS lanes FROM q)
SELECT condition_id, shape_id, lanes, h + 0.5 AS length FROM l""")
def r04(spark, sf):
    """Lanes and cut length of each room with the roll running north and south: walls add three inches at both ends."""
    cuts = roll.roll_cuts(rooms(spark, sf), roll.Roll(direction="ns"))
    return cuts.groupBy("condition_id", "shape_id").agg(F.first("lanes").alias("lanes"), F.max(F.col("run_max") - F.col("run_min")).alias("length"))


@query("R07_seams", _ROOMS + """, n AS (SELECT unnest(range(1, 41)) AS n), cap AS (SELECT n, CASE WHEN n = 1 THEN 138 ELSE 278 + (n - 2) * 140 END AS cap FROM n), l AS (SELECT q.*, (SELECT min(n) FROM cap WHERE cap >= q.w * 12 - 1e-6) AS lanes FROM q)
SELECT condition_id, shape_id, floor((lanes - 1) * h * 100 + 0.5) / 100 AS seam_lf FROM l WHERE lanes > 1""")
def r07(spark, sf):
    return roll.seams(roll.room_strips(rooms(spark, sf), roll.Roll(direction="ns")))


@query("R06_nested_cuts")
def r06(spark, sf):
    """Nesting is sequential; tests hold it against its invariants."""
    return roll.roll_cuts(rooms(spark, sf))


@query("A13_roll_report")
def a13(spark, sf):
    return roll.roll_report(roll.roll_cuts(rooms(spark, sf)), p.conditions(spark, sf))


@query("T01_idempotent_capture", "SELECT event_type AS finish_tag, user_id % 7 AS contributor_group, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, value FROM events) GROUP BY ALL")
def t01(spark, sf):
    """A stream over the events, twice in its source, banked once by fingerprint."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    doubled = stream.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = doubled.select("event_type", "user_id", "value", capture.fingerprint(F.col("event_type"), F.col("user_id"), F.col("value")).alias("fp"))
    path = scratch(spark)
    return capture.banked(rows, f"{path}/bank", f"{path}/log").groupBy(F.col("event_type").alias("finish_tag"), (F.col("user_id") % 7).alias("contributor_group")).agg(F.count("*").alias("n"))


@query("T02_version_gate", "SELECT event_id % 4 AS version, event_id % 4 IN (1, 2) AS taken, count(*) AS n FROM events GROUP BY ALL")
def t02(spark, sf):
    events = table(spark, sf, "events").withColumn("version", F.col("event_id") % 4)
    taken, turned = capture.gate(events, F.col("version"))
    both = taken.select("version", F.lit(True).alias("taken")).unionByName(turned.select("version", F.lit(False).alias("taken")))
    return both.groupBy("version", "taken").agg(F.count("*").alias("n"))


@query("T04_presence", "SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) AS state, epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(max(ts))) > 21600 AS stale FROM events GROUP BY 1")
def t04(spark, sf):
    beats = table(spark, sf, "events").withColumn("state", F.col("event_type"))
    return capture.presence(beats, "user_id", F.lit("2024-01-30 00:00:00").cast("timestamp"), 7200)


@query("A23_corpus_summary", "SELECT event_type AS finish_tag, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE 'manual' END AS origin_method, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ALL")
def a23(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("finish_tag"), F.when(F.col("user_id") % 3 == 0, "unknown").otherwise("manual").alias("origin_method"), "ts")
    return capture.corpus_summary(rows)


@query("S10_report_csv", ROWS + """SELECT 0 AS place, 'Finish,Total SF,LF,EA' AS line UNION ALL SELECT row_number() OVER (ORDER BY ord), finish_tag || ',' || CAST(shape_count AS VARCHAR) || ',' || CAST(CAST(waste_pct AS INT) AS VARCHAR) || ',' || CAST(CAST(ea AS BIGINT) AS VARCHAR) FROM rows_""")
def s10(spark, sf):
    rows = totals.condition_totals(p.conditions(spark, sf), p.shapes(spark, sf)).withColumns({"w": F.col("waste_pct").cast("int"), "e": F.col("ea").cast("long")})
    return csv_lines(rows, [("finish_tag", "Finish", True), ("shape_count", "Total SF", False), ("w", "LF", False), ("e", "EA", False)], ["ord"])


@query("S11_report_json")
def s11(spark, sf):
    """One report of the fixed project; a test reads it back."""
    conditions, shapes, materials = p.fixed(spark)
    rows = totals.condition_totals(conditions, shapes).where("shape_count > 0")
    return report_json(rows, totals.grand_totals(rows), totals.buy_list(totals.condition_materials(conditions, shapes, materials)))
