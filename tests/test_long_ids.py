"""Ids of net rooms beside marks that have none."""

from __future__ import annotations

from plumbline.operators import netrooms


def test_ids_beyond_doubles(spark):
    """An id that no double holds stays what it is on a sheet with marks."""
    k = 2**53 + 1
    lines = spark.createDataFrame([(1, i, *map(float, e)) for i, e in enumerate([(0, 0, 40, 0), (40, 0, 40, 30), (0, 30, 40, 30), (0, 0, 0, 30)])], "sheet_id long, idx long, x1 double, y1 double, x2 double, y2 double")
    seeds = spark.createDataFrame([(1, k, 9.0, 9.0), (1, k + 2, 60.0, 9.0)], "sheet_id long, id long, x double, y double")
    marks = spark.createDataFrame([(1, "doorless", 70.0, 70.0)], "sheet_id long, kind string, x double, y double")
    got = netrooms.net_rooms(seeds, lines, spark.createDataFrame([(1, 1.0)], "sheet_id long, px_per_ft double"), marks).collect()
    assert sorted((r.id, r.status, r.area_sf) for r in got) == [(k, "ok", 1200.0), (k + 2, "refused", None)]
