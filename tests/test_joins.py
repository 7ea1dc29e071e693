"""Sides of joins that grow with the tables are never broadcast, however small the planner takes them for; depth without recursion's row limit."""

import os

import pytest

from plumbline.driver.queries import QUERIES
from plumbline.operators import merge, records

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def grown(name, spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return QUERIES[name](spark, SF)


def test_descendants_beyond_the_row_limit_of_recursion(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        found = records.descendants(spark.createDataFrame([(k, k // 2) for k in range(2, 40)], "child long, parent long")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted((r["root"], r["id"], r["depth"]) for r in found) == sorted((1, k, k.bit_length() - 1) for k in range(1, 40))


def test_descendants_of_a_cycle_end(spark):
    found = records.descendants(spark.createDataFrame([(2, 1), (3, 2), (2, 3)], "child long, parent long"), 4).collect()
    assert sorted((r["id"], r["depth"]) for r in found) == [(1, 0), (2, 1), (2, 3), (3, 2), (3, 4)]


def test_stitched_segments(spark):
    assert broadcasts(grown("U11_merged_segments", spark)) == 0


def test_imported_rows(spark):
    rows = lambda n: spark.range(n).selectExpr("cast(id AS string) AS id", "id AS value")
    new = merge.import_new(rows(5), rows(8))
    assert broadcasts(new) == 0 and sorted(r["id"] for r in new.collect()) == ["5", "6", "7"]


def test_sheet_roles(spark):
    assert broadcasts(grown("X01_european_titles", spark)) == 0


def test_counts_from_points(spark):
    assert broadcasts(grown("X17_counts_from_points", spark)) == 0


def test_wall_network(spark):
    assert broadcasts(grown("X24_wall_network", spark)) == 0


def test_ink_classes(spark):
    assert broadcasts(grown("X28_ink_classes", spark)) == 0


@pytest.mark.parametrize("name", ["G16_ring_samples", "X17_counts_from_points"])
def test_python_work_is_spread(spark, name):
    assert "REPARTITION_BY_NUM" in grown(name, spark)._jdf.queryExecution().executedPlan().toString()
