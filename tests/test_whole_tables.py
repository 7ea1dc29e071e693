"""Queries that give an operator its whole table."""

import os

import pytest

from plumbline.driver.queries import QUERIES
from plumbline.driver.registry import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name, source", [("D06_clipped_runs_whole", "orders"), ("W06_rfi_numbers_whole", "orders"), ("G17_shape_metrics_roles", "part")])
def test_whole_table(spark, name, source):
    assert QUERIES[name](spark, SF).count() == table(spark, SF, source).count()


def test_all_roles(spark):
    roles = {r["p_partkey"] % 4 for r in QUERIES["G17_shape_metrics_roles"](spark, SF).collect()}
    assert roles == {0, 1, 2, 3}


def test_all_collisions(spark):
    got = QUERIES["O03_collisions_ranked"](spark, SF).collect()
    assert len(got) == QUERIES["J09_floor_collisions"](spark, SF).count() > 50
    assert sorted(r["place"] for r in got) == list(range(1, len(got) + 1))


def test_groupings_are_dealt_by_the_count_of_shapes(spark, monkeypatch):
    """One shuffle of shapes, by condition, to tasks that grow with the table."""
    from plumbline.operators import totals
    from plumbline.plans import projection

    monkeypatch.setattr(totals, "TASK_ROWS", 100, raising=False)
    shapes = projection.shapes(spark, "/root/testdata/sf0.001")
    found = totals.all_groupings(projection.conditions(spark, "/root/testdata/sf0.001"), shapes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [condition_id" in plan and f"], {-(-shapes.count() // 100)}" in plan
    assert found.groupBy("grouping").agg({"shape_count": "sum"}).select("sum(shape_count)").distinct().count() == 1
