"""Work on runs instead of rasters, and on pairs of small groups in whole batches: the results of the plain way."""

import numpy as np
import pytest

from plumbline.operators import masks
from plumbline.plans.scratch import sheetwise_pairs
from test_joins import grown


def test_open_runs_are_those_of_the_raster():
    rng = np.random.default_rng(7)
    for _ in range(200):
        high, wide, n = *rng.integers(1, 12, 2), rng.integers(0, 20)
        y, a, b = rng.integers(0, high, n), rng.integers(0, wide + 1, n), rng.integers(0, wide + 1, n)
        walls = (y, np.minimum(a, b), np.maximum(a, b))
        plain = masks.runs_of(~masks.raster(high, wide, *walls))
        assert all((p == q).all() and len(p) == len(q) for p, q in zip(plain, masks.between(high, wide, *walls)))


def test_pairs_of_groups(spark):
    left = spark.createDataFrame([(k, (1 << 60) + j) for k in range(40) for j in range(k % 3)], "sheet_id long, id long")
    right = spark.createDataFrame([(k, float(j)) for k in range(50) for j in range(k % 4)], "sheet_id long, v double")
    got = sheetwise_pairs(left, right, lambda a, b: [(s.sheet_id, s.id, len(b), float(b["v"].sum())) for s in a.itertuples()], "sheet_id long, id long, n long, total double", "sheet_id").collect()
    assert sorted(map(tuple, got)) == [(k, (1 << 60) + j, k % 4, float(sum(range(k % 4)))) for k in range(40) for j in range(k % 3)]


@pytest.mark.parametrize("name", ["X25_flooded_rooms", "X26_rooms_from_labels", "X27_sealed_doorways"])
def test_sheets_come_in_batches(spark, name):
    """A group of its own for each sheet costs more than its flood."""
    assert "CoGroups" not in grown(name, spark)._jdf.queryExecution().executedPlan().toString()
