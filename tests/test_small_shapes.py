"""Plain numbers for shapes of few points: what arrays give for them; and Python work over one file is dealt to several tasks."""

import numpy as np
import pytest

from plumbline.operators import cutouts, overlay, roll, transitions
from test_joins import grown


def ring(rng, n):
    return rng.integers(0, 7, (n, 2)) * (1.0 if rng.integers(2) else 0.37)


def test_areas_and_cuts_are_those_of_arrays(monkeypatch):
    rng = np.random.default_rng(11)
    for _ in range(150):
        a, b = ring(rng, rng.integers(3, 8)), ring(rng, rng.integers(3, 8))
        found, judged = [], []
        for few in (64, 0):
            monkeypatch.setattr(overlay, "FEW_EDGES", few)
            monkeypatch.setattr(cutouts, "FEW_EDGES", few)
            monkeypatch.setattr(cutouts, "FEW", few * 64)
            found.append([overlay.overlay_area([[a]], 1), overlay.overlay_area([[a], [b]], 2), overlay.overlay_area([[a], [b]], 1)])
            rings, why = cutouts.judged_cut([a], b)
            judged.append((why, [round(abs(cutouts.area(r)), 6) for r in rings or ()]))
        assert np.allclose(found[0], found[1], atol=1e-9) and judged[0] == judged[1]


def test_extents_of_a_bent_room():
    bent = np.array([[0, 0], [10, 0], [10, 4], [6, 9], [0, 9]], float)
    assert roll.run_extent(bent, 0, 0.0, 5.0) == (0.0, 9.0) and roll.run_extent(bent, 0, 11.0, 12.0) is None
    assert np.allclose(roll.run_extent(bent, 0, 8.0, 10.0), (0.0, 6.5), atol=1e-5)


@pytest.mark.parametrize("name", ["D05_crossing_cuts", "G22_snapped_rings", "G20_layout_lanes", "R05_directions", "R04_strips_of_rectangles", "G21_tidied_rings", "P13_roll_columns", "D01_polygons", "W09_lane_overlaps", "D02_polygon_collisions", "J22_shared_runs", "R10_seams_in_materials"])
def test_work_over_one_file_is_spread(spark, name):
    assert "REPARTITION_BY_NUM" in grown(name, spark)._jdf.queryExecution().executedPlan().toString()


def test_ends_of_runs_are_those_of_arrays(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = ring(rng, 5), ring(rng, 5)
        found = []
        for few in (64, 0):
            monkeypatch.setattr(transitions, "FEW_EDGES", few)
            found.append([(round(long, 6), round(gap, 9), status) for long, gap, status, _ in transitions.shared_runs(a, b)])
        assert found[0] == found[1]
