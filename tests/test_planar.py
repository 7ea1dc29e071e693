"""Planar subdivisions against pixels, Euler's formula, and sheets that are cut by a join."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cutouts, netrooms, planar


def random_lines(seed):
    rng = np.random.default_rng(seed)
    lines = rng.uniform(0, 100, (int(rng.integers(3, 14)), 4))
    x, y, w, h = *rng.uniform(5, 60, 2), *rng.uniform(10, 30, 2)
    box = [(x, y, x + w, y), (x + w, y, x + w, y + h), (x, y + h, x + w, y + h), (x, y, x, y + h)]
    inner = [(x + w / 3, y + h / 3, x + w / 2, y + h / 3), (x + w / 2, y + h / 3, x + w / 2, y + h / 2), (x + w / 2, y + h / 2, x + w / 3, y + h / 3)]
    return np.concatenate([lines, box, inner, [(0, 0, 100, 0), (100, 0, 100, 100), (0, 100, 100, 100), (0, 0, 0, 100)]])


@pytest.mark.parametrize("seed", range(30))
def test_faces_of_random_lines(seed):
    lines = random_lines(seed)
    plane = planar.Plane(lines, reach=1e-6)
    nodes, edges, pieces, faces = plane.counts()
    assert nodes - edges + faces == pieces
    assert sum(f.area for f in plane.faces) == pytest.approx(100 * 100)  # the frame's inside, whatever is drawn in it
    # a point's face is bounded by the lines around it: points are told apart exactly if some line crosses all ways between
    rng = np.random.default_rng(seed + 100)
    for p in rng.uniform(1, 99, (40, 2)):
        k = plane.at(*p)
        assert k >= 0
        q = p + rng.uniform(-3, 3, 2)
        crossed = any(_cross(p, q, line) for line in lines)
        if not crossed:
            assert plane.at(*q) == k
    # areas by pixels of a quarter unit
    at = (np.stack(np.meshgrid(np.arange(400), np.arange(400)), -1).reshape(-1, 2) + 0.5) / 4
    for f in plane.faces:
        if f.area > 60:
            count = cutouts.holds([f.ring, *f.holes], at).sum() / 16
            edge = sum(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum() for r in [f.ring, *f.holes])
            assert abs(count - f.area) < 0.25 * edge


def _cross(p, q, line):
    a, b = np.array(line[:2]), np.array(line[2:])
    turn = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    return turn(p, q, a) * turn(p, q, b) <= 0 and turn(a, b, p) * turn(a, b, q) <= 0


def test_ends_are_welded_and_overlaps_are_one_edge():
    lines = np.array([(0, 0, 10, 0.2), (10.1, 0, 10, 8), (10, 8.3, 0, 8), (0.2, 8, 0, -0.3), (2, 0, 8, 0.1), (3, 0.2, 12, 0.2), (5, 0.5, 5, 7.6), (5, 7.6, 5, 7.6)])
    plane = planar.Plane(lines)
    assert len(plane.faces) == 2 and sum(f.area for f in plane.faces) == pytest.approx(80, abs=4)
    nodes, edges, pieces, faces = plane.counts()
    assert nodes - edges + faces == pieces == 1
    assert planar.Plane(np.zeros((0, 4))).faces == []


def test_holes_and_outlines():
    box = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x0, y1, x1, y1), (x0, y0, x0, y1)]
    plane = planar.Plane(np.array(box(0, 0, 30, 20) + [(10, 0, 10, 20), (20, 0, 20, 20)] + box(12, 5, 15, 8) + [(24, 10, 26, 10)], float))
    assert sorted(f.area for f in plane.faces) == pytest.approx([9, 191, 200, 200])
    middle, left, right, small = plane.at(11, 1), plane.at(1, 1), plane.at(29, 1), plane.at(13, 6)
    assert len(plane.faces[middle].holes) == 1 and plane.at(50, 50) == -1
    sides = {(int(a), int(b)) for a, b, _ in plane.sides()}
    assert (middle, small) in sides and (left, middle) in sides and (left, right) not in sides and (left, -1) in sides
    ring, *holes = plane.outline({left, middle})
    assert abs(cutouts.area(ring)) == 400 and [abs(cutouts.area(h)) for h in holes] == [9]
    ring, *holes = plane.outline({left, middle, small, right})
    assert abs(cutouts.area(ring)) == 600 and holes == []
    # two faces that touch at a corner only are two rings of one set
    rings = planar.Plane(np.array(box(0, 0, 5, 5) + box(5, 5, 10, 10), float)).outline({0, 1})
    assert [abs(cutouts.area(r)) for r in rings] == [25, 25]


def test_sheets_are_cut_by_a_join(spark):
    rows = [(s, k, *map(float, line)) for s in (1, 2) for k, line in enumerate(random_lines(s))]
    rows += [(1, 900 + k, *r[2:]) for k, r in enumerate(rows[:4])] + [(1, 950, None, 1.0, 2.0, 2.0), (2, 951, 5.0, 5.0, 5.0, 5.0), (None, 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sheet_id long, idx long, x1 double, y1 double, x2 double, y2 double").withColumn("face", F.lit("clash"))
    got = planar.faces_of(df, 1e-6).collect()
    for s in (1, 2):
        want = planar.Plane(random_lines(s), reach=1e-6)
        mine = [r for r in got if r.sheet_id == s]
        assert sorted(r.area for r in mine) == pytest.approx([f.area for f in want.faces])
        sides = want.sides()
        assert Counter(len(r.neighbours) for r in mine) == Counter(len({int(b) for b in sides[sides[:, 0] == k, 1]} - {k, -1}) for k in range(len(want.faces)))
    counts = {r.sheet_id: (r.nodes, r.edges, r.pieces, r.faces) for r in planar.plane_counts(df, 1e-6).collect()}
    assert all(n - e + f == p for n, e, p, f in (counts[1], counts[2])) and math.isclose(sum(r.area for r in got if r.sheet_id == 1), 10_000)
    assert planar.faces_of(df.limit(0)).count() == 0


def test_rooms_grow_over_pieces():
    box = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x0, y1, x1, y1), (x0, y0, x0, y1)]
    lines = box(0, 0, 30, 30) + box(30, 0, 70, 30) + box(2, 2, 6, 6) + box(20, 0, 30, 5) + [(30.4, 0, 30.4, 30)]
    plane = planar.Plane(np.array(lines, float), reach=0.01)
    none = np.zeros((0, 2))
    grown = netrooms.Growth(plane, 1.0, none, none)
    faces, reason = grown.room(15, 15)
    assert reason == "" and sum(map(grown.area, faces)) == pytest.approx(900 - 50)  # the box inside joins, that of 50 square feet and the narrow wall don't
    assert [abs(cutouts.area(r)) for r in plane.outline(faces)] == pytest.approx([850])
    assert netrooms.Growth(plane, 1.0, np.array([[3.0, 3.0]]), none).room(4, 4)[1] == "on a wall" and plane.at(4, 4) in netrooms.Growth(plane, 1.0, np.array([[3.0, 3.0]]), none).solid
    assert netrooms.Growth(plane, 1.0, np.array([[15.0, 15.0]]), none).room(15, 16)[1] == "on a wall"
    assert grown.room(90, 90) == (set(), "no lines close it")
    whole = netrooms.Growth(plane, 1.0, none, np.array([[25.0, 2.0]])).room(15, 15)[0]
    assert sum(map(grown.area, whole)) == pytest.approx(912)  # no door leads into the cell of 50; the narrow face now touches the room twice


@pytest.mark.parametrize("seed", range(8))
def test_grown_rooms_never_pass_walls(seed):
    """Whatever is drawn inside, a room stays in its frame, and its outline's area is that of its faces."""
    rng = np.random.default_rng(seed)
    box = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x0, y1, x1, y1), (x0, y0, x0, y1)]
    lines = box(0, 0, 40, 40) + box(40, 0, 90, 40)
    for _ in range(6):
        x, y = rng.uniform(1, 33, 2)
        lines += box(x, y, x + rng.uniform(1, 6), y + rng.uniform(1, 6))
    plane = planar.Plane(np.array(lines), reach=1e-6)
    grown = netrooms.Growth(plane, 1.0, np.zeros((0, 2)), np.zeros((0, 2)))
    faces, _ = grown.room(0.5, 39.5)
    ring, *holes = plane.outline(faces)
    assert ring.min() >= 0 and ring.max() <= 40
    assert abs(cutouts.area(ring)) - sum(abs(cutouts.area(h)) for h in holes) == pytest.approx(sum(map(grown.area, faces)))


def test_net_rooms_of_sheets(spark):
    lines = spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate([(0, 0, 30, 0), (30, 0, 30, 20), (30, 20, 0, 20), (0, 20, 0, 0)])], "sheet_id long, idx long, x1 double, y1 double, x2 double, y2 double")
    seeds = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 50.0, 5.0), (1, 3, None, 1.0), (2, 4, 1.0, 1.0), (3, 5, 1.0, 1.0)], "sheet_id long, id int, x double, y double")
    sheets = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "sheet_id long, px_per_ft double")
    got = {r.id: (r.status, r.reason, r.area_sf) for r in netrooms.net_rooms(seeds, lines, sheets).collect()}
    assert got[1] == ("ok", "", pytest.approx(150)) and all(got[k][:2] == ("refused", "no lines close it") for k in (2, 3, 4, 5))
    assert {r.reason for r in netrooms.net_rooms(seeds, lines, sheets.where("sheet_id > 1")).collect()} == {"no scale", "no lines close it"}
