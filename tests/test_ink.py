"""Classes of lines against loops, planted drawings and noise."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import ink

LINE = "sheet_id long, idx long, x1 double, y1 double, x2 double, y2 double, pen int, clip boolean, fill boolean, path long"


def chords(cx, cy, r, start, sweep, n):
    t = np.radians(start + sweep * np.arange(n + 1) / n)
    x, y = cx + r * np.cos(t), cy + r * np.sin(t)
    return np.column_stack([x[:-1], y[:-1], x[1:], y[1:]])


def test_arcs_in_chains():
    door = chords(0, 0, 40, 0, 90, 8)
    assert ink.arc_classes(door) == ["arc"] * 8
    assert ink.arc_classes(chords(0, 0, 40, 0, 360, 24)) == ["circle"] * 24
    stub = np.concatenate([[[60.0, -3.0, 40.0, 0.0]], door])  # a leader drawn on to the swing
    assert ink.arc_classes(stub)[2:] == ["arc"] * 7
    cloud = np.concatenate([chords(20 * k, 0, 10, 180, 180, 6) for k in range(6)])
    assert ink.arc_classes(cloud) == ["cloud"] * 36
    double = np.concatenate([chords(0, 0, 40, 90, -90, 8), chords(80, 0, 40, 180, -90, 8)])  # two leaves of one door
    assert set(ink.arc_classes(double)) == {"arc"}
    assert ink.arc_classes(np.array([[k * 10.0, 0, k * 10 + 10, 0] for k in range(9)])) == [None] * 9
    zigzag = np.array([[k * 10.0, k % 2 * 8.0, k * 10 + 10, (k + 1) % 2 * 8.0] for k in range(9)])
    assert ink.arc_classes(zigzag) == [None] * 9
    ellipse = np.column_stack([100 * np.cos(np.radians(np.arange(-90, 100, 10))), 30 * np.sin(np.radians(np.arange(-90, 100, 10)))])
    assert ink.arc_classes(np.column_stack([ellipse[:-1], ellipse[1:]])) == [None] * 18


def plain_hatch(rows, cap):
    """rows: (place, low, high, pen) of level lines."""
    out = []
    for i, (c, low, high, pen) in enumerate(rows):
        at = [r[0] - c for j, r in enumerate(rows) if j != i and r[3] == pen and min(high, r[2]) - max(low, r[1]) >= 0.5]
        has = lambda t: any(abs(d - t) <= 0.5 for d in at)  # noqa: B023, E731
        up, down = min((d for d in at if 0.5 < d <= cap + 0.5), default=None), min((-d for d in at if 0.5 < -d <= cap + 0.5), default=None)
        fits = lambda p: (has(p) and has(-p) and (has(2 * p) or has(-2 * p))) or (has(p) and has(2 * p) and has(3 * p) and down <= p + 0.5) or (has(-p) and has(-2 * p) and has(-3 * p) and up <= p + 0.5)  # noqa: B023, E731
        out.append(up is not None and down is not None and (fits(up) or fits(down)))
    return out


def test_hatch_equals_a_loop(spark):
    r = random.Random(2)
    rows, lines = {}, []
    for s in range(12):
        mine = [(float(r.randrange(0, 120)), float(a := r.randrange(0, 50)), float(a + r.randrange(5, 80)), r.choice([1, 1, 2])) for _ in range(40)]
        mine += [(20 + k * 5.0 + r.choice([0, 0, 0.2]), 10.0, 60.0, 1) for k in range(r.randrange(3, 9))]
        rows[s] = mine
        lines += [(s, k, low, c, high, c, pen, False, False, None) for k, (c, low, high, pen) in enumerate(mine)]
    from plumbline.operators.wallnet import directed

    straight = directed(spark.createDataFrame([(*x, 10.0) for x in lines], LINE + ", m double"), ink.ONE_WAY)
    got = {tuple(x) for x in ink.hatch_classes(straight).collect()}
    want = {(s, k) for s, mine in rows.items() for k, yes in enumerate(plain_hatch(mine, 10 * ink.PITCH_FT)) if yes}
    assert got == want and len(want) > 30


def drawn(spark, figures):
    lines = [(k, i, *map(float, e[:4]), *(e[4:] or (1,)), False, False, None) for k, some in figures.items() for i, e in enumerate(some)]
    return {k: c for k, c in _grouped(ink.classify_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame([], "sheet_id long, x double, y double, w double, h double"), spark.createDataFrame([(k, 10.0) for k in figures], "sheet_id long, px_per_ft double")).collect()).items()}


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sheet_id, {})[r.idx] = r["class"]
    return out


def test_what_is_no_dimension_string(spark):
    """Witnesses need ticks and ink past the joint; a wall's face has a partner; coursing is too close."""
    string = [(-3, 0, 163, 0), *[(x, -3, x, 8) for x in (0, 80, 160)], *[(x - 2, -2, x + 2, 2) for x in (0, 80, 160)]]
    turn = lambda rows, a: [(x1 * math.cos(a) - y1 * math.sin(a), x1 * math.sin(a) + y1 * math.cos(a), x2 * math.cos(a) - y2 * math.sin(a), x2 * math.sin(a) + y2 * math.cos(a)) for x1, y1, x2, y2 in rows]
    got = drawn(spark, {
        1: string, 2: turn(string, 0.6), 3: string[:4], 4: [*string, (-3, 5, 163, 5)], 5: [(0, 0, 160, 0), (0, 0, 0, 40), (160, 0, 160, 40), (-2, -2, 2, 2), (158, -2, 162, 2)],
        6: [(-3, 0, 60, 0), *[(x, -3, x, 8) for x in range(0, 60, 8)], *[(x - 2, -2, x + 2, 2) for x in range(0, 60, 8)]],
    })
    assert Counter(got[1].values()) == Counter(got[2].values()) == {"dimension": 7}
    assert all("dimension" not in got[k].values() for k in (3, 4, 5, 6))


def test_every_line_has_one_class(spark):
    r = random.Random(8)
    lines = [(s, k, *(r.uniform(0, 300) for _ in range(4)), r.choice([1, 2, None]), r.random() < 0.05, r.random() < 0.05, r.choice([None, k // 4])) for s in range(4) for k in range(80)]
    lines += [(0, 900, None, 1.0, 2.0, 3.0, 1, False, False, None), (0, 901, 5.0, 5.0, 5.0, 5.0, 1, None, None, 3), (77, 1, 0.0, 0.0, 9.0, 9.0, 1, False, False, None), (None, 2, 0.0, 0.0, 9.0, 9.0, 1, False, False, None)]
    texts = spark.createDataFrame([(0, 5.0, 5.0, None, None)], "sheet_id long, x double, y double, w double, h double")
    found = ink.classify_lines(spark.createDataFrame(lines, LINE), texts, spark.createDataFrame([(s, 10.0 if s else None) for s in range(4)], "sheet_id long, px_per_ft double")).collect()
    assert sorted(((r.sheet_id is None, r.sheet_id or 0), r.idx) for r in found) == sorted(((x[0] is None, x[0] or 0), x[1]) for x in lines)
    assert {r["class"] for r in found} <= set(ink.CLASSES) and {(r.sheet_id, r.idx) for r in found if r["class"] == "clip"} == {(x[0], x[1]) for x in lines if x[7]}
    assert ink.classify_lines(spark.createDataFrame([], LINE), texts, spark.createDataFrame([], "sheet_id long, px_per_ft double")).count() == 0


@pytest.mark.parametrize("n", [5, 6])
def test_flecks_need_company(spark, n):
    lines = [(1, 2 * k + j, 100.0 + k * 2, 100.0, 101.0 + k * 2, 101.0, 1, False, False, k) for k in range(n) for j in range(2)]
    got = _grouped(ink.classify_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame([], "sheet_id long, x double, y double, w double, h double"), spark.createDataFrame([(1, 10.0)], "sheet_id long, px_per_ft double")).collect())
    assert Counter(got[1].values()) == {"fleck" if n > 5 else "plain": 2 * n}
