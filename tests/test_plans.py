"""Plan geometry, schedules, stitches and session tables held against brute force and stated edge cases."""

import json
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import outlines
from plumbline.operators import cutouts, grid, islands, merge, overlay, stitches, tables, walls, workspace
from plumbline.sources import archive, takeoff, workbook
from plumbline.streaming import capture


def rect(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def measured(polygons):
    return sum(abs(cutouts.area(p[0])) - sum(abs(cutouts.area(h)) for h in p[1:]) for p in polygons)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_differences_have_the_area_that_is_left(seed):
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 7))
    far = rng.uniform(2, 6, 7)
    star = np.column_stack([far * np.cos(turn), far * np.sin(turn)]) + rng.uniform(-2, 2, 2)
    star = star[rng.permutation(7)] if seed % 3 == 0 else star  # crosses itself many times
    base = rect(-4, -4, 4, 4)
    shared = overlay.overlay_area([[base], [star]], 2)
    assert measured(cutouts.difference([base], star)) == pytest.approx(64 - shared, abs=1e-6)


def test_cuts_are_never_guessed():
    base = [rect(0, 0, 10, 10)]
    hole = cutouts.cut_out(base, rect(2, 2, 4, 4))
    assert len(hole) == 2 and measured([hole]) == pytest.approx(96)
    assert cutouts.cut_out(base, rect(4, -1, 6, 11)) is None  # falls apart
    assert cutouts.cut_out(base, rect(-1, -1, 11, 11)) is None  # gone
    assert cutouts.cut_out(base, rect(2, 2, 4, 4)[:2]) is None
    notch = cutouts.cut_out(base, rect(0, 0, 3, 3))  # edges that coincide
    assert len(notch) == 1 and measured([notch]) == pytest.approx(91)
    assert measured([cutouts.recomposed(base, [rect(1, 1, 2, 2), rect(3, 3, 5, 5)])]) == pytest.approx(95)
    assert cutouts.recomposed(base, [rect(1, 1, 2, 2), rect(4, -1, 6, 11)]) is None
    assert [cutouts.judged_cut(base, c)[1] for c in (rect(2, 2, 4, 4), rect(4, -1, 6, 11), rect(-1, -1, 11, 11), rect(0, 0, 1, 1)[:2])] == ["", "the floor would fall apart", "nothing would be left", "fewer than three points"]


def test_boxes_of_all_sizes_meet(spark):
    rng = np.random.default_rng(5)
    size = 10.0 ** rng.uniform(-2, 3, 150)
    x, y = rng.uniform(-500, 500, (2, 150))
    rows = [(int(i % 3), i, float(a), float(b), float(a + s), float(b + s * (i % 2))) for i, (a, b, s) in enumerate(zip(x, y, size))]
    rows += [(None, 900, 0.0, 0.0, 1.0, 1.0), (1, 901, None, 0.0, 1.0, 1.0), (1, 902, 5.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sheet_id int, id int, x0 double, y0 double, x1 double, y1 double")
    found = sorted((r["p"], r["q"]) for r in grid.meeting(df, df).select(F.col("a.id").alias("p"), F.col("b.id").alias("q")).collect())
    sound = rows[:150]
    expected = sorted((p[1], q[1]) for p in sound for q in sound if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert found == expected


HEADERS = [("ROOM NO.", 100), ("ROOM NAME", 200), ("FLOOR", 300), ("BASE", 400), ("WALLS", 500)]
LINES = [("101", "OFFICE", "CPT-1", "RB-1", "PT-1"), ("102", "STORE", "VCT-1", "RB-2", "PT-2"), ("103", "HALL", "CPT-2", "RB-1", "PT-1")]


def schedule(top=50.0):
    out = [tables.Span(0, "ROOM FINISH SCHEDULE", 100, top - 30, 130, 12)]
    out += [tables.Span(1 + n, h, x, top, len(h) * 6.0, 10) for n, (h, x) in enumerate(HEADERS)]
    return out + [tables.Span(100 + i * 10 + n, c, HEADERS[n][1], top + 30 + i * 15, len(c) * 6.0, 10) for i, line in enumerate(LINES) for n, c in enumerate(line)]


def cells(found):
    return [(r.key, r.text("FLOOR"), r.text("BASE"), r.text("WALLS")) for r in found.rows]


WANTED = [(line[0], *line[2:]) for line in LINES]


def test_schedules_in_rows():
    (found,) = tables.read_tables(schedule(), "room-finish")
    assert found.title.text == "ROOM FINISH SCHEDULE" and cells(found) == WANTED
    assert tables.read_tables([], "room-finish") == [] and tables.sheet_tables([]) == []
    assert tables.read_tables(schedule()[6:], "room-finish") == []  # no header, no table


def test_schedules_with_walls_under_a_parent():
    spans = schedule()[:5] + [tables.Span(8, "WALLS", 545, 38, 30, 10)]
    spans += [tables.Span(9 + n, h, x, 50, 30, 10) for n, (h, x) in enumerate((("NORTH", 500), ("SOUTH", 550), ("EAST", 600), ("WEST", 650)))]
    spans += [s for s in schedule()[6:] if s.x < 500]
    spans += [tables.Span(500 + i * 10 + n, f"PT-{n}", x, 80 + i * 15, 24, 10) for i in range(3) for n, x in enumerate((500, 550, 600, 650))]
    (found,) = tables.read_tables(spans, "room-finish")
    walls = [h for h in found.headers if "WALL" in h or h in ("NORTH", "SOUTH", "EAST", "WEST")]
    assert len(walls) == 4 and [[r.text(h) for h in walls] for r in found.rows] == [["PT-0", "PT-1", "PT-2", "PT-3"]] * 3


def test_finishes_of_another_family_are_refused(spark):
    heads = [("MARK", 100), ("MATERIAL", 200), ("MANUFACTURER", 300), ("COLOR", 400)]
    spans = [tables.Span(0, "PLUMBING FIXTURE SCHEDULE", 100, 20, 150, 12)] + [tables.Span(1 + n, h, x, 50, len(h) * 6.0, 10) for n, (h, x) in enumerate(heads)]
    spans += [tables.Span(10 + n, c, x, 80, len(c) * 6.0, 10) for n, (c, (_, x)) in enumerate(zip(("P-1", "STEEL", "ACME", "GREY"), heads))]
    assert not [t for t in tables.sheet_tables(spans) if t.kind == "finish" and t.rows]


def test_outlines_keep_what_drifts():
    ring = rect(0, 0, 10, 10)
    same, changed = outlines.tidied(ring, np.zeros((0, 2)))
    assert not changed and np.array_equal(same, ring)
    two, changed = outlines.tidied(ring[:2], ring)
    assert not changed and len(two) == 2
    assert np.array_equal(outlines.onto_lines(ring, np.zeros((0, 4)), 1.0), ring)


def test_faulty_stitches_go_whole(spark):
    rows = [("stitch:1", 0, "a", 5.0, 0.0), ("stitch:1", 1, "b", 95.0, 10.0), ("stitch:2", 0, "a", 0.0, 0.0), ("stitch:3", 0, "a", 0.0, 0.0), ("stitch:3", 1, "a", 90.0, 0.0)]
    rows += [("stitch:4", 0, "a", 0.0, 0.0), ("stitch:4", 1, "stitch:1", 90.0, 0.0), ("stitch:5", 0, "a", 0.0, 0.0), ("stitch:5", 1, "b", float("nan"), 0.0), ("other", 0, "a", 0.0, 0.0), ("other", 1, "b", 9.0, 0.0)]
    found = stitches.sane_stitches(spark.createDataFrame(rows, "stitch_id string, ord int, key string, dx double, dy double")).orderBy("ord").collect()
    assert [tuple(r) for r in found] == [("stitch:1", 0, "a", 0.0, 0.0), ("stitch:1", 1, "b", 90.0, 10.0)]
    flush = stitches.side_by_side(spark.createDataFrame([("s", i, k) for i, k in enumerate("abc")], "stitch_id string, ord int, key string"), spark.createDataFrame([("a", 100.0), ("c", 50.0)], "sheet_id string, width double"))
    assert [r["dx"] for r in flush.orderBy("ord").collect()] == [0.0, 100.0, 100.0]


def test_imports_are_taken_whole_or_not_at_all(spark):
    frames = lambda multiplier, upp, ids: {
        "sheets": spark.createDataFrame([("s", upp)], "sheet_id string, units_per_px double"),
        "conditions": spark.createDataFrame([("c1", 0, "T-1", multiplier, None)], "id string, ord long, finish_tag string, multiplier double, variant_of string"),
        "shapes": spark.createDataFrame([(i, "s", "c1", "floor_area", None) for i in ids], "id string, sheet_id string, condition_id string, measure_role string, reviewed boolean"),
    }
    mine = frames(1.0, 0.1, ["a"])
    with pytest.raises(ValueError, match="multiplier"):
        merge.import_takeoff(mine, frames(0.0, 0.1, ["b"]))
    with pytest.raises(ValueError, match="scales conflict"):
        merge.import_takeoff(mine, frames(1.0, 0.2, ["b"]))
    out, note = merge.import_takeoff(mine, frames(1.0, 0.1, ["a", "b"]))
    assert sorted(r["id"] for r in out["shapes"].collect()) == ["a", "b"] and (note["shapes_added"], note["replaced"]) == (1, False)
    empty = {k: v.limit(0) for k, v in mine.items()}
    out, note = merge.import_takeoff(empty, mine)
    assert note["replaced"] and out["shapes"].count() == 1


def test_tabs_have_names_that_open():
    names = workbook.tab_names(["a/b", "A_B", "x" * 40, "x" * 41, "'q'", "", "  "])
    assert len({n.lower() for n in names}) == 7 and all(0 < len(n) <= 31 and not set(n) & set("[]:*?/\\") for n in names)
    assert workbook.plain_text("a\x00b\ud800c") == "abc"
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_archives_that_are_none(spark, tmp_path):
    good = archive.pack(json.dumps({"conditions": []}), {"a.pdf": b"x"}, "One")
    assert archive.unpack(good)[:3] == ("ok", None, "One") and archive.unpack(good)[4] == ["a.pdf"]
    assert archive.unpack(b"")[1] == "not an archive"
    for name, text, why in (("other.json", "{}", "no manifest"), (archive.MANIFEST, "{", "manifest is not JSON"), (archive.MANIFEST, "{}", "another version"), (archive.MANIFEST, json.dumps({"schema": archive.VERSION}), "no takeoff")):
        path = tmp_path / "a.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, text)
        assert archive.unpack(path.read_bytes())[:2] == ("refused", why)
    path = tmp_path / "b.zip"
    path.write_bytes(good)
    found = archive.read_archives(spark.read.format("binaryFile").load(str(path)).select("path", "content")).collect()
    assert [r["project_name"] for r in found] == ["One"]
    layers = spark.range(1).select(*[archive.layer_name(F.lit(t), "HOLE") for t in ("cpt/1 : x", None, "a  b")]).first()
    assert list(layers) == ["PL-CPT-1 - X-HOLE", "PL-UNTAGGED-HOLE", "PL-A B-HOLE"]


def test_mirrors_replace_the_whole(spark, tmp_path):
    path = str(tmp_path / "m")
    capture.mirror(spark.range(10), path)
    capture.mirror(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    takeoff.write_guarded(spark.range(4), str(tmp_path / "g"))
    takeoff.write_guarded(spark.range(5), str(tmp_path / "g"))
    (tmp_path / "g").rename(tmp_path / "g.old")  # a crash between the two renames
    takeoff.write_guarded(spark.range(6), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 6 and not (tmp_path / "g.old").exists()
    takeoff.write_guarded(spark.range(5), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 5


def test_points_near_each_other(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 40, (60, 2))
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(at)], "sheet_id int, id int, x double, y double")
    found = sorted((r["a_id"], r["b_id"]) for r in workspace.near_pairs(df, 5.0).collect())
    assert found == [(i, j) for i in range(60) for j in range(i + 1, 60) if np.hypot(*(at[i] - at[j])) <= 5.0]


def test_islands_against_a_flood():
    rng = np.random.default_rng(1)
    ring = np.array([[1, 1], [20, 1], [20, 16], [8, 16], [8, 9], [1, 9]], float)
    for _ in range(40):
        wall = rng.random((18, 22)) < 0.45
        lines = {y: [(int(x), int(x) + 1) for x in np.flatnonzero(wall[y])] for y in range(18)}
        free = {(x, y) for y in range(18) for p, q in islands.inner_runs(ring, y) for x in range(p, q) if not wall[y, x]}
        expected = []
        while free:
            todo, found = [free.pop()], []
            while todo:
                x, y = todo.pop()
                found.append((x, y))
                for step in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if step in free:
                        free.remove(step)
                        todo.append(step)
            low, high = np.min(found, axis=0), np.max(found, axis=0)
            if 4 <= len(found) <= 30 and (high - low).min() >= 1:
                expected.append((len(found), *low, *(high + 1)))
        got = [(cells, *shape.min(0), *shape.max(0)) for cells, shape in islands.enclosed(ring, lines, 30)]
        assert sorted(got) == sorted(expected)
    assert islands.enclosed(ring, {}, 30) == []


def test_wall_faces_in_any_direction(spark):
    rng = np.random.default_rng(7)
    angle = rng.uniform(0, np.pi, 40)
    at = rng.uniform(0, 600, (40, 2))
    size = rng.uniform(40, 300, 40)
    far = rng.uniform(0, 50, 40)
    way = np.column_stack([np.cos(angle), np.sin(angle)])
    a = np.column_stack([at, at + way * size[:, None]])
    side = np.column_stack([-way[:, 1], way[:, 0]]) * far[:, None]
    b = a + np.column_stack([side, side]) + np.column_stack([way, way]) * 15
    lines = np.concatenate([a, b])

    def is_wall(p, q):
        u = (p[2:] - p[:2]) / np.hypot(*(p[2:] - p[:2]))
        e = q[2:] - q[:2]
        if min(np.hypot(*(p[2:] - p[:2])), np.hypot(*e)) < 80 or abs(u[0] * e[1] - u[1] * e[0]) > np.sin(np.radians(1.5)) * np.hypot(*e):
            return False
        middle = (q[:2] + q[2:]) / 2 - p[:2]
        t = sorted(((q[:2] - p[:2]) @ u, (q[2:] - p[:2]) @ u))
        return 7 <= abs(u[0] * middle[1] - u[1] * middle[0]) <= 35 and min(np.hypot(*(p[2:] - p[:2])), t[1]) - max(0, t[0]) >= 80

    rows = [(0, i, *map(float, s)) for i, s in enumerate(lines)]
    segments = spark.createDataFrame(rows, "sheet_id int, idx int, x1 double, y1 double, x2 double, y2 double")
    found = walls.wall_pairs(segments, spark.createDataFrame([(0, 100.0)], "sheet_id int, px_per_m double")).collect()
    expected = [(i, j) for i in range(80) for j in range(i + 1, 80) if is_wall(lines[i], lines[j])]
    assert sorted((r["a_idx"], r["b_idx"]) for r in found) == expected and expected
    for r in found:  # the middle line lies half a thickness off the first face
        p = lines[r["a_idx"]]
        u = (p[2:] - p[:2]) / np.hypot(*(p[2:] - p[:2]))
        assert abs(abs(u[0] * (r["y1"] - p[1]) - u[1] * (r["x1"] - p[0])) - r["thickness_m"] * 50) < 1e-6


def test_all_tables_of_a_sheet_are_read():
    """Fifteen schedules below each other, none lost."""
    spans = []
    for k in range(15):
        moved = [tables.Span(s.ord + 1000 * k, s.text, s.x, s.y + 130 * k, s.w, s.h) for s in schedule()]
        spans += moved
    found = tables.read_tables(spans, "room-finish")
    assert sum(len(t.rows) for t in found) == 45 and {r.key for t in found for r in t.rows} == {"101", "102", "103"}
    heads = (("MARK", 100), ("CFM", 180), ("VOLTS", 260), ("REMARKS", 340))
    devices = []
    for k in range(14):
        devices += [tables.Span(100 * k + n, h, x, 40 + 90 * k, len(h) * 6.0, 10) for n, (h, x) in enumerate(heads)]
        devices += [tables.Span(100 * k + 10 + 10 * i + n, c, heads[n][1], 60 + 90 * k + 15 * i, len(c) * 6.0, 10) for i in range(2) for n, c in enumerate((f"AHU-{k * 2 + i + 1}", "900", "208", "NEW"))]
    got = tables.read_tables(devices, "equipment")
    assert sorted(int(r.key.split("-")[1]) for t in got for r in t.rows) == list(range(1, 29))


def test_columns_lie_where_data_leave_gaps():
    """Headers centred over wide columns, data at the columns' left, one cell that runs over into the next."""
    heads = [("MARK", 130), ("MODEL", 330), ("VOLTS", 530), ("REMARKS", 730)]
    spans = [tables.Span(n, h, x - len(h) * 3.0, 40, len(h) * 6.0, 10) for n, (h, x) in enumerate(heads)]
    rows = [(f"EF-{i + 1}", f"X{i}", "208", "NONE") for i in range(12)]
    rows[4] = ("EF-5", "A MODEL NAME THAT RUNS ON FAR TOO LONG", "208", "NONE")
    spans += [tables.Span(10 + 10 * i + n, c, 60.0 + 200 * n, 60 + 15 * i, len(c) * 6.0, 10) for i, row in enumerate(rows) for n, c in enumerate(row)]
    (found,) = tables.read_tables(spans, "equipment")
    assert [tuple(r.text(h) for h in ("MARK", "MODEL", "VOLTS", "REMARKS")) for r in found.rows] == rows


def test_tiers_name_what_stands_below_them():
    """DOOR and FRAME over two columns each, of the same names."""
    spans = [tables.Span(0, "DOOR", 190, 30, 24, 10), tables.Span(1, "FRAME", 387, 30, 30, 10)]
    heads = [("MARK", 60), ("WIDTH", 150), ("MATERIAL", 240), ("TYPE", 350), ("MATERIAL", 440)]
    spans += [tables.Span(2 + n, h, x - len(h) * 3.0, 44, len(h) * 6.0, 10) for n, (h, x) in enumerate(heads)]
    spans += [tables.Span(10 + 10 * i + n, c, heads[n][1] - 12, 64 + 15 * i, 24, 10) for i in range(3) for n, c in enumerate((f"10{i}", "900", "WD", "F1", "HM"))]
    (found,) = tables.read_tables(spans, "opening")
    assert found.headers == ["MARK", "WIDTH", "DOOR MATERIAL", "TYPE", "FRAME MATERIAL"]
    assert [found.rows[0].text(h) for h in found.headers] == ["100", "900", "WD", "F1", "HM"]
