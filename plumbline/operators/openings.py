"""Doors, windows and base around rooms: leaves from drawn swings, doors on rings, marks beside openings, and the skirting that is left."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grid import boxed, meeting
from plumbline.plans.scratch import spread

# Widths of leaves (m), sweeps of a swing (degrees), how exactly a curve's points lie on its circle and a leaf on its radius (shares of it), and how two
# leaves meet as one door.
LEAF_M, SWEEP, ON_CIRCLE, LEAF_SLACK, PAIR_SPAN, PAIR_MEET = (0.45, 1.4), (40.0, 115.0), 0.06, 0.10, 0.08, 0.08
# Fixed values, metres: how far a door lies from the ring it opens on, a window's mark from its opening (with what each kind of opening adds), a mullion, the widest window.
WALL_M, MARK_M, MULLION_M, WIDEST_WINDOW_M = 0.40, 2.0, 0.3, 3.0
KIND_PENALTY = {"window": 0.0, "opening": 0.3, "door": 0.3, "gap": 0.6}
ALONG, PARALLEL_DEG, SPAN_SLACK = 0.5, 15.0, 0.3
# Fixed values, metres: steps of the walk around a room, what lies on a face or near one, the shortest break that is an opening, the narrowest passage, a door's frame, the
# widest opening; and the shares that tell a ring off its walls and drawn ink.
STEP_M, ON_M, NEAR_M, JUNCTION_M, PASSAGE_M, FRAME_M, OPENING_M, OFF_SHARE, INK_SHARE, STRAIGHT_DEG = 0.02, 0.03, 0.4, 0.4, 0.6, 0.3, 2.0, 0.5, 0.2, 10.0


def circle_of(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of the circle that fits points best."""
    a = np.column_stack([2 * points, np.ones(len(points))])
    x, y, c = np.linalg.lstsq(a, (points**2).sum(1), rcond=None)[0]
    return np.array([x, y]), float(math.sqrt(max(0.0, c + x * x + y * y)))


def swings(curves: list[np.ndarray], lines: np.ndarray, px_per_m: float) -> list[dict]:
    """Door leaves of a sheet: curves (chains of points) that sweep part of a circle of a leaf's radius, with a straight line from its centre (the hinge) to one of its
    ends; the other end is where the leaf closes. What isn't a door stays, and why."""
    out: list[dict] = []
    for c in curves:
        if len(c) < 3:
            continue
        hinge, r = circle_of(c)
        if not LEAF_M[0] <= r / px_per_m <= LEAF_M[1]:
            continue
        away = np.hypot(*(c - hinge).T)
        angle = np.unwrap(np.arctan2(c[:, 1] - hinge[1], c[:, 0] - hinge[0]))
        sweep = math.degrees(abs(angle[-1] - angle[0]))
        same = next((o for o in out if math.hypot(*(o["hinge"] - hinge)) < 0.1 * r and abs(o["r"] - r) < 0.1 * r and math.hypot(*(o["middle"] - c[len(c) // 2])) < 0.2 * r), None)
        if same is not None:  # one swing drawn twice
            continue
        swing = {"hinge": hinge, "r": r, "middle": c[len(c) // 2], "reject": None, "strike": c[0], "far": c[-1]}
        out.append(swing)
        if np.abs(away - r).max() > max(1.0, ON_CIRCLE * r):
            swing["reject"] = "not a circle"
        elif not SWEEP[0] <= sweep <= SWEEP[1]:
            swing["reject"] = "short sweep" if sweep < SWEEP[0] else "over sweep"
        else:
            slack = max(1.5, LEAF_SLACK * r)
            ends = np.concatenate([lines, lines[:, [2, 3, 0, 1]]]) if len(lines) else np.zeros((0, 4))
            leaf = [k for k in (0, -1) if len(ends) and ((np.hypot(*(ends[:, :2] - hinge).T) <= slack) & (np.hypot(*(ends[:, 2:] - c[k]).T) <= slack)).any()]
            if not leaf:
                swing["reject"] = "no leaf"
            else:
                swing["far"], swing["strike"] = c[leaf[0]], c[-1 - leaf[0]]
    return out


def doors_of(found: list[dict]) -> list[dict]:
    """Doors of judged swings: two leaves that close on one point between their hinges are a pair."""
    leaves, used, out = [s for s in found if s["reject"] is None], set(), []
    for i, a in enumerate(leaves):
        if i in used:
            continue
        used.add(i)
        mate = None
        for j in range(i + 1, len(leaves)):
            b = leaves[j]
            both, span = a["r"] + b["r"], b["hinge"] - a["hinge"]
            meet = a["hinge"] + span * a["r"] / both
            if j not in used and abs(math.hypot(*span) - both) <= PAIR_SPAN * both and all(min(math.hypot(*(e - meet)) for e in (s["strike"], s["far"])) <= PAIR_MEET * both for s in (a, b)):
                mate = j
                break
        if mate is None:
            out.append({"opening": (a["hinge"], a["strike"]), "width": a["r"], "leaves": 1})
        else:
            used.add(mate)
            out.append({"opening": (a["hinge"], leaves[mate]["hinge"]), "width": a["r"] + leaves[mate]["r"], "leaves": 2})
    return out


DOORS = "sheet_id long, x1 double, y1 double, x2 double, y2 double, width double, leaves int, status string, reason string"


def find_doors(curves: DataFrame, lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """Doors of sheets (sheet_id, px_per_m) from curves (sheet_id, points) and straight lines (sheet_id, x1, y1, x2, y2): the opening's ends, its
    width in px and leaves; swings that are no doors are rejected, with the reason. Only lines near a curve's box reach it."""
    near = meeting(boxed(curves.select("sheet_id", "points", F.monotonically_increasing_id().alias("k")), "points", 120.0), lines.select("sheet_id", F.array("x1", "y1", "x2", "y2").alias("line"), F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1")))
    by_sheet = near.groupBy(F.col("a.sheet_id").alias("l_sheet")).agg(F.collect_set("b.line").alias("lines"))
    all_curves = curves.groupBy("sheet_id").agg(F.collect_list("points").alias("curves"))
    joined = all_curves.join(by_sheet, F.col("sheet_id") == F.col("l_sheet"), "left").join(sheets.select(F.col("sheet_id").alias("s_sheet"), "px_per_m"), F.col("sheet_id") == F.col("s_sheet")).select("sheet_id", "curves", "lines", "px_per_m")

    def run(frames):
        for frame in frames:
            out = []
            for sheet, cs, ls, scale in zip(frame["sheet_id"], frame["curves"], frame["lines"], frame["px_per_m"]):
                chains = sorted((np.array([list(p) for p in c], float) for c in cs), key=lambda c: (c[0, 1], c[0, 0]))
                straight = np.array([list(x) for x in ls], float).reshape(-1, 4) if ls is not None else np.zeros((0, 4))
                found = swings(chains, straight, scale)
                out += [(sheet, *d["opening"][0], *d["opening"][1], d["width"], d["leaves"], "door", None) for d in doors_of(found)]
                out += [(sheet, *s["hinge"], *s["strike"], s["r"], 1, "rejected", s["reject"]) for s in found if s["reject"]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOORS.split(", ")])

    return spread(joined).mapInPandas(run, DOORS)


def on_ring(opening: np.ndarray, ring: np.ndarray, reach: float) -> bool:
    """Whether a door's opening runs along a ring: beside an edge about parallel to it, for half its width or more."""
    d = opening[1] - opening[0]
    long = math.hypot(*d)
    e = np.roll(ring, -1, axis=0) - ring
    size = np.hypot(e[:, 0], e[:, 1])
    ok = (size > 0) & (np.abs(e @ d) >= math.cos(math.radians(PARALLEL_DEG)) * size * long)
    if not ok.any() or not long:
        return False
    p = opening[0] + d * np.linspace(0, 1, 11)[:, None]
    a, e = ring[ok], e[ok]
    t = np.clip(((p[:, None] - a) * e).sum(2) / (e * e).sum(1), 0, 1)
    return bool((np.hypot(*np.moveaxis(p[:, None] - (a + t[..., None] * e), 2, 0)).min(1) <= reach).mean() >= ALONG)


def doors_on_rings(doors: DataFrame, rings: DataFrame, reach: float) -> DataFrame:
    """(door_id, ring_id) of doors (sheet_id, id, x1, y1, x2, y2) that open on rings (sheet_id, id, ring) within reach px."""
    line = doors.select("sheet_id", "id", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("opening"))
    met = meeting(boxed(line, "opening", reach), boxed(rings.select("sheet_id", "id", "ring"))).select(F.col("a.id").alias("door_id"), F.col("b.id").alias("ring_id"), "a.opening", "b.ring")

    def run(frames):
        for frame in frames:
            ok = [on_ring(np.array([list(p) for p in o], float), np.array([list(p) for p in r], float), reach) for o, r in zip(frame["opening"], frame["ring"])]
            yield frame.loc[ok, ["door_id", "ring_id"]]

    return met.mapInPandas(run, "door_id long, ring_id long")


def length_mm(text: Column) -> Column:
    """A schedule's length in mm: thousands may be parted, below 10 it is metres, below 100 decimetres."""
    plain = F.replace(F.regexp_replace(F.trim(text), r"([0-9])[\s.](?=[0-9]{3}\b)", "$1"), F.lit(","), F.lit("."))
    n = F.nullif(F.regexp_extract(plain, r"^-?([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return F.floor(F.when(n < 10, n * 1000).when(n < 100, n * 100).otherwise(n) + 0.5)


def marked_openings(marks: DataFrame, openings: DataFrame, px_per_m: float) -> DataFrame:
    """Each mark (sheet_id, ord, x, y) with the opening (sheet_id, id, kind, x1, y1, x2, y2) it stands beside, or none: within reach, and beside its
    span; the nearest, with a penalty for kinds a window's mark is less likely to name. An opening answers for one mark, marks in order.

    Pairs within reach are found on the grid; only the marks and openings of one sheet's pairs are dealt out one after the other.
    """
    reach = MARK_M * px_per_m
    at = marks.select("sheet_id", "ord", F.col("x").alias("mx"), F.col("y").alias("my"), (F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    mid = openings.select("sheet_id", "id", "kind", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), cx.alias("x0"), cy.alias("y0"), cx.alias("x1"), cy.alias("y1"))
    m, o = F.col("a"), F.col("b")
    dx, dy = o["bx"] - o["ax"], o["by"] - o["ay"]
    square = F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    t = ((m["mx"] - o["ax"]) * dx + (m["my"] - o["ay"]) * dy) / square
    away = F.hypot(o["x0"] - m["mx"], o["y0"] - m["my"])
    penalty = F.coalesce(F.create_map(*[F.lit(x) for k, v in KIND_PENALTY.items() for x in (k, v)])[o["kind"]], F.lit(0.0))
    pairs = meeting(at, mid).where((away <= reach) & t.between(-SPAN_SLACK, 1 + SPAN_SLACK)).select(m["sheet_id"].alias("sheet_id"), m["ord"].alias("ord"), o["id"].alias("id"), (away + penalty * px_per_m).alias("score"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for ord_, mine in frame.sort_values(["ord", "score", "id"]).groupby("ord", sort=True):
            best = next((int(i) for i in mine["id"] if i not in taken), None)
            if best is not None:
                taken.add(best)
                out.append((frame["sheet_id"].iloc[0], int(ord_), best))
        return pd.DataFrame(out, columns=["sheet_id", "ord", "opening_id"])

    dealt = pairs.groupBy("sheet_id").applyInPandas(run, "sheet_id long, ord long, opening_id long")
    return marks.select("sheet_id", "ord").join(dealt, ["sheet_id", "ord"], "left")


def window_takeoff(openings: DataFrame, marked: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows (id, type, width_mm, schedule_mm, check): openings that a window's mark names, doors left out, with the mark's schedule width (mark, width_mm) checked to 60 mm; on a
    sheet without marks, the glazed openings of exterior walls."""
    named = marked.where("opening_id IS NOT NULL").join(marks.select("sheet_id", "ord", "mark"), ["sheet_id", "ord"]).select(F.col("sheet_id").alias("m_sheet"), F.col("opening_id"), "mark")
    sheets = marks.select(F.col("sheet_id").alias("marked_sheet")).distinct()
    joined = openings.join(named, (F.col("sheet_id") == F.col("m_sheet")) & (F.col("id") == F.col("opening_id")), "left").join(sheets, F.col("sheet_id") == F.col("marked_sheet"), "left").join(rows.select(F.col("mark").alias("row_mark"), F.col("width_mm").alias("schedule_mm")), F.col("mark") == F.col("row_mark"), "left")
    counts = F.when(F.col("marked_sheet").isNotNull(), F.col("mark").isNotNull() & (F.col("kind") != "door")).otherwise((F.col("kind") == "window") & F.col("exterior"))
    check = F.when(F.col("schedule_mm").isNull(), "no schedule width").when(F.abs(F.col("width_mm") - F.col("schedule_mm")) <= 60, "agrees").otherwise("differs")
    unmarked = F.concat(F.lit("unmarked ~"), (F.floor(F.col("width_mm") / 100 + 0.5) * 100).cast("string"), F.lit(" mm"))
    return joined.where(F.coalesce(counts, F.lit(False))).select("sheet_id", "id", F.coalesce("mark", unmarked).alias("type"), "width_mm", "schedule_mm", check.alias("check"))


def skirting(ring: np.ndarray, faces: np.ndarray, ink: np.ndarray, doors: list[np.ndarray], step: float = STEP_M) -> dict:
    """Base around a room (metres): its ring walked in steps along wall faces (x1, y1, x2, y2). Breaks are doors (with their frames), openings between walls on one line,
    open sides, junctions too short to be any, or flags: where something else is drawn (ink), or the ring is off its walls. Flagged length is not deducted.

    Returns gross, net, deductions [(kind, length)], and flags [(reason, length)].
    """
    legs = np.roll(ring, -1, axis=0) - ring
    long = np.hypot(legs[:, 0], legs[:, 1])
    ring, legs, long = ring[long > 1e-9], legs[long > 1e-9], long[long > 1e-9]
    n = np.maximum(1, np.ceil(long / step)).astype(int)
    leg = np.repeat(np.arange(len(ring)), n)
    share = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[leg]
    p, w = ring[leg] + legs[leg] * share[:, None], (long / n)[leg]
    u = legs / long[:, None]

    def beside(lines: np.ndarray, reach: float, parallel: bool) -> np.ndarray:
        out = np.zeros(len(p), bool)
        for x1, y1, x2, y2 in lines:
            d, a = np.array([x2 - x1, y2 - y1]), np.array([x1, y1])
            size = math.hypot(*d)
            if size > 0:
                t = (p - a) @ d / (size * size)
                off = np.abs((p - a) @ np.array([-d[1], d[0]])) / size
                ok = (t >= 0) & (t <= 1) & (off <= reach)
                if parallel:
                    ok &= np.abs(u[leg][:, 0] * d[1] - u[leg][:, 1] * d[0]) <= math.sin(math.radians(4.0)) * size
                out |= ok
        return out

    on, near, drawn = beside(faces, ON_M, True), beside(faces, NEAR_M, True), beside(ink, NEAR_M, False)
    gross = float(long.sum())
    deductions, flags, gone = [], [], np.zeros(len(p), bool)
    for door in doors:
        if not on_ring(door, ring, WALL_M):
            continue
        at, size = door.mean(0), math.hypot(*(door[1] - door[0]))
        along = np.abs(u[leg] @ ((door[1] - door[0]) / size)) >= math.cos(math.radians(PARALLEL_DEG))
        best = int(np.where(along, np.hypot(*(p - at).T), np.inf).argmin())
        mine = np.zeros(len(p), bool)
        for way in (1, -1):  # half the leaf both ways, then on to where the wall begins
            k, went = best, 0.0
            while went < size / 2 and not mine.all():
                mine[k % len(p)] = True
                went += w[k % len(p)]
                k += way
            while not on[k % len(p)] and not mine.all():
                mine[k % len(p)] = True
                k += way
        width = float(w[mine].sum())
        if (mine & gone).sum() > mine.sum() / 2:
            continue
        if width > size + 2 * FRAME_M + 2 * step:
            flags.append(("door gap", width))
        gone |= mine
        deductions.append(("door", width))
    bad = ~on & ~gone
    if bad.all() and not deductions:
        return {"gross": gross, "net": gross, "deductions": [], "flags": [("off walls" if near.any() else "nothing drawn", gross)]}
    from plumbline.operators.transitions import islands

    for run in islands(bad) if bad.any() else ():
        width = float(w[run].sum())
        if width < JUNCTION_M:
            continue
        turns = [abs(float(u[a] @ u[b])) < math.cos(math.radians(STRAIGHT_DEG)) for a, b in zip(leg[run], leg[run][1:]) if a != b]
        before, after = (run[0] - 1) % len(p), (run[-1] + 1) % len(p)
        line = p[run[-1]] - p[run[0]]
        normal = np.array([-line[1], line[0]]) / max(math.hypot(*line), 1e-12)
        one_line = all(abs(float((p[k] - p[run[0]]) @ normal)) <= ON_M for k in (before, after))
        off, inked = near[run].mean() >= OFF_SHARE, drawn[run].mean() >= INK_SHARE
        if width <= OPENING_M:
            if width < PASSAGE_M:
                continue
            kind, why = "opening", "off walls" if off or any(turns) or not one_line else "something drawn" if inked else None
        else:
            kind, why = "open side", "off walls" if off or any(turns) else "something drawn" if inked else None
        if why:
            flags.append((why, width))
        else:
            gone[run] = True
            deductions.append((kind, width))
    return {"gross": gross, "net": gross - float(w[gone].sum()), "deductions": deductions, "flags": flags}


BASE = "sheet_id long, id long, gross_m double, net_m double, doors_m double, openings_m double, open_sides_m double, flagged_m double, status string, reason string"


def derive_base(rooms: DataFrame, faces: DataFrame, ink: DataFrame, doors: DataFrame) -> DataFrame:
    """Base of rooms (sheet_id, id, ring in metres) from wall faces, other ink and doors (sheet_id, x1, y1, x2, y2) near them: measured, or flagged and why."""
    seg = lambda df: df.select("sheet_id", F.array("x1", "y1", "x2", "y2").alias("line"), F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    wide = boxed(rooms.select("sheet_id", "id", "ring"), margin=NEAR_M)
    listed = lambda df, name: meeting(wide, seg(df)).groupBy(F.col("a.id").alias(f"{name}_id")).agg(F.collect_list("b.line").alias(name))
    joined = rooms.select("sheet_id", "id", "ring")
    for df, name in ((faces, "faces"), (ink, "ink"), (doors, "doors")):
        joined = joined.join(listed(df, name), F.col("id") == F.col(f"{name}_id"), "left").drop(f"{name}_id")

    def run(frames):
        lines = lambda v: np.array(sorted(list(x) for x in v), float).reshape(-1, 4) if v is not None else np.zeros((0, 4))
        for frame in frames:
            out = []
            for sheet, i, ring, f, k, d in zip(*(frame[c] for c in ("sheet_id", "id", "ring", "faces", "ink", "doors"))):
                got = skirting(np.array([list(p) for p in ring], float), lines(f), lines(k), [x.reshape(2, 2) for x in lines(d)])
                part = lambda kind: sum(x for n, x in got["deductions"] if n == kind)  # noqa: E731,B023
                why = ", ".join(sorted({r for r, _ in got["flags"]})) or None
                out.append((sheet, i, got["gross"], got["net"], part("door"), part("opening"), part("open side"), sum(x for _, x in got["flags"]), "flagged" if why else "measured", why))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BASE.split(", ")])

    return joined.mapInPandas(run, BASE)


def labelled_placements(placements: DataFrame, spans: DataFrame, reach: float = 3.0) -> DataFrame:
    """Placements (sheet_id, id, x, y) with the drawing's own name for them: the nearest mark-like text (sheet_id, ord, str, x0, y0, x1, y1) within reach of its heights, at least 8 px."""
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(8.0))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    marks = spans.where(F.trim("str").rlike("^[A-Z]{1,3}-?[0-9]{1,3}[A-Z]?$")).select("sheet_id", "ord", F.trim("str").alias("mark"), (reach * h).alias("reach"), cx.alias("cx"), cy.alias("cy"), (cx - reach * h).alias("x0"), (cy - reach * h).alias("y0"), (cx + reach * h).alias("x1"), (cy + reach * h).alias("y1"))
    at = placements.select("sheet_id", "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    away = F.hypot(F.col("b.cx") - F.col("a.x0"), F.col("b.cy") - F.col("a.y0"))
    near = meeting(at, marks).where(away <= F.col("b.reach")).groupBy(F.col("a.sheet_id").alias("n_sheet"), F.col("a.id").alias("n_id")).agg(F.min(F.struct(away.alias("away"), F.col("b.ord").alias("ord"), F.col("b.mark").alias("mark"))).alias("best"))
    joined = placements.join(near, (F.col("sheet_id") == F.col("n_sheet")) & (F.col("id") == F.col("n_id")), "left")
    return joined.select("sheet_id", "id", F.col("best.mark").alias("label"), F.when(F.col("best").isNotNull(), "adjacent").alias("via"), F.floor(F.col("best.away") + 0.5).alias("distance_px"))
