"""What a sheet's lines are, told from the lines themselves: curves, hatch, dimension strings, offset rings, flecks, boxes around labels, and what may be a wall.

Each classifier is a join over all sheets between a line and what lies near it along its own direction; only the fit of circles goes through the chains of a sheet in order.
A line has one class, the first of CLASSES that any classifier gives it. Without a scale only clip paths, curves and hatch are told.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.grid import meeting
from plumbline.operators.openings import circle_of
from plumbline.operators.wallnet import chained, directed
from plumbline.plans.scratch import kept, shuffled

CLASSES = ["clip", "circle", "cloud", "arc", "hatch", "dimension", "ring", "fleck", "tag box", "plain"]
# Fixed values of curves: chords of an arc, its least turn, the least and most turn between chords (degrees), ratio of chords; residual of the fit (share of the radius, px at least);
# the turn that closes a circle; of a cloud: cusps, ratio of radii, length of its run in radii.
CHORDS, ARC_TURN, LEAST_TURN, MOST_TURN, CHORD_RATIO, FIT, FIT_PX, CLOSED, CUSPS, CUSP_RATIO, CUSP_RUN = 4, 30.0, 2.0, 45.0, 3.0, 0.03, 0.75, 300.0, 3, 1.5, 8.0
# Fixed values of hatch: one direction (degrees), pitch (feet; px without a scale), half a cell in which rows agree (px).
ONE_WAY, PITCH_FT, PITCH_PX, HALF = 2.0, 24 / 18, 24.0, 0.5
# Fixed values of offset rings, feet: the line's length, how far its heavier neighbour is, and which share of it that runs along.
RING_FT, NEAR_FT, FAR_FT, BESIDE = 4.0, 0.25, 2.0, 0.6
# Size of a fleck, the cell in which they are counted (feet), how many make a texture; area of a tag box (square feet) and the share that text fills.
FLECK_FT, FIELD_FT, FIELD, TAG_SF, TAG_TEXT = 4 / 18, 2.0, 6, 6.0, 0.25
# Fixed values of dimension strings, feet: gap and offset of one line's pieces, its length; a partner that makes it a wall's face (how near, share); witness lines' length, how near they meet the
# line, how far apart; ticks' length and angle (degrees), how near a joint; what goes on past a joint; how many joints, how many ticked, and their share.
GAP_FT, OFF_FT, RUN_FT, PARTNER_FT, PARTNER, WITNESS_FT, SOFT_FT, ATTACH_FT, APART_FT, TICK_FT, TICK_DEG, AT_JOINT_FT, PAST_FT, JOINTS, TICKED, TICK_SHARE = 0.6, 0.06, 4.0, 1.0, 0.4, 0.3, 8.0, 0.35, 1.5, (0.2, 1.5), (20.0, 70.0), 0.5, 0.1, 2, 2, 0.5


def arc_windows(ends: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first chord, last chord, signed turn, radius) of the arcs in a chain of joined chords (x1, y1, x2, y2): stretches that turn evenly one way, and fit a circle once
    an end that doesn't is left out."""
    d = ends[:, 2:] - ends[:, :2]
    long, way = np.hypot(d[:, 0], d[:, 1]), np.degrees(np.arctan2(d[:, 1], d[:, 0]))
    turn = (np.diff(way) + 180) % 360 - 180
    even = np.maximum(long[1:], long[:-1]) <= CHORD_RATIO * np.maximum(np.minimum(long[1:], long[:-1]), 1e-9)
    bends = even & (np.abs(turn) >= LEAST_TURN) & (np.abs(turn) <= MOST_TURN)
    straight = even & (np.abs(turn) < LEAST_TURN)
    out, k = [], 0
    while k < len(turn):
        if not bends[k]:
            k += 1
            continue
        last = j = k
        while j + 1 < len(turn) and ((bends[j + 1] and turn[j + 1] * turn[k] > 0) or (straight[j + 1] and bends[j])):
            j += 1
            last = j if bends[j] else last
        for a, b in ((k, last + 1), (k + 1, last + 1), (k, last), (k + 1, last)):  # chords a to b
            if b - a + 1 >= CHORDS and np.abs(turn[a:b]).sum() >= ARC_TURN:
                points = np.concatenate([ends[a : a + 1, :2], ends[a : b + 1, 2:]])
                centre, r = circle_of(points)
                if r > 0 and np.abs(np.hypot(*(points - centre).T) - r).max() <= max(FIT_PX, FIT * r):
                    out.append((a, b, float(turn[a:b].sum()), r))
                    break
        k = last + 1
    return out


def arc_classes(ends: np.ndarray) -> list[str | None]:
    """The class of each chord of a chain: a circle if an arc of it closes, a cloud if many small arcs of one radius follow each other at cusps, else arc."""
    found = arc_windows(ends)
    out: list[str | None] = [None] * len(ends)
    closes = any(abs(t) >= CLOSED for _, _, t, _ in found)
    run = best = 1
    for (_, b, t, _), (a, _, s, _) in zip(found, found[1:]):
        run = run + 1 if a - b <= 2 and t * s > 0 else 1
        best = max(best, run)
    radii = [r for *_, r in found]
    length = float(np.hypot(*(ends[:, 2:] - ends[:, :2]).T).sum())
    cloud = not closes and best > CUSPS and max(radii) <= CUSP_RATIO * min(radii) and CUSP_RUN * max(radii) <= length
    for a, b, t, _ in found:
        kind = "circle" if abs(t) >= CLOSED else "cloud" if cloud else "arc"
        out[a : b + 1] = [kind] * (b + 1 - a)
    return out


def curve_classes(lines: DataFrame) -> DataFrame:
    """(sheet_id, idx, class) of the lines of arcs, circles and clouds. Chains are lines that follow each other in drawing order with one pen, nearer than the longer of two; lines below half a px are passed over."""
    rows = lines.where(~F.coalesce("clip", F.lit(False))).withColumn("long", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("long >= 0.5")
    order = Window.partitionBy("sheet_id").orderBy("idx")
    before = lambda c: F.lag(c).over(order)
    apart = F.hypot(F.col("x1") - before("x2"), F.col("y1") - before("y2")) > F.greatest(F.col("long"), before("long"))
    breaks = F.coalesce((apart | (F.col("pen") != before("pen"))).cast("int"), F.lit(1))
    chains = rows.withColumn("breaks", breaks).withColumn("chain", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    long_enough = F.count("*").over(Window.partitionBy("sheet_id", "chain")) >= CHORDS
    chains = chains.withColumn("enough", long_enough).where("enough").select("sheet_id", "chain", "idx", "x1", "y1", "x2", "y2")
    kinds = dict(chains.dtypes)

    def run(key, frame):
        out = []
        for _, chain in frame.sort_values("idx").groupby("chain"):
            classes = arc_classes(chain[["x1", "y1", "x2", "y2"]].to_numpy(float))
            out += [(key[0], i, c) for i, c in zip(chain["idx"], classes) if c]
        return pd.DataFrame(out, columns=["sheet_id", "idx", "class"])

    return chains.groupBy("sheet_id").applyInPandas(run, f"sheet_id {kinds['sheet_id']}, idx {kinds['idx']}, class string")


def _beside(rows: DataFrame, reach: Column, *columns: str) -> DataFrame:
    """Pairs (a, b) of a sheet's lines of one direction whose places across are within reach; boxes lie along and across it."""
    place = F.concat_ws(":", "sheet_id", "way").alias("place")
    boxes = rows.select(place, "sheet_id", "idx", "c", "low", "high", *columns, F.col("low").alias("x0"), (F.col("c") - reach / 2).alias("y0"), F.col("high").alias("x1"), (F.col("c") + reach / 2).alias("y1"))
    return meeting(boxes, boxes, "place").where("a.idx <> b.idx")


def hatch_classes(straight: DataFrame) -> DataFrame:
    """(sheet_id, idx) of the lines that stand in a regular row of lines of their pen: at one pitch on both sides and at two on one; or, at the row's end, at three pitches on one side and
    something within the pitch on the other. straight: directed lines with m (px a foot, or 0)."""
    cap = F.when(F.col("m") > 0, F.col("m") * PITCH_FT).otherwise(PITCH_PX)
    a, b = F.col("a"), F.col("b")
    near = _beside(straight.withColumn("cap", cap), 3 * cap + 2 * HALF, "pen", "cap").where((a["pen"] == b["pen"]) & (F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"]) >= HALF))
    rows = near.groupBy(a["sheet_id"].alias("sheet_id"), a["idx"].alias("idx")).agg(F.first(a["cap"]).alias("cap"), F.collect_set(F.round(b["c"] - a["c"], 6)).alias("at"))
    side = lambda sign: F.array_min(F.filter(F.transform("at", lambda d: d * sign), lambda d: (d > HALF) & (d <= F.col("cap") + HALF)))
    rows = rows.withColumns({"up": side(1), "down": side(-1)}).where("up IS NOT NULL AND down IS NOT NULL")
    has = lambda where: F.exists("at", lambda d: F.abs(d - where) <= HALF)

    def fits(p: Column) -> Column:
        inside = has(p) & has(-p) & (has(2 * p) | has(-2 * p))
        ends = (has(p) & has(2 * p) & has(3 * p) & (F.col("down") <= p + HALF)) | (has(-p) & has(-2 * p) & has(-3 * p) & (F.col("up") <= p + HALF))
        return inside | ends

    return rows.where(fits(F.col("up")) | fits(F.col("down"))).select("sheet_id", "idx")


def ring_classes(straight: DataFrame) -> DataFrame:
    """(sheet_id, idx) of long lines with a heavier one alongside on one side, the first there, and none on the other: the outline of a finish inside its walls."""
    rows = straight.where((F.col("m") > 0) & (F.col("long") >= RING_FT * F.col("m")))
    a, b = F.col("a"), F.col("b")
    off = b["c"] - a["c"]
    along = F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"]) >= BESIDE * (a["high"] - a["low"])
    near = _beside(rows, FAR_FT * F.col("m"), "pen", "m").where(along & (F.abs(off) >= NEAR_FT * a["m"]) & (F.abs(off) <= FAR_FT * a["m"]))
    first = near.groupBy(a["sheet_id"].alias("sheet_id"), a["idx"].alias("idx")).agg(F.first(a["pen"]).alias("pen"), F.min_by(F.when(off > 0, b["pen"]), F.when(off > 0, off)).alias("above"), F.min_by(F.when(off < 0, b["pen"]), F.when(off < 0, -off)).alias("below"))
    heavier = lambda one, other: F.col(one).isNotNull() & F.col(other).isNull() & (F.col(one) > F.col("pen"))
    return first.where(heavier("above", "below") | heavier("below", "above")).select("sheet_id", "idx")


def figures(lines: DataFrame) -> DataFrame:
    """(sheet_id, path, m, x0, y0, x1, y1, filled, closed) of the paths that lines are drawn as."""
    box = {"x0": F.min(F.least("x1", "x2")), "y0": F.min(F.least("y1", "y2")), "right": F.max(F.greatest("x1", "x2")), "bottom": F.max(F.greatest("y1", "y2"))}
    first, last = F.min_by(F.struct("x1", "y1"), "idx"), F.max_by(F.struct("x2", "y2"), "idx")
    found = lines.where("path IS NOT NULL AND m > 0").where(~F.coalesce("clip", F.lit(False))).groupBy("sheet_id", "path").agg(F.first("m").alias("m"), F.max(F.coalesce("fill", F.lit(False))).alias("filled"), first.alias("first"), last.alias("last"), *[v.alias(k) for k, v in box.items()])
    shut = F.hypot(F.col("first.x1") - F.col("last.x2"), F.col("first.y1") - F.col("last.y2")) <= 0.5
    return found.select("sheet_id", "path", "m", "filled", shut.alias("closed"), "x0", "y0", F.col("right").alias("x1"), F.col("bottom").alias("y1"))


def fleck_paths(found: DataFrame) -> DataFrame:
    """(sheet_id, path) of figures smaller than a wall is thick, where a cell and those around it hold FIELD of them."""
    small = found.where(~F.col("filled") & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < FLECK_FT * F.col("m")))
    cell = lambda p, q: F.floor((F.col(p) + F.col(q)) / 2 / (FIELD_FT * F.col("m")))
    rows = small.select("sheet_id", "path", cell("x0", "x1").alias("cx"), cell("y0", "y1").alias("cy"))
    counts = rows.groupBy("sheet_id", "cx", "cy").count()
    step = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.col(c) + k)).alias(c)
    spread = counts.select("sheet_id", step("cx"), "cy", "count").select("sheet_id", "cx", step("cy"), "count")
    field = spread.groupBy("sheet_id", "cx", "cy").agg(F.sum("count").alias("n")).where(F.col("n") >= FIELD)
    return rows.join(shuffled(field), ["sheet_id", "cx", "cy"], "left_semi").select("sheet_id", "path")


def tag_paths(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(sheet_id, path) of small closed figures that the texts in them fill: texts (sheet_id, x, y, w, h), x and y at the left end of the base line."""
    boxes = found.where(F.col("closed") & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= TAG_SF * F.col("m") * F.col("m")) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    h = F.coalesce("h", F.lit(0.0))
    points = texts.select("sheet_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.coalesce("w", F.lit(0.0)).alias("tw"), h.alias("th"), F.col("x").alias("x0"), (F.col("y") - h).alias("y0"), F.col("x").alias("x1"), (F.col("y") + h).alias("y1"))
    a, b = F.col("a"), F.col("b")
    met = meeting(boxes, points)
    size = lambda low, high: F.max(high) - F.min(low)
    filled = met.groupBy(a["sheet_id"].alias("sheet_id"), a["path"].alias("path")).agg((size(b["tx"], b["tx"] + b["tw"]) * size(b["ty"] - b["th"], b["ty"])).alias("text"), F.first((a["x1"] - a["x0"]) * (a["y1"] - a["y0"])).alias("area"))
    return filled.where(F.col("text") >= TAG_TEXT * F.col("area")).select("sheet_id", "path")


def dimension_classes(straight: DataFrame) -> DataFrame:
    """(sheet_id, idx) of the lines of dimension strings: a long line without a partner alongside, met square by short witness lines at room's distance, with oblique ticks at its
    joints and ink that goes on past them; and its witnesses and ticks."""
    rows = straight.where("m > 0")
    m = F.col("m")
    pieces = chained(rows, ["sheet_id", "way"], OFF_FT * m, GAP_FT * m)
    runs = kept(pieces.groupBy("sheet_id", "way", "row", "piece").agg(*[F.first(k).alias(k) for k in ("ux", "uy", "m")], (F.sum(F.col("c") * F.col("long")) / F.sum("long")).alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("idx").alias("idxs"), F.min("idx").alias("idx")))
    long = F.col("high") - F.col("low")
    a, b = F.col("a"), F.col("b")
    lines = runs.where(long >= RUN_FT * m)
    partner = F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"]) >= PARTNER * (a["high"] - a["low"])
    faces = _beside(runs, 2 * PARTNER_FT * m, "m").where(partner & (F.abs(a["c"] - b["c"]) <= PARTNER_FT * a["m"])).select(a["sheet_id"].alias("sheet_id"), a["idx"].alias("idx")).distinct()
    lone = kept(lines.join(shuffled(faces), ["sheet_id", "idx"], "left_anti"))

    def boxed(df: DataFrame, margin: Column) -> DataFrame:
        at = lambda u, c: (F.col(u) * F.col("ux") - F.col(c) * F.col("uy"), F.col(u) * F.col("uy") + F.col(c) * F.col("ux"))
        (px, py), (qx, qy) = at("low", "c"), at("high", "c")
        return df.withColumns({"px": px, "py": py, "qx": qx, "qy": qy}).select("*", (F.least("px", "qx") - margin).alias("x0"), (F.least("py", "qy") - margin).alias("y0"), (F.greatest("px", "qx") + margin).alias("x1"), (F.greatest("py", "qy") + margin).alias("y1"))

    along = lambda x, y: x * a["ux"] + y * a["uy"]
    across = lambda x, y: y * a["ux"] - x * a["uy"] - a["c"]
    met = meeting(boxed(lone, ATTACH_FT * m), boxed(runs, F.lit(0.0))).where((a["sheet_id"] == b["sheet_id"]) & (a["idx"] != b["idx"]))
    sine = F.abs(a["ux"] * b["uy"] - a["uy"] * b["ux"])
    size = b["high"] - b["low"]
    c1, c2 = across(b["px"], b["py"]), across(b["qx"], b["qy"])
    attach = ATTACH_FT * a["m"]
    at_u = (along(b["px"], b["py"]) + along(b["qx"], b["qy"])) / 2
    square = (sine >= F.lit(math.cos(math.radians(ONE_WAY)))) & (size >= WITNESS_FT * a["m"]) & (F.least(F.abs(c1), F.abs(c2)) <= F.greatest(attach, PAST_FT * a["m"])) | ((sine >= F.lit(math.cos(math.radians(ONE_WAY)))) & (c1 * c2 < 0))
    on_run = (at_u >= a["low"] - attach) & (at_u <= a["high"] + attach)
    past = (F.greatest(c1, c2) > PAST_FT * a["m"]) & (F.least(c1, c2) < -PAST_FT * a["m"]) | (at_u - a["low"] > PAST_FT * a["m"]) & (a["high"] - at_u > PAST_FT * a["m"])
    low_deg, high_deg = (F.lit(math.sin(math.radians(d))) for d in TICK_DEG)
    tick = (sine > low_deg) & (sine < high_deg) & (size >= TICK_FT[0] * a["m"]) & (size <= TICK_FT[1] * a["m"]) & (F.abs(c1 + c2) / 2 <= attach)
    name = [a["sheet_id"].alias("sheet_id"), a["idx"].alias("run")]
    witnesses = met.where(square & on_run).select(*name, at_u.alias("u"), a["m"].alias("m"), past.alias("past"), F.when(size <= SOFT_FT * a["m"], b["idxs"]).alias("own"))
    ticks = met.where(tick & on_run).select(a["sheet_id"].alias("t_sheet"), a["idx"].alias("t_run"), at_u.alias("t_u"), b["idxs"].alias("t_own"))
    order = Window.partitionBy("sheet_id", "run").orderBy("u")
    joints = witnesses.withColumn("begins", F.coalesce((F.col("u") - F.lag("u").over(order) > ATTACH_FT * m).cast("int"), F.lit(1))).withColumn("joint", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joints = joints.groupBy("sheet_id", "run", "joint").agg(F.avg("u").alias("u"), F.first("m").alias("m"), F.max("past").alias("past"), F.flatten(F.collect_list("own")).alias("own"))
    marked = joints.join(shuffled(ticks), (F.col("sheet_id") == F.col("t_sheet")) & (F.col("run") == F.col("t_run")) & (F.abs(F.col("u") - F.col("t_u")) <= AT_JOINT_FT * m), "left").groupBy("sheet_id", "run", "joint").agg(F.first("u").alias("u"), F.first("m").alias("m"), F.first("past").alias("past"), F.first("own").alias("own"), F.count("t_u").alias("ticks"), F.flatten(F.collect_list("t_own")).alias("t_own"))
    apart = F.coalesce(F.col("u") - F.lag("u").over(order), F.lit(1e18)) >= APART_FT * m
    judged = marked.withColumn("apart", apart).groupBy("sheet_id", "run").agg(F.count("*").alias("joints"), F.sum((F.col("ticks") > 0).cast("int")).alias("ticked"), F.min((F.col("past") & F.col("apart")).cast("int")).alias("sound"), F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("t_own")).alias("t_own"))
    strings = judged.where((F.col("joints") >= JOINTS) & (F.col("ticked") >= TICKED) & (F.col("ticked") >= TICK_SHARE * F.col("joints")) & (F.col("sound") == 1))
    whole = strings.join(shuffled(lone.select("sheet_id", F.col("idx").alias("run"), "idxs")), ["sheet_id", "run"])
    return whole.select("sheet_id", F.explode(F.array_distinct(F.concat("idxs", "own", "t_own"))).alias("idx")).distinct()


def classify_lines(lines: DataFrame, texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, idx, class) of every line (sheet_id, idx, x1, y1, x2, y2 in px, pen, clip, fill, path): one of CLASSES.

    texts: (sheet_id, x, y, w, h); sheets: (sheet_id, px_per_ft). Filled outlines are plain: they bound solid ink. Lines with a null end are plain too.
    """
    scale = sheets.select(F.col("sheet_id").alias("of_sheet"), F.coalesce(F.col("px_per_ft").cast("double"), F.lit(0.0)).alias("m"))
    rows = lines.join(shuffled(scale), F.col("sheet_id") == F.col("of_sheet"), "left").drop("of_sheet").withColumns({"m": F.coalesce("m", F.lit(0.0)), "pen": F.coalesce("pen", F.lit(0))})
    rows = kept(rows)
    whole = rows.dropna(subset=["x1", "y1", "x2", "y2"])
    curves = kept(curve_classes(whole))
    open_ = whole.where(~F.coalesce("clip", F.lit(False)) & ~F.coalesce("fill", F.lit(False)) & (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 0.75))
    straight = kept(directed(open_.join(shuffled(curves.select("sheet_id", "idx")), ["sheet_id", "idx"], "left_anti"), ONE_WAY))
    shapes = figures(whole)
    of_path = lambda paths, name: whole.join(shuffled(paths), ["sheet_id", "path"], "left_semi").select("sheet_id", "idx", F.lit(name).alias("class"))
    named = lambda found, name: found.select("sheet_id", "idx", F.lit(name).alias("class"))
    votes = rows.where("clip").select("sheet_id", "idx", F.lit("clip").alias("class")).unionByName(curves)
    for more in (named(hatch_classes(straight), "hatch"), named(dimension_classes(straight), "dimension"), named(ring_classes(straight), "ring"), of_path(fleck_paths(shapes), "fleck"), of_path(tag_paths(shapes, texts), "tag box")):
        votes = votes.unionByName(more)
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    best = votes.groupBy(F.col("sheet_id").alias("v_sheet"), F.col("idx").alias("v_idx")).agg(F.min_by("class", place).alias("class"))
    found = rows.select("sheet_id", "idx").join(shuffled(best), F.col("sheet_id").eqNullSafe(F.col("v_sheet")) & (F.col("idx") == F.col("v_idx")), "left")
    return found.select("sheet_id", "idx", F.coalesce("class", F.lit("plain")).alias("class"))
