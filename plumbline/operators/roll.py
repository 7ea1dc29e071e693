"""Roll goods: lanes and strips of rooms, nesting of cuts on rolls, seams, order footage.

Strips and nesting are sequential by nature and run once per condition in Python; seams and orders are windows and sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import round2_eps, round2_plain, round_up_to_inch
from plumbline.plans.scratch import spread

# A roll's defaults and the most lanes of a room.
WIDTH_FT, SEAM_IN, WALL_IN, DOORWAY_IN, MOST_LANES, TOLERANCE = 12.0, 2.0, 3.0, 1.0, 40, 1e-6


@dataclass(frozen=True)
class Roll:
    width_ft: float = WIDTH_FT
    length_ft: float = 0.0  # 0: no end
    seam_in: float = SEAM_IN
    wall_in: float = WALL_IN
    direction: str = "auto"


def lane_capacities(n: int, roll: Roll) -> list[float]:
    """Usable inches of each of n lanes: walls cost at the outer sides, seams at the shared ones."""
    width = roll.width_ft * 12
    if n == 1:
        return [width - 2 * roll.wall_in]
    return [width - (roll.wall_in if i in (0, n - 1) else roll.seam_in) - roll.seam_in for i in range(n)]


@lru_cache(1024)
def _widest(roll: Roll) -> list[tuple[int, float]]:
    """(n, inches that n lanes cover)."""
    return [(n, sum(lane_capacities(n, roll))) for n in range(1, MOST_LANES + 1)]


def lane_count(room_in: float, roll: Roll) -> int:
    return next((n for n, widest in _widest(roll) if widest >= room_in - TOLERANCE), MOST_LANES)


def run_extent(ring: np.ndarray, lane: int, low: float, high: float) -> tuple[float, float] | None:
    """Least and greatest position along the run at which the ring is met within a lane (its sides and the vertices between)."""
    across, along = np.asarray(ring)[:, lane].tolist(), np.asarray(ring)[:, 1 - lane].tolist()
    return _extent(across, along, low, high)


def _extent(across: list[float], along: list[float], low: float, high: float) -> tuple[float, float] | None:
    """run_extent() of a ring's coordinates across and along the lanes: plain numbers, since most rings have few points."""
    found = []
    edges = list(zip(across, along, across[1:] + across[:1], along[1:] + along[:1]))
    for v in (min(low + TOLERANCE, high), max(high - TOLERANCE, low), *[c for c in across if low + TOLERANCE < c < high - TOLERANCE]):
        for a, s, b, t in edges:
            if (a <= v < b) or (b <= v < a):
                found.append(s + (v - a) / (b - a) * (t - s))
    if not found:
        return None
    return (min(found), max(found)) if math.isfinite(sum(found)) else (float(np.min(found)), float(np.max(found)))


def strips(shape_id, ring: np.ndarray, direction: str, roll: Roll) -> list[dict]:
    """The cuts that cover a room's ring (feet) when the roll runs one way: ns fills lanes along x, ew along y."""
    lane = 0 if direction == "ns" else 1
    points = np.asarray(ring, float)
    across, along = points[:, lane].tolist(), points[:, 1 - lane].tolist()
    low, high = float(np.min(across)), float(np.max(across))  # a coordinate that is no number leaves no strips
    if len(ring) < 3 or not high > low:
        return []
    n = lane_count((high - low) * 12, roll)
    wall, seam = roll.wall_in / 12, roll.seam_in / 12
    out, at, left = [], low, high - low
    for i, capacity in enumerate(lane_capacities(n, roll)):
        width = max(0.0, left) if i == n - 1 else min(capacity / 12, left)
        extent = _extent(across, along, at, at + width)
        if extent:
            piece = min(width + (wall if i == 0 else seam) + (wall if i == n - 1 else seam), roll.width_ft)
            out.append({"shape_id": shape_id, "lane": i, "lanes": n, "width": piece, "run_min": extent[0] - wall, "run_max": extent[1] + wall, "overage": wall})
        at, left = at + width, left - width
    return out


class _Skyline:
    """How far down each stretch of a roll's width is taken."""

    def __init__(self, width: float) -> None:
        self.width, self.steps = width, [(0.0, width, 0.0)]  # (from, to, reached)

    def place(self, wide: float, long: float, end: float) -> tuple[float, float] | None:
        best = None
        for y, _, _ in self.steps:
            if y + wide <= self.width + TOLERANCE:
                x = max((r for a, b, r in self.steps if a < y + wide - TOLERANCE and b > y + TOLERANCE), default=0.0)
                if x + long <= end + TOLERANCE and (best is None or x < best[0] - TOLERANCE or (abs(x - best[0]) < TOLERANCE and y < best[1])):
                    best = (x, y)
        return best

    def take(self, y: float, wide: float, reach: float) -> None:
        steps = [(y, y + wide, reach)]
        for a, b, r in self.steps:
            if a < y - TOLERANCE:
                steps.append((a, min(b, y), r))
            if b > y + wide + TOLERANCE:
                steps.append((max(a, y + wide), b, r))
        merged: list[tuple[float, float, float]] = []
        for a, b, r in sorted(steps):
            if merged and abs(merged[-1][2] - r) < TOLERANCE and abs(merged[-1][1] - a) < TOLERANCE:
                merged[-1] = (merged[-1][0], b, r)
            else:
                merged.append((a, b, r))
        self.steps = merged


def nest(cuts: list[dict], roll: Roll, sequence: dict | None = None) -> list[dict]:
    """Each cut's roll and place: those with a stated place in the sequence first, then the widest, then the longest, each at the
    least footage that takes it; a full roll opens another, and a cut longer than a roll is flagged."""
    end = roll.length_ft if roll.length_ft > 0 else math.inf
    stated = sequence or {}
    rank = lambda c: (0, stated[c["id"]]) if c["id"] in stated else (1, 0)
    ordered = sorted(cuts, key=lambda c: (rank(c), -round(c["width"] / TOLERANCE), -(c["run_max"] - c["run_min"])))
    rolls = [_Skyline(roll.width_ft)]
    for cut in ordered:
        wide, long = cut["width"], max(0.0, cut["run_max"] - cut["run_min"])
        found = next(((k, spot) for k, sky in enumerate(rolls) if (spot := sky.place(wide, long, end))), None)
        cut["over_roll"] = False
        if found is None:
            rolls.append(_Skyline(roll.width_ft))
            spot = rolls[-1].place(wide, long, end)
            if spot is None:
                spot, cut["over_roll"] = (0.0, max(0.0, (roll.width_ft - wide) / 2)), long > end + TOLERANCE
            found = (len(rolls) - 1, spot)
        k, (x, y) = found
        cut.update(roll=k, x=x + (k * end if math.isfinite(end) else 0.0), y=y)
        rolls[k].take(y, wide, x + long)
    return cuts


def layout(items: list[tuple], roll: Roll, sequence: dict | None = None) -> list[dict]:
    """Nested cuts of rooms (id, ring): in the direction that takes less footage, unless one is set."""
    build = lambda d: [s | {"direction": d, "id": f"{s['shape_id']}:{s['lane']}"} for i, ring in items for s in strips(i, ring, d, roll)]
    if roll.direction in ("ns", "ew"):
        cuts = build(roll.direction)
    else:
        ns, ew = build("ns"), build("ew")
        footage = lambda cuts: sum(max(0.0, c["run_max"] - c["run_min"]) for c in cuts)
        cuts = ns if footage(ns) <= footage(ew) else ew
    return nest(cuts, roll, sequence)


STRIPS = "condition_id long, shape_id long, lane long, lanes long, width double, run_min double, run_max double, overage double, direction string"
def takeoff_rooms(shapes: DataFrame, conditions: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rooms (condition_id, shape_id, ring in feet) of a whole takeoff's roll goods: floors of conditions with a roll setup, on sheets with a size and a scale. Holes
    don't shorten cuts. shapes: verts_norm; sheets: (sheet_id, width, height, units_per_px); conditions: (id, is_roll)."""
    frames = sheets.where("width > 0 AND height > 0 AND units_per_px > 0").select(F.col("sheet_id").alias("of_sheet"), "width", "height", F.col("units_per_px").alias("upp"))
    rolls = conditions.where("is_roll").select(F.col("id").alias("of_condition"))
    some = shapes.where((F.col("measure_role") == "floor_area") & (F.size("verts_norm") >= 3)).join(rolls, F.col("condition_id") == F.col("of_condition")).join(frames, F.col("sheet_id") == F.col("of_sheet"))
    ring = F.transform("verts_norm", lambda p: F.array(p[0] * F.col("width") * F.col("upp"), p[1] * F.col("height") * F.col("upp")))
    return some.select("condition_id", F.col("id").alias("shape_id"), ring.alias("ring"))


def with_overrides(strips: DataFrame, overrides: DataFrame) -> DataFrame:
    """Strips with their stated runs (shape_id, lane, lanes, run_min, run_max), where the room still has that many lanes and the run is one; else as they were."""
    said = overrides.select(F.col("shape_id").alias("o_shape"), F.col("lane").alias("o_lane"), F.col("lanes").alias("o_lanes"), F.col("run_min").alias("o_min"), F.col("run_max").alias("o_max"))
    joined = strips.join(said, (F.col("shape_id") == F.col("o_shape")) & (F.col("lane") == F.col("o_lane")), "left")
    ok = F.coalesce((F.col("o_lanes") == F.col("lanes")) & (F.col("o_max") > F.col("o_min")), F.lit(False))
    return joined.select(*[F.when(ok, F.col(f"o_{c[4:]}")).otherwise(F.col(c)).alias(c) if c in ("run_min", "run_max") else F.col(c) for c in strips.columns])


def directions(strips: DataFrame) -> DataFrame:
    """(condition_id, direction, footage) of the strips that were chosen."""
    long = F.greatest(F.lit(0.0), F.col("run_max") - F.col("run_min")).cast("decimal(28,9)")
    return strips.groupBy("condition_id").agg(F.first("direction").alias("direction"), F.sum(long).cast("double").alias("footage"))


CUTS = STRIPS + ", roll long, x double, y double, over_roll boolean"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def room_strips(rooms: DataFrame, roll: Roll = Roll()) -> DataFrame:
    """rooms: (condition_id, shape_id, ring in feet); the strips of each room, room by room, in the direction that takes
    its condition the less footage (ns where both take the same), unless the roll sets one."""
    ways = (roll.direction,) if roll.direction in ("ns", "ew") else ("ns", "ew")

    def run(frames):
        for frame in frames:
            rows = []
            for condition, shape, ring in zip(frame["condition_id"], frame["shape_id"], frame["ring"]):
                points = np.array([list(p) for p in ring], float) if ring is not None else np.zeros((0, 2))
                if len(points) >= 3:
                    rows += [{**s, "condition_id": condition, "direction": d} for d in ways for s in strips(shape, points, d, roll)]
            yield pd.DataFrame(rows, columns=_columns(STRIPS))

    both = spread(rooms.select("condition_id", "shape_id", "ring")).mapInPandas(run, STRIPS)
    if len(ways) == 1:
        return both
    # a condition's footage both ways, added as decimals so that the order of rooms can't show
    long = F.greatest(F.lit(0.0), F.col("run_max") - F.col("run_min")).cast("decimal(28,9)")
    w = Window.partitionBy("condition_id")
    footage = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, long)).over(w), F.lit(0))
    chosen = F.when(footage("ns") <= footage("ew"), "ns").otherwise("ew")
    return both.withColumn("chosen", chosen).where("direction = chosen").drop("chosen")


def roll_cuts(rooms: DataFrame, roll: Roll = Roll(), sequence: dict | None = None) -> DataFrame:
    """rooms: (condition_id, shape_id, ring in feet); the cuts of each condition, nested. A condition's cuts are nested in
    one task, one condition after the other; sequence places cuts ("shape:lane") first, in the order of its numbers."""

    def run(batches):
        now, cuts = None, []

        def nested() -> pa.RecordBatch:
            out = nest(cuts, roll, sequence)
            return pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_columns(CUTS)), schema=wanted, preserve_index=False)

        for batch in batches:
            for row in batch.to_pylist():
                if row["condition_id"] != now and cuts:
                    yield nested()
                    cuts = []
                now = row["condition_id"]
                cuts.append(row | {"id": f"{row['shape_id']}:{row['lane']}"})
        if cuts:
            yield nested()

    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    wanted = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CUTS.split(", ")])
    return spread(room_strips(rooms, roll), "condition_id").sortWithinPartitions("condition_id", "shape_id", "lane").mapInArrow(run, CUTS)


def seam_overlaps(cuts: DataFrame) -> DataFrame:
    """Feet that each pair of neighbouring lanes runs side by side between their wall allowances; a lane left out leaves none."""
    w = Window.partitionBy("condition_id", "shape_id").orderBy("lane")
    low, high = F.col("run_min") + F.col("overage"), F.col("run_max") - F.col("overage")
    beside = cuts.select("condition_id", "shape_id", "lane", low.alias("low"), high.alias("high")).withColumns({"n_lane": F.lead("lane").over(w), "n_low": F.lead("low").over(w), "n_high": F.lead("high").over(w)})
    overlap = F.greatest(F.lit(0.0), F.least("high", "n_high") - F.greatest("low", "n_low"))
    return beside.where(F.col("n_lane") == F.col("lane") + 1).select("condition_id", "shape_id", "lane", overlap.alias("overlap_lf"))


def seams(cuts: DataFrame) -> DataFrame:
    """Seam feet of each shape, of its strips or nested cuts alike."""
    return seam_overlaps(cuts).groupBy("condition_id", "shape_id").agg(round2_plain(F.sum("overlap_lf")).alias("seam_lf")).where("seam_lf > 0")


def roll_report(cuts: DataFrame, conditions: DataFrame, roll: Roll = Roll(), unit: str = "sy") -> DataFrame:
    """Order footage (the furthest reach, not the sum), rolls, quantity in the selling unit and seams, times the multiplier."""
    reach = cuts.groupBy("condition_id").agg(
        round_up_to_inch(F.max(F.col("x") + F.greatest(F.lit(0.0), F.col("run_max") - F.col("run_min")))).alias("order_ft"), (F.max("roll") + 1).alias("roll_count"), F.count("*").alias("cuts"), F.bool_or("over_roll").alias("oversize"), F.first("direction").alias("direction")
    )
    sewn = seams(cuts).groupBy(F.col("condition_id").alias("seam_condition")).agg(round2_plain(F.sum("seam_lf")).alias("seam"))
    per = {"lf": F.col("order_ft"), "sf": F.col("order_ft") * roll.width_ft}.get(unit, F.col("order_ft") * roll.width_ft / 9.0)
    times = F.when(F.coalesce("multiplier", F.lit(0.0)) == 0, 1.0).otherwise(F.col("multiplier"))
    rows = reach.join(sewn, F.col("condition_id") == F.col("seam_condition"), "left").join(conditions.select("id", "multiplier"), F.col("condition_id") == F.col("id"))
    return rows.select("condition_id", "direction", "cuts", round2_eps(F.col("order_ft") * times).alias("order_lf"), (F.col("roll_count") * times).alias("rolls"), round2_eps(round2_eps(per) * times).alias("order_qty"), "oversize", round2_eps(F.coalesce("seam", F.lit(0.0)) * times).alias("seam_lf"))
