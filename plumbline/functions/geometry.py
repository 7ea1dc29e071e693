"""Rings and points as higher-order array expressions; a ring is an array of [x, y] that isn't closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """(ax, ay, bx, by) of each edge, the last back to the first point."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def _length(e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    return F.sqrt(dx * dx + dy * dy)


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 below three points."""
    area = F.abs(_sum(edges(ring), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2.0
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(area)


def open_length(line: Column) -> Column:
    steps = F.slice(edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(_sum(steps, _length))


def ring_perimeter(ring: Column) -> Column:
    """Around the ring; below three points the open length."""
    return F.when(F.size(ring) < 3, open_length(ring)).otherwise(_sum(edges(ring), _length))


def holed_area(ring: Column, holes: Column) -> Column:
    return F.greatest(F.lit(0.0), ring_area(ring) - F.aggregate(F.coalesce(holes, F.array().cast("array<array<array<double>>>")), F.lit(0.0), lambda acc, h: acc + ring_area(h)))


def holed_perimeter(ring: Column, holes: Column) -> Column:
    return ring_perimeter(ring) + F.aggregate(F.coalesce(holes, F.array().cast("array<array<array<double>>>")), F.lit(0.0), lambda acc, h: acc + ring_perimeter(h))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        return spans & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(spans, e["by"] - e["ay"]).otherwise(F.lit(1.0)) + e["ax"])

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the vertices."""
    n = F.size(ring)
    return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[0]) / n, F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[1]) / n


def ring_within(inner: Column, outer: Column) -> Column:
    """All vertices of inner, and their mean, inside outer."""
    cx, cy = centroid(inner)
    return F.forall(inner, lambda p: contains(outer, p[0], p[1])) & contains(outer, cx, cy)


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.when(square > 0, square).otherwise(F.lit(1.0))))).otherwise(F.lit(0.0))
    px, py = x - (e["ax"] + t * dx), y - (e["ay"] + t * dy)
    return F.sqrt(px * px + py * py)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """To the nearest edge."""
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(x, y, e)))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(e: Column, f: Column) -> Column:
    """Whether two segments cross properly: touching ends don't count."""
    one = _turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]) * _turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    two = _turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]) * _turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    return (one < 0) & (two < 0)


def self_crossing(ring: Column) -> Column:
    all_edges = edges(ring)
    return F.exists(all_edges, lambda e: F.exists(all_edges, lambda f: segments_cross(e, f)))


def reflected(ring: Column, axis: str) -> Column:
    """Normalised vertices mirrored about the middle of the sheet, across x or y."""
    return F.transform(ring, lambda p: F.array(1.0 - p[0], p[1]) if axis == "x" else F.array(p[0], 1.0 - p[1]))


def snapped_angle(dx: Column, dy: Column, tolerance: float = 4.0) -> Column:
    """Degrees of a direction, pulled to the nearest multiple of 45 within the tolerance."""
    angle = F.degrees(F.atan2(dy, dx))
    near = F.round(angle / 45.0) * 45.0
    return F.when(F.abs(angle - near) <= tolerance, near).otherwise(angle)


def segment_meets_box(ax: Column, ay: Column, bx: Column, by: Column, x0, y0, x1, y1) -> Column:
    """Whether a segment meets a closed box: the parameter interval left after clipping to its four sides isn't empty."""
    low, high = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for a, d, near, far in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
        near, far = F.lit(near) if not isinstance(near, Column) else near, F.lit(far) if not isinstance(far, Column) else far
        ok = ok & ((d != 0) | ((a >= near) & (a <= far)))
        step = F.when(d != 0, d).otherwise(F.lit(1.0))
        t0, t1 = (near - a) / step, (far - a) / step
        low = F.greatest(low, F.when(d != 0, F.least(t0, t1)).otherwise(F.lit(0.0)))
        high = F.least(high, F.when(d != 0, F.greatest(t0, t1)).otherwise(F.lit(1.0)))
    return ok & (low <= high)


def legs(own_rise: Column, own_drop: Column, rise: Column, drop: Column) -> Column:
    """Vertical feet of a run: its own legs before the condition's, negatives are 0."""
    one = lambda own, other: F.greatest(F.lit(0.0), F.coalesce(own, other, F.lit(0.0)))
    return one(own_rise, rise) + one(own_drop, drop)


def shape_metrics(role: Column, ring: Column, holes: Column, upp: Column, height: Column, thickness_in: Column, vertical: Column) -> Column:
    """(area_sf, perimeter_lf, count) of a drawn shape; null where the sheet has no scale, counts aside."""
    line, run = open_length(ring) * upp, None
    run = line + vertical
    plain = F.struct((holed_area(ring, holes) * upp * upp).alias("area_sf"), (holed_perimeter(ring, holes) * upp).alias("perimeter_lf"), F.lit(None).cast("double").alias("count"))
    wall = F.struct((line * F.coalesce(height, F.lit(0.0))).alias("area_sf"), line.alias("perimeter_lf"), F.lit(None).cast("double").alias("count"))
    linear = F.struct((run * F.coalesce(thickness_in, F.lit(0.0)) / 12.0).alias("area_sf"), run.alias("perimeter_lf"), F.lit(None).cast("double").alias("count"))
    one = F.struct(F.lit(0.0).alias("area_sf"), F.lit(0.0).alias("perimeter_lf"), F.lit(1.0).alias("count"))
    return F.when(role == "count", one).when(upp > 0, F.when(role == "surface_area", wall).when(role == "linear", linear).otherwise(plain))
