"""Column expressions over polylines: array<struct<x: double, y: double>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(vertices: DataFrame, *keys: str) -> DataFrame:
    """keys, pts: the vertices of each key in order of seq, gathered once; null coordinates are left out."""
    keys = keys or ("line_id",)
    ok = vertices.filter("x is not null and y is not null")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ok.groupBy(*keys).agg(pts.alias("pts"))


def pairs(pts: Column) -> Column:
    """Neighbouring vertices as (x1, y1, x2, y2); none for fewer than two."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(
        F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    )


def seg_length(s: Column) -> Column:
    return F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2)


def length(pts: Column) -> Column:
    """Sum of segment lengths."""
    return F.aggregate(pairs(pts), F.lit(0.0), lambda a, s: a + seg_length(s))


def ends_distance(pts: Column) -> Column:
    a, b = pts[0], F.element_at(pts, -1)
    return F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)


def sinuosity(pts: Column) -> Column:
    """Length over end-to-end distance; null for a closed line."""
    return F.try_divide(length(pts), ends_distance(pts))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north; null for no movement."""
    dx, dy = x2 - x1, y2 - y1
    turn = F.when(dx == 0, F.when(dy > 0, 0.0).when(dy < 0, 180.0)).when(dx > 0, 90 - F.degrees(F.atan(dy / dx))).otherwise(270 - F.degrees(F.atan(dy / dx)))
    return turn


def direction(deg: Column) -> Column:
    """N-S, NE-SW, E-W or NW-SE by half-open bins of 45 degrees; N-S where there is no bearing."""
    d = deg % 180
    return F.when((d >= 22.5) & (d < 67.5), "NE-SW").when((d >= 67.5) & (d < 112.5), "E-W").when((d >= 112.5) & (d < 157.5), "NW-SE").otherwise("N-S")


def ring_area(pts: Column) -> Column:
    """Shoelace area of a ring; the closing edge is implied."""
    closed = F.concat(pts, F.slice(pts, 1, 1))
    return F.abs(F.aggregate(pairs(closed), F.lit(0.0), lambda a, s: a + (s["x1"] * s["y2"] - s["x2"] * s["y1"]))) / 2


def ring_perimeter(pts: Column) -> Column:
    return length(F.concat(pts, F.slice(pts, 1, 1)))


def segmentized(pts: Column, most: float) -> Column:
    """Vertices put in so that no segment is longer than `most`."""
    def steps(s):
        n = F.greatest(F.ceil(seg_length(s) / most).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((s["x1"] + (s["x2"] - s["x1"]) * i / n).alias("x"), (s["y1"] + (s["y2"] - s["y1"]) * i / n).alias("y")))

    return F.concat(F.flatten(F.transform(pairs(pts), steps)), F.slice(pts, -1, 1))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2)


def side(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 left of the segment's line, -1 right of it, 0 on it."""
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)).cast("int")


def clip_interval(x1, y1, x2, y2, bx0, by0, bx1, by1) -> tuple[Column, Column]:
    """(t0, t1) of the part of a segment inside a box; t0 > t1 if it has none (Liang and Barsky)."""
    def axis(p, d, lo, hi):
        a, b = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        flat = F.when((p >= lo) & (p <= hi), F.lit(0.0)).otherwise(F.lit(2.0))
        return F.coalesce(F.least(a, b), flat), F.coalesce(F.greatest(a, b), F.when((p >= lo) & (p <= hi), F.lit(1.0)).otherwise(F.lit(-1.0)))

    ax, bx = axis(x1, x2 - x1, bx0, bx1)
    ay, by = axis(y1, y2 - y1, by0, by1)
    return F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting; a point on the left or lower edge counts as inside."""
    return in_edges(px, py, pairs(F.concat(ring, F.slice(ring, 1, 1))))


def in_edges(px: Column, py: Column, edges: Column) -> Column:
    """in_ring() over a ring's edges as pairs() gives them."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda n, s: n + F.when(((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]), 1).otherwise(0),
    )
    return crossings % 2 == 1


def rotated(x: Column, y: Column, ox: Column, oy: Column, radians: Column) -> tuple[Column, Column]:
    return ox + (x - ox) * F.cos(radians) - (y - oy) * F.sin(radians), oy + (x - ox) * F.sin(radians) + (y - oy) * F.cos(radians)


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """The point (x, y) where segments a-b and c-d meet; null where they don't, or run parallel."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), det)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def without_holes(rings: Column) -> Column:
    """The outer ring alone of a polygon's rings."""
    return F.slice(rings, 1, 1)
