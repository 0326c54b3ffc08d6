"""Planar and geodetic scalar expressions over coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in kilometres.
EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def polyline_km(points: Column) -> Column:
    """Length of ``array<struct<lon, lat>>``: the sum of its haversine legs, 0 for fewer than two points."""
    n = F.size(points)
    legs = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]),
    )
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def norm(dx: Column, dy: Column) -> Column:
    """Length of a vector as the root of its squares, the very number that SQL gives, so that equal distances tie alike; ``hypot`` rounds otherwise."""
    dx, dy = dx.cast("double"), dy.cast("double")
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return norm(x1 - x2, y1 - y2)


def millimetres(metres: Column) -> Column:
    """Metres to whole millimetres, half to even; decimals are only needed near halves."""
    m = metres.cast("double") * 1000
    plain = (F.abs(m) < 1e12) & (F.abs(m - F.floor(m) - 0.5) > 0.01)
    return F.when(plain, F.rint(m).cast("long")).otherwise(F.bround(metres.cast("decimal(38,6)") * 1000, 0).cast("long"))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    square = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square))).otherwise(F.lit(0.0))
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def bearing_difference_degrees(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Angle between two directions, without regard to sense (0 to 90)."""
    scale = F.hypot(dx1, dy1) * F.hypot(dx2, dy2)
    cosine = F.least(F.lit(1.0), F.abs(dx1 * dx2 + dy1 * dy2) / scale)
    return F.when(scale > 0, F.degrees(F.acos(cosine)))


def orientation(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    return F.when(dx1 * dx2 + dy1 * dy2 >= 0, "same").otherwise("reversed")


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross in the inside of both."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def cell(value: Column, size: float) -> Column:
    """Index of the grid cell that holds a coordinate."""
    return F.floor(value / size).cast("long")
