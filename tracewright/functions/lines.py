"""Lines as ``array<struct<x double, y double>>`` on a plane: lengths, positions, parts, overlap with a corridor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import distance, point_segment_distance, segments_cross


def legs(points: Column) -> Column:
    """The segments of a line, in order, as structs ax, ay, bx, by."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def length(points: Column) -> Column:
    return F.aggregate(legs(points), F.lit(0.0), lambda s, g: s + distance(g["ax"], g["ay"], g["bx"], g["by"]))


def is_line(points: Column) -> Column:
    """Whether there are two points at least, all finite, and some length."""
    whole = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return F.coalesce((F.size(points) >= 2) & whole & (length(points) > 0), F.lit(False))


def along(points: Column, x: Column, y: Column) -> Column:
    """Distance along a line to its place nearest to a point; of equally near places the first."""
    none = F.struct(F.lit(0.0).alias("gone"), F.lit(float("inf")).alias("near"), F.lit(0.0).alias("at"))

    def step(s: Column, g: Column) -> Column:
        dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - g["ax"]) * dx + (y - g["ay"]) * dy) / square))).otherwise(F.lit(0.0))
        d = distance(x, y, g["ax"] + t * dx, g["ay"] + t * dy)
        better = d < s["near"]
        return F.struct((s["gone"] + F.sqrt(square)).alias("gone"), F.least(d, s["near"]).alias("near"), F.when(better, s["gone"] + t * F.sqrt(square)).otherwise(s["at"]).alias("at"))

    return F.aggregate(legs(points), none, step, lambda s: s["at"])


def segment_gap(a: dict, b: dict) -> Column:
    """Distance between two segments, each a mapping of ax, ay, bx, by to columns; 0 if they meet."""
    ends = [point_segment_distance(p, q, *(o[k] for k in ("ax", "ay", "bx", "by"))) for s, o in ((a, b), (b, a)) for p, q in ((s["ax"], s["ay"]), (s["bx"], s["by"]))]
    cross = segments_cross(*(a[k] for k in ("ax", "ay", "bx", "by")), *(b[k] for k in ("ax", "ay", "bx", "by")))
    return F.when(cross, F.lit(0.0)).otherwise(F.least(*ends))


def part(points: Column, start: Column, end: Column) -> Column:
    """The part of a line between two distances along it, with points set in at both ends."""
    none = F.struct(F.lit(0.0).alias("gone"), F.array().cast("array<struct<x:double,y:double>>").alias("kept"))

    def step(s: Column, g: Column) -> Column:
        size = distance(g["ax"], g["ay"], g["bx"], g["by"])
        low, high = F.greatest(start, s["gone"]), F.least(end, s["gone"] + size)
        spot = lambda m: F.struct((g["ax"] + (g["bx"] - g["ax"]) * (m - s["gone"]) / size).alias("x"), (g["ay"] + (g["by"] - g["ay"]) * (m - s["gone"]) / size).alias("y"))
        first = F.when(F.size(s["kept"]) == 0, F.array(spot(low))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.struct((s["gone"] + size).alias("gone"), F.when((size > 0) & (low < high), F.concat(s["kept"], first, F.array(spot(high)))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(legs(points), none, step, lambda s: s["kept"])
