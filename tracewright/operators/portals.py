"""Where lines pass the edges of cells and boundaries: exact portals, gateways towards centres, and the portals that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed
from .lines import near_segments, segments
from .planar import TOUCH, inside_rings


def cell_portals(lines: DataFrame, size: float) -> DataFrame:
    """Places where each line meets an edge between two square cells: (id, left_x, left_y, right_x, right_y, x_mm, y_mm), each once.

    ``lines``: id, points.  Cells are named by their indices; an edge holds both its ends, so a corner belongs to the edges of four pairs of cells.  Of a stretch
    along an edge its ends count.  The work grows with the edges passed.
    """
    legs = segments(lines)

    def across(p: str, q: str) -> DataFrame:
        """Meetings with the grid lines on which coordinate ``p`` is a multiple of the size."""
        a, b, d = F.col(f"a{p}"), F.col(f"b{p}"), F.col(f"b{p}") - F.col(f"a{p}")
        low, high = F.ceil(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)
        rows = legs.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
        along = d == 0
        at = F.when(along, F.array(F.col(f"a{q}"), F.col(f"b{q}"))).otherwise(F.array(F.col(f"a{q}") + (F.col("k") * size - a) / F.nullif(d, F.lit(0.0)) * (F.col(f"b{q}") - F.col(f"a{q}"))))
        rows = rows.select("id", "k", F.explode(at).alias("v"))
        row = F.floor(F.col("v") / size)
        # On a corner the edge of the row before ends, too.
        rows = rows.withColumn("r", F.explode(F.when(F.col("v") == row * size, F.array(row - 1, row)).otherwise(F.array(row))))
        place = {p: F.col("k") * F.lit(float(size)), q: F.col("v")}
        left, right = {p: F.col("k") - 1, q: F.col("r")}, {p: F.col("k"), q: F.col("r")}
        mm = lambda c: F.bround(c * 1000, 0).cast("long")
        return rows.select("id", *[left[c].alias(f"left_{c}") for c in "xy"], *[right[c].alias(f"right_{c}") for c in "xy"], mm(place["x"]).alias("x_mm"), mm(place["y"]).alias("y_mm"))

    return across("x", "y").union(across("y", "x")).distinct()


def gateway_score(x: Column, y: Column, out_x: Column, out_y: Column, to_x: Column, to_y: Column) -> Column:
    """How badly a centre lies on the way out of a crossing: its distance off the bearing, a tenth of its distance, and 10 if it is behind."""
    dx, dy, size, far = out_x - x, out_y - y, F.hypot(out_x - x, out_y - y), F.hypot(to_x - x, to_y - y)
    ahead = ((to_x - x) * dx + (to_y - y) * dy) / F.nullif(size, F.lit(0.0))
    off = F.abs((to_x - x) * dy - (to_y - y) * dx) / F.nullif(size, F.lit(0.0))
    return F.when(size == 0, far).otherwise(F.when(ahead <= 0, 10.0).otherwise(0.0) + off + far * 0.1)


def crossings(lines: DataFrame, rings: DataFrame, side: float) -> DataFrame:
    """Where lines cross rings: (id, ring, x, y), each place once.  ``rings``: ring, ax, ay, bx, by."""
    border = rings.select(F.col("ring").alias("id"), "ax", "ay", "bx", "by")
    met = near_segments(segments(lines), border, TOUCH, side)
    dx, dy, ex, ey = F.col("s_bx") - F.col("s_ax"), F.col("s_by") - F.col("s_ay"), F.col("t_bx") - F.col("t_ax"), F.col("t_by") - F.col("t_ay")
    turn = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    fx, fy = F.col("t_ax") - F.col("s_ax"), F.col("t_ay") - F.col("s_ay")
    rows = met.withColumn("u", (fx * ey - fy * ex) / turn).withColumn("v", (fx * dy - fy * dx) / turn).where("u >= 0 and u <= 1 and v >= 0 and v <= 1")
    return rows.select(F.col("s_id").alias("id"), F.col("t_id").alias("ring"), (F.col("s_ax") + F.col("u") * dx).alias("x"), (F.col("s_ay") + F.col("u") * dy).alias("y")).distinct()


def gateways(lines: DataFrame, rings: DataFrame, centres: DataFrame, side: float) -> DataFrame:
    """The gateway of each ring towards each centre: (ring, centre_id, line_id, x, y, score); centre null: ``unresolved``.

    ``lines``: id, points.  ``rings``: ring, ax, ay, bx, by.  ``centres``: centre_id, x, y, few enough that every crossing meets all of them in blocks.  A line's
    crossing goes out towards the nearest of its two ends that lies outside the ring, and to the centre with the least score; of a centre's
    crossings the least score counts, then the line and the place.  Crossings of lines with no end outside are unresolved, the first of a ring stays.
    """
    met = checkpointed(crossings(lines, rings, side))
    ends = lines.join(met.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("end", "p"))
    spots = ends.select(F.struct("id", "end").alias("point_id"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    held = inside_rings(spots, rings, side).select("point_id.id", "point_id.end", "ring")
    out = met.join(ends.select("id", "end", F.col("p.x").alias("ox"), F.col("p.y").alias("oy")), "id").join(held, ["id", "end", "ring"], "left_anti")
    out = out.groupBy("id", "ring", "x", "y").agg(F.min(F.struct(F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")).alias("far"), "end", "ox", "oy")).alias("o"))
    out = checkpointed(out.select("id", "ring", "x", "y", "o.ox", "o.oy"))
    place = centres.select("centre_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    score = gateway_score(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("cx"), F.col("cy"))
    # A stated set of centres against all crossings.
    best = out.crossJoin(place).groupBy("id", "ring", "x", "y").agg(F.min(F.struct(score.alias("score"), "centre_id")).alias("b"))
    named = best.groupBy("ring", F.col("b.centre_id").alias("centre_id")).agg(F.min(F.struct(F.col("b.score").alias("score"), F.col("id").alias("line_id"), "x", "y")).alias("g")).select("ring", "centre_id", "g.line_id", "g.x", "g.y", "g.score")
    rest = met.join(best.select("id", "ring", "x", "y"), ["id", "ring", "x", "y"], "left_anti").groupBy("ring").agg(F.min(F.struct(F.col("id").alias("line_id"), "x", "y")).alias("g"))
    return named.union(rest.select("ring", F.lit(None).cast(centres.schema["centre_id"].dataType), "g.line_id", "g.x", "g.y", F.lit(None).cast("double")))


def top_portals(portals: DataFrame, centres: DataFrame, by: str, k: int = 4) -> DataFrame:
    """The ``k`` portals of each area that lie farthest from its centre, in that order: adds place and distance.

    ``portals``: the area, x, y.  ``centres``: the area, cx, cy.  Equally far ones go by x and y; portals at one place count once.
    """
    once = portals.select(by, "x", "y").distinct().join(centres.select(by, "cx", "cy"), by)
    rows = once.withColumn("distance", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("distance"), "x", "y"))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("cx", "cy")
