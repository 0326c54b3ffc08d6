"""Distance joins on a grid, nearest neighbours, population reach and catchments.

A distance join deals both sides to square cells: the right side goes to its own cell, the left side to its own and the
eight around it, so that only near rows meet and a dense cell is an ordinary skewed join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell, distance
from .components import checkpointed


def within(left: DataFrame, right: DataFrame, radius: float, prefix: str = "near_") -> DataFrame:
    """Pairs of rows at most ``radius`` apart; both sides have x and y, the right side's columns get ``prefix``.

    Rows without finite coordinates are near nothing.
    """
    left, right = left.where(located(left)), right.where(located(right))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    l = left.withColumn("dx_", around).withColumn("dy_", around)  # noqa: E741
    l = l.withColumn("cx_", cell(F.col("x"), radius) + F.col("dx_")).withColumn("cy_", cell(F.col("y"), radius) + F.col("dy_")).drop("dx_", "dy_")  # noqa: E741
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    r = r.withColumn("cx_", cell(F.col(f"{prefix}x"), radius)).withColumn("cy_", cell(F.col(f"{prefix}y"), radius))
    pairs = l.join(r, ["cx_", "cy_"]).drop("cx_", "cy_")
    d = distance(F.col("x"), F.col("y"), F.col(f"{prefix}x"), F.col(f"{prefix}y"))
    return pairs.withColumn("distance", d).where(F.col("distance") <= radius)


#: Fine cells along a side of a ring's cell; a ring looks into those alone that may hold the nearest row.
FINE = 16


def located(df: DataFrame) -> Column:
    """Whether a row has both coordinates, as finite numbers."""
    good = lambda c: df[c].isNotNull() & ~F.isnan(df[c].cast("double")) & (F.abs(df[c].cast("double")) != float("inf"))
    return F.coalesce(good("x") & good("y"), F.lit(False))


def _ring(left: DataFrame, right: DataFrame, key: str, other: str, radius: float, prefix: str) -> DataFrame:
    """The nearest right row within ``radius`` of each left row that has one.

    The right side is summed up to the boxes of its fine cells.  A left row meets the boxes around it, at most
    (3 * FINE) ** 2, and then only the rows of those boxes that are not farther than another box lies as a whole.
    """
    size = radius / FINE
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    x, y = F.col(f"{prefix}x").cast("double"), F.col(f"{prefix}y").cast("double")
    r = r.withColumn("fx_", cell(x, size)).withColumn("fy_", cell(y, size))
    boxes = r.groupBy("fx_", "fy_").agg(F.min(x).alias("x0_"), F.max(x).alias("x1_"), F.min(y).alias("y0_"), F.max(y).alias("y1_"))
    boxes = boxes.withColumn("cx_", F.floor(F.col("fx_") / FINE)).withColumn("cy_", F.floor(F.col("fy_") / FINE))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    l = left.withColumn("dx_", around).withColumn("dy_", around)  # noqa: E741
    l = l.withColumn("cx_", F.floor(cell(F.col("x"), size) / FINE) + F.col("dx_")).withColumn("cy_", F.floor(cell(F.col("y"), size) / FINE) + F.col("dy_")).drop("dx_", "dy_")  # noqa: E741
    gap = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    far = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    sides = [(F.col("x").cast("double"), F.col("x0_"), F.col("x1_")), (F.col("y").cast("double"), F.col("y0_"), F.col("y1_"))]
    met = l.join(boxes, ["cx_", "cy_"]).withColumn("low_", F.hypot(*[gap(*s) for s in sides])).where(F.col("low_") <= radius)
    met = met.withColumn("most_", F.min(F.hypot(*[far(*s) for s in sides])).over(Window.partitionBy(key)))
    # Rounding must not lose a box that just touches the bound.
    met = met.where(F.col("low_") <= F.col("most_") * (1 + 1e-9)).select(*left.columns, "fx_", "fy_")
    pairs = met.join(r, ["fx_", "fy_"]).drop("fx_", "fy_").withColumn("distance", distance(F.col("x"), F.col("y"), F.col(f"{prefix}x"), F.col(f"{prefix}y")))
    pairs = pairs.where(F.col("distance") <= radius)
    row = F.struct(*pairs.columns)
    best = pairs.groupBy(key).agg(F.min_by(row, F.struct("distance", prefix + other)).alias("best_"))
    return best.select(*[F.col("best_")[c].alias(c) for c in pairs.columns])


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, first_radius: float, prefix: str = "near_") -> DataFrame:
    """The nearest right row of each left row, ties to the smaller ``other``; ``key`` tells the left rows apart.

    Rows without finite coordinates take no part on either side.  Rings grow by doubling, or at once to where the
    right side begins, until every row has a neighbour; raises if rows are left beyond the farthest right row.
    """
    none = within(left, right, first_radius, prefix).limit(0)
    left, right = left.where(located(left)), right.where(located(right))
    box = right.agg(*[f(F.col(c).cast("double")) for c in "xy" for f in (F.min, F.max)]).first()
    if box[0] is None:
        return none
    low = [F.greatest(F.lit(box[2 * i]) - F.col(c), F.col(c) - F.lit(box[2 * i + 1]), F.lit(0.0)) for i, c in enumerate("xy")]
    high = [F.greatest(F.abs(F.lit(box[2 * i]) - F.col(c)), F.abs(F.col(c) - F.lit(box[2 * i + 1]))) for i, c in enumerate("xy")]
    open_rows, radius, found = left, float(first_radius), None
    while True:
        n, least, most = open_rows.agg(F.count("*"), F.min(F.hypot(*low)), F.max(F.hypot(*high))).first()
        if not n:
            return found if found is not None else none
        radius = max(radius, least * (1 + 1e-9))
        if radius > 4 * (most + first_radius):
            raise RuntimeError(f"{n} rows have no neighbour within {radius}")
        best = checkpointed(_ring(open_rows, right, key, other, radius, prefix))
        found = best if found is None else found.union(best)
        open_rows = checkpointed(open_rows.join(best.select(key), key, "left_anti"))
        radius *= 2


def reach_near(points: DataFrame, seeds: DataFrame, radius: float, limit: int = 200) -> DataFrame:
    """Fewest steps of at most ``radius`` from any seed to each point that can be reached so: (node, hops).

    ``points``: node, x, y.  ``seeds``: node, of ``points``.  In every round the points reached last meet the open ones in grid cells; pairs are told
    apart where they meet, so only points go between tasks.
    """
    front = checkpointed(points.join(seeds.select("node").distinct(), "node", "left_semi").select("node", "x", "y"))
    left = checkpointed(points.select("node", "x", "y").join(front.select("node"), "node", "left_anti"))
    seen = front.select("node", F.lit(0).alias("hops"))
    for hops in range(1, limit + 1):
        found = checkpointed(within(front.select("x", "y"), left, radius).select(*[F.col(f"near_{c}").alias(c) for c in ("node", "x", "y")]).distinct())
        if found.isEmpty():
            return seen.distinct()
        seen, front = seen.union(found.select("node", F.lit(hops).alias("hops"))), found
        left = checkpointed(left.join(found.select("node"), "node", "left_anti"))
        if hops % 8 == 0:
            seen = checkpointed(seen)
    raise RuntimeError(f"reach did not settle in {limit} steps")


def match_disposition(sources: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Every source with its targets within tolerance: one is accepted, several are ambiguous and all stay; none leaves the nearest, unmatched.

    Both sides: id, x, y.  A source without finite coordinates is unlocated; without any target to compare with it is unmatched, too.
    """
    hits = within(sources, targets, tolerance).select("id", F.col("near_id").alias("target_id"), "distance")
    hits = hits.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    hits = hits.select("id", "target_id", "distance", F.when(F.col("n") == 1, "accepted").otherwise("ambiguous").alias("state"))
    rest = sources.join(hits.select("id").distinct(), "id", "left_anti")
    far = nearest(rest, targets, "id", "id", tolerance * 2).select("id", F.col("near_id").alias("target_id"), "distance", F.lit("unmatched").alias("state"))
    other = rest.join(far.select("id"), "id", "left_anti")
    other = other.select("id", F.lit(None).cast(hits.schema["target_id"].dataType).alias("target_id"), F.lit(None).cast("double").alias("distance"), F.when(located(other), "unmatched").otherwise("unlocated").alias("state"))
    return hits.union(far).union(other)


#: Most options that a dense record table multiplies output areas by.
MOST_OPTIONS = 10_000


def reach_records(options: DataFrame, areas: DataFrame, radii: Sequence[float], borderline: float, inside: Column) -> DataFrame:
    """A record for each option, corridor distance and output area, captured or not.

    ``options``: option_id, x, y, a roster of plans and checked to be short, since each meets every area.  ``areas``: oa_id, residents, x, y.
    """
    n = options.limit(MOST_OPTIONS + 1).count()
    if n > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options")
    o = F.broadcast(options.select("option_id", F.col("x").alias("ox"), F.col("y").alias("oy")))
    rows = areas.withColumn("inside", inside).join(o, how="cross").withColumn("distance", distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    rows = rows.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    return rows.select("option_id", "radius", "oa_id", "residents", "inside", "distance", (F.col("distance") <= F.col("radius")).alias("captured"), (F.abs(F.col("distance") - F.col("radius")) <= borderline).alias("borderline"))


def reach_summary(records: DataFrame) -> DataFrame:
    """Residents that each option reaches: in all, inside and outside the area, shared with other options and its own alone; from dense records.

    Where no records are wanted ``reach_totals`` gives the same without them.
    """
    owners = records.where("captured").groupBy("radius", "oa_id").agg(F.countDistinct("option_id").alias("owners"))
    rows = records.join(owners, ["radius", "oa_id"], "left")
    total = lambda test: F.coalesce(F.sum(F.when(F.col("captured") & test, F.col("residents"))), F.lit(0)).cast("long")
    return rows.groupBy("option_id", "radius").agg(
        total(F.lit(True)).alias("total_residents"), total(F.col("inside")).alias("inside_residents"), total(~F.col("inside")).alias("outside_residents"),
        total(F.col("owners") > 1).alias("shared_residents"), total(F.col("owners") == 1).alias("exclusive_residents"), F.count_if("captured").alias("n_captured"),
    )


def reach_totals(options: DataFrame, areas: DataFrame, radii: Sequence[float], inside: Column) -> DataFrame:
    """Residents that each option reaches: in all, inside and outside the area, shared with other options and its own alone.

    ``options``: option_id, x, y.  ``areas``: oa_id, residents, x, y.  Only areas near an option meet it; an option that
    reaches nobody stays, with zeros.
    """
    pairs = within(areas.withColumn("inside", inside), options.select("option_id", "x", "y"), float(max(radii)))
    pairs = pairs.select(F.col("near_option_id").alias("option_id"), "oa_id", "residents", "inside", F.explode(F.filter(F.array(*[F.lit(float(r)) for r in radii]), lambda r: F.col("distance") <= r)).alias("radius"))
    owners = pairs.groupBy("radius", "oa_id").agg(F.countDistinct("option_id").alias("owners"))
    rows = pairs.join(owners, ["radius", "oa_id"])
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("residents"))), F.lit(0)).cast("long")
    sums = rows.groupBy("option_id", "radius").agg(
        total(F.lit(True)).alias("total_residents"), total(F.col("inside")).alias("inside_residents"), total(~F.col("inside")).alias("outside_residents"),
        total(F.col("owners") > 1).alias("shared_residents"), total(F.col("owners") == 1).alias("exclusive_residents"), F.count("*").alias("n_captured"),
    )
    every = options.select("option_id", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"))
    return every.join(sums, ["option_id", "radius"], "left").na.fill(0, [c for c in sums.columns if c not in ("option_id", "radius")])


def reach_sensitivity(summary: DataFrame, tolerance: float, tolerance_pct: float) -> DataFrame:
    """For each distance the ranking, the winner's margin, whether it is within tolerance, and whether the order differs from the first distance."""
    w = Window.partitionBy("radius").orderBy(F.desc("total_residents"), "option_id")
    rows = summary.select("radius", "option_id", "total_residents", F.row_number().over(w).alias("place"), F.lead("total_residents").over(w).alias("next"))
    tops = rows.groupBy("radius").agg(
        F.sort_array(F.collect_list(F.struct("place", "option_id"))).alias("order"),
        F.max(F.when(F.col("place") == 1, F.col("option_id"))).alias("winner"),
        F.max(F.when(F.col("place") == 1, F.col("total_residents") - F.col("next"))).alias("margin"),
        F.max(F.when(F.col("place") == 1, F.col("total_residents"))).alias("best"),
    )
    tops = tops.withColumn("ranking", F.array_join("order.option_id", ","))
    first = F.min_by("ranking", "radius").over(Window.partitionBy())
    near = F.col("margin") <= F.greatest(F.lit(float(tolerance)), F.col("best") * tolerance_pct / 100)
    return tops.select("radius", "winner", "margin", near.alias("near_equivalent"), (F.col("ranking") != first).alias("order_differs"), "ranking")


def catchments(centres: DataFrame, attractors: DataFrame, radius: float) -> DataFrame:
    """How many attractors lie inside and outside the radius of each centre.

    ``centres``: centre_id, x, y.  The outside is all attractors less those inside, so no centre meets the far ones.
    """
    inside = within(centres, attractors, radius).groupBy("centre_id").agg(F.count("*").alias("n_inside"), F.sum("near_residents").alias("inside_residents"))
    total = attractors.agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    rows = centres.join(inside, "centre_id", "left").crossJoin(F.broadcast(total))
    return rows.select("centre_id", F.coalesce("n_inside", zero).alias("n_inside"), (F.col("n") - F.coalesce("n_inside", zero)).alias("n_outside"), F.coalesce("inside_residents", zero).alias("inside_residents"))
