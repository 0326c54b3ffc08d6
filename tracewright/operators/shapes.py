"""Hausdorff distance between sets of lines, the choice of an alignment by a reference, and binding geometries to assets.

The distance is taken at vertices: the farthest that a vertex of either side lies from the lines of the other.  Vertices look for lines in rings; only those
that found none go on to the next ring, so the work goes to the vertices that decide.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell, point_segment_distance
from .components import checkpointed
from .lines import SLACK_M, near_segments, segments


def _gaps(vertices: DataFrame, legs: DataFrame, first_m: float) -> DataFrame:
    """(id, gap): the farthest that any vertex of each id lies from the segments of the same id.  ``vertices``: id, x, y.  ``legs``: id, ax, ay, bx, by."""
    left = checkpointed(vertices.join(legs.select("id").distinct(), "id", "left_semi").distinct())
    box = left.select(F.col("x").alias("ax"), F.col("y").alias("ay")).union(legs.select("ax", "ay")).union(legs.select("bx", "by")).agg(*[f(c) for c in ("ax", "ay") for f in (F.min, F.max)]).first()
    most = 0.0 if box[0] is None else (box[1] - box[0]) + (box[3] - box[2])
    radius, found = max(first_m, 1e-6), None
    while not left.isEmpty():
        spots = left.select("id", "x", "y", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
        met = near_segments(spots, legs, radius).where("s_id = t_id")
        gap = point_segment_distance(F.col("s_x"), F.col("s_y"), *[F.col(f"t_{c}") for c in ("ax", "ay", "bx", "by")])
        near = met.groupBy(F.col("s_id").alias("id"), F.col("s_x").alias("x"), F.col("s_y").alias("y")).agg(F.min(gap).alias("gap")).where(F.col("gap") <= radius)
        near = checkpointed(near)
        found = near if found is None else found.union(near)
        left = checkpointed(left.join(near, ["id", "x", "y"], "left_anti"))
        if radius > 2 * most + 1 and not left.isEmpty():
            raise RuntimeError("vertices without finite coordinates")
        radius *= 4
    if found is None:
        return left.select("id", F.lit(0.0).alias("gap"))
    return found.groupBy("id").agg(F.max("gap").alias("gap"))


def hausdorff(left: DataFrame, right: DataFrame, first_m: float = 50.0) -> DataFrame:
    """(id, distance) between the lines of each id on both sides; an id without lines on either has no row.

    Both sides: id, points; several rows of one id are one set of lines.  ``first_m``: radius of the first ring.
    """
    parts = []
    sides = [checkpointed(segments(side)) for side in (left, right)]
    for a, b in (sides, sides[::-1]):
        spots = a.select("id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("id", "p.x", "p.y")
        parts.append(_gaps(spots, b, first_m))
    return parts[0].union(parts[1]).groupBy("id").agg(F.max("gap").alias("distance"))


#: Groups and reference lines that one call of a task measures against each other.
GROUPS, LINES = 1024, 8192


def _off(x, y, ax, ay, bx, by):
    """Distances of points from segments, as in ``point_segment_distance``."""
    dx, dy = bx - ax, by - ay
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
    gx, gy = x - (ax + t * dx), y - (ay + t * dy)
    return np.sqrt(gx * gx + gy * gy)


def _unpacked(legs: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns ax, ay, bx, by of all segments of a column of lists of them, and how many each row has."""
    legs = legs.combine_chunks()
    flat = legs.flatten()
    return [flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")], pc.list_value_length(legs).to_numpy(zero_copy_only=False)


def seeded_alignment(options: DataFrame, references: DataFrame, ends: DataFrame, radius: float = 2000.0, side: float | None = None) -> DataFrame:
    """The option of each group nearest in shape to the reference lines around its ends: group_id, option_id, distance, n_references.

    ``options``: group_id, option_id, points.  ``references``: id, points.  ``ends``: group_id, ax, ay, bx, by, a row for each group.  Reference lines within
    ``radius`` of both ends count together as one shape; groups without any have no row.  Equal distances go by option_id.

    Groups and lines meet in the grid cell of a group's first end, in blocks: a task measures a block of groups against one of lines and gives, for each vertex
    of an option, how near the lines come, and how far their vertices lie.  So a group and a line that are near are no row.  ``side``: of the cells, ``radius`` at least.
    """
    side = max(side or radius, radius, 1e-9)
    leg = F.struct("ax", "ay", "bx", "by")
    shape = segments(options.select(F.struct("group_id", "option_id").alias("id"), "points")).groupBy("id").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    finite = reduce(and_, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in ("ax", "ay", "bx", "by")])
    tips = ends.where(finite).select("group_id", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")], cell(F.col("ax"), side).alias("cx"), cell(F.col("ay"), side).alias("cy")).distinct()
    groups = checkpointed(shape.select("id.group_id", "id.option_id", "legs").join(tips, "group_id"))
    box = [f(g(f"a{c}", f"b{c}")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))]
    lines = segments(references).groupBy("id").agg(F.collect_list(leg).alias("legs"), *[b.alias(n) for b, n in zip(box, ("x0", "x1", "y0", "y1"))])
    over = lambda low, high: F.explode(F.sequence(cell(F.col(low) - radius - SLACK_M, side), cell(F.col(high) + radius + SLACK_M, side)))
    lines = checkpointed(lines.withColumn("cx", over("x0", "x1")).withColumn("cy", over("y0", "y1")).select("id", "legs", "cx", "cy"))
    of = lambda df, key, most, name: df.groupBy("cx", "cy").agg(F.ceil(F.countDistinct(key) / most).cast("int").alias(name))
    cells = checkpointed(of(groups, "group_id", GROUPS, "group_blocks").join(of(lines, "id", LINES, "line_blocks"), ["cx", "cy"]))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = groups.join(cells, ["cx", "cy"]).withColumn("i", block("group_id", "group_blocks")).withColumn("j", every("line_blocks")).drop("group_blocks", "line_blocks")
    right = lines.join(cells, ["cx", "cy"]).withColumn("j", block("id", "line_blocks")).withColumn("i", every("group_blocks")).select("cx", "cy", "i", "j", "legs")

    def measure(g: pa.Table, t: pa.Table) -> pa.Table:
        found = {"row": [], "vertex": [], "gap": [], "back": [], "n": []}
        if g.num_rows and t.num_rows:
            (ax, ay, bx, by), size = _unpacked(t.column("legs"))
            begin = np.cumsum(size) - size
            own, count = _unpacked(g.column("legs"))
            stop = np.cumsum(count)
            tip = np.stack([g.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")])
            number = g.column("group_id").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.argsort(number, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                x0, y0, x1, y1 = tip[:, rows[0]]
                both = np.minimum.reduceat(_off(x0, y0, ax, ay, bx, by), begin) <= radius
                both &= np.minimum.reduceat(_off(x1, y1, ax, ay, bx, by), begin) <= radius
                if not both.any():
                    continue
                keep = np.repeat(both, size)
                near = [c[keep] for c in (ax, ay, bx, by)]
                vx, vy = np.concatenate([near[0], near[2]]), np.concatenate([near[1], near[3]])
                for row in rows:
                    mine = [c[stop[row] - count[row] : stop[row]] for c in own]
                    back = reduce(np.minimum, [_off(vx, vy, *m) for m in zip(*mine)]).max()
                    for k, (x, y) in enumerate(sorted({*zip(mine[0], mine[1]), *zip(mine[2], mine[3])})):
                        for c, v in zip(found.values(), (row, k, _off(x, y, *near).min(), back, both.sum())):
                            c.append(v)
        at = pa.array(np.array(found["row"], np.int64))
        return pa.table([g.column("group_id").take(at), g.column("option_id").take(at), *[pa.array(np.array(found[c], k)) for c, k in (("vertex", np.int64), ("gap", float), ("back", float), ("n", np.int64))]], names=["group_id", "option_id", "vertex", "gap", "back", "n"])

    key = ["cx", "cy", "i", "j"]
    names = ", ".join(f"{c} {options.schema[c].dataType.simpleString()}" for c in ("group_id", "option_id"))
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(measure, f"{names}, vertex long, gap double, back double, n long")
    merged = parts.groupBy("group_id", "option_id", "vertex").agg(F.min("gap").alias("gap"), F.max("back").alias("back"), F.sum("n").alias("n_references"))
    far = merged.groupBy("group_id", "option_id").agg(F.max(F.greatest("gap", "back")).alias("distance"), F.max("n_references").alias("n_references"))
    best = far.groupBy("group_id").agg(F.min(F.struct("distance", "option_id", "n_references")).alias("b"))
    return best.select("group_id", "b.option_id", "b.distance", "b.n_references")


def bind_geometry(candidates: DataFrame, assets: DataFrame, claims: DataFrame, tolerance_m: float) -> DataFrame:
    """At most one asset for each candidate whose claimed identities are used by several: candidate_id, asset_id, state.

    ``candidates``: candidate_id, points.  ``assets``: asset_id, points, identities (array).  ``claims``: candidate_id, identity.  An identity of one asset
    binds at once (``identity``, a row for each such asset).  Else the assets that share an identity are told apart by shape: one of the very same points, either
    way round (``exact``), or the nearest within ``tolerance_m`` if the next is more than ``tolerance_m`` farther (``nearest``).  Several exact or
    close ones are ``ambiguous``, none is ``unbound``, no shared identity ``unclaimed``; these have a null asset.
    """
    held = checkpointed(assets.select("asset_id", F.explode(F.array_distinct("identities")).alias("identity")))
    often = held.groupBy("identity").agg(F.count("*").alias("often"))
    match = claims.distinct().join(held, "identity").join(often, "identity").groupBy("candidate_id", "asset_id").agg((F.min("often") == 1).alias("direct"))
    match = checkpointed(match)
    direct = match.where("direct").select("candidate_id", "asset_id", F.lit("identity").alias("state"))
    rest = match.join(direct.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", "asset_id")
    rest = rest.join(candidates.select("candidate_id", F.col("points").alias("c")), "candidate_id").join(assets.select("asset_id", F.col("points").alias("a")), "asset_id")
    rest = checkpointed(rest.withColumn("id", F.struct("candidate_id", "asset_id")).withColumn("same", (F.col("c") == F.col("a")) | (F.col("c") == F.reverse("a"))))
    far = hausdorff(rest.where("not same").select("id", F.col("c").alias("points")), rest.where("not same").select("id", F.col("a").alias("points"))).where(F.col("distance") <= tolerance_m)
    rows = rest.select("id", "candidate_id", "asset_id", "same").join(far, "id", "left")
    w = Window.partitionBy("candidate_id")
    rows = rows.withColumn("n_same", F.sum(F.col("same").cast("int")).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("same").desc(), F.col("distance").asc_nulls_last(), "asset_id"))).withColumn("next", F.lead("distance").over(w.orderBy(F.col("same").desc(), F.col("distance").asc_nulls_last(), "asset_id")))
    state = F.when(F.col("n_same") == 1, "exact").when(F.col("n_same") > 1, "ambiguous").when(F.col("distance").isNull(), "unbound").when(F.col("next").isNull() | (F.col("next") - F.col("distance") > tolerance_m), "nearest").otherwise("ambiguous")
    told = rows.where("place = 1").withColumn("state", state).select("candidate_id", F.when(F.col("state").isin("exact", "nearest"), F.col("asset_id")).alias("asset_id"), "state")
    none = F.lit(None).cast(assets.schema["asset_id"].dataType)
    other = candidates.select("candidate_id").distinct().join(match.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", none.alias("asset_id"), F.lit("unclaimed").alias("state"))
    return direct.union(told).union(other)
