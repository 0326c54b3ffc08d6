"""Lines against lines: matching with dispositions, marking within corridors, splitting at an extent.

Lines are dealt to grid cells segment by segment, so only near segments meet; what a pair of lines needs as a whole
(positions, bearings, shared length) is measured in blocks of lines, see ``meeting``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.geometry import cell, norm
from . import meeting
from .components import checkpointed
from .linear import merge_intervals

_LEG = ("ax", "ay", "bx", "by")
#: Boxes may lie this much farther apart (metres), so that rounding loses no pair.
SLACK_M = 1e-6


def segments(lines: DataFrame) -> DataFrame:
    """id, seq, ax, ay, bx, by, size and from_m (distance along the line) of each segment that has a length.

    ``lines``: id, points (``array<struct<x, y>>``).  Rows that are no line (null, one point, no length, coordinates that
    are not finite) have no segments.
    """
    rows = lines.where(L.is_line(F.col("points"))).select("id", F.posexplode(L.legs(F.col("points"))).alias("seq", "leg")).select("id", "seq", "leg.*")
    rows = rows.withColumn("size", norm(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("from_m", F.coalesce(F.sum("size").over(before), F.lit(0.0))).where("size > 0")


def _dealt(rows: DataFrame, side: float, reach: float, prefix: str) -> DataFrame:
    """Segments in every cell of a grid of ``side`` that their boxes, widened by ``reach``, touch; columns prefixed."""
    over = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - reach, side), cell(F.greatest(a, b) + reach, side)))
    rows = rows.withColumn("cx_", over("ax", "bx")).withColumn("cy_", over("ay", "by"))
    return rows.select("cx_", "cy_", *[F.col(c).alias(prefix + c) for c in rows.columns if c not in ("cx_", "cy_")])


def near_segments(left: DataFrame, right: DataFrame, radius: float, side: float | None = None, own: bool = False) -> DataFrame:
    """Pairs of segments, columns s_ and t_, whose boxes come within ``radius``, each once; with ``own`` only those of one id.

    ``side``: of the cells, ``radius`` at least; about the length of a segment is a good one.
    """
    side = max(side or radius, radius, 1e-9)
    s, t = _dealt(left, side, radius, "s_"), _dealt(right, side, 0.0, "t_")
    same = [s[c] == t[c] for c in ("cx_", "cy_")]
    met = s.join(t, [*same, F.col("s_id") == F.col("t_id")]).drop(t["cx_"]).drop(t["cy_"]) if own else s.join(t, ["cx_", "cy_"])
    # Of the cells that both boxes touch the first one counts.
    for c in "xy":
        s, t = (F.col(f"s_a{c}"), F.col(f"s_b{c}")), (F.col(f"t_a{c}"), F.col(f"t_b{c}"))
        met = met.where(F.col(f"c{c}_") == F.greatest(cell(F.least(*s) - radius, side), cell(F.least(*t), side)))
        met = met.where((F.least(*t) - F.greatest(*s) <= radius + SLACK_M) & (F.least(*s) - F.greatest(*t) <= radius + SLACK_M))
    return met.drop("cx_", "cy_")


def match_lines(sources: DataFrame, targets: DataFrame, tolerance_m: float, bearing_degrees: float, least_shared_m: float, same_direction: bool = False, side: float | None = None, within_m: float | None = None) -> DataFrame:
    """Every source line with its disposition against all target lines.

    One target that passes all tests is accepted; several are ambiguous and all stay; with none the best of
    all targets by (distance, bearing, id) stays as unmatched, with the first test that it fails: distance, bearing,
    orientation, shared length.  Both sides: id, points.  A source that is no line is unmatched as
    invalid-source-geometry, an id with several source rows conflicting as duplicate-source-id; target ids that
    repeat and targets that are no line take no part.  Without any target sources are unmatched as no-target-lines.

    The best of all is looked for in widening rings, at most to where a ring holds both sides, for the sources still open; with ``within_m`` no farther than
    that, and sources without a target so near are unmatched as no-target-within.

    Lines meet in blocks (``meeting``), so pairs are rows of the result alone.  Only sources that no target comes near are told and written before.
    """
    one = lambda df: df.join(df.groupBy("id").count().where("count > 1").select("id"), "id", "left_anti")
    twice = sources.groupBy("id").count().where("count > 1").select("id")
    radius, side = max(tolerance_m, 1e-3) + 1e-3, side or tolerance_m
    good = lambda df: one(df).where(L.is_line(F.col("points"))).select("id", "points")
    s, t = checkpointed(meeting.in_blocks(good(sources), max(side, radius))), checkpointed(meeting.with_lengths(good(targets)))
    rule = meeting.Rule(tolerance_m, bearing_degrees, least_shared_m, same_direction)
    out, empty = meeting.met(s, t, rule, radius, side).where("state <> 'open'"), t.isEmpty()
    still = lambda rows: checkpointed(s.join(rows.where("state = 'open'").select(F.col("source_id").alias("id")), "id", "left_semi"))
    open_s = s
    if not empty:
        doubtful = s.join(meeting.surely_near(s, t, radius), "id", "left_anti")
        open_s = still(meeting.met(doubtful, t, rule, radius, side, probe=True))
        ends = [f(g(c)) for c in "xy" for f, g in ((F.min, F.array_min), (F.max, F.array_max))]
        box = s.select("x", "y").union(t.select("x", "y")).agg(*ends).first()
        span = (box[1] - box[0]) + (box[3] - box[2]) if s.head(1) else 0.0
        while not open_s.isEmpty() and not (radius > 2 * span + 2 * tolerance_m + 1 or (within_m is not None and radius >= within_m)):
            radius = radius * 4 if within_m is None else min(radius * 4, max(within_m, radius))
            found = checkpointed(meeting.met(open_s, t, rule, radius, side))
            out, open_s = out.union(found.where("state <> 'open'")), still(found)
    rest = open_s.select("id", F.lit("unmatched").alias("state"), F.lit("no-target-lines" if empty else "no-target-within").alias("reason"))
    rest = rest.union(one(sources).where(~L.is_line(F.col("points"))).select("id", F.lit("unmatched"), F.lit("invalid-source-geometry")))
    rest = rest.union(twice.select("id", F.lit("conflicting"), F.lit("duplicate-source-id")))
    blank = {c: F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns}
    out = out.select("source_id", "target_id", "state", "reason", "distance_mm", "bearing_mdeg", "orientation", "shared_mm", "source_mm", "target_mm", "source_millionths", "target_millionths")
    return out.union(rest.select(*[F.col("id").alias(c) if c == "source_id" else F.col(c) if c in ("state", "reason") else blank[c] for c in out.columns]))


def _let(value: Column, step) -> Column:
    """``step`` of a value that it may name many times, without writing the value out as often."""
    return F.transform(F.array(value), step)[0]


def inside_stretches(met: DataFrame, radius: float) -> DataFrame:
    """Pairs of segments s_ and t_ with low and high: the fractions of the first between which it is at most ``radius`` from the second.

    What lies within a distance of a segment is convex, so it is one stretch: the hull of what lies in the discs round both ends and in
    the rectangle between them.  Pairs without any are left out.
    """
    r, far = F.lit(float(radius)), float("inf")
    zero = lambda x: F.nullif(x, F.lit(0.0))
    named = lambda **columns: F.struct(*[v.alias(k) for k, v in columns.items()])
    gaps = named(
        ux=F.col("t_bx") - F.col("t_ax"), uy=F.col("t_by") - F.col("t_ay"), dx=F.col("s_bx") - F.col("s_ax"), dy=F.col("s_by") - F.col("s_ay"),
        fx=F.col("s_ax") - F.col("t_ax"), fy=F.col("s_ay") - F.col("t_ay"), gx=F.col("s_ax") - F.col("t_bx"), gy=F.col("s_ay") - F.col("t_by"),
    )

    def products(g: Column) -> Column:
        w = F.hypot(g["ux"], g["uy"])
        return named(
            w=w, a=g["dx"] * g["dx"] + g["dy"] * g["dy"], b1=g["fx"] * g["dx"] + g["fy"] * g["dy"], b2=g["gx"] * g["dx"] + g["gy"] * g["dy"],
            c1=g["fx"] * g["fx"] + g["fy"] * g["fy"] - r * r, c2=g["gx"] * g["gx"] + g["gy"] * g["gy"] - r * r,
            # Where the place beside the second segment lies between its ends (u), and on which side of its line, how far (v).
            u0=(g["fx"] * g["ux"] + g["fy"] * g["uy"]) / zero(w), u1=(g["dx"] * g["ux"] + g["dy"] * g["uy"]) / zero(w),
            v0=(g["fx"] * g["uy"] - g["fy"] * g["ux"]) / zero(w), v1=(g["dx"] * g["uy"] - g["dy"] * g["ux"]) / zero(w),
        )

    def band(start: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
        x, y = (low - start) / zero(slope), (high - start) / zero(slope)
        always = (start >= low) & (start <= high)
        return F.when(slope != 0, F.least(x, y)).when(always, F.lit(-far)), F.when(slope != 0, F.greatest(x, y)).when(always, F.lit(far))

    def pieces(p: Column) -> Column:
        root = lambda b, k: F.when(b * b - p["a"] * k >= 0, F.sqrt(F.abs(b * b - p["a"] * k)))
        (m0, m1), (n0, n1) = band(p["u0"], p["u1"], F.lit(0.0), p["w"]), band(p["v0"], p["v1"], -r, r)
        return named(a=p["a"], b1=p["b1"], b2=p["b2"], r1=root(p["b1"], p["c1"]), r2=root(p["b2"], p["c2"]), m0=m0, m1=m1, n0=n0, n1=n1)

    def hull(p: Column) -> Column:
        both = p["m0"].isNotNull() & p["n0"].isNotNull() & (F.greatest(p["m0"], p["n0"]) <= F.least(p["m1"], p["n1"]))
        low = F.least((-p["b1"] - p["r1"]) / p["a"], (-p["b2"] - p["r2"]) / p["a"], F.when(both, F.greatest(p["m0"], p["n0"])))
        high = F.greatest((-p["b1"] + p["r1"]) / p["a"], (-p["b2"] + p["r2"]) / p["a"], F.when(both, F.least(p["m1"], p["n1"])))
        # Least and greatest skip nulls, so a hull of nothing is null here and not the whole segment.
        return named(low=F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))), high=F.when(high.isNotNull(), F.least(high, F.lit(1.0))))

    rows = met.withColumn("hull", _let(_let(_let(gaps, products), pieces), hull))
    return rows.withColumn("low", F.col("hull.low")).withColumn("high", F.col("hull.high")).drop("hull").where("low < high")


def _hulls(c: dict[str, np.ndarray], r: float) -> tuple[np.ndarray, np.ndarray]:
    """low and high of ``inside_stretches`` for many pairs at once; NaN stands for nothing."""
    ux, uy, dx, dy = c["t_bx"] - c["t_ax"], c["t_by"] - c["t_ay"], c["s_bx"] - c["s_ax"], c["s_by"] - c["s_ay"]
    fx, fy, gx, gy = c["s_ax"] - c["t_ax"], c["s_ay"] - c["t_ay"], c["s_ax"] - c["t_bx"], c["s_ay"] - c["t_by"]

    def band(start: np.ndarray, slope: np.ndarray, low, high) -> tuple[np.ndarray, np.ndarray]:
        x, y = (low - start) / slope, (high - start) / slope
        always = (start >= low) & (start <= high)
        return np.where(slope != 0, np.minimum(x, y), np.where(always, -np.inf, np.nan)), np.where(slope != 0, np.maximum(x, y), np.where(always, np.inf, np.nan))

    with np.errstate(all="ignore"):
        w, a = np.hypot(ux, uy), dx * dx + dy * dy
        z = np.where(w == 0, np.nan, w)
        ends = []
        for px, py in ((fx, fy), (gx, gy)):
            b, k = px * dx + py * dy, px * px + py * py - r * r
            root = np.sqrt(b * b - a * k)
            ends.append(((-b - root) / a, (-b + root) / a))
        m0, m1 = band((fx * ux + fy * uy) / z, (dx * ux + dy * uy) / z, 0.0, w)
        n0, n1 = band((fx * uy - fy * ux) / z, (dx * uy - dy * ux) / z, -r, r)
        both = np.maximum(m0, n0) <= np.minimum(m1, n1)
        low = np.fmin(np.fmin(ends[0][0], ends[1][0]), np.where(both, np.maximum(m0, n0), np.nan))
        high = np.fmax(np.fmax(ends[0][1], ends[1][1]), np.where(both, np.minimum(m1, n1), np.nan))
    return np.maximum(low, 0.0), np.minimum(high, 1.0)


def merged_stretches(met: DataFrame, radius: float, touch: float = 1e-9) -> DataFrame:
    """(id, start_m, end_m): where the first segments of pairs are at most ``radius`` from the second, merged as far as pairs come together.

    Pairs are measured by the batch inside tasks, and of a batch only the union of each line's stretches goes on; ``merge_intervals`` makes the rest one.
    """
    columns = ["s_from_m", "s_size", *[p + k for p in ("s_", "t_") for k in _LEG]]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in columns}
            low, high = _hulls(c, float(radius))
            keep = np.flatnonzero(low < high)
            if not len(keep):
                continue
            code = batch.column("id").dictionary_encode().indices.to_numpy()[keep]
            start, end = (c["s_from_m"][keep] + x[keep] * c["s_size"][keep] for x in (low, high))
            order = np.lexsort((end, start, code))
            keep, code, start, end = keep[order], code[order], start[order], end[order]
            reach = pd.Series(end).groupby(code).cummax().to_numpy()
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] > reach[:-1] + touch)])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep[new])), pa.array(start[new]), pa.array(np.maximum.reduceat(end, new))], names=["id", "start_m", "end_m"])

    kind = met.schema["s_id"].dataType.simpleString()
    return met.select(F.col("s_id").alias("id"), *columns).mapInArrow(measured, f"id {kind}, start_m double, end_m double")


def corridor_stretches(lines: DataFrame, corridor: DataFrame, buffer_m: float, side: float | None = None) -> DataFrame:
    """(id, start_m, end_m): stretches of each line that lie within ``buffer_m`` of any corridor line, merged.

    Both sides: id, points; a corridor row of one point, or of points all alike, is a disc.
    """
    s = segments(lines)
    discs = corridor.where((F.size("points") >= 1) & ~L.is_line(F.col("points")) & F.forall("points", lambda p: F.abs(p["x"]).isNotNull() & F.abs(p["y"]).isNotNull()))
    discs = discs.select("id", *[F.col("points")[0][c[1]].cast("double").alias(c) for c in _LEG])
    c = segments(corridor).select("id", *_LEG).union(discs)
    rows = merged_stretches(near_segments(s, c, buffer_m, side), buffer_m)
    return merge_intervals(rows, ["id"], "start_m", "end_m").select("id", "start_m", "end_m")


def corridor_share(lines: DataFrame, corridor: DataFrame, buffer_m: float, side: float | None = None) -> DataFrame:
    """(id, length_m, inside_m, share) of each line: the share that lies within ``buffer_m`` of the corridor, at most 1.

    A row that is no line has length and share 0.
    """
    inside = corridor_stretches(lines, corridor, buffer_m, side).groupBy("id").agg(F.sum(F.col("end_m") - F.col("start_m")).alias("inside_m"))
    size = F.when(L.is_line(F.col("points")), L.length(F.col("points"))).otherwise(F.lit(0.0))
    rows = lines.select("id", size.alias("length_m")).join(inside, "id", "left").withColumn("inside_m", F.coalesce("inside_m", F.lit(0.0)))
    return rows.withColumn("share", F.when(F.col("length_m") > 0, F.least(F.lit(1.0), F.col("inside_m") / F.col("length_m"))).otherwise(F.lit(0.0)))


def mark_edges(edges: DataFrame, routes: DataFrame, buffer_m: float = 20.0, least_share: float = 0.5, side: float | None = None) -> DataFrame:
    """Edges (id, points) with their share in the routes' corridor and whether it is at least ``least_share``."""
    return corridor_share(edges, routes, buffer_m, side).withColumn("marked", (F.col("length_m") > 0) & (F.col("share") >= least_share))


def split_scopes(lines: DataFrame, communities: DataFrame, buffer_m: float, inside: str = "urban", outside: str = "rural", side: float | None = None) -> DataFrame:
    """Lines split where they enter and leave the communities' extent: (id, scope, start_m, end_m, points) for each part.

    ``communities``: id, x, y; the extent is what lies within ``buffer_m`` of any of them.
    """
    spots = communities.select("id", F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("points"))
    urban = checkpointed(corridor_stretches(lines, spots, buffer_m, side)).withColumn("scope", F.lit(inside))
    whole = lines.where(L.is_line(F.col("points"))).select("id", "points", L.length(F.col("points")).alias("length_m"))
    order = Window.partitionBy("id").orderBy("start_m")
    gaps = urban.withColumn("from_m", F.coalesce(F.lag("end_m").over(order), F.lit(0.0))).select("id", F.col("from_m").alias("start_m"), F.col("start_m").alias("end_m"), F.lit(outside).alias("scope"))
    last = whole.join(urban.groupBy("id").agg(F.max("end_m").alias("last_m")), "id", "left").select("id", F.coalesce("last_m", F.lit(0.0)).alias("start_m"), F.col("length_m").alias("end_m"), F.lit(outside).alias("scope"))
    parts = urban.unionByName(gaps).unionByName(last).where(F.col("end_m") - F.col("start_m") > 1e-6)
    return parts.join(whole, "id").select("id", "scope", "start_m", "end_m", L.part(F.col("points"), F.col("start_m"), F.col("end_m")).alias("points"))
