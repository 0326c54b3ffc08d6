"""Interval sweeps, sampling, reuse of existing alignments, parallel sections, materialisation checks and governance rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def transitions(intervals: DataFrame, by: str) -> DataFrame:
    """Stretches between neighbouring ends of intervals, with how many intervals cover each and the smallest of them.

    ``intervals``: the line, evidence_id, start_m, end_m.  Coverage is a running sum of starts and ends; only the smallest id needs the
    intervals themselves, which meet the stretches of their own line.
    """
    points = intervals.select(by, F.col("start_m").alias("at"), F.lit(1).alias("d")).union(intervals.select(by, F.col("end_m"), F.lit(-1)))
    points = points.groupBy(by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(by).orderBy("at")
    out = points.select(by, F.col("at").alias("from_m"), F.lead("at").over(w).alias("to_m"), F.sum("d").over(w).alias("n_covering")).where("to_m is not null and n_covering > 0")
    hit = out.join(intervals, by).where("start_m <= from_m and end_m >= to_m").groupBy(by, "from_m", "to_m", "n_covering").agg(F.min("evidence_id").alias("first_evidence"))
    return hit


def samples(routes: DataFrame, spacing_m: int) -> DataFrame:
    """Ordered samples every ``spacing_m`` along each straight route, both ends included.  ``routes``: route_id, x0, y0, x1, y1 (metres)."""
    rows = routes.withColumn("length_m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).withColumn("steps", F.ceil(F.col("length_m") / spacing_m))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    at = F.least(F.col("step") * F.lit(float(spacing_m)), F.col("length_m"))
    share = F.when(F.col("length_m") > 0, at / F.col("length_m")).otherwise(0.0)
    return rows.select("route_id", "step", at.alias("at_m"), (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("y"))


def sample_raster(places: DataFrame, pixels: DataFrame, tile_m: int, pixel_m: int, no_data: float = -3e38) -> DataFrame:
    """The pixel under each place: available, no-data in a known tile, or explicit-unknown where no tile is.

    ``places``: sample_id, x, y.  ``pixels``: tile_x, tile_y, row, col, value; rows count down from a tile's upper edge.
    """
    tx, ty = F.floor(F.col("x") / tile_m), F.floor(F.col("y") / tile_m)
    most = tile_m // pixel_m - 1
    p = places.select("sample_id", tx.alias("tile_x"), ty.alias("tile_y"), F.least(F.floor((F.col("x") - tx * tile_m) / pixel_m), F.lit(most)).alias("col"), F.greatest(F.lit(0), most - F.floor((F.col("y") - ty * tile_m) / pixel_m)).alias("row"))
    tiles = pixels.select("tile_x", "tile_y").distinct().withColumn("known", F.lit(True))
    rows = p.join(pixels, ["tile_x", "tile_y", "row", "col"], "left").join(tiles, ["tile_x", "tile_y"], "left")
    good = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.col("value") > no_data)
    state = F.when(F.col("known").isNull(), "explicit-unknown").when(good, "available").otherwise("no-data")
    return rows.select("sample_id", F.when(good, F.col("value")).alias("value"), state.alias("availability"))


def reusable_state(assertions: DataFrame, dimensions: Sequence[str], as_of: Column) -> DataFrame:
    """Whether an alignment can be reused: unknown beats absent beats confirmed over its dimensions.

    ``assertions``: alignment_id, dimension, state (confirmed, absent, unknown), valid_to.  A dimension without current assertions, with an unknown or
    with contradictory ones is unknown.
    """
    per = assertions.groupBy("alignment_id", "dimension").agg(
        F.count_if((F.col("valid_to") < as_of) | (F.col("state") == "unknown")).alias("doubts"), F.countDistinct("state").alias("states"), F.min("state").alias("state")
    )
    per = per.withColumn("state", F.when((F.col("doubts") > 0) | (F.col("states") > 1), "unknown").otherwise(F.col("state")))
    known = per.where(F.col("dimension").isin(list(dimensions))).groupBy("alignment_id").agg(F.count_if(F.col("state") != "unknown").alias("known"), F.count_if(F.col("state") == "absent").alias("absent"))
    overall = F.when(F.coalesce("known", F.lit(0)) < len(dimensions), "unknown").when(F.col("absent") > 0, "absent").otherwise("confirmed")
    return assertions.select("alignment_id").distinct().join(known, "alignment_id", "left").select("alignment_id", overall.alias("reusable"))


def reuse_order(rows: DataFrame, by: str) -> DataFrame:
    """Near-equivalent alignments by reusable share, recognised share, directness and id."""
    w = Window.partitionBy(by).orderBy(F.desc("reusable_share"), F.desc("recognised_share"), "directness", "alignment_id")
    return rows.withColumn("place", F.row_number().over(w))


def parallel_sections(routes: DataFrame, choice_points: DataFrame) -> DataFrame:
    """Sections of each route between its ends and the declared choice points on it.  ``routes``: route_id, nodes (array).  ``choice_points``: node."""
    rows = routes.select("route_id", F.posexplode("nodes").alias("at", "node"), F.size("nodes").alias("n")).join(choice_points.select("node", F.lit(True).alias("choice")).distinct(), "node", "left")
    cuts = rows.where("choice or at = 0 or at = n - 1")
    w = Window.partitionBy("route_id").orderBy("at")
    out = cuts.select("route_id", (F.row_number().over(w) - 1).alias("section"), F.col("node").alias("from_node"), F.lead("node").over(w).alias("to_node"), (F.lead("at").over(w) - F.col("at")).alias("n_edges"))
    return out.where("to_node is not null")


def hybrids(routes: DataFrame, choice_points: DataFrame) -> DataFrame:
    """Routes of the beginning of one and the end of another, switched at a choice point inside both of the same ends, if that is a new sequence.

    ``routes``: route_id (of one route), ends, nodes (array, each node once).  Of routes that begin alike up to a choice point, or end alike behind it, the
    smallest stands for all: where one route is both, its own sequence would come of it, which is not new.
    """
    inner = routes.select("route_id", "ends", "nodes", F.posexplode("nodes").alias("at", "node")).where("at > 0 and at < size(nodes) - 1").join(choice_points.select("node").distinct(), "node", "left_semi")
    a = inner.groupBy("ends", "node", F.slice("nodes", F.lit(1), F.col("at") + 1).alias("head")).agg(F.min("route_id").alias("first_id"))
    b = inner.groupBy("ends", "node", F.slice("nodes", F.col("at") + 2, F.size("nodes")).alias("tail")).agg(F.min("route_id").alias("second_id"))
    both = a.join(b, ["ends", "node"]).where("first_id <> second_id and not arrays_overlap(head, tail)").withColumn("nodes", F.concat("head", "tail"))
    fresh = both.join(routes.select("ends", "nodes"), ["ends", "nodes"], "left_anti")
    return fresh.groupBy("ends", "nodes").agg(F.min(F.struct("first_id", "second_id", "node")).alias("made")).select("ends", "made.*", F.size("nodes").alias("n_nodes"))


def section_union(captured: DataFrame, selected: DataFrame) -> DataFrame:
    """Residents of the areas that the selected sections of a group capture, each area once.  ``captured``: group_id, section, oa_id, residents."""
    rows = captured.join(selected, ["group_id", "section"], "left_semi").select("group_id", "oa_id", "residents").distinct()
    return rows.groupBy("group_id").agg(F.count("*").alias("n_areas"), F.sum("residents").alias("residents"))


def materialise(rows: DataFrame, exact: Column) -> DataFrame:
    """Rows of a pinned query by layer and key: selected once, duplicates folded, different contents in conflict, others rejected.

    ``rows``: layer, key, content.
    """
    g = rows.withColumn("hit", exact).groupBy("layer", "key").agg(F.count_if("hit").alias("hits"), F.countDistinct(F.when(F.col("hit"), F.col("content"))).alias("contents"))
    state = F.when(F.col("hits") == 0, "rejected").when(F.col("contents") > 1, "conflict").when(F.col("hits") > 1, "deduplicated").otherwise("selected")
    return g.select("layer", "key", "hits", state.alias("state"))


def digests(rows: DataFrame, layer: str, columns: Sequence[str]) -> DataFrame:
    """A digest of each layer over its rows, in whatever order they come, and their number.

    Each row's SHA-256, over its columns with their lengths before them (a null is a lone hyphen), is taken as eight
    32-bit numbers; these are summed up apart, so partial sums meet and no layer is gathered.  The digest is that of the sums.
    """
    text = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])
    one = rows.select(layer, F.sha2(text, 256).alias("d"))
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(8)]
    sums = one.groupBy(layer).agg(F.count("*").alias("n_rows"), *words)
    return sums.select(layer, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def cutover(gates: DataFrame, manifests: DataFrame, commit: str) -> DataFrame:
    """Each required gate: missing, duplicate, of another commit, over its threshold, or passed.  ``gates``: gate, threshold.  ``manifests``: gate, commit, value."""
    g = manifests.groupBy("gate").agg(F.count("*").alias("n"), F.count_if(F.col("commit") != commit).alias("other"), F.max("value").alias("value"))
    rows = gates.join(g, "gate", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("other") > 0, "commit-mismatch").when(F.col("value") > F.col("threshold"), "threshold-failed").otherwise("passed")
    return rows.select("gate", state.alias("state"))


def resolve_sources(cells: DataFrame, providers: DataFrame, capability: str, use: str) -> DataFrame:
    """The provider of each requested cell by authority; cells that nobody covers stay, without one.

    ``providers``: provider_id, capability, uses (array), cell, authority (1 is highest).
    """
    ok = providers.where((F.col("capability") == capability) & F.array_contains("uses", use))
    best = ok.groupBy("cell").agg(F.min(F.struct("authority", "provider_id")).alias("b"), F.countDistinct("provider_id").alias("n"))
    return cells.join(best, "cell", "left").select("cell", F.col("b.provider_id").alias("provider_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_providers"))


def lifecycle(changes: DataFrame, legal: Mapping[str, Sequence[str]], gated: Sequence[str]) -> DataFrame:
    """Whether each change of state is legal; entering a gated state needs a named person.  ``changes``: record_id, was, state, approver."""
    allowed = F.lit(False)
    for was, nexts in legal.items():
        allowed = allowed | ((F.col("was") == was) & F.col("state").isin(list(nexts)))
    verdict = F.when(~F.coalesce(allowed, F.lit(False)), "illegal").when(F.col("state").isin(list(gated)) & F.col("approver").isNull(), "needs-approval").otherwise("legal")
    return changes.select("record_id", "was", "state", verdict.alias("verdict"))


def route_menu(routes: DataFrame, by: str, criteria: Sequence[str]) -> DataFrame:
    """Routes of each line in order of their criteria (higher first), then length and id."""
    w = Window.partitionBy(by).orderBy(*[F.desc_nulls_last(c) for c in criteria], "length", "route_id")
    return routes.withColumn("place", F.row_number().over(w))


def broken_references(rows: DataFrame, target: DataFrame, column: str, key: str) -> DataFrame:
    """Values of ``column`` that no row of ``target`` has, with how often each occurs."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(target.select(F.col(key).alias(column)), column, "left_anti")


def urban_eligibility(streets: DataFrame, rules: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Class of each community by the first rule that its street length and junctions both meet.  ``streets``: community_id, street_km, n_junctions."""
    out = None
    for name, km, junctions in rules:
        test = (F.col("street_km") >= km) & (F.col("n_junctions") >= junctions)
        out = F.when(test, name) if out is None else out.when(test, name)
    return streets.select("community_id", "street_km", "n_junctions", out.otherwise("rural").alias("class"))
