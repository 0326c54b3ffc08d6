"""Demand: desire lines, their filters, sensitivity to the filters, and network density."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import haversine_km


class Scale(NamedTuple):
    """Filters of one planning scale. ``protect``: equality-relevant places are kept below the trip threshold."""

    name: str
    minimum_km: float
    maximum_km: float
    minimum_trips: float
    protect: bool = False


class Case(NamedTuple):
    """Other thresholds for one scale."""

    name: str
    scale: str
    minimum_km: float
    maximum_km: float
    minimum_trips: float


def _as_table(frame: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A few configured rows as an array column, exploded: no join and no driver data."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return frame.withColumn("row_", F.explode(rows)).select(*frame.columns, *[F.col("row_")[n].alias(n) for n in names])


_RULES = ("minimum_km", "maximum_km", "minimum_trips")


def desire_lines(points: DataFrame, flows: DataFrame, scales: Sequence[Scale]) -> DataFrame:
    """One line for each scenario, origin, destination, unit and scale; all lines stay, with what the filters say.

    ``points``: point_id, lon, lat, equality.  ``flows``: flow_id, scenario_id, origin_id, destination_id, trips, unit.
    Flows are summed before they meet the points.
    """
    grouped = flows.groupBy("scenario_id", "origin_id", "destination_id", "unit").agg(F.sum("trips").alias("trips"), F.count("*").alias("n_flows"))
    for end in ("origin", "destination"):
        side = points.select(F.col("point_id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in ("lon", "lat", "equality")])
        grouped = grouped.join(side, f"{end}_id")
    grouped = grouped.withColumn("km", haversine_km(F.col("origin_lon"), F.col("origin_lat"), F.col("destination_lon"), F.col("destination_lat")))
    lines = _as_table(grouped, scales, ("scale", *_RULES, "protect"))
    lines = lines.withColumn("override", F.col("protect") & (F.col("origin_equality") | F.col("destination_equality")) & (F.col("trips") < F.col("minimum_trips")))
    near = (F.col("km") >= F.col("minimum_km")) & (F.col("km") <= F.col("maximum_km"))
    lines = lines.withColumn("retained", near & ((F.col("trips") >= F.col("minimum_trips")) | F.col("override")))
    reason = F.when(~F.col("retained"), "filtered").when(F.col("override"), "equality-access").otherwise("filters-passed")
    return lines.select(
        F.concat_ws("-", F.lit("desire"), "scenario_id", "scale", "origin_id", "destination_id").alias("desire_line_id"),
        "scenario_id", "scale", "origin_id", "destination_id", "trips", "unit", "n_flows", "km", "retained", reason.alias("reason"),
        *_RULES, "protect", "override", (F.col("origin_equality") | F.col("destination_equality")).alias("equality"),
    )


def filter_outcomes(lines: DataFrame) -> DataFrame:
    """A row for each line and rule."""
    rule = lambda name, configured, observed, passed, override: F.struct(F.lit(name).alias("rule"), F.col(configured).alias("configured_value"), F.col(observed).alias("observed_value"), passed.alias("passed"), override.alias("overridden"))
    rules = F.array(
        rule("minimum-distance-km", "minimum_km", "km", F.col("km") >= F.col("minimum_km"), F.lit(False)),
        rule("maximum-distance-km", "maximum_km", "km", F.col("km") <= F.col("maximum_km"), F.lit(False)),
        rule("minimum-trips", "minimum_trips", "trips", F.col("trips") >= F.col("minimum_trips"), F.col("override")),
    )
    return lines.select("desire_line_id", F.explode(rules).alias("o")).select("desire_line_id", "o.*")


def sensitivity(lines: DataFrame, cases: Sequence[Case]) -> DataFrame:
    """For each case the lines retained and those that differ from the base; distances count as published."""
    rows = _as_table(lines.drop(*_RULES).withColumnRenamed("scale", "own"), cases, ("case_id", "scale", *_RULES)).where("own = scale")
    km = F.round("km", 6)
    held = (km >= F.col("minimum_km")) & (km <= F.col("maximum_km")) & ((F.col("trips") >= F.col("minimum_trips")) | (F.col("protect") & F.col("equality")))
    rows = rows.withColumn("held", held)
    return rows.groupBy("case_id", "scale").agg(
        F.count_if("held").alias("n_retained"),
        F.count_if(F.col("held") != F.col("retained")).alias("n_changed"),
        F.sort_array(F.collect_set(F.when(F.col("held") != F.col("retained"), F.col("desire_line_id")))).alias("changed_ids"),
    )


def network_density(points: DataFrame, lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Coverage of points by selected routes, for each scenario and scale.

    ``selected``: desire_line_id, length_km.  Points that no selected route touches are listed as gaps.
    """
    routes = lines.where("retained").join(selected, "desire_line_id", "left")
    base = lines.select("scenario_id", "scale").distinct()
    counts = routes.groupBy("scenario_id", "scale").agg(
        F.count("*").alias("retained_count"), F.count("length_km").alias("preferred_count"), F.round(F.coalesce(F.sum("length_km"), F.lit(0.0)), 6).alias("preferred_length_km")
    )
    ends = routes.where("length_km is not null").select("scenario_id", "scale", F.explode(F.array("origin_id", "destination_id")).alias("point_id")).distinct()
    # A row for each point of each planning case: the configured cases, not data, multiply here.
    grid = base.crossJoin(points.select("point_id"))
    seen = grid.join(ends.withColumn("covered", F.lit(True)), ["scenario_id", "scale", "point_id"], "left")
    cover = seen.groupBy("scenario_id", "scale").agg(
        F.count("covered").alias("covered_count"), F.count("*").alias("total_count"),
        F.sort_array(F.collect_list(F.when(F.col("covered").isNull(), F.col("point_id")))).alias("gap_ids"),
    )
    zero = F.lit(0).cast("long")
    return cover.join(counts, ["scenario_id", "scale"], "left").select(
        F.concat_ws("-", F.lit("density"), "scenario_id", "scale").alias("density_id"), "scenario_id", "scale",
        F.coalesce("retained_count", zero).alias("retained_count"), F.coalesce("preferred_count", zero).alias("preferred_count"),
        "covered_count", "total_count", F.round(F.col("covered_count") / F.col("total_count"), 6).alias("coverage_ratio"),
        F.coalesce("preferred_length_km", F.lit(0.0)).alias("preferred_length_km"), "gap_ids",
    )
