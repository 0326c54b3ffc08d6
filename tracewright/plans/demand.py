"""Demand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import haversine_km, polyline_km
from ..operators import demand as D
from .tables import FLOWS_SQL, PLACES_SQL, flows, places

SCALES = (D.Scale("local", 0.0, 4000.0, 120.0, True), D.Scale("strategic", 2000.0, 14000.0, 400.0))
CASES = (D.Case("lower-trips", "local", 0.0, 4000.0, 60.0), D.Case("longer", "local", 0.0, 6000.0, 120.0), D.Case("strict", "strategic", 3000.0, 12000.0, 800.0))
_NAMES = ("scale", "minimum_km", "maximum_km", "minimum_trips", "protect")


def _values(rows) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"cast({v} as double)"
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
LINES_SQL = f"""{PLACES_SQL}, {FLOWS_SQL},
    scales({', '.join(_NAMES)}) as (values {_values(SCALES)}),
    grouped as (select scenario_id, origin_id, destination_id, unit, sum(trips) as trips, count(*) as n_flows from flows group by all),
    base as (select g.*, s.*, {HAVERSINE.format(a='o', b='d')} as km, o.equality or d.equality as equality
        from grouped g join points o on o.point_id = origin_id join points d on d.point_id = destination_id cross join scales s),
    flagged as (select *, protect and equality and trips < minimum_trips as override from base),
    lines as (select *, concat_ws('-', 'desire', scenario_id, scale, origin_id, destination_id) as desire_line_id,
        km >= minimum_km and km <= maximum_km and (trips >= minimum_trips or override) as retained from flagged)"""


def _lines(spark, sf_dir):
    return D.desire_lines(places(spark, sf_dir), flows(spark, sf_dir), SCALES)


def desire_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("desire_line_id", "scenario_id", "scale", "origin_id", "destination_id", "trips", "unit", F.round("km", 6).alias("distance_km"), "n_flows", "retained", "reason")


DESIRE_LINES = f"""with {LINES_SQL} select desire_line_id, scenario_id, scale, origin_id, destination_id, trips, unit, round(km, 6) as distance_km, n_flows, retained,
    case when not retained then 'filtered' when override then 'equality-access' else 'filters-passed' end as reason from lines"""


def desire_filter_outcomes(spark, sf_dir):
    return D.filter_outcomes(_lines(spark, sf_dir)).withColumn("observed_value", F.round("observed_value", 6))


OUTCOMES = f"""with {LINES_SQL}
    select desire_line_id, 'minimum-distance-km' as rule, minimum_km as configured_value, round(km, 6) as observed_value, km >= minimum_km as passed, false as overridden from lines
    union all select desire_line_id, 'maximum-distance-km', maximum_km, round(km, 6), km <= maximum_km, false from lines
    union all select desire_line_id, 'minimum-trips', minimum_trips, round(trips, 6), trips >= minimum_trips, override from lines"""


def desire_sensitivity(spark, sf_dir):
    return D.sensitivity(_lines(spark, sf_dir), CASES).withColumn("changed_ids", F.array_join("changed_ids", ","))


SENSITIVITY = f"""with {LINES_SQL}, cases(case_id, case_scale, low_km, high_km, low_trips) as (values {_values(CASES)}),
    held as (select case_id, case_scale as scale, desire_line_id, retained, round(km, 6) >= low_km and round(km, 6) <= high_km and (trips >= low_trips or (protect and equality)) as held
        from lines join cases on scale = case_scale)
    select case_id, scale, count(*) filter (where held) as n_retained, count(*) filter (where held <> retained) as n_changed,
        coalesce(string_agg(desire_line_id, ',' order by desire_line_id) filter (where held <> retained), '') as changed_ids from held group by case_id, scale"""


def network_density(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    selected = lines.where("n_flows >= 12").select("desire_line_id", (F.round("km", 6) * 1.25).alias("length_km"))
    return D.network_density(places(spark, sf_dir), lines, selected).withColumn("gap_ids", F.array_join("gap_ids", ","))


DENSITY = f"""with {LINES_SQL}, routes as (select *, case when n_flows >= 12 then round(km, 6) * 1.25 end as length_km from lines where retained),
    planned as (select distinct scenario_id, scale from lines),
    ends as (select scenario_id, scale, origin_id as point_id from routes where length_km is not null union select scenario_id, scale, destination_id from routes where length_km is not null),
    cover as (select b.scenario_id, b.scale, count(e.point_id) as covered_count, count(*) as total_count,
        coalesce(string_agg(p.point_id, ',' order by p.point_id) filter (where e.point_id is null), '') as gap_ids
        from planned b cross join points p left join ends e on e.scenario_id = b.scenario_id and e.scale = b.scale and e.point_id = p.point_id group by all),
    counts as (select scenario_id, scale, count(*) as retained_count, count(length_km) as preferred_count, round(coalesce(sum(length_km), 0), 6) as preferred_length_km from routes group by all)
    select concat_ws('-', 'density', c.scenario_id, c.scale) as density_id, c.scenario_id, c.scale, coalesce(retained_count, 0) as retained_count, coalesce(preferred_count, 0) as preferred_count,
        covered_count, total_count, round(covered_count / total_count, 6) as coverage_ratio, coalesce(preferred_length_km, 0.0) as preferred_length_km, gap_ids
    from cover c left join counts n on n.scenario_id = c.scenario_id and n.scale = c.scale"""


def haversine_pairs(spark, sf_dir):
    p = places(spark, sf_dir)
    a, b = (p.select(*[F.col(c).alias(f"{side}_{c}") for c in ("point_id", "lon", "lat")]) for side in "ab")
    km = haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return a.join(b, F.col("a_point_id") < F.col("b_point_id")).select("a_point_id", "b_point_id", F.round(km, 6).alias("km"))


HAVERSINE_PAIRS = f"""with {PLACES_SQL} select a.point_id as a_point_id, b.point_id as b_point_id, round({HAVERSINE.format(a='a', b='b')}, 6) as km
    from points a join points b on a.point_id < b.point_id"""


def polyline_length(spark, sf_dir):
    """Length of the path through a region's nations in order."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string("n%02d", "n_nationkey").alias("point_id"), "n_regionkey")
    rows = places(spark, sf_dir).join(nation, "point_id")
    lines = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("point_id", "lon", "lat"))).alias("points"))
    return lines.select("n_regionkey", F.size("points").cast("long").alias("n_points"), F.round(polyline_km(F.col("points")), 6).alias("length_km"))


POLYLINE = f"""with {PLACES_SQL}, p as (select n_regionkey, points.*, lead(lon) over w as lon2, lead(lat) over w as lat2
    from points join nation on printf('n%02d', n_nationkey) = point_id window w as (partition by n_regionkey order by point_id))
    select n_regionkey, count(*) as n_points, round(coalesce(sum(case when lon2 is not null then {HAVERSINE.format(a='a', b='b').replace('a.', '').replace('b.lat', 'lat2').replace('b.lon', 'lon2')} end), 0), 6) as length_km from p group by n_regionkey"""

PLANS = {
    "desire_lines": (desire_lines, DESIRE_LINES),
    "desire_filter_outcomes": (desire_filter_outcomes, OUTCOMES),
    "desire_sensitivity": (desire_sensitivity, SENSITIVITY),
    "network_density": (network_density, DENSITY),
    "haversine_pairs": (haversine_pairs, HAVERSINE_PAIRS),
    "polyline_length": (polyline_length, POLYLINE),
}
