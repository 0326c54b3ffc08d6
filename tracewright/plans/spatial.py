"""Linear-referencing, distance and evidence-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import point_segment_distance
from ..operators import linear as LR
from ..operators import spatial as S
from ..operators import store as ST
from .tables import POINTS_SQL, SERIES_SQL, points, series, table

BAND = "case when abs({0}) <= 3 then 'gentle' when abs({0}) <= 5 then 'noticeable' when abs({0}) <= 8 then 'steep' when abs({0}) <= 12.5 then 'very-steep' when {0} is not null then 'severe' end"
GRADIENTS_SQL = f"""{SERIES_SQL}, pairs as (select line_id, lag(at_m) over w as start_m, at_m as end_m, height_mm - lag(height_mm) over w as rise_mm from series window w as (partition by line_id order by at_m)),
    grads as (select *, end_m - start_m as length_m, cast(rise_mm as double) / ((end_m - start_m) * 10) as gradient_pct,
        case when rise_mm > 0 then 'forward' when rise_mm < 0 then 'reverse' else 'level' end as direction from pairs where start_m is not null),
    g as (select *, {BAND.format('gradient_pct')} as band from grads)"""


def pairwise_gradient(spark, sf_dir):
    return LR.gradients(series(spark, sf_dir)).select("line_id", "start_m", "end_m", F.round("gradient_pct", 6).alias("gradient_pct"), "band", "direction")


PAIRWISE = f"with {GRADIENTS_SQL} select line_id, start_m, end_m, round(gradient_pct, 6) as gradient_pct, band, direction from g"


def elevation_profile(spark, sf_dir):
    return LR.profile(LR.gradients(series(spark, sf_dir))).withColumn("steepest_pct", F.round("steepest_pct", 6))


PROFILE = f"""with {GRADIENTS_SQL} select line_id, cast(sum(greatest(rise_mm, 0)) as bigint) as ascent_mm, cast(sum(greatest(-rise_mm, 0)) as bigint) as descent_mm,
    round(max(abs(gradient_pct)), 6) as steepest_pct, cast(sum(length_m) as bigint) as length_m from g group by line_id"""


def gradient_islands(spark, sf_dir):
    rows = LR.merge_sections(LR.gradients(series(spark, sf_dir)))
    return rows.select("line_id", "band", "direction", "start_m", "end_m", "length_m", F.round("gradient_pct", 6).alias("gradient_pct"), F.round("steepest_pct", 6).alias("steepest_pct"), "n_sections")


ISLANDS = f"""with {GRADIENTS_SQL}, marked as (select *, case when lag(band) over w is not distinct from band and lag(direction) over w is not distinct from direction and lag(start_m) over w is not null then 0 else 1 end as b
        from g window w as (partition by line_id order by start_m)),
    numbered as (select *, sum(b) over (partition by line_id order by start_m) as island from marked)
    select line_id, band, direction, min(start_m) as start_m, max(end_m) as end_m, cast(sum(length_m) as bigint) as length_m, round(cast(sum(rise_mm) as double) / (sum(length_m) * 10), 6) as gradient_pct,
        round(max(abs(gradient_pct)), 6) as steepest_pct, count(*) as n_sections from numbered group by line_id, island, band, direction"""


def rolling_gradient(spark, sf_dir):
    dense = series(spark, sf_dir).withColumn("at_m", F.col("at_m") * 1.5)
    rows = LR.rolling_gradients(dense, max_spacing_m=20.0)
    return rows.select("line_id", F.col("window_m").cast("long").alias("window_m"), "start_m", "end_m", F.round("gradient_pct", 6).alias("gradient_pct"), "band")


_INTERPOLATED = """case when r.at_m is null then l.height_mm when l.at_m is null then r.height_mm when l.at_m >= r.at_m then l.height_mm
    else l.height_mm + (r.height_mm - l.height_mm) * ((t.target_m - l.at_m) / (r.at_m - l.at_m)) end"""
ROLLING = f"""with {SERIES_SQL}, dense as (select line_id, cast(at_m as double) * 1.5 as at_m, cast(height_mm as double) as height_mm from series),
    ends as (select line_id, cast(max(at_m) as bigint) as e from dense group by line_id), windows(w) as (values (20), (50)),
    starts as (select line_id, cast(w as bigint) as window_m, unnest(generate_series(0, e - w, 10)) as start_m from ends, windows where e >= w),
    places as (select distinct line_id, cast(target_m as double) as target_m from (select line_id, start_m as target_m from starts union all select line_id, start_m + window_m from starts)),
    t2 as (select t.line_id, t.target_m, {_INTERPOLATED} as height from places t
        left join lateral (select at_m, height_mm from dense d where d.line_id = t.line_id and d.at_m <= t.target_m order by at_m desc limit 1) l on true
        left join lateral (select at_m, height_mm from dense d where d.line_id = t.line_id and d.at_m >= t.target_m order by at_m limit 1) r on true),
    p as (select s.line_id, window_m, start_m, start_m + window_m as end_m, (b.height - a.height) / (window_m * 10) as pct from starts s
        join t2 a on a.line_id = s.line_id and a.target_m = start_m join t2 b on b.line_id = s.line_id and b.target_m = start_m + window_m)
    select line_id, window_m, start_m, end_m, round(pct, 6) as gradient_pct, {BAND.format('pct')} as band from p"""


def interpolate_series(spark, sf_dir):
    s = series(spark, sf_dir)
    ends = s.groupBy("line_id").agg(F.max("at_m").alias("e"))
    targets = ends.select("line_id", F.explode(F.sequence(F.lit(-5).cast("long"), F.col("e") + 7, F.lit(7).cast("long"))).alias("target_m"))
    return LR.interpolate(s, targets).withColumn("height_mm", F.round("height_mm", 3))


INTERPOLATE = f"""with {SERIES_SQL}, d as (select line_id, cast(at_m as double) as at_m, cast(height_mm as double) as height_mm from series),
    t as (select line_id, cast(unnest(generate_series(-5, max(at_m) + 7, 7)) as double) as target_m from series group by line_id)
    select t.line_id, t.target_m, round({_INTERPOLATED}, 3) as height_mm from t
        left join lateral (select at_m, height_mm from d where d.line_id = t.line_id and d.at_m <= t.target_m order by at_m desc limit 1) l on true
        left join lateral (select at_m, height_mm from d where d.line_id = t.line_id and d.at_m >= t.target_m order by at_m limit 1) r on true"""


def scope_fill(spark, sf_dir):
    s = series(spark, sf_dir)
    lines = s.groupBy("line_id").agg(F.max("at_m").alias("length_m"))
    spans = s.where("event_type = 'purchase'").select("line_id", F.col("at_m").alias("start_m"), (F.col("at_m") + 10).alias("end_m"), F.lit("urban").alias("scope"))
    spans = spans.join(lines, "line_id").where("end_m <= length_m").drop("length_m")
    return LR.fill_scopes(lines, spans, "rural")


SCOPE_FILL = f"""with {SERIES_SQL}, lines as (select line_id, max(at_m) as length_m from series group by line_id),
    spans as (select line_id, at_m as start_m, at_m + 10 as end_m from series join lines using (line_id) where event_type = 'purchase' and at_m + 10 <= length_m),
    walk as (select line_id, start_m, end_m, coalesce(lag(end_m) over (partition by line_id order by start_m), 0) as prev from spans),
    tail as (select line_id, coalesce(max(end_m), 0) as start_m, length_m as end_m from lines left join spans using (line_id) group by line_id, length_m)
    select line_id, start_m, end_m, 'urban' as scope from spans union all select line_id, prev, start_m, 'rural' from walk where prev < start_m union all select line_id, start_m, end_m, 'rural' from tail where start_m < end_m"""


def interval_merge(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", day.alias("start_at"), (day + 30 + F.col("o_orderkey") % 30).alias("end_at"))
    return LR.merge_intervals(rows, ["o_custkey"])


INTERVALS = """with i as (select o_custkey, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as bigint) as start_at, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) + 30 + o_orderkey % 30 as bigint) as end_at from orders),
    m as (select *, case when start_at <= max(end_at) over (partition by o_custkey order by start_at, end_at rows between unbounded preceding and 1 preceding) then 0 else 1 end as b from i),
    n as (select *, sum(b) over (partition by o_custkey order by start_at, end_at rows unbounded preceding) as island from m)
    select o_custkey, min(start_at) as start_at, max(end_at) as end_at, count(*) as n_merged from n group by o_custkey, island"""


def sustained_samples(spark, sf_dir):
    return LR.sustained(series(spark, sf_dir), 35.0)


def near_duplicate_collapse(spark, sf_dir):
    s = series(spark, sf_dir)
    close = s.select("line_id", (F.col("at_m") + F.col("event_id") % 3 * 4.8).alias("at_m"), "height_mm")
    return LR.collapse(close, 100.0)


def _options(spark, sf_dir):
    return points(spark, sf_dir).groupBy("label").agg(F.floor(F.avg("x")).cast("long").alias("x"), F.floor(F.avg("y")).cast("long").alias("y")).withColumnRenamed("label", "option_id")


OPTIONS_SQL = f"{POINTS_SQL}, opts as (select label as option_id, cast(floor(avg(x)) as bigint) as x, cast(floor(avg(y)) as bigint) as y from pts group by label)"
RADII = (600.0, 1200.0)
RECORDS_SQL = f"""{OPTIONS_SQL}, radii(radius) as (values (600.0::double), (1200.0::double)),
    dist as (select option_id, vec_id as oa_id, residents, p.x > 0 as inside, sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) as distance from pts p cross join opts o),
    recs as (select *, distance <= radius as captured, abs(distance - radius) <= 50 as borderline from dist cross join radii)"""


def _records(spark, sf_dir):
    areas = points(spark, sf_dir).select(F.col("vec_id").alias("oa_id"), "residents", "x", "y")
    return S.reach_records(_options(spark, sf_dir), areas, RADII, 50.0, F.col("x") > 0)


def _reach(spark, sf_dir):
    return _options(spark, sf_dir), points(spark, sf_dir).select(F.col("vec_id").alias("oa_id"), "residents", "x", "y"), RADII, F.col("x") > 0


def population_reach(spark, sf_dir):
    return _records(spark, sf_dir).withColumn("distance", F.round("distance", 4))


REACH = f"with {RECORDS_SQL} select option_id, radius, oa_id, residents, inside, round(distance, 4) as distance, captured, borderline from recs"


def population_summary(spark, sf_dir):
    return S.reach_totals(*_reach(spark, sf_dir))


SUMMARY_SQL = f"""{RECORDS_SQL}, own as (select radius, oa_id, count(distinct option_id) as owners from recs where captured group by radius, oa_id),
    summary as (select option_id, radius, cast(coalesce(sum(residents) filter (where captured), 0) as bigint) as total_residents, cast(coalesce(sum(residents) filter (where captured and inside), 0) as bigint) as inside_residents,
        cast(coalesce(sum(residents) filter (where captured and not inside), 0) as bigint) as outside_residents, cast(coalesce(sum(residents) filter (where captured and owners > 1), 0) as bigint) as shared_residents,
        cast(coalesce(sum(residents) filter (where captured and owners = 1), 0) as bigint) as exclusive_residents, count(*) filter (where captured) as n_captured
        from recs left join own using (radius, oa_id) group by option_id, radius)"""


def population_sensitivity(spark, sf_dir):
    return S.reach_sensitivity(S.reach_totals(*_reach(spark, sf_dir)), 40.0, 5.0)


POPULATION_SENSITIVITY = f"""with {SUMMARY_SQL}, r as (select *, row_number() over w as place, lead(total_residents) over w as nxt from summary window w as (partition by radius order by total_residents desc, option_id)),
    t as (select radius, max(option_id) filter (where place = 1) as winner, max(total_residents - nxt) filter (where place = 1) as margin, max(total_residents) filter (where place = 1) as best, string_agg(cast(option_id as varchar), ',' order by place) as ranking from r group by radius)
    select radius, winner, margin, margin <= greatest(40.0, best * 5.0 / 100) as near_equivalent, ranking <> (select arg_min(ranking, radius) from t) as order_differs, ranking from t"""


def _sections(spark, sf_dir):
    """Sections of straight lines from each option, 1,450 m to the east and 400 m to the north, urban for even options."""
    o = _options(spark, sf_dir).select(F.col("option_id").alias("line_id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    scope = F.when(F.col("line_id") % 2 == 0, "urban").otherwise("rural")
    parts = LR.sections(o.select("line_id", F.lit(0).alias("start_m"), F.lit(450).alias("end_m"), F.lit("rural").alias("scope")).union(o.select("line_id", F.lit(450), F.lit(1450), scope)))
    at = lambda m, c, d: F.col(c) + F.col(m) * d / 1450.0
    parts = parts.join(o, "line_id").select(parts["line_id"], "section", "start_m", "end_m", "scope", *[at(m, c, d).alias(f"{n}{i}") for i, m in ((1, "start_m"), (2, "end_m")) for n, c, d in (("x", "x0", 1450.0), ("y", "y0", 400.0))])
    parts = parts.withColumn("radius", F.when(F.col("scope") == "urban", 250.0).otherwise(750.0)).withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    # Whatever is within 750 m of a section is within 900 m of its middle.
    pairs = S.within(parts, points(spark, sf_dir).select("vec_id", "residents", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), 900.0)
    d = point_segment_distance(F.col("near_x"), F.col("near_y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    hits = pairs.where(d <= F.col("radius")).groupBy("line_id", "section").agg(F.sum("near_residents").alias("residents"), F.count("*").alias("n_areas"))
    zero = F.lit(0).cast("long")
    return parts.join(hits, ["line_id", "section"], "left").select("line_id", "section", "start_m", "end_m", "scope", "radius", F.coalesce("residents", zero).alias("residents"), F.coalesce("n_areas", zero).alias("n_areas"))


def section_population(spark, sf_dir):
    return _sections(spark, sf_dir)


SECTIONS_SQL = f"""{OPTIONS_SQL}, ranges as (select option_id as line_id, x as x0, y as y0, 0 as a, 450 as b, 'rural' as scope from opts union all select option_id, x, y, 450, 1450, case when option_id % 2 = 0 then 'urban' else 'rural' end from opts),
    cutting as (select *, unnest(generate_series(a, b - 1, 100)) as start_m from ranges),
    sec as (select line_id, cast(row_number() over (partition by line_id order by start_m) - 1 as bigint) as section, cast(start_m as bigint) as start_m, cast(least(start_m + 100, b) as bigint) as end_m, scope, case when scope = 'urban' then 250.0::double else 750.0::double end as radius,
        x0 + start_m * 1450.0::double / 1450.0::double as x1, y0 + start_m * 400.0::double / 1450.0::double as y1, x0 + least(start_m + 100, b) * 1450.0::double / 1450.0::double as x2, y0 + least(start_m + 100, b) * 400.0::double / 1450.0::double as y2 from cutting),
    near as (select s.line_id, s.section, s.radius, residents, greatest(0.0::double, least(1.0::double, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t, p.x as px, p.y as py, x1, y1, x2, y2 from sec s cross join pts p),
    hits as (select line_id, section, cast(sum(residents) as bigint) as residents, count(*) as n_areas from near where sqrt(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2)) <= radius group by line_id, section),
    secpop as (select line_id, section, start_m, end_m, scope, radius, coalesce(residents, 0) as residents, coalesce(n_areas, 0) as n_areas from sec left join hits using (line_id, section))"""


def material_runs(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    ids = _options(spark, sf_dir).select("option_id")
    pairs = ids.select(F.col("option_id").alias("line_id"), (F.col("option_id") + 1).alias("other_id")).join(ids.withColumnRenamed("option_id", "other_id"), "other_id").select("line_id", "other_id")
    runs = LR.material_runs(sections, pairs, 200, 2.0, 200.0)
    return runs.withColumn("min_relative", F.round("min_relative", 6))


MATERIAL = f"""with {SECTIONS_SQL}, mid as (select *, (start_m + end_m) / 2.0 / max(end_m) over (partition by line_id) as m from secpop),
    paired as (select a.line_id, b.line_id as other_id, a.section, a.start_m, a.end_m, a.residents, b.residents as compared, row_number() over (partition by a.line_id, a.section order by abs(a.m - b.m), b.section) as n from mid a join mid b on b.line_id = a.line_id + 1),
    gains as (select *, residents - compared as gain, case when compared > 0 then (residents - compared) * 100.0::double / compared when residents > 0 then 1e6 else 0.0 end as relative from paired where n = 1),
    flagged as (select *, gain >= 200 and relative >= 2 as material from gains),
    marked as (select *, case when lag(material) over w = material and abs(start_m - lag(end_m) over w) <= 0.001 then 0 else 1 end as b from flagged window w as (partition by line_id order by start_m)),
    numbered as (select *, sum(b) over (partition by line_id order by start_m) as island from marked)
    select line_id, other_id, min(start_m) as start_m, max(end_m) as end_m, cast(sum(end_m - start_m) as bigint) as length_m, min(gain) as min_gain, round(min(relative), 6) as min_relative, count(*) as n_sections
    from numbered where material group by line_id, other_id, island having sum(end_m - start_m) + 1e-9 >= 200"""


def catchments(spark, sf_dir):
    centres = _options(spark, sf_dir).withColumnRenamed("option_id", "centre_id")
    return S.catchments(centres, points(spark, sf_dir).select("x", "y", "residents"), 900.0)


CATCHMENTS = f"""with {OPTIONS_SQL}, c as (select option_id, sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) <= 900 as hit, residents from opts o cross join pts p)
    select option_id as centre_id, count(*) filter (where hit) as n_inside, count(*) filter (where not hit) as n_outside, cast(coalesce(sum(residents) filter (where hit), 0) as bigint) as inside_residents from c group by option_id"""


def match_disposition(spark, sf_dir):
    p = points(spark, sf_dir)
    side = lambda k: p.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias("id"), "x", "y")
    return S.match_disposition(side(0), side(1), 120.0).withColumn("distance", F.round("distance", 4))


DISPOSITION = f"""with {POINTS_SQL}, d as (select s.vec_id as id, t.vec_id as target_id, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) as distance from pts s join pts t on s.vec_id % 2 = 0 and t.vec_id % 2 = 1),
    r as (select *, count(*) filter (where distance <= 120) over (partition by id) as n, row_number() over (partition by id order by distance, target_id) as k from d)
    select id, target_id, round(distance, 4) as distance, case when n = 1 then 'accepted' when n > 1 then 'ambiguous' else 'unmatched' end as state from r where (n > 0 and distance <= 120) or (n = 0 and k = 1)"""


def _features(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(F.col("vec_id").alias("feature_id"), F.col("x").alias("min_x"), F.col("y").alias("min_y"), (F.col("x") + F.col("vec_id") % 7 * 400).alias("max_x"), (F.col("y") + F.col("vec_id") % 3 * 600).alias("max_y"), "label")


FEATURES_SQL = f"""{POINTS_SQL}, feats as (select vec_id as feature_id, x as min_x, y as min_y, x + vec_id % 7 * 400 as max_x, y + vec_id % 3 * 600 as max_y, label from pts),
    touched as (select feature_id, min_x, min_y, max_x, max_y, label, cell_x, unnest(generate_series(cast(floor(min_y / 1000.0) as bigint), cast(floor(max_y / 1000.0) as bigint))) as cell_y
        from (select *, unnest(generate_series(cast(floor(min_x / 1000.0) as bigint), cast(floor(max_x / 1000.0) as bigint))) as cell_x from feats)),
    own as (select feature_id, min(row(cell_x, cell_y)) as o from touched group by feature_id),
    owned as (select feature_id, o[1] as cell_x, o[2] as cell_y from own)"""


def store_query(spark, sf_dir):
    rows = ST.cells(_features(spark, sf_dir), 1000.0)
    return ST.query(rows, (-800.0, -600.0, 1500.0, 900.0), "intersects", {"label": 3}, ["min_x", "min_y", "label"])


STORE = f"with {FEATURES_SQL} select feature_id, label, min_x, min_y from feats where label = 3 and max_x >= -800 and min_x <= 1500 and max_y >= -600 and min_y <= 900"


def availability_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "no-data").when(F.col("toxic") == 1, "explicit-unknown").otherwise("available")
    return ST.availability(rows.withColumn("availability", state), ["source", "lang"])


AVAILABILITY = """select source, lang, count(*) filter (where quality is not null and toxic <> 1) as n_available, count(*) filter (where quality is null) as n_no_data, count(*) filter (where toxic = 1) as n_explicit_unknown
    from documents left join labels using (doc_id) group by source, lang"""


def feature_owner(spark, sf_dir):
    return ST.owners(_features(spark, sf_dir), 1000.0)


OWNER = f"with {FEATURES_SQL} select feature_id, cell_x, cell_y from owned"


def cell_footprint(spark, sf_dir):
    return ST.cells(_features(spark, sf_dir), 1000.0).select("feature_id", "cell_x", "cell_y")


FOOTPRINT = f"with {FEATURES_SQL} select feature_id, cell_x, cell_y from touched"


def halo_refs(spark, sf_dir):
    return ST.halo_references(_features(spark, sf_dir), 1000.0)


HALO = f"""with {FEATURES_SQL}, core as (select distinct cell_x, cell_y from owned), steps(d) as (values (-1), (0), (1)),
    spread as (select distinct feature_id, cell_x + a.d as cell_x, cell_y + b.d as cell_y from touched cross join steps a cross join steps b)
    select s.cell_x, s.cell_y, s.feature_id from spread s join core c on c.cell_x = s.cell_x and c.cell_y = s.cell_y
    where not exists (select 1 from owned o where o.feature_id = s.feature_id and o.cell_x = s.cell_x and o.cell_y = s.cell_y)"""


def partition_stitch(spark, sf_dir):
    rows = ST.cells(_features(spark, sf_dir), 1000.0).select("feature_id", F.struct("cell_x", "cell_y").alias("partition"), F.when((F.col("feature_id") % 11 == 0) & (F.col("cell_x") > 0), "altered").otherwise("same").alias("content"))
    out = ST.stitch(rows, "feature_id", "content", "partition")
    return out.select("feature_id", F.col("owner.cell_x").alias("owner_x"), F.col("owner.cell_y").alias("owner_y"), "n_copies", "n_contents", "state")


STITCH = f"""with {FEATURES_SQL}, c as (select feature_id, row(cell_x, cell_y) as p, case when feature_id % 11 = 0 and cell_x > 0 then 'altered' else 'same' end as content from touched),
    s as (select feature_id, min(p) as o, count(*) as n_copies, count(distinct content) as n_contents from c group by feature_id)
    select feature_id, o[1] as owner_x, o[2] as owner_y, n_copies, n_contents, case when n_contents > 1 then 'conflict' else 'stitched' end as state from s"""


def refresh_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ST.refresh_plan(o.where("o_orderkey % 6 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("f")), o.where("o_orderkey % 6 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 2, "new").otherwise(F.col("o_orderstatus")).alias("f")), "o_orderkey", "f")


REFRESH = "select o_orderkey, case o_orderkey % 6 when 0 then 'missing' when 1 then 'retained' when 2 then 'replaced' else 'reused' end as action from orders"


def coverage_missing(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return ST.missing(table(spark, sf_dir, "part").select("p_partkey"), item.where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")))


MISSING = "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 40)"


def anti_duplicate_append(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ST.append_new(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 3 <> 0 or c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


APPEND = "select c_custkey, c_name from customer where c_custkey % 3 = 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 3 <> 0"


def equivalence_proof(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ST.equivalent(c, c.where("c_custkey % 50 <> 0").union(c.where("c_custkey % 75 = 0")))


EQUIVALENCE = """select c_custkey, c_mktsegment, 'left' as side from customer where c_custkey % 50 = 0 and c_custkey % 75 <> 0
    union all select c_custkey, c_mktsegment, 'right' from customer where c_custkey % 75 = 0 and c_custkey % 50 <> 0"""


def site_source_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return ST.precedence(rows, ["site_id"], [rank, "l_orderkey", "l_linenumber"]).select("site_id", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")


SITE = """select l_partkey as site_id, l_returnflag, l_orderkey, l_linenumber, l_suppkey from lineitem
    qualify row_number() over (partition by l_partkey order by case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end, l_orderkey, l_linenumber) = 1"""

PLANS = {
    "pairwise_gradient": (pairwise_gradient, PAIRWISE),
    "elevation_profile": (elevation_profile, PROFILE),
    "gradient_islands": (gradient_islands, ISLANDS),
    "rolling_gradient": (rolling_gradient, ROLLING),
    "interpolate_series": (interpolate_series, INTERPOLATE),
    "scope_fill": (scope_fill, SCOPE_FILL),
    "interval_merge": (interval_merge, INTERVALS),
    "sustained_samples": (sustained_samples, None),
    "near_duplicate_collapse": (near_duplicate_collapse, None),
    "population_reach": (population_reach, REACH),
    "population_summary": (population_summary, f"with {SUMMARY_SQL} select * from summary"),
    "population_sensitivity": (population_sensitivity, POPULATION_SENSITIVITY),
    "section_population": (section_population, f"with {SECTIONS_SQL} select * from secpop"),
    "material_runs": (material_runs, MATERIAL),
    "catchments": (catchments, CATCHMENTS),
    "match_disposition": (match_disposition, DISPOSITION),
    "store_query": (store_query, STORE),
    "availability_counts": (availability_counts, AVAILABILITY),
    "feature_owner": (feature_owner, OWNER),
    "cell_footprint": (cell_footprint, FOOTPRINT),
    "halo_refs": (halo_refs, HALO),
    "partition_stitch": (partition_stitch, STITCH),
    "refresh_plan": (refresh_plan, REFRESH),
    "coverage_missing": (coverage_missing, MISSING),
    "anti_duplicate_append": (anti_duplicate_append, APPEND),
    "equivalence_proof": (equivalence_proof, EQUIVALENCE),
    "site_source_rank": (site_source_rank, SITE),
}
