"""Corridor obligations and bound observations over the driver's tables: suppliers of a region as a network, consecutive items of orders as demand between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import obligations as O
from ..operators import selection as C
from .tables import table

PERCENTILE, LIMIT_M, SEGMENT_M, NEAR_M, BUDGET, MOST = 90, 1500, 400, 200, 600, 60


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    nodes = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), "region")
    order = Window.partitionBy("region").orderBy("node")
    pairs = nodes.withColumn("ahead", F.array(*[F.lead("node", n).over(order) for n in (1, 3, 9)])).select("node", F.explode("ahead").alias("next")).where("next is not null")
    way = lambda a, b, least, step: pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), (least + F.col(a) * step % 400).cast("long").alias("weight"))
    return nodes, way("node", "next", 100, 37).union(way("next", "node", 120, 53))


def _demand(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("origin"), F.lead("l_suppkey").over(order).alias("destination")).where("destination is not null and origin <> destination")
    flows = steps.groupBy("origin", "destination").agg(F.count("*").alias("n"))
    both = F.col("origin") + F.col("destination")
    state = F.when(both % 17 == 0, "unmatched").when(both % 19 == 0, "conflicting").when(both % 23 == 0, "unknown").otherwise("evidenced")
    return flows.select(F.format_string("%06d-%06d", "origin", "destination").alias("flow_id"), "origin", "destination", F.when(F.col("origin") * F.col("destination") % 29 > 0, F.col("n")).alias("value"), state.alias("state"))


def _derived(spark, sf_dir) -> O.Obligations:
    nodes, edges = _network(spark, sf_dir)
    turn = F.floor(F.col("node") / 4)
    endpoints = nodes.where("node % 4 = 0 and region <> 4").select(
        F.format_string("s%04d", "node").alias("endpoint_id"), F.when(turn % 4 == 0, "destination").when(turn % 4 == 1, "gateway").otherwise("place").alias("kind"), F.when(turn % 4 == 2, "town").otherwise("village").alias("category"), "node"
    )
    return O.derive(
        _demand(spark, sf_dir), nodes.select("node"), edges, endpoints, PERCENTILE, True, LIMIT_M, segment_length=SEGMENT_M, epsilon=NEAR_M, budget=BUDGET, max_obligations=MOST,
        hierarchy=[("town", "village")], gateways=["gateway-destination"],
    )


OBLIGATIONS_SQL = f"""s as (select s_suppkey as node, n_regionkey as region, row_number() over (partition by n_regionkey order by s_suppkey) as place from supplier join nation on s_nationkey = n_nationkey),
    links as (select a.node as a, b.node as b from s a join s b on a.region = b.region and b.place - a.place in (1, 3, 9)),
    e as (select a as src, b as dst, 100 + a * 37 % 400 as weight from links union all select b, a, 120 + b * 53 % 400 from links),
    walk(root, node, cost) using key (root, node) as (select node, node, 0::bigint from s
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst),
    ep as (select node, printf('s%04d', node) as endpoint_id, case (node // 4) % 4 when 0 then 'destination' when 1 then 'gateway' else 'place' end as kind, (node // 4) % 4 = 2 as town from s where node % 4 = 0 and region <> 4),
    anchored as (select distinct region from s join ep using (node)),
    steps as (select l_suppkey as o, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_suppkey) as d from lineitem),
    flows as (select o, d, printf('%06d-%06d', o, d) as flow_id, case when o * d % 29 > 0 then count(*) end as value, case when (o + d) % 17 = 0 then 'unmatched' when (o + d) % 19 = 0 then 'conflicting' when (o + d) % 23 = 0 then 'unknown-demand' end as state
        from steps where d is not null and o <> d group by o, d),
    bar as (select quantile_cont(value, {PERCENTILE / 100}) as bar from flows where state is null),
    early as (select f.*, case when state is not null then state when value is null then 'missing-value' when value < bar then 'below-threshold'
        when (a.region = b.region and a.region not in (from anchored)) or (a.region <> b.region and (a.region not in (from anchored) or b.region not in (from anchored))) then 'disconnected-island' end as early
        from flows f, bar join s a on a.node = o join s b on b.node = d),
    routed as (select flow_id from early where early is null order by flow_id limit {BUDGET}),
    told as (select flow_id, o, d, value, case when f.flow_id in (from routed) then cost end as distance, case when early is not null then early when f.flow_id not in (from routed) then 'budget-exceeded' when cost is null then 'failed-path' when cost > {LIMIT_M} then 'over-distance' else 'eligible' end as disposition
        from early f left join walk on root = o and node = d),
    seeds as (select *, flow_id || '#' || printf('%03d', segment) as seed_id from (select *, unnest(range(case when disposition = 'eligible' then least(3, greatest(1, cast(ceil(distance / {SEGMENT_M}) as bigint))) else 1 end)) as segment from told)),
    od as (select o, d, min(seed_id) as od, count(*) as weight from seeds where disposition = 'eligible' group by o, d),
    fwd as (select a.od as a, b.od as b, (x.cost + y.cost) / 2 as apart from od a join od b on true join walk x on x.root = a.o and x.node = b.o and x.cost <= {LIMIT_M} join walk y on y.root = a.d and y.node = b.d and y.cost <= {LIMIT_M}),
    dist as (select a, b, min(apart) as apart from (select * from fwd union all select b, a, apart from fwd) group by a, b),
    core as (select a as od from dist join od on od = b where apart <= {NEAR_M} group by a having sum(weight) >= 2),
    inner_links as (select a, b from dist where apart <= {NEAR_M} and a in (from core) and b in (from core)),
    grow(od, seen) as (select od, od from core union select b, seen from grow join inner_links on a = od),
    named as (select od, o, d, weight, coalesce(seen, od) as cluster from od left join (select od, min(seen) as seen from grow group by od) using (od)),
    sums as (select p.cluster, p.od, case when count(apart) = count(*) then sum(q.weight * apart) else 'inf'::double end as total from named p join named q using (cluster) left join dist on a = p.od and b = q.od group by p.cluster, p.od),
    medoids as (select cluster, arg_min(od, row(total, od)) as od from sums group by cluster),
    out as (select seed_id, flow_id, s.o, s.d, value, segment, s.disposition, distance, cluster, seed_id in (select od from medoids) as medoid from seeds s left join named n on n.o = s.o and n.d = s.d and disposition = 'eligible'),
    called as (select 0 as stage, coalesce(a.endpoint_id, 'node:' || o) as oe, coalesce(b.endpoint_id, 'node:' || d) as de, seed_id as source, 'demand-led' as basis, disposition, distance, medoid from out left join ep a on a.node = o left join ep b on b.node = d
        where medoid or disposition in ('below-threshold', 'failed-path', 'over-distance', 'disconnected-island')),
    rules as (select 1 as stage, a.endpoint_id as oe, b.endpoint_id as de, 'place-hierarchy' as basis, a.node as o, b.node as d from ep a join ep b on a.kind = 'place' and b.kind = 'place' and a.town and not b.town where exists (select 1 from out where medoid)
        union all select 2, a.endpoint_id, b.endpoint_id, 'gateway-rule', a.node, b.node from ep a join ep b on a.kind = 'gateway' and b.kind = 'destination'),
    chosen as (select * from called union all select stage, oe, de, null, basis, case when cost is null then 'failed-path' when cost > {LIMIT_M} then 'over-distance' else 'eligible' end, cost, true from rules left join walk on root = o and node = d),
    turned as (select *, case when medoid then row_number() over (partition by oe, de, medoid order by stage, source) end as turn from chosen)"""


def corridor_seeds(spark, sf_dir):
    """Seeds of all flows with their dispositions, clusters and medoids."""
    seeds = _derived(spark, sf_dir).seeds
    return seeds.select("seed_id", "flow_id", "origin", "destination", "value", F.col("segment").cast("long").alias("segment"), "disposition", "distance", F.col("end").cast("long").alias("end_m"), "cluster", "medoid")


SEEDS = f"""with recursive {OBLIGATIONS_SQL} select seed_id, flow_id, o as origin, d as destination, value, segment, disposition, distance,
    case when disposition = 'eligible' then least(distance, (segment + 1) * {SEGMENT_M}) end as end_m, cluster, medoid from out"""


def corridor_pairs(spark, sf_dir):
    """Every pair of endpoints that was looked at, by demand or by rule, and what became of it."""
    return _derived(spark, sf_dir).pairs


PAIRS = f"""with recursive {OBLIGATIONS_SQL} select oe as origin_endpoint, de as destination_endpoint, source, basis, case when turn > 1 then 'duplicate' else disposition end as disposition, distance from turned"""


def corridor_obligations(spark, sf_dir):
    """The first of each pair of endpoints, as many as the profile allows."""
    return _derived(spark, sf_dir).obligations


OWED = f"""with recursive {OBLIGATIONS_SQL} select oe || '>' || de as obligation_id, oe as origin_endpoint, de as destination_endpoint, source, basis, disposition, distance from turned where turn = 1 order by obligation_id limit {MOST}"""


def fallback_route(spark, sf_dir):
    """Parts of a brand and size class as routes: preferred, else of the largest size, else of the best price class."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey") % 7).alias("component"), "p_partkey", (F.col("p_partkey") % 40 == 0).alias("preferred"), F.when(F.col("p_size") > 3, F.floor(F.col("p_size") / 10)).alias("population"), F.floor(F.col("p_retailprice") / 100).alias("quality"))
    return C.fallback_route(rows, "component", ["preferred", "population", "quality"], "p_partkey")


FALLBACK = """with r as (select p_brand || '/' || (p_partkey % 7) as component, p_partkey, p_partkey % 40 = 0 as preferred, case when p_size > 3 then p_size // 10 end as population, floor(p_retailprice / 100) as quality from part),
    a as (select *, rank() over (partition by component order by preferred desc) as x, rank() over (partition by component order by preferred desc, population desc nulls last) as y,
        rank() over (partition by component order by preferred desc, population desc nulls last, quality desc) as z from r)
    select component, min(p_partkey) filter (where z = 1) as route_id, count(*) as n_routes, case when count(*) filter (where x = 1) = 1 then 'preferred' when count(*) filter (where y = 1) = 1 then 'population' when count(*) filter (where z = 1) = 1 then 'quality' else 'route-id' end as decided_by from a group by component"""


def observation_binding(spark, sf_dir):
    """Events as observations of streets between suppliers; some name no street, some lack a claim."""
    _, edges = _network(spark, sf_dir)
    streets = edges.select(F.concat_ws(">", "src", "dst").alias("edge_id"), F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst")).alias("source_id"))
    first = F.col("event_id") % 97 + 1
    seen = table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("-", first, first + F.col("event_id") % 11 + 1).alias("subject_id"), F.when(F.col("event_id") % 31 > 0, F.col("event_type")).alias("claim"), F.lit("observed").alias("state"), F.when(F.col("event_id") % 2 == 0, "asset").otherwise("road").alias("source_kind")
    ).withColumnRenamed("event_id", "observation_id")
    rows = C.bind_observations(seen, streets)
    return rows.select("observation_id", "subject_id", "claim", "source_kind", F.array_join("edge_ids", ",").alias("edge_ids"), "result")


BINDING = """with s as (select s_suppkey as node, n_regionkey as region, row_number() over (partition by n_regionkey order by s_suppkey) as place from supplier join nation on s_nationkey = n_nationkey),
    links as (select a.node as a, b.node as b from s a join s b on a.region = b.region and b.place - a.place in (1, 3, 9)),
    k as (select a || '-' || b as subject_id, case when a || '>' || b < b || '>' || a then a || '>' || b || ',' || b || '>' || a else b || '>' || a || ',' || a || '>' || b end as edge_ids from links),
    o as (select event_id, (event_id % 97 + 1) || '-' || (event_id % 97 + 1 + event_id % 11 + 1) as subject_id, case when event_id % 31 > 0 then event_type end as claim, case when event_id % 2 = 0 then 'asset' else 'road' end as source_kind from events)
    select event_id as observation_id, o.subject_id, claim, source_kind, case when claim is not null then edge_ids end as edge_ids, case when claim is null then 'invalid-observation' when edge_ids is null then 'unmatched-observation' else 'bound' end as result from o left join k using (subject_id)"""

PLANS = {
    "corridor_seeds": (corridor_seeds, SEEDS),
    "corridor_pairs": (corridor_pairs, PAIRS),
    "corridor_obligations": (corridor_obligations, OWED),
    "fallback_route": (fallback_route, FALLBACK),
    "observation_binding": (observation_binding, BINDING),
}
