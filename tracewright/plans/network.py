"""Graph, selection, traffic and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.bands import ROLE_FACTORS, first_true, role_weight
from ..operators import graph as G
from ..operators import selection as C
from ..operators import spatial as S
from .demand import _lines as desire
from .demand import LINES_SQL
from .spatial import FEATURES_SQL, _features
from .tables import POINTS_SQL, TRANSITIONS_SQL, points, table, transitions

LINK = 90.0
NEAR_SQL = f"""{POINTS_SQL}, links as (select a.vec_id as src, b.vec_id as dst from pts a join pts b on a.vec_id <> b.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {LINK})"""


def _near(spark, sf_dir):
    """Points at most 90 m apart as an undirected graph, both directions listed."""
    p = points(spark, sf_dir).select(F.col("vec_id").alias("node"), "x", "y")
    return p.select("node"), S.within(p, p, LINK).where("node <> near_node").select(F.col("node").alias("src"), F.col("near_node").alias("dst"))


def components_weak(spark, sf_dir):
    return G.components(*_near(spark, sf_dir))


WEAK = f"""with recursive {NEAR_SQL}, walk(node, seen) as (select vec_id, vec_id from pts union select dst, seen from walk join links on src = node)
    select node, min(seen) as component from walk group by node"""


def dangles_isolated(spark, sf_dir):
    return G.degrees(*_near(spark, sf_dir))


DANGLES = f"""with {NEAR_SQL}, d as (select vec_id as node, count(distinct dst) as degree from pts left join links on src = vec_id group by vec_id)
    select node, degree, case degree when 0 then 'isolated' when 1 then 'dangle' when 2 then 'through' else 'junction' end as kind from d"""


def reciprocal_edges(spark, sf_dir):
    return G.reciprocity(transitions(spark, sf_dir).select("src", "dst", "n"))


RECIPROCAL = f"""with {TRANSITIONS_SQL}, e as (select * from edges)
    select src, dst, n, case when exists (select 1 from e r where r.src = e.dst and r.dst = e.src) then 'reciprocal' else 'one-way' end as state from e"""


def reach_hops(spark, sf_dir):
    nodes, edges = _near(spark, sf_dir)
    return G.reach(nodes.where("node % 25 = 0"), edges, 3).withColumn("hops", F.col("hops").cast("long"))


REACH = f"""with recursive {NEAR_SQL}, walk(node, hops) as (select vec_id, 0 from pts where vec_id % 25 = 0 union select dst, hops + 1 from walk join links on src = node where hops < 3)
    select node, cast(min(hops) as bigint) as hops from walk group by node"""


def community_chain(spark, sf_dir):
    """Communities that attach, step by step, to served ones; how many steps away each is."""
    nodes = points(spark, sf_dir).select(F.col("vec_id").alias("node"), "x", "y")
    served = S.reach_near(nodes, nodes.where("node % 10 = 0"), LINK)
    return nodes.select("node").join(served, "node", "left").select("node", F.col("hops").cast("long").alias("steps"), F.when(F.col("hops").isNull(), "unserved").when(F.col("hops") == 0, "direct").otherwise("chained").alias("state"))


CHAIN = f"""with recursive {NEAR_SQL}, walk(node, hops) using key (node) as (select vec_id, 0 from pts where vec_id % 10 = 0
        union select l.dst, min(w.hops + 1) from walk w join links l on l.src = w.node left join recurring.walk r on r.node = l.dst where r.hops is null or r.hops > w.hops + 1 group by l.dst)
    select vec_id as node, cast(hops as bigint) as steps, case when hops is null then 'unserved' when hops = 0 then 'direct' else 'chained' end as state from pts left join walk on node = vec_id"""


def bridges(spark, sf_dir):
    _, e = _near(spark, sf_dir)
    return G.bridges(e.where("src < dst").select(F.concat_ws("-", "src", "dst").alias("edge_id"), "src", "dst"))


BRIDGES = f"""with recursive {NEAR_SQL}, e as (select src || '-' || dst as edge_id, src, dst from links where src < dst),
    walk(edge_id, node) as (select edge_id, src from e union select w.edge_id, l.dst from walk w join links l on l.src = w.node where least(l.src, l.dst) || '-' || greatest(l.src, l.dst) <> w.edge_id)
    select edge_id from e where not exists (select 1 from walk w where w.edge_id = e.edge_id and w.node = e.dst)"""


def _backbone(spark, sf_dir):
    edges = transitions(spark, sf_dir).select("src", "dst", "weight")
    both = edges.union(edges.select("dst", "src", "weight"))
    nodes = transitions(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.grow_backbone(nodes.where("node like '%-3' or node like '%-5' or node like '%-7'"), nodes.where("node like 'view-%'"), both, 90)


def backbone_connections(spark, sf_dir):
    return _backbone(spark, sf_dir)[0]


def backbone_states(spark, sf_dir):
    return _backbone(spark, sf_dir)[1]


BACKBONE = f"""with recursive {TRANSITIONS_SQL}, kept as (select src, dst, weight from edges), nodes as (select src as node from edges union select dst from edges),
    named as (select case when src like 'view-%' then '*' else src end as src, case when dst like 'view-%' then '*' else dst end as dst, weight from (select * from kept union all select dst, src, weight from kept)),
    e as (select src, dst, min(weight) as weight from named where src <> dst group by src, dst),
    places as (select node from nodes where node not like 'view-%' and (node like '%-3' or node like '%-5' or node like '%-7') union select '*'),
    walk(root, node, cost) using key (root, node) as (select node, node, 0::bigint from places
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst
        where w.cost + e.weight <= 90 and (r.cost is null or r.cost > w.cost + e.weight) group by w.root, e.dst),
    near as (select root, node from walk where root <> node and node in (from places)),
    joined(node) as (select '*' union select near.node from joined join near on root = joined.node)
    select node, case when node like 'view-%' or node in (from joined) then 'connected' else 'gap' end as state from nodes where node like '%-3' or node like '%-5' or node like '%-7'"""


def candidate_paths(spark, sf_dir):
    """Three cheapest simple paths of at most three edges between the busiest neighbours of a few nodes."""
    edges = transitions(spark, sf_dir)
    asked = edges.where("src like '%-0'").select(F.concat_ws(">", "src", "dst").alias("obligation_id"), F.col("src").alias("origin"), F.col("dst").alias("destination"))
    rows = G.simple_paths(asked, edges, 3, 3)
    return rows.select("obligation_id", "cost", F.array_join("nodes", ">").alias("path"), F.col("place").cast("long").alias("place"))


PATHS = f"""with recursive {TRANSITIONS_SQL}, e as (select * from edges), asked as (select src || '>' || dst as id, src as origin, dst as goal from e where src like '%-0'),
    walk(id, goal, node, cost, nodes, k) as (select id, goal, origin, 0::bigint, [origin], 0 from asked
        union all select w.id, w.goal, e.dst, w.cost + e.weight, list_append(w.nodes, e.dst), w.k + 1 from walk w join e on e.src = w.node where w.k < 3 and w.node <> w.goal and not list_contains(w.nodes, e.dst)),
    r as (select id, cost, nodes, row_number() over (partition by id order by cost, nodes) as place from walk where node = goal)
    select id as obligation_id, cost, array_to_string(nodes, '>') as path, place from r where place <= 3"""


def shortest_paths(spark, sf_dir):
    edges = transitions(spark, sf_dir)
    return G.shortest_paths(edges.select(F.col("src").alias("node")).where("node like '%-0'").distinct(), edges).select("root", "node", "cost")


SHORTEST = f"""with recursive {TRANSITIONS_SQL}, e as (select * from edges),
    walk(root, node, cost) using key (root, node) as (select distinct src, src, 0::bigint from e where src like '%-0'
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst)
    select root, node, cost from walk"""


def strong_components(spark, sf_dir):
    edges = transitions(spark, sf_dir).select("src", "dst")
    nodes = transitions(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.strong_components(nodes, edges)


STRONG = f"""with recursive {TRANSITIONS_SQL}, e as (select src, dst from edges), nodes as (select src as node from edges union select dst from edges),
    walk(a, b) as (select node, node from nodes union select a, dst from walk join e on src = b)
    select x.a as node, max(x.b) as component from walk x join walk y on y.a = x.b and y.b = x.a group by x.a"""


def best_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.round("l_extendedprice", 2).alias("length"))
    return G.best_edges(rows)


BEST = """select l_suppkey as src, l_partkey % 50 as dst, l_orderkey || '-' || l_linenumber as edge_id, round(l_extendedprice, 2) as length from lineitem
    qualify row_number() over (partition by l_suppkey, l_partkey % 50 order by round(l_extendedprice, 2), l_orderkey || '-' || l_linenumber) = 1"""


def role_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("length"), F.col("p_type").startswith("STANDARD").alias("preferred"))
    return p.select("p_partkey", *[F.round(role_weight(F.col("length"), role, F.col("preferred")), 6).alias(role.replace("-", "_")) for role in ROLE_FACTORS])


ROLES = "select p_partkey, " + ", ".join(f"round(p_size * case when p_type like 'STANDARD%' then {a}::double else {b}::double end, 6) as {role.replace('-', '_')}" for role, (a, b) in ROLE_FACTORS.items()) + " from part"


def route_choice(spark, sf_dir):
    size = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pair_id"), (size + 20).alias("direct_m"), (size * 1.4 + 30).alias("strategic_m"), ((F.col("p_partkey") % 11) / 10.0).alias("a_road_share"),
        F.when(F.col("p_partkey") % 3 > 0, size * 1.6 + 10).alias("ncn_m"), F.when(F.col("p_partkey") % 5 > 0, size * 0.9 + 35).alias("quiet_m"),
    )
    return C.choose_alignment(p)


ROUTE = """with o as (select p_partkey as pair_id, p_size + 20.0::double as direct_m, p_size * 1.4::double + 30 as strategic_m, (p_partkey % 11) / 10.0::double as a_road_share,
    case when p_partkey % 3 > 0 then p_size * 1.6::double + 10 end as ncn_m, case when p_partkey % 5 > 0 then p_size * 0.9::double + 35 end as quiet_m from part)
    select pair_id, case when a_road_share >= 0.8::double and strategic_m <= 1.5::double * direct_m then 'strategic' when ncn_m <= 1.35::double * direct_m then 'ncn' when quiet_m <= 1.35::double * direct_m then 'low-traffic' else 'direct' end as role from o"""


def _routes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("route_id"), (F.col("user_id") % 5).alias("ends"), F.concat_ws("-", F.hour("ts"), "event_type").alias("item"))


ROUTES_SQL = "routes as (select distinct user_id as route_id, user_id % 5 as ends, hour(ts) || '-' || event_type as item from events), size as (select route_id, count(*) as size from routes group by route_id)"
PARALLEL_SQL = f"""{ROUTES_SQL}, pairs as (select a.ends, a.route_id as a_id, b.route_id as b_id, count(*) as common from routes a join routes b on a.ends = b.ends and a.item = b.item and a.route_id < b.route_id group by all),
    rel as (select ends, a_id, b_id, common, common / greatest(x.size, y.size) as coverage from pairs join size x on x.route_id = a_id join size y on y.route_id = b_id where common / greatest(x.size, y.size) >= 0.5)"""


def parallel_relations(spark, sf_dir):
    return G.parallel_relations(_routes(spark, sf_dir), 0.5).withColumn("coverage", F.round("coverage", 6))


def parallel_components(spark, sf_dir):
    """Groups of parallel routes; a route that is parallel to none is a group of its own."""
    return G.components(_routes(spark, sf_dir).select(F.col("route_id").alias("node")).distinct(), G.parallel_links(_routes(spark, sf_dir), 0.5))


PARALLEL_COMPONENTS = f"""with recursive {PARALLEL_SQL}, both_ways as (select a_id as src, b_id as dst from rel union all select b_id, a_id from rel),
    walk(node, seen) as (select route_id, route_id from size union select dst, seen from walk join both_ways on src = node) select node, min(seen) as component from walk group by node"""


def percentile_threshold(spark, sf_dir):
    lines = desire(spark, sf_dir).where("scale = 'local'")
    bars = lines.groupBy("scenario_id").agg(F.percentile("trips", 0.8).alias("threshold"))
    return lines.join(bars, "scenario_id").groupBy("scenario_id", "threshold").agg(F.count_if(F.col("trips") >= F.col("threshold")).alias("n_obligations"), F.count("*").alias("n_flows")).withColumn("threshold", F.round("threshold", 6))


PERCENTILE = f"""with {LINES_SQL}, l as (select * from lines where scale = 'local'), bars as (select scenario_id, quantile_cont(trips, 0.8) as threshold from l group by scenario_id)
    select scenario_id, round(threshold, 6) as threshold, count(*) filter (where trips >= threshold) as n_obligations, count(*) as n_flows from l join bars using (scenario_id) group by scenario_id, threshold"""


def seed_cluster(spark, sf_dir):
    """Density clusters: cores have four neighbours, themselves included, within 90 m; a border joins its nearest core's cluster."""
    p = points(spark, sf_dir).select(F.col("vec_id").alias("node"), "x", "y")
    pairs = S.within(p, p, LINK).select("node", "near_node", "distance")
    cores = pairs.groupBy("node").agg(F.count("*").alias("n")).where("n >= 4").select("node")
    inner = pairs.join(cores, "node").join(cores.withColumnRenamed("node", "near_node"), "near_node")
    found = G.components(cores, inner.select(F.col("node").alias("src"), F.col("near_node").alias("dst")))
    nearest = pairs.join(cores.withColumnRenamed("node", "near_node"), "near_node").groupBy("node").agg(F.min_by("near_node", F.struct("distance", "near_node")).alias("core"))
    rows = p.select("node").join(nearest, "node", "left").join(found.select(F.col("node").alias("core"), F.col("component").alias("cluster")), "core", "left")
    return rows.select("node", "cluster", F.when(F.col("core").isNull(), "noise").when(F.col("core") == F.col("node"), "core").otherwise("border").alias("role"))


CLUSTER = f"""with recursive {POINTS_SQL}, near as (select a.vec_id as node, b.vec_id as other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as distance from pts a join pts b on sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {LINK}),
    cores as (select node from near group by node having count(*) >= 4), inner_links as (select node, other from near where node in (from cores) and other in (from cores)),
    walk(node, seen) as (select node, node from cores union select other, seen from walk join inner_links using (node)), found as (select node, min(seen) as cluster from walk group by node),
    nearest as (select node, arg_min(other, row(distance, other)) as core from near where other in (from cores) group by node)
    select vec_id as node, cluster, case when core is null then 'noise' when core = vec_id then 'core' else 'border' end as role from pts left join nearest n on n.node = vec_id left join found f on f.node = core"""


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("candidate_id"), F.split("p_type", " ")[0].alias("class"), F.round("p_retailprice", 0).alias("score"), (F.col("p_size") % 40).alias("shape"))


def diverse_admission(spark, sf_dir):
    return C.admit_diverse(_candidates(spark, sf_dir), "p_brand", ["PROMO", "STANDARD"], 6)


DIVERSE = """with c as (select p_brand, p_partkey as candidate_id, split_part(p_type, ' ', 1) as class, round(p_retailprice, 0) as score, p_size % 40 as shape from part),
    k as (select *, row_number() over (partition by p_brand, shape order by score desc, candidate_id) as copy from c),
    s as (select *, row_number() over (partition by p_brand, class order by score desc, candidate_id) as in_class from k where copy = 1),
    p as (select *, row_number() over (partition by p_brand order by case when in_class > 1 then 4 when class = 'PROMO' then 1 when class = 'STANDARD' then 2 else 3 end, score desc, candidate_id) as place from s)
    select p_brand, candidate_id, class, score, shape, case when place > 6 then 'over-maximum' when in_class = 1 then 'class-representative' else 'admitted' end as disposition from p
    union all select p_brand, candidate_id, class, score, shape, 'duplicate-shape' from k where copy > 1"""


def cascade_winner(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("reach", F.when(F.col("p_partkey") % 9 > 0, F.floor(F.col("p_retailprice") / 100)))
    return C.cascade(p, "p_brand", F.col("p_size") > 5, [("reach", True), ("p_size", False)], "p_partkey")


CASCADE = """with p as (select *, case when p_partkey % 9 > 0 then floor(p_retailprice / 100) end as reach from part),
    r as (select *, row_number() over (partition by p_brand order by p_size > 5 desc, reach desc nulls last, p_size, p_partkey) as n from p)
    select p_brand, max(case when n = 1 and p_size > 5 then p_partkey end) as winner, count(*) filter (where not p_size > 5) as n_gated, count(*) as n_considered from r group by p_brand"""


def detour_displacement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("option_id"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("class_rank"), F.col("l_quantity").alias("length"))
    return C.detour_displacement(rows, "l_partkey", 1.6)


DETOUR = """with o as (select l_partkey, l_orderkey || '-' || l_linenumber as option_id, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as class_rank, l_quantity as length from lineitem),
    b as (select * from o qualify row_number() over (partition by l_partkey order by class_rank, length, option_id) = 1), s as (select * from o qualify row_number() over (partition by l_partkey order by length, class_rank, option_id) = 1)
    select l_partkey, case when b.length > s.length * 1.6::double then s.option_id else b.option_id end as winner, b.option_id as preferred, b.length > s.length * 1.6::double as displaced from b join s using (l_partkey)"""


def education_access(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("option_id"), F.col("n_regionkey").alias("region_id"))
    s = table(spark, sf_dir, "supplier").join(n.withColumnRenamed("option_id", "s_nationkey"), "s_nationkey").select(F.col("s_suppkey").alias("site_id"), "region_id")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("option_id"))
    e = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("option_id", F.col("l_suppkey").alias("site_id")).agg(F.when(F.count("*") >= 26, "reachable").otherwise("partial").alias("status"))
    return C.option_access(n, s, e)


EDUCATION = """with e as (select c_nationkey as option_id, l_suppkey as site_id, case when count(*) >= 26 then 'reachable' else 'partial' end as status from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all)
    select n.n_nationkey as option_id, s_suppkey as site_id, coalesce(status, 'network-gap') as status from nation n join nation m on m.n_regionkey = n.n_regionkey join supplier on s_nationkey = m.n_nationkey left join e on option_id = n.n_nationkey and site_id = s_suppkey"""


def edge_class_costs(spark, sf_dir):
    """The class of each edge by the first rule that holds, and its length under that class."""
    p = table(spark, sf_dir, "part")
    t, size = F.col("p_type"), F.col("p_size").cast("long") * 1000
    kind = first_true(("cycleway", t.startswith("PROMO")), ("right-of-way", t.startswith("ECONOMY")), ("a-road", t.startswith("STANDARD")), ("quiet-road", F.col("p_size") < 25), otherwise="unknown")
    p = p.select("p_partkey", kind.alias("edge_class"), (F.col("p_partkey") % 19 == 0).alias("prohibited"), size.alias("mm"))
    return p.select("p_partkey", "edge_class", "prohibited", *[F.when(F.col("edge_class") == c, F.col("mm")).otherwise(0).cast("long").alias(c.replace("-", "_") + "_mm") for c in ("cycleway", "right-of-way", "a-road", "quiet-road", "unknown")])


EDGE_CLASS = """with p as (select p_partkey, p_partkey % 19 = 0 as prohibited, cast(p_size as bigint) * 1000 as mm, case when p_type like 'PROMO%' then 'cycleway' when p_type like 'ECONOMY%' then 'right-of-way' when p_type like 'STANDARD%' then 'a-road' when p_size < 25 then 'quiet-road' else 'unknown' end as edge_class from part)
    select p_partkey, edge_class, prohibited, """ + ", ".join(f"cast(case when edge_class = '{c}' then mm else 0 end as bigint) as {c.replace('-', '_')}_mm" for c in ("cycleway", "right-of-way", "a-road", "quiet-road", "unknown")) + " from p"


def asset_accounting(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "A", "selected").when(F.col("l_returnflag") == "N", "candidate").otherwise("rejected")
    use = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset_id"), state.alias("state"))
    return C.account(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id")), use)


ACCOUNT = """with g as (select l_partkey, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'N') as n, count(*) filter (where l_returnflag = 'R') as r from lineitem group by l_partkey)
    select p_partkey as asset_id, case when a > 0 then 'selected' when n > 0 then 'candidate' when r > 0 then 'rejected' else 'unused' end as disposition, coalesce(a, 0) as n_selected, coalesce(n, 0) as n_candidate, coalesce(r, 0) as n_rejected from part left join g on l_partkey = p_partkey"""


def crossing_warnings(spark, sf_dir):
    f = _features(spark, sf_dir)
    return C.crossings(f.select(F.col("feature_id").alias("line_id"), *[F.col(c).cast("double").alias(n) for c, n in (("min_x", "ax"), ("min_y", "ay"), ("max_x", "bx"), ("max_y", "by"))]), 1000.0)


_SIDE = "sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
CROSSING = f"""with {FEATURES_SQL}, l as (select feature_id as id, min_x::double as ax, min_y::double as ay, max_x::double as bx, max_y::double as by from feats)
    select l.id as line_id, o.id as other_id, 'amber' as status from l join l o on l.id < o.id
    where {_SIDE.format(p='l.a', q='l.b', r='o.a')} * {_SIDE.format(p='l.a', q='l.b', r='o.b')} < 0 and {_SIDE.format(p='o.a', q='o.b', r='l.a')} * {_SIDE.format(p='o.a', q='o.b', r='l.b')} < 0"""


def plan_divergence(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    side = lambda test: i.where(test).select(F.col("l_orderkey").alias("route_id"), F.col("l_suppkey").alias("item"))
    return C.compare_plan(side("l_orderkey % 2 = 0"), side("l_orderkey % 2 = 1")).withColumn("share", F.round("share", 6))


DIVERGENCE = """with p as (select distinct l_orderkey as route_id, l_suppkey as item from lineitem where l_orderkey % 2 = 0), r as (select distinct l_orderkey as route_id, l_suppkey as item from lineitem where l_orderkey % 2 = 1),
    s as (select route_id, count(*) filter (where item in (select item from r)) / count(*) as share from p group by route_id)
    select 'plan' as side, route_id, round(share, 6) as share, case when share >= 0.7 then 'match' when share > 0 then 'deviation' else 'addition' end as kind from s
    union all select 'reference', route_id, 0.0, 'omission' from r group by route_id having count(*) filter (where item in (select item from p)) = 0"""


def gate_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 4 == 0, "green").when(F.col("o_orderkey") % 4 == 1, "amber").when(F.col("o_orderkey") % 4 == 2, "red").otherwise("grey")
    requests = o.select(F.col("o_orderkey").alias("request_id"), status.alias("status"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("dependency_fingerprint"))
    ledger = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("request_id"), F.concat("o_orderstatus", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).cast("string")).alias("dependency_fingerprint"), F.when(F.col("o_orderkey") % 5 == 0, "defer").when(F.col("o_orderkey") % 5 < 3, "accept").otherwise("reject").alias("choice"))
    return C.gate(requests, ledger, {"amber": ("accept", "reject"), "red": ("reject", "defer")})


GATE = """with c as (select o_orderkey as id, case o_orderkey % 4 when 0 then 'green' when 1 then 'amber' when 2 then 'red' else 'grey' end as status, case when o_orderkey % 3 > 0 then case when o_orderkey % 5 = 0 then 'defer' when o_orderkey % 5 < 3 then 'accept' else 'reject' end end as choice, o_orderkey % 7 <> 0 as fresh from orders),
    v as (select *, coalesce(fresh and ((status = 'amber' and choice in ('accept', 'reject')) or (status = 'red' and choice in ('reject', 'defer'))), false) as valid from c)
    select id as request_id, status, case when status = 'green' then 'accept' when status = 'grey' then 'gap' when valid then choice when status = 'amber' then 'accept-with-review' else 'gap' end as outcome,
        case when choice is null then 'no-decision' when valid then 'replayed' else 'stale-or-not-offered' end as decision from v"""


def traffic_match_precedence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obs = e.select(F.col("event_id").alias("observation_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("count_point"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" R"), (F.col("event_id") % 90).cast("string"))).alias("road"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("J"), (F.col("user_id") % 4).cast("string"))).alias("junction"), F.col("event_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("count_point"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("road"), F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("j"), (F.col("s_nationkey") % 4).cast("string"))).alias("junction"), (F.col("s_suppkey") * 90).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return C.match_traffic(obs, t, 12.0)


TRAFFIC = """with o as (select event_id as oid, case when event_id % 3 = 0 then user_id end as cp, case when event_id % 2 = 0 then 'r' || (event_id % 90) end as road, case when event_id % 5 = 0 then 'j' || (user_id % 4) end as junction, event_id::double as at_m from events),
    t as (select s_suppkey as tid, case when s_suppkey % 2 = 0 then s_suppkey end as cp, case when s_suppkey % 5 > 0 then 'r' || s_suppkey end as road, case when s_suppkey % 7 > 0 then 'j' || (s_nationkey % 4) end as junction, (s_suppkey * 90)::double as at_m from supplier),
    pairs as (select oid, tid, case when o.cp = t.cp then 1 when (o.road = t.road or o.road is null or t.road is null) and (o.junction = t.junction or o.junction is null or t.junction is null) and (coalesce(o.road = t.road, false) or coalesce(o.junction = t.junction, false)) then 2 when abs(o.at_m - t.at_m) <= 12 then 3 end as rank from o join t on true),
    b as (select *, min(rank) over (partition by oid) as best from pairs where rank is not null), k as (select *, count(*) over (partition by oid) as n from b where rank = best)
    select o.oid as observation_id, tid as target_id, case rank when 1 then 'count-point' when 2 then 'link-identity' when 3 then 'buffer' else 'none' end as relation, case when n is null then 'unmatched' when n > 1 then 'ambiguous' else 'matched' end as state from o left join k on k.oid = o.oid"""


def traffic_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", F.round("value", 0).cast("long").alias("vehicles"))
    return C.traffic_claims(e, ["user_id", "day", "event_type"], "vehicles")


TRAFFIC_CONFLICTS = """with e as (select user_id, cast(cast(ts as date) as varchar) as day, event_type, cast(round(value, 0) as bigint) as v from events)
    select user_id, day, event_type, count(*) as n_claims, count(distinct v) as n_values, min(v) as lowest, max(v) as highest, case when count(distinct v) > 1 then 'conflicting' when count(*) > 1 then 'identical' else 'single' end as state from e group by user_id, day, event_type"""


def traffic_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    return C.traffic_bands(o, "o_totalprice", "year", (("quiet", 50000.0), ("moderate", 150000.0), ("busy", None)), 1998, 4).select("o_orderkey", "band", "freshness")


TRAFFIC_BANDS = """select o_orderkey, case when o_totalprice <= 50000 then 'quiet' when o_totalprice <= 150000 then 'moderate' when o_totalprice is not null then 'busy' end as band,
    case when year(o_orderdate) > 1998 or o_orderdate is null then 'unknown' when 1998 - year(o_orderdate) > 4 then 'stale' else 'fresh' end as freshness from orders"""


def dependency_levels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    return G.dependency_levels(part, part.where("item % 3 <> 0").select("item", F.floor(F.col("item") / 2).cast("long").alias("on"))).withColumn("level", F.col("level").cast("long"))


LEVELS = """with recursive walk(item, level) as (select p_partkey, 0 from part where p_partkey % 3 = 0 or p_partkey // 2 not in (select p_partkey from part)
        union all select p_partkey, level + 1 from walk join part on p_partkey // 2 = item and p_partkey % 3 <> 0 where p_partkey <> item)
    select p_partkey as item, cast(level as bigint) as level from part left join walk on item = p_partkey"""


def canonical_fingerprint(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = I.canonical_json(id=F.col("s_suppkey"), name=I.quoted(F.col("s_name")), nation=F.col("s_nationkey"))
    return s.select("s_suppkey", text.alias("canonical"), I.fingerprint(text).alias("fingerprint"), I.stable_id("supplier", F.col("s_suppkey").cast("string"), F.col("s_name")).alias("stable_id"), I.coordinate_key(F.col("s_nationkey"), F.col("s_suppkey")).alias("node_key"))


FINGERPRINT = """with t as (select *, '{"id":' || s_suppkey || ',"name":"' || s_name || '","nation":' || s_nationkey || '}' as canonical from supplier)
    select s_suppkey, canonical, sha256(canonical) as fingerprint, 'supplier-' || substring(sha256(s_suppkey || '::' || s_name), 1, 12) as stable_id, printf('%.3f', s_nationkey::double) || ':' || printf('%.3f', s_suppkey::double) as node_key from t"""

PLANS = {
    "components_weak": (components_weak, WEAK),
    "dangles_isolated": (dangles_isolated, DANGLES),
    "reciprocal_edges": (reciprocal_edges, RECIPROCAL),
    "reach_hops": (reach_hops, REACH),
    "community_chain": (community_chain, CHAIN),
    "backbone_connections": (backbone_connections, None),
    "backbone_states": (backbone_states, BACKBONE),
    "bridges": (bridges, BRIDGES),
    "candidate_paths": (candidate_paths, PATHS),
    "shortest_paths": (shortest_paths, SHORTEST),
    "strong_components": (strong_components, STRONG),
    "best_edges": (best_edges, BEST),
    "role_weights": (role_weights, ROLES),
    "route_choice": (route_choice, ROUTE),
    "parallel_relations": (parallel_relations, f"with {PARALLEL_SQL} select ends, a_id, b_id, common, round(coverage, 6) as coverage from rel"),
    "parallel_components": (parallel_components, PARALLEL_COMPONENTS),
    "percentile_threshold": (percentile_threshold, PERCENTILE),
    "seed_cluster": (seed_cluster, CLUSTER),
    "diverse_admission": (diverse_admission, DIVERSE),
    "cascade_winner": (cascade_winner, CASCADE),
    "detour_displacement": (detour_displacement, DETOUR),
    "education_access": (education_access, EDUCATION),
    "edge_class_costs": (edge_class_costs, EDGE_CLASS),
    "asset_accounting": (asset_accounting, ACCOUNT),
    "crossing_warnings": (crossing_warnings, CROSSING),
    "plan_divergence": (plan_divergence, DIVERGENCE),
    "gate_decisions": (gate_decisions, GATE),
    "traffic_match_precedence": (traffic_match_precedence, TRAFFIC),
    "traffic_conflicts": (traffic_conflicts, TRAFFIC_CONFLICTS),
    "traffic_bands": (traffic_bands, TRAFFIC_BANDS),
    "dependency_levels": (dependency_levels, LEVELS),
    "canonical_fingerprint": (canonical_fingerprint, FINGERPRINT),
}
