"""Queries over sweeps, samples, reuse, sections and governance rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import graph as G
from ..operators import rules as R
from ..operators import spatial as S
from ..operators import trees
from .network import LINK, _near
from .spatial import OPTIONS_SQL, _options
from .tables import POINTS_SQL, points, table


def interval_transitions(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("evidence_id"), day.alias("start_m"), (day + 60 + F.col("o_orderkey") % 90).alias("end_m"))
    return R.transitions(rows, "o_custkey")


TRANSITIONS = """with i as (select o_custkey, o_orderkey, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as bigint) as s, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) + 60 + o_orderkey % 90 as bigint) as e from orders),
    p as (select o_custkey, s as at_m from i union select o_custkey, e from i), w as (select o_custkey, at_m as from_m, lead(at_m) over (partition by o_custkey order by at_m) as to_m from p)
    select w.o_custkey, from_m, to_m, count(*) as n_covering, min(o_orderkey) as first_evidence from w join i on i.o_custkey = w.o_custkey and s <= from_m and e >= to_m where to_m is not null group by w.o_custkey, from_m, to_m"""


def route_samples(spark, sf_dir):
    p = points(spark, sf_dir)
    routes = p.select(F.col("vec_id").alias("route_id"), *[F.col(c).cast("double").alias(c + "0") for c in "xy"], (F.col("x") + F.col("vec_id") % 5 * 30).cast("double").alias("x1"), (F.col("y") + F.col("vec_id") % 5 * 40).cast("double").alias("y1"))
    return R.samples(routes, 20).select("route_id", "step", *[F.round(c, 4).alias(c) for c in ("at_m", "x", "y")])


ROUTE_SAMPLES = f"""with {POINTS_SQL}, r as (select vec_id as route_id, x::double as x0, y::double as y0, vec_id % 5 * 30 as dx, vec_id % 5 * 40 as dy, vec_id % 5 * 50.0::double as len from pts),
    s as (select *, unnest(generate_series(0, cast(ceil(len / 20) as bigint))) as step from r), a as (select *, least(step * 20.0::double, len) as at_m from s)
    select route_id, step, round(at_m, 4) as at_m, round(case when len > 0 then x0 + at_m / len * dx else x0 end, 4) as x, round(case when len > 0 then y0 + at_m / len * dy else y0 end, 4) as y from a"""


def raster_samples(spark, sf_dir):
    p = points(spark, sf_dir)
    tile, pixel = 500, 100
    grid = p.where("vec_id % 3 > 0").select(F.floor(F.col("x") / tile).alias("tile_x"), F.floor(F.col("y") / tile).alias("tile_y"), (4 - F.floor((F.col("y") - F.floor(F.col("y") / tile) * tile) / pixel)).alias("row"), F.floor((F.col("x") - F.floor(F.col("x") / tile) * tile) / pixel).alias("col"), F.when(F.col("vec_id") % 7 == 0, -1e39).otherwise(F.col("residents").cast("double")).alias("value"))
    grid = grid.groupBy("tile_x", "tile_y", "row", "col").agg(F.max("value").alias("value"))
    return R.sample_raster(p.select(F.col("vec_id").alias("sample_id"), "x", "y"), grid, tile, pixel)


RASTER = f"""with {POINTS_SQL}, c as (select vec_id, residents, cast(floor(x / 500.0) as bigint) as tx, cast(floor(y / 500.0) as bigint) as ty, cast(floor(x / 100.0) as bigint) as px, cast(floor(y / 100.0) as bigint) as py from pts),
    g as (select tx, ty, px, py, max(case when vec_id % 7 = 0 then -1e39 else residents::double end) as value from c where vec_id % 3 > 0 group by all), t as (select distinct tx, ty from g)
    select vec_id as sample_id, case when value > -3e38 then value end as value, case when t.tx is null then 'explicit-unknown' when value > -3e38 then 'available' else 'no-data' end as availability
    from c left join g using (tx, ty, px, py) left join t on t.tx = c.tx and t.ty = c.ty"""


def reusable_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = F.when(F.col("doc_id") % 29 == 0, "unknown").when(F.col("doc_id") % 23 == 0, "absent").otherwise("confirmed")
    rows = d.select(F.floor(F.col("doc_id") / 5).alias("alignment_id"), F.element_at(F.array(*[F.lit(x) for x in ("width", "surface", "access", "works")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("dimension"), state.alias("state"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("valid_to"))
    return R.reusable_state(rows, ("width", "surface", "access", "works"), F.lit("2024-01-20").cast("date"))


REUSABLE = """with a as (select doc_id // 5 as id, doc_id % 4 as d, case when doc_id % 29 = 0 then 'unknown' when doc_id % 23 = 0 then 'absent' else 'confirmed' end as state, date '2024-01-01' + cast(doc_id % 400 as integer) < date '2024-01-20' as old from documents),
    p as (select id, d, case when bool_or(old or state = 'unknown') or count(distinct state) > 1 then 'unknown' else min(state) end as state from a group by id, d)
    select id as alignment_id, case when count(*) filter (where state <> 'unknown') < 4 then 'unknown' when bool_or(state = 'absent') then 'absent' else 'confirmed' end as reusable from p group by id"""


def reuse_comparison(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("alignment_id"), (F.col("p_partkey") % 4 / 4.0).alias("reusable_share"), (F.col("p_size") % 5 / 5.0).alias("recognised_share"), F.round("p_retailprice", 0).alias("directness"))
    return R.reuse_order(p, "p_brand")


REUSE = """select p_brand, p_partkey as alignment_id, p_partkey % 4 / 4.0::double as reusable_share, p_size % 5 / 5.0::double as recognised_share, round(p_retailprice, 0) as directness,
    cast(row_number() over (partition by p_brand order by p_partkey % 4 desc, p_size % 5 desc, round(p_retailprice, 0), p_partkey) as integer) as place from part"""


def _walks(spark, sf_dir):
    """Orders as routes over the suppliers of their items, in order and each once."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 12).alias("node")).agg(F.min("l_linenumber").alias("at"))
    return i.groupBy(F.col("l_orderkey").alias("route_id")).agg(F.sort_array(F.collect_list(F.struct("at", "node"))).getField("node").alias("nodes"))


WALKS_SQL = """stops as (select l_orderkey as route_id, l_suppkey % 12 as node, min(l_linenumber) as first_at from lineitem group by all),
    walks as (select route_id, list(node order by first_at, node) as nodes from stops group by route_id)"""


def parallel_sections(spark, sf_dir):
    choice = spark.range(0, 12, 4).select(F.col("id").alias("node"))
    return R.parallel_sections(_walks(spark, sf_dir), choice)


SECTIONS = f"""with {WALKS_SQL}, e as (select route_id, len(nodes) as n, unnest(nodes) as node, generate_subscripts(nodes, 1) as pos from walks), c as (select * from e where node % 4 = 0 or pos = 1 or pos = n),
    s as (select route_id, row_number() over w - 1 as section, node as from_node, lead(node) over w as to_node, lead(pos) over w - pos as n_edges from c window w as (partition by route_id order by pos))
    select route_id, cast(section as integer) as section, from_node, to_node, cast(n_edges as integer) as n_edges from s where to_node is not null"""


def hybrid_routes(spark, sf_dir):
    w = _walks(spark, sf_dir).where("size(nodes) >= 4").withColumn("ends", F.concat_ws("-", F.element_at("nodes", 1), F.element_at("nodes", -1)))
    return R.hybrids(w, spark.range(0, 12, 4).select(F.col("id").alias("node")))


HYBRIDS = f"""with {WALKS_SQL}, r as (select route_id, nodes, nodes[1] || '-' || nodes[-1] as ends from walks where len(nodes) >= 4), e as (select *, unnest(nodes) as node, generate_subscripts(nodes, 1) as pos from r),
    i as (select * from e where node % 4 = 0 and pos > 1 and pos < len(nodes)),
    b as (select a.ends, a.node, a.route_id as first_id, b.route_id as second_id, a.nodes[1:a.pos] as head, b.nodes[b.pos + 1:] as tail from i a join i b on a.ends = b.ends and a.node = b.node and a.route_id <> b.route_id),
    h as (select *, list_concat(head, tail) as nodes from b where not list_has_any(head, tail)), f as (select * from h where not exists (select 1 from r where r.ends = h.ends and r.nodes = h.nodes)),
    m as (select ends, nodes, min(row(first_id, second_id, node)) as made from f group by ends, nodes)
    select ends, made[1] as first_id, made[2] as second_id, made[3] as node, cast(len(nodes) as integer) as n_nodes from m"""


def section_union(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("group_id"), (F.col("l_linenumber") % 3).alias("section"), F.col("l_partkey").alias("oa_id"), (F.col("l_partkey") % 300).alias("residents"))
    return R.section_union(i, i.select("group_id", "section").where("section <> group_id % 3").distinct())


SECTION_UNION = """select g as group_id, count(*) as n_areas, cast(sum(r) as bigint) as residents from (select distinct l_suppkey % 20 as g, l_partkey, l_partkey % 300 as r from lineitem where l_linenumber % 3 <> l_suppkey % 20 % 3) group by g"""


def area_materialise(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_partkey").alias("key"), F.col("l_linestatus").alias("content"), "l_quantity")
    return R.materialise(i, F.col("l_quantity") > 40)


MATERIALISE = """select l_returnflag as layer, l_partkey as key, count(*) filter (where l_quantity > 40) as hits, case when count(*) filter (where l_quantity > 40) = 0 then 'rejected'
    when count(distinct l_linestatus) filter (where l_quantity > 40) > 1 then 'conflict' when count(*) filter (where l_quantity > 40) > 1 then 'deduplicated' else 'selected' end as state from lineitem group by all"""


def layer_digests(spark, sf_dir):
    return R.digests(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey", "c_name", "c_nationkey"])


DIGESTS = f"""with d as (select c_mktsegment, sha256(length(c_custkey::varchar) || ':' || c_custkey || length(c_name) || ':' || c_name || length(c_nationkey::varchar) || ':' || c_nationkey) as d from customer),
    s as (select c_mktsegment, count(*) as n_rows, {', '.join(f"sum(('0x' || substring(d, {8 * i + 1}, 8))::bigint)::varchar as w{i}" for i in range(8))} from d group by c_mktsegment)
    select c_mktsegment, n_rows, sha256(concat_ws('|', n_rows::varchar, {', '.join(f'w{i}' for i in range(8))})) as digest from s"""


def cutover_gates(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier")
    gates = n.select(F.col("n_name").alias("gate"), F.lit(5000.0).alias("threshold"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("gate"), F.when(F.col("s_suppkey") % 10 == 0, "old").otherwise("new").alias("commit"), F.col("s_acctbal").alias("value"))
    return R.cutover(gates, rows, "new")


CUTOVER = """with m as (select n_name as gate, count(*) as n, bool_or(s_suppkey % 10 = 0) as other, max(s_acctbal) as v from supplier join nation on s_nationkey = n_nationkey group by n_name)
    select n_name as gate, case when n is null then 'missing' when n > 1 then 'duplicate' when other then 'commit-mismatch' when v > 5000 then 'threshold-failed' else 'passed' end as state from nation left join m on gate = n_name"""


def catalogue_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("provider_id"), F.split("p_type", " ")[0].alias("capability"), F.when(F.col("p_size") > 25, F.array(F.lit("routing"), F.lit("display"))).otherwise(F.array(F.lit("display"))).alias("uses"), (F.col("p_partkey") % 120).alias("cell"), (F.col("p_size") % 3 + 1).alias("authority"))
    return R.resolve_sources(spark.range(120).withColumnRenamed("id", "cell"), p, "PROMO", "routing")


RESOLVE = """with c as (select unnest(generate_series(0, 119)) as cell), p as (select p_partkey % 120 as cell, min(row(p_size % 3 + 1, p_partkey)) as b, count(*) as n from part where p_type like 'PROMO%' and p_size > 25 group by 1)
    select c.cell, b[2] as provider_id, coalesce(n, 0) as n_providers from c left join p using (cell)"""


def lifecycle_transitions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("draft", "review", "adopted", "retired")]), (k % 4 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("record_id"), name(F.col("o_orderkey")).alias("was"), name(F.col("o_custkey")).alias("state"), F.when(F.col("o_orderkey") % 3 == 0, "an officer").alias("approver"))
    return R.lifecycle(rows, {"draft": ["review"], "review": ["draft", "adopted"], "adopted": ["retired"]}, ["adopted", "retired"])


LIFECYCLE = """with o as (select o_orderkey as record_id, ['draft', 'review', 'adopted', 'retired'][o_orderkey % 4 + 1] as was, ['draft', 'review', 'adopted', 'retired'][o_custkey % 4 + 1] as state, o_orderkey % 3 = 0 as ok from orders)
    select record_id, was, state, case when not ((was = 'draft' and state = 'review') or (was = 'review' and state in ('draft', 'adopted')) or (was = 'adopted' and state = 'retired')) then 'illegal' when state in ('adopted', 'retired') and not ok then 'needs-approval' else 'legal' end as verdict from o"""


def anchored_spines(spark, sf_dir):
    _, e = _near(spark, sf_dir)
    edges = e.where("src < dst").select(F.concat_ws("-", "src", "dst").alias("edge_id"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return G.prune_leaves(edges, points(spark, sf_dir).where("vec_id % 4 = 0").select(F.col("vec_id").alias("node")))


def spanning_forest(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("vec_id").alias("node"), "x", "y")
    pairs = S.within(p, p, LINK).where("node < near_node")
    return trees.spanning_forest(pairs.select(F.concat_ws("-", "node", "near_node").alias("edge_id"), F.col("node").alias("src"), F.col("near_node").alias("dst"), F.round(F.col("distance") * 1000).cast("long").alias("cost")))


def route_menu(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("route_id"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("comfort"), F.col("l_tax").alias("safety"), F.col("l_quantity").alias("length"))
    return R.route_menu(i, "l_partkey", ["comfort", "safety"]).select("l_partkey", "route_id", "place")


MENU = """select l_partkey, l_orderkey || '-' || l_linenumber as route_id, cast(row_number() over (partition by l_partkey order by case when l_tax > 0.01::double then l_discount end desc nulls last, l_tax desc, l_quantity, l_orderkey || '-' || l_linenumber) as integer) as place from lineitem"""


def broken_references(spark, sf_dir):
    return R.broken_references(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").where("c_nationkey > 9"), "user_id", "c_custkey")


BROKEN = "select user_id, count(*) as n from events where user_id not in (select c_custkey from customer where c_nationkey > 9) group by user_id"


def urban_eligibility(spark, sf_dir):
    p = points(spark, sf_dir)
    near = S.within(_options(spark, sf_dir).withColumnRenamed("option_id", "community_id"), p.select("x", "y", "residents", "label"), 1500.0)
    g = near.groupBy("community_id").agg((F.sum("near_residents") / 1000.0).alias("street_km"), F.count_if(F.col("near_label") % 2 == 0).alias("n_junctions"))
    return R.urban_eligibility(g, (("city", 30.0, 90), ("town", 20.0, 60), ("village", 5.0, 1)))


URBAN = f"""with {OPTIONS_SQL}, g as (select option_id as community_id, sum(residents) / 1000.0::double as street_km, count(*) filter (where p.label % 2 = 0) as n_junctions from opts o join pts p on sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) <= 1500 group by option_id)
    select *, case when street_km >= 30 and n_junctions >= 90 then 'city' when street_km >= 20 and n_junctions >= 60 then 'town' when street_km >= 5 and n_junctions >= 1 then 'village' else 'rural' end as class from g"""


def tag_classes(spark, sf_dir):
    """Tags made up from part rows, decoded and classified."""
    p = table(spark, sf_dir, "part")
    ref = F.when(F.col("p_size") % 4 == 0, F.format_string("['A%d', 'B%d']", "p_size", "p_size")).when(F.col("p_size") % 4 == 1, F.format_string(" B%d ;A%d", "p_size", "p_size")).when(F.col("p_size") % 4 == 2, F.format_string("B%d", "p_size"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("Oak Primary", "Elm Secondary", "Ash Special School", "All-through Yew")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", F.array_join(T.tag_values(ref), "|").alias("refs"), T.is_a_road(ref).alias("a_road"), T.school_kind(F.lit("school"), name, F.lit(None).cast("string")).alias("school"), T.official_class(F.upper(F.element_at(F.array(F.lit("a road"), F.lit("b road"), F.lit("lane")), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("official"))


TAGS = """select p_partkey, case p_size % 4 when 0 then 'A' || p_size || '|B' || p_size when 1 then 'B' || p_size || '|A' || p_size when 2 then 'B' || p_size else '' end as refs, p_size % 4 in (0, 1) as a_road,
    ['primary', 'secondary', 'special', 'all-through'][p_partkey % 4 + 1] as school, ['a-road', 'b-road', 'unknown'][p_partkey % 3 + 1] as official from part"""

PLANS = {
    "interval_transitions": (interval_transitions, TRANSITIONS),
    "route_samples": (route_samples, ROUTE_SAMPLES),
    "raster_samples": (raster_samples, RASTER),
    "reusable_state": (reusable_state, REUSABLE),
    "reuse_comparison": (reuse_comparison, REUSE),
    "parallel_sections": (parallel_sections, SECTIONS),
    "hybrid_routes": (hybrid_routes, HYBRIDS),
    "section_union": (section_union, SECTION_UNION),
    "area_materialise": (area_materialise, MATERIALISE),
    "layer_digests": (layer_digests, DIGESTS),
    "cutover_gates": (cutover_gates, CUTOVER),
    "catalogue_resolve": (catalogue_resolve, RESOLVE),
    "lifecycle_transitions": (lifecycle_transitions, LIFECYCLE),
    "anchored_spines": (anchored_spines, None),
    "spanning_forest": (spanning_forest, None),
    "route_menu": (route_menu, MENU),
    "broken_references": (broken_references, BROKEN),
    "urban_eligibility": (urban_eligibility, URBAN),
    "tag_classes": (tag_classes, TAGS),
}
