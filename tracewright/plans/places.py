"""Queries over the driver's tables for attachment, reuse, witness paths, lineages, portals, shapes and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import millimetres
from ..operators import attachment as A
from ..operators import discovery as D
from ..operators import intervals as I
from ..operators import lineage as N
from ..operators import linework as K
from ..operators import planar as P
from ..operators import portals as B
from ..operators import shapes as H
from ..operators import witness as W
from .lines import _MM, LINES_SQL, SIDE_M, _fraction, _lines, _to_leg
from .network import _near
from .tables import POINTS_SQL, TRANSITIONS_SQL, points, table, transitions

NEAR_M, NODE_M, CELL_M, SEED_M, LEAST_M = 120.0, 20.0, 500.0, 700.0, 30


def _requests(spark, sf_dir):
    """Two other dimensions of embeddings as points."""
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 10000)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), at(6).alias("x"), at(7).alias("y"))


REQUESTS_SQL = "req as (select vec_id as point_id, round(cast(embedding[7] as double) * 10000) as px, round(cast(embedding[8] as double) * 10000) as py from embeddings)"


def places_on_lines(spark, sf_dir):
    """The nearest place on each line within 120 m of each request."""
    rows = A.places_on_lines(_requests(spark, sf_dir), _lines(spark, sf_dir), NEAR_M, SIDE_M)
    return rows.select("point_id", "line_id", millimetres(F.col("distance")).alias("distance_mm"), millimetres(F.col("at_m")).alias("at_mm"))


PLACES = f"""with {LINES_SQL}, {REQUESTS_SQL},
    near as (select point_id, t.id as line_id, seq, {_to_leg('px', 'py', 't')} as d, t.from_m + ({_fraction('px', 'py', 't')}) * t.size as m from req join sized t on t.size > 0
        where px between least(t.ax, t.bx) - {NEAR_M} and greatest(t.ax, t.bx) + {NEAR_M} and py between least(t.ay, t.by) - {NEAR_M} and greatest(t.ay, t.by) + {NEAR_M})
    select point_id, line_id, {_MM('min(d)')} as distance_mm, {_MM('arg_min(m, row(d, seq))')} as at_mm from near where d <= {NEAR_M} group by point_id, line_id"""


def nodes_on_lines(spark, sf_dir):
    """Requests as nodes within 20 m of each line."""
    rows = A.nodes_on_lines(_requests(spark, sf_dir).withColumnRenamed("point_id", "node"), _lines(spark, sf_dir), NODE_M, SIDE_M)
    return rows.select("id", "node", millimetres(F.col("distance")).alias("distance_mm"), F.col("place").cast("long").alias("place"))


NODES = f"""with {LINES_SQL}, {REQUESTS_SQL},
    near as (select point_id as node, t.id, min({_to_leg('px', 'py', 't')}) as d from req join sized t on t.size > 0 group by point_id, t.id having min({_to_leg('px', 'py', 't')}) <= {NODE_M})
    select id, node, {_MM('d')} as distance_mm, row_number() over (partition by id order by d, node) as place from near"""


def _streets(spark, sf_dir):
    """Near points as nodes, their pairs as streets both ways; some have no way back and some come back by another street, far off."""
    p = points(spark, sf_dir).select(F.col("vec_id").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    _, links = _near(spark, sf_dir)
    end = lambda n: p.select(F.col("node").alias(n), F.struct("x", "y").alias(f"{n}_p"))
    rows = links.where("(src + dst) % 7 > 0 or src < dst").join(end("src"), "src").join(end("dst"), "dst").where("src_p <> dst_p")
    a, b = F.col("src_p"), F.col("dst_p")
    far = F.struct((a["x"] + 3000.0).alias("x"), (a["y"] + 3000.0).alias("y"))
    shape = F.when((F.col("src") > F.col("dst")) & ((F.col("src") + F.col("dst")) % 5 == 0), F.array(a, far, b)).otherwise(F.array(a, b))
    return p, rows.select(F.concat_ws(">", "src", "dst").alias("edge_id"), "src", "dst", F.hypot(a["x"] - b["x"], a["y"] - b["y"]).alias("length"), shape.alias("points"))


STREETS_SQL = f"""{POINTS_SQL}, {REQUESTS_SQL}, e as (select a.vec_id as src, b.vec_id as dst, a.vec_id || '>' || b.vec_id as edge_id, b.vec_id || '>' || a.vec_id as reverse_edge_id,
        cast(a.x as double) as ax, cast(a.y as double) as ay, cast(b.x as double) as bx, cast(b.y as double) as "by", sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as size
        from pts a join pts b on a.vec_id <> b.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 90 and (a.x <> b.x or a.y <> b.y)),
    street as (select * from e where (src + dst) % 7 > 0 and (src + dst) % 5 > 0),
    met as (select point_id, dst as node, edge_id, reverse_edge_id, size, {_to_leg('px', 'py', 's')} as d, {_fraction('px', 'py', 's')} as f from req join street s on px between least(s.ax, s.bx) - {NEAR_M} and greatest(s.ax, s.bx) + {NEAR_M} and py between least(s.ay, s.by) - {NEAR_M} and greatest(s.ay, s.by) + {NEAR_M}),
    att as (select point_id, node, edge_id, reverse_edge_id, d as association_m, size * (1 - f) as prefix_m, d + size * (1 - f) as routing_m from met where d <= {NEAR_M} and f > 1e-9 and f < 1 - 1e-9
        union all select point_id, vec_id, null, null, sqrt(pow(x - px, 2) + pow(y - py, 2)), 0.0, sqrt(pow(x - px, 2) + pow(y - py, 2)) from req join pts on sqrt(pow(x - px, 2) + pow(y - py, 2)) <= {NEAR_M})"""


def _attached(spark, sf_dir):
    nodes, edges = _streets(spark, sf_dir)
    return A.point_attachments(_requests(spark, sf_dir), nodes, edges, NEAR_M, side=SIDE_M), edges


def point_attachments(spark, sf_dir):
    rows, _ = _attached(spark, sf_dir)
    return rows.select("point_id", "node", "edge_id", "reverse_edge_id", *[millimetres(F.col(f"{c}_m")).alias(f"{c}_mm") for c in ("association", "prefix", "routing")])


ATTACHMENTS = f"""with {STREETS_SQL} select point_id, node, edge_id, reverse_edge_id, {_MM('association_m')} as association_mm, {_MM('prefix_m')} as prefix_mm, {_MM('routing_m')} as routing_mm from att"""


def best_point_attachment(spark, sf_dir):
    """Each request attached on its way to the first node near the request of the next id."""
    rows, edges = _attached(spark, sf_dir)
    near = rows.where("edge_id is null").groupBy((F.col("point_id") - 1).alias("request_id")).agg(F.min("node").alias("node")).withColumn("snap", F.col("request_id") % 3)
    own = rows.where("edge_id is null").select(F.col("point_id").alias("request_id"), F.col("node")).groupBy("request_id").agg(F.max("node").alias("node")).withColumn("snap", F.lit(1).cast("long"))
    ways = edges.select("src", "dst", F.round(F.col("length") * 1000).cast("long").alias("weight"))
    return A.best_point_attachment(rows, near.union(own), ways)


BEST = f"""with recursive {STREETS_SQL}, two as (select src, dst, cast(round(size * 1000) as bigint) as weight from e where (src + dst) % 7 > 0),
    walk(root, node, cost) using key (root, node) as (select vec_id, vec_id, 0::bigint from pts
        union select w.root, t.dst, min(w.cost + t.weight) from walk w join two t on t.src = w.node left join recurring.walk r on r.root = w.root and r.node = t.dst where r.cost is null or r.cost > w.cost + t.weight group by w.root, t.dst),
    a as (select *, {_MM('routing_m')} as snap from att), starts as (select point_id as request_id, node, min(snap) as snap from a group by 1, 2),
    ends as (select point_id - 1 as request_id, min(node) as node, (point_id - 1) % 3 as snap from a where edge_id is null group by point_id union all select point_id, max(node), 1 from a where edge_id is null group by point_id),
    ends1 as (select request_id, node, min(snap) as snap from ends group by 1, 2),
    best as (select request_id, min(row(s.snap + cost + n.snap, s.snap, n.snap, s.node, n.node, cost)) as b from starts s join ends1 n using (request_id) join walk on root = s.node and walk.node = n.node group by request_id)
    select request_id, b[4] as start, b[5] as "end", arg_min(edge_id, row(coalesce(edge_id, ''), coalesce(reverse_edge_id, ''), association_m)) as edge_id, arg_min(reverse_edge_id, row(coalesce(edge_id, ''), coalesce(reverse_edge_id, ''), association_m)) as reverse_edge_id,
        arg_min({_MM('association_m')}, row(coalesce(edge_id, ''), coalesce(reverse_edge_id, ''), association_m)) as association_mm, arg_min({_MM('prefix_m')}, row(coalesce(edge_id, ''), coalesce(reverse_edge_id, ''), association_m)) as prefix_mm, b[3] as end_snap, b[6] as cost, b[1] as total
    from best join a on point_id = request_id and node = b[4] and snap = b[2] group by request_id, b"""
BEST = BEST.replace("arg_min(edge_id", "arg_min_null(edge_id").replace("arg_min(reverse_edge_id", "arg_min_null(reverse_edge_id")


def _spans(spark, sf_dir):
    """Orders as matches of evidence along their customers, a day for a metre."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), k.alias("evidence_id"), day.alias("start_m"), (day + k % 90).alias("end_m"),
        (F.col("o_orderstatus") == "F").alias("recognised"), (k % 3 == 0).alias("reusable"), (k % 5 == 0).alias("declassified"), (k % 4 == 0).alias("delivered"),
    )


SPANS_SQL = """m as (select o_custkey as id, o_orderkey as e, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) as s, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) + o_orderkey % 90 as double) as t,
    o_orderstatus = 'F' as f0, o_orderkey % 3 = 0 as f1, o_orderkey % 5 = 0 as f2, o_orderkey % 4 = 0 as f3 from orders)"""


def reuse_advantage(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.lit(1500.0) + F.col("c_custkey") % 900).alias("length_m"))
    rows = I.reuse_advantage(lines, _spans(spark, sf_dir), LEAST_M)
    return rows.select("*", *[F.round(f"{c}_share", 9).alias(f"{c}_part") for c in ("matched", "recognised", "reusable")]).drop("matched_share", "recognised_share", "reusable_share")


def _island(name: str, test: str) -> str:
    return f"""{name} as (select id, max(size) as l from (select id, sum(t - s) as size from (select *, sum(gap) over (partition by id order by s) as run from (select *, case when lag(t) over (partition by id order by s) = s then 0 else 1 end as gap from cut where {test})) group by id, run) group by id)"""


REUSE = f"""with {SPANS_SQL}, lines as (select c_custkey as id, cast(1500 + c_custkey % 900 as double) as size from customer),
    c as (select m.id, e, greatest(s, 0) as s, least(t, size) as t, f0, f1, f2, f3, size from m join lines using (id) where s <= size),
    g as (select *, sum(gap) over (partition by id order by s, t) as run from (select *, case when s <= max(t) over (partition by id order by s, t rows between unbounded preceding and 1 preceding) then 0 else 1 end as gap from c where t > s)),
    runs as (select id, min(s) as s, max(t) as t from g group by id, run having max(t) - min(s) >= {LEAST_M}),
    marks as materialized (select c.id, c.s as p from c join runs r on r.id = c.id and r.s <= c.s and r.t >= c.t where c.t > c.s union select c.id, c.t from c join runs r on r.id = c.id and r.s <= c.s and r.t >= c.t where c.t > c.s union select id, 0.0 from lines union select id, size from lines),
    step as materialized (select id, p as s, lead(p) over (partition by id order by p) as t from marks),
    seen as (select step.id, step.s, step.t, count(*) as n, bool_or(f0) as f0, bool_or(f1) as f1, bool_or(f2) as f2, bool_or(f3) as f3 from step join runs r on r.id = step.id and r.s <= step.s and r.t >= step.t join c on c.id = step.id and c.s <= step.s and c.t >= step.t and c.t > c.s where step.t is not null group by 1, 2, 3),
    cut as materialized (select step.id, step.s, step.t, coalesce(n, 0) as n, coalesce(f0, false) as f0, coalesce(f1, false) as f1, coalesce(f2, false) and not f0 as f2, coalesce(f3, false) as f3 from step left join seen using (id, s) where step.t is not null),
    total as (select id, count(*) as n_stretches, sum(t - s) filter (where n > 0) as a, sum(t - s) filter (where f0) as b, sum(t - s) filter (where f1) as c, sum(t - s) filter (where f2) as d, sum(t - s) filter (where n = 0) as u, sum(t - s) filter (where f3) as v from cut group by id),
    {_island('la', 'n > 0')}, {_island('lb', 'f0')}, {_island('lc', 'f1')}
    select id, size as length_m, n_stretches, coalesce(a, 0.0) as matched_m, coalesce(b, 0.0) as recognised_m, coalesce(c, 0.0) as reusable_m, coalesce(d, 0.0) as declassified_m, coalesce(u, 0.0) as unknown_m, coalesce(v, 0.0) as delivered_m,
        coalesce(la.l, 0.0) as longest_m, coalesce(lb.l, 0.0) as longest_recognised_m, coalesce(lc.l, 0.0) as longest_reusable_m, round(coalesce(a, 0.0) / size, 9) as matched_part, round(coalesce(b, 0.0) / size, 9) as recognised_part, round(coalesce(c, 0.0) / size, 9) as reusable_part
    from lines left join total using (id) left join la using (id) left join lb using (id) left join lc using (id)"""


def interval_difference(spark, sf_dir):
    """Days of a customer that finished orders cover and open ones do not."""
    rows = _spans(spark, sf_dir).select("id", "start_m", "end_m", "recognised")
    return I.combine(rows.where("recognised"), rows.where("not recognised"), ["id"], "difference")


DIFFERENCE = f"""with {SPANS_SQL}, marks as (select id, s as p from m union select id, t from m), step as (select id, p as s, lead(p) over (partition by id order by p) as t from marks),
    cut as (select id, s, t from step where t is not null and exists (select 1 from m where m.id = step.id and f0 and m.s <= step.s and m.t >= step.t) and not exists (select 1 from m where m.id = step.id and not f0 and m.s <= step.s and m.t >= step.t)),
    r as (select *, sum(gap) over (partition by id order by s) as run from (select *, case when lag(t) over (partition by id order by s) = s then 0 else 1 end as gap from cut))
    select id, min(s) as start_m, max(t) as end_m from r group by id, run"""


def _ways(spark, sf_dir):
    return transitions(spark, sf_dir).select(F.concat_ws(">", "src", "dst").alias("edge_id"), "src", "dst", "weight")


def witness_paths(spark, sf_dir):
    """One cheapest way from each node of number 0 to 3 to every node of its number, edge by edge."""
    e = _ways(spark, sf_dir)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("k", F.element_at(F.split("node", "-"), -1)).where("k < '4'")
    pairs = ends.withColumnRenamed("node", "origin").join(ends.withColumnRenamed("node", "destination"), "k")
    return W.witness_paths(pairs, e).select("origin", "destination", "place", "edge_id", "cost")


ALL_COSTS = f"""{TRANSITIONS_SQL}, nodes as (select src as node from edges union select dst from edges),
    walk(root, node, cost) using key (root, node) as (select node, node, 0::bigint from nodes
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join edges e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst)"""
WITNESS = f"""with recursive {ALL_COSTS}, asked as (select root as origin, node as destination, cost as total from walk where root <> node and split_part(root, '-', 2) < '4' and split_part(root, '-', 2) = split_part(node, '-', 2)),
    step as (select origin, destination, e.src, min(row(e.src || '>' || e.dst, e.dst)) as s from asked join walk a on a.root = origin join edges e on e.src = a.node join walk b on b.root = e.dst and b.node = destination where a.cost + e.weight + b.cost = total group by 1, 2, 3),
    way(origin, destination, total, node, place, edge_id) as (select origin, destination, total, origin, -1::bigint, '' from asked
        union all select w.origin, w.destination, total, s[2], place + 1, s[1] from way w join step on step.origin = w.origin and step.destination = w.destination and step.src = w.node)
    select origin, destination, place, edge_id, total as cost from way where place >= 0"""


def directness(spark, sf_dir):
    """Ways over common steps against straight lines between made-up coordinates; rare steps are of unknown access."""
    e = transitions(spark, sf_dir)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    at = lambda a: F.conv(F.substring(F.md5("node"), a, 3), 16, 10).cast("double")
    asked = ends.select(F.col("node").alias("origin")).crossJoin(ends.select(F.col("node").alias("destination")).where("destination like '%-1'"))
    asked = asked.select(F.concat_ws(">", "origin", "destination").alias("obligation_id"), "origin", "destination")
    common = F.conv(F.substring(F.md5(F.concat_ws(">", "src", "dst")), 1, 2), 16, 10).cast("int") % 3 > 0
    step = e.select("src", "dst", "weight", common.alias("common"))
    rows = W.directness(asked, ends.select("node", at(1).alias("x"), at(4).alias("y")), step.where("common"), step.where("not common"))
    return rows.withColumn("ratio", F.round("ratio", 9))


DIRECT = f"""with recursive {TRANSITIONS_SQL}, rated as (select src, dst, weight, ('0x' || substring(md5(src || '>' || dst), 1, 2))::bigint % 3 > 0 as common from edges), nodes as (select src as node from edges union select dst from edges),
    xy as (select node, ('0x' || substring(md5(node), 1, 3))::bigint::double as x, ('0x' || substring(md5(node), 4, 3))::bigint::double as y from nodes),
    walk(root, node, cost) using key (root, node) as (select node, node, 0::bigint from nodes
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join rated e on e.src = w.node and e.common left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst),
    reach(root, node) as (select node, node from nodes union select root, dst from reach join rated on src = node)
    select a.node || '>' || b.node as obligation_id, w.cost as network_mm, {_MM('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))')} as straight_mm, case when w.cost is not null then 'available' when r.root is not null then 'unknown' else 'no-path' end as state,
        round(case when {_MM('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))')} > 0 then w.cost / {_MM('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))')} end, 9) as ratio
    from xy a join xy b on b.node like '%-1' left join walk w on w.root = a.node and w.node = b.node left join reach r on r.root = a.node and r.node = b.node"""


def connector_lineage(spark, sf_dir):
    """Parts as places that hang on the part of a third of their number; each meets the part of seven times its number."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.col("p_size").cast("long").alias("size"))
    n = p.agg(F.max("k").alias("n"))
    links = p.where("k % 50 > 0").select(F.concat(F.lit("c"), "k").alias("connection_id"), F.col("k").alias("place"), F.floor(F.col("k") / 3).alias("parent_place"), F.col("p_brand").alias("branch_id"), F.col("size").alias("length_mm"))
    meetings = p.crossJoin(n).select(F.col("k").alias("meeting_id"), F.col("k").alias("from_place"), (F.col("k") * 7 % F.col("n")).alias("to_place"), F.col("size").alias("length_mm"))
    rows = N.connectors(meetings, links)
    return rows.withColumn("roots", F.array_join(F.transform("roots", lambda x: x.cast("string")), ","))


LINEAGE = """with recursive p as (select p_partkey as k, p_brand, cast(p_size as bigint) as size from part), links as (select * from p where k % 50 > 0),
    starts as (select k as id, k as item from p union select k, k * 7 % (select max(k) from p) from p),
    walk(id, item, steps) as (select id, item, 0 from starts union select id, cast(floor(links.k / 3) as bigint), steps + 1 from walk join links on links.k = item),
    seen as (select id, item, min(steps) as steps from walk group by id, item),
    g as (select id, count(links.k) as n, count(distinct p_brand) as b, coalesce(string_agg(case when links.k is null then item::varchar end, ',' order by item), '') as roots, min(p_brand) as first, max(steps) as depth, coalesce(sum(size), 0) as size from seen left join links on links.k = item group by id)
    select id as meeting_id, n as n_connections, b as n_branches, roots, first as first_branch, cast(depth as bigint) as depth, cast(p.size + g.size as bigint) as length_mm from g join p on p.k = g.id"""


def circle_witnesses(spark, sf_dir):
    """A circle of each strong component of customers' steps between kinds of event."""
    return N.circle_witnesses(transitions(spark, sf_dir).select("src", "dst"))


def cell_portals(spark, sf_dir):
    return B.cell_portals(_lines(spark, sf_dir), CELL_M)


PORTALS_SQL = f"""{LINES_SQL}, px as (select id, k, z.ay + (k * {CELL_M} - z.ax) / (z.bx - z.ax) * (z.by - z.ay) as v from (select *, unnest(generate_series(cast(ceil(least(g.ax, g.bx) / {CELL_M}) as bigint), cast(floor(greatest(g.ax, g.bx) / {CELL_M}) as bigint))) as k from sized g where g.ax <> g.bx and size > 0) z
        union all select id, cast(ax / {CELL_M} as bigint), unnest([g.ay, g.by]) from sized g where g.ax = g.bx and size > 0 and ax / {CELL_M} = floor(ax / {CELL_M})),
    py as (select id, k, z.ax + (k * {CELL_M} - z.ay) / (z.by - z.ay) * (z.bx - z.ax) as v from (select *, unnest(generate_series(cast(ceil(least(g.ay, g.by) / {CELL_M}) as bigint), cast(floor(greatest(g.ay, g.by) / {CELL_M}) as bigint))) as k from sized g where g.ay <> g.by and size > 0) z
        union all select id, cast(ay / {CELL_M} as bigint), unnest([g.ax, g.bx]) from sized g where g.ay = g.by and size > 0 and ay / {CELL_M} = floor(ay / {CELL_M})),
    ports as (select distinct id, k - 1 as left_x, r as left_y, k as right_x, r as right_y, cast(round_even(k * {CELL_M} * 1000, 0) as bigint) as x_mm, cast(round_even(v * 1000, 0) as bigint) as y_mm
            from (select *, unnest(case when v / {CELL_M} = floor(v / {CELL_M}) then [cast(floor(v / {CELL_M}) as bigint) - 1, cast(floor(v / {CELL_M}) as bigint)] else [cast(floor(v / {CELL_M}) as bigint)] end) as r from px)
        union select distinct id, r, k - 1, r, k, cast(round_even(v * 1000, 0) as bigint), cast(round_even(k * {CELL_M} * 1000, 0) as bigint)
            from (select *, unnest(case when v / {CELL_M} = floor(v / {CELL_M}) then [cast(floor(v / {CELL_M}) as bigint) - 1, cast(floor(v / {CELL_M}) as bigint)] else [cast(floor(v / {CELL_M}) as bigint)] end) as r from py))"""
PORTALS = f"with {PORTALS_SQL} select * from ports"


def top_portals(spark, sf_dir):
    """The four portals of each cell that lie farthest from its middle."""
    p = B.cell_portals(_lines(spark, sf_dir), CELL_M)
    both = p.select(F.struct(F.col("left_x").alias("x"), F.col("left_y").alias("y")).alias("area"), "x_mm", "y_mm").union(p.select(F.struct("right_x", "right_y"), "x_mm", "y_mm"))
    both = both.select("area", F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y"))
    middle = lambda c: (F.col(f"area.{c}") + 0.5) * CELL_M * 1000
    rows = B.top_portals(both, both.select("area", middle("x").alias("cx"), middle("y").alias("cy")).distinct(), "area")
    return rows.select(F.col("area.x").alias("cell_x"), F.col("area.y").alias("cell_y"), "x", "y", F.round("distance", 3).alias("distance"), F.col("place").cast("long").alias("place"))


TOP = f"""with {PORTALS_SQL}, b as (select left_x as cell_x, left_y as cell_y, x_mm, y_mm from ports union select right_x, right_y, x_mm, y_mm from ports),
    d as (select cell_x, cell_y, cast(x_mm as double) as x, cast(y_mm as double) as y, sqrt(pow(x_mm - (cell_x + 0.5) * {CELL_M * 1000}, 2) + pow(y_mm - (cell_y + 0.5) * {CELL_M * 1000}, 2)) as distance from b)
    select cell_x, cell_y, x, y, round(distance, 3) as distance, row_number() over (partition by cell_x, cell_y order by distance desc, x, y) as place from d qualify place <= 4"""


def gateways(spark, sf_dir):
    """Squares around regions' places; lines that leave them, and nations as the centres they may lead to."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ring"), (F.col("r_regionkey") * 900 - 1800).cast("double").alias("x"), (F.col("r_regionkey") * 500 - 1000).cast("double").alias("y"))
    x0, x1, y0, y1 = F.col("x") - 411.5, F.col("x") + 411.5, F.col("y") - 233.5, F.col("y") + 233.5
    leg = lambda a, b, c, d: F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"))
    rings = r.select("ring", F.explode(F.array(leg(x0, y0, x1, y0), leg(x1, y0, x1, y1), leg(x1, y1, x0, y1), leg(x0, y1, x0, y0))).alias("l")).select("ring", "l.*")
    centres = table(spark, sf_dir, "nation").select(F.col("n_name").alias("centre_id"), (F.col("n_nationkey") * 997 % 11000 - 5500).cast("double").alias("x"), (F.col("n_nationkey") * 1693 % 9000 - 4500).cast("double").alias("y"))
    rows = B.gateways(_lines(spark, sf_dir), rings, centres, SIDE_M)
    return rows.select("ring", "centre_id", "line_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "score")])


GATEWAYS = f"""with {LINES_SQL}, box as (select r_regionkey as ring, r_regionkey * 900 - 1800 - 411.5::double as x0, r_regionkey * 900 - 1800 + 411.5::double as x1, r_regionkey * 500 - 1000 - 233.5::double as y0, r_regionkey * 500 - 1000 + 233.5::double as y1 from region),
    wall as (select ring, x0 as cx, y0 as cy, x1 as dx, y0 as dy, * from box union all select ring, x1, y0, x1, y1, * from box union all select ring, x1, y1, x0, y1, * from box union all select ring, x0, y1, x0, y0, * from box),
    turn as (select id, ring, x0, x1, y0, y1, g.ax, g.ay, g.bx - g.ax as hx, g.by - g.ay as hy, (g.bx - g.ax) * (dy - cy) - (g.by - g.ay) * (dx - cx) as t, (cx - g.ax) * (dy - cy) - (cy - g.ay) * (dx - cx) as u, (cx - g.ax) * (g.by - g.ay) - (cy - g.ay) * (g.bx - g.ax) as v from sized g, wall where size > 0),
    hit as (select distinct id, ring, x0, x1, y0, y1, ax + u / t * hx as x, ay + u / t * hy as y from turn where t <> 0 and u / t between 0 and 1 and v / t between 0 and 1),
    tips as (select id, 0 as k, x0 as ox, y0 as oy from lines union all select id, 1, x2, y2 from lines),
    away as (select hit.id, ring, x, y, min(row(sqrt(pow(ox - x, 2) + pow(oy - y, 2)), k, ox, oy)) as o from hit join tips using (id) where not (ox > x0 and ox < x1 and oy > y0 and oy < y1) group by hit.id, ring, x, y),
    towards as (select away.id, ring, x, y, o[3] - x as gx, o[4] - y as gy, sqrt(pow(o[3] - x, 2) + pow(o[4] - y, 2)) as g, n_name, (n_nationkey * 997 % 11000 - 5500)::double - x as tx, (n_nationkey * 1693 % 9000 - 4500)::double - y as ty from away, nation),
    scored as (select *, case when g = 0 then sqrt(tx * tx + ty * ty) else case when (tx * gx + ty * gy) / g <= 0 then 10.0 else 0.0 end + abs(tx * gy - ty * gx) / g + sqrt(tx * tx + ty * ty) * 0.1 end as score from towards),
    best as (select id, ring, x, y, min(row(score, n_name)) as b from scored group by 1, 2, 3, 4),
    named as (select ring, b[2] as centre_id, min(row(b[1], id, x, y)) as g from best group by ring, b[2]), rest as (select ring, min(row(id, x, y)) as g from hit where not exists (select 1 from away where away.id = hit.id and away.ring = hit.ring and away.x = hit.x and away.y = hit.y) group by ring)
    select ring, centre_id, g[2] as line_id, round(g[3], 6) as x, round(g[4], 6) as y, round(g[1], 6) as score from named union all select ring, null, g[1], round(g[2], 6), round(g[3], 6), null from rest"""


def seeded_alignment(spark, sf_dir):
    """Three lines of neighbouring ids as the options of a group; lines with an even number are the reference, too."""
    rows = _lines(spark, sf_dir)
    options = rows.select(F.floor(F.col("id") / 3).alias("group_id"), F.col("id").alias("option_id"), "points")
    first = options.groupBy("group_id").agg(F.min(F.struct("option_id", "points")).alias("o")).select("group_id", F.col("o.points").alias("p"))
    ends = first.select("group_id", F.col("p")[0]["x"].alias("ax"), F.col("p")[0]["y"].alias("ay"), F.element_at("p", -1)["x"].alias("bx"), F.element_at("p", -1)["y"].alias("by"))
    chosen = H.seeded_alignment(options, rows, ends, SEED_M, SIDE_M)
    return chosen.select("group_id", "option_id", millimetres(F.col("distance")).alias("distance_mm"), "n_references")


SEEDED = f"""with {LINES_SQL}, o as (select id as option_id, cast(floor(id / 3) as bigint) as group_id, * from lines), first as (select group_id, arg_min(row(x0, y0, x2, y2), option_id) as p from o group by group_id),
    tips as (select group_id, 0 as k, p[1] as px, p[2] as py from first union all select group_id, 1, p[3], p[4] from first),
    near as (select group_id, t.id from tips join sized t on t.size > 0 and {_to_leg('px', 'py', 't')} <= {SEED_M} group by group_id, t.id having count(distinct k) = 2),
    spot as (select option_id as id, group_id, unnest([row(x0, y0), row(x1, y1), row(x2, y2)]) as p from o),
    there as (select s.group_id, s.id as option_id, min({_to_leg('s.p[1]', 's.p[2]', 't')}) as d from spot s join near n on n.group_id = s.group_id join sized t on t.id = n.id and t.size > 0 group by s.group_id, s.id, s.p),
    back as (select n.group_id, o.option_id, min({_to_leg('s.p[1]', 's.p[2]', 't')}) as d from near n join spot s on s.id = n.id join o on o.group_id = n.group_id join sized t on t.id = o.option_id and t.size > 0 group by n.group_id, o.option_id, s.id, s.p),
    far as (select group_id, option_id, max(d) as d from (select group_id, option_id, d from there union all select * from back) group by 1, 2)
    select group_id, arg_min(option_id, row(d, option_id)) as option_id, {_MM('min(d)')} as distance_mm, any_value(n) as n_references from far join (select group_id, count(*) as n from near group by group_id) using (group_id) group by group_id"""


def _web(spark, sf_dir):
    """Lines drawn out three times as long, so that they cross."""
    wide = lambda p, o: F.struct((o["x"] + (p["x"] - o["x"]) * 3).alias("x"), (o["y"] + (p["y"] - o["y"]) * 3).alias("y"))
    rows = _lines(spark, sf_dir).withColumn("o", F.col("points")[0])
    return rows.select("id", F.transform("points", lambda p: wide(p, F.col("o"))).alias("points"))


def planar_faces(spark, sf_dir):
    """Faces of the lines' linework, told by their smallest half-edge."""
    edges = P.noded(_web(spark, sf_dir), SIDE_M)
    rows = P.faces(P.half_edges(edges))
    return rows.select(F.concat_ws("/", "face.edge_id", "face.way").alias("face"), "n_edges", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


def _cells(spark, sf_dir):
    rows = _web(spark, sf_dir)
    return P.low_traffic_cells(rows.where("id % 3 > 0").withColumn("governed", F.col("id") % 5 > 0), rows.where("id % 3 = 0").withColumn("residential", F.col("id") % 2 == 0), SIDE_M, most_ungoverned_share=0.2, least_streets=1)


def low_traffic_cells(spark, sf_dir):
    rows = _cells(spark, sf_dir)[0]
    return rows.select(F.concat_ws("/", "face.edge_id", "face.way").alias("face"), F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), "n_streets", "n_portals")


def area_portals(spark, sf_dir):
    rows = _cells(spark, sf_dir)[1]
    return rows.select(F.concat_ws("/", "face.edge_id", "face.way").alias("face"), "boundary_id", "x_mm", "y_mm")


def area_graph(spark, sf_dir):
    rows = _cells(spark, sf_dir)[2]
    return rows.select(F.concat_ws("/", "left.edge_id", "left.way").alias("left_face"), F.concat_ws("/", "right.edge_id", "right.way").alias("right_face"), "n_common")


def candidate_sets(spark, sf_dir):
    """Candidates between neighbouring kinds of event of number 0, by rarity and by how common the steps are; some steps are prohibited."""
    e = transitions(spark, sf_dir).withColumn("edge_id", F.concat_ws(">", "src", "dst"))
    allowed = F.conv(F.substring(F.md5("edge_id"), 1, 2), 16, 10).cast("int") % 4 > 0
    edges = e.select("edge_id", "src", "dst", allowed.alias("allowed"), F.col("weight").alias("length"), F.col("n").alias("busy"))
    asked = e.where("src like '%-0'").select(F.col("edge_id").alias("obligation_id"), F.col("src").alias("origin"), F.col("dst").alias("destination"))
    rows, _ = D.discover(asked, edges, ["length", "busy"], k=3, detour_ceiling=1.5, max_candidates=3)
    return rows.select("obligation_id", F.array_join("strategies", ",").alias("strategies"), F.array_join("edge_ids", " ").alias("edge_ids"), "length", "prohibited", "state")


CANDIDATES = f"""with recursive {TRANSITIONS_SQL}, e as (select src || '>' || dst as edge_id, src, dst, weight, n, ('0x' || substring(md5(src || '>' || dst), 1, 2))::bigint % 4 > 0 as ok from edges),
    walk(id, goal, node, nodes, ids, size, busy, ok) as (select edge_id, dst, src, [src], []::varchar[], 0::bigint, 0::bigint, true from e where src like '%-0'
        union all select id, goal, e.dst, list_append(nodes, e.dst), list_append(ids, e.edge_id), size + e.weight, busy + e.n, walk.ok and e.ok from walk join e on e.src = walk.node where walk.node <> goal and not list_contains(nodes, e.dst)),
    whole as (select * from walk where node = goal), direct as (select id, coalesce(min(size) filter (where ok), min(size)) as direct from whole group by id),
    ranked as (select *, 'length' as strategy, 0 as s, row_number() over (partition by id order by size, nodes, ids) as place from whole union all select *, 'busy', 1, row_number() over (partition by id order by busy, nodes, ids) from whole),
    one as (select id, ids, string_agg(strategy, ',' order by strategy) as strategies, min(s * 100 + place) as turn, any_value(size) as size, not any_value(ok) as prohibited from ranked where place <= 3 group by id, ids),
    told as (select one.*, size > direct * 1.5 + 1e-9 and not prohibited as far from one join direct using (id))
    select id as obligation_id, strategies, array_to_string(ids, ' ') as edge_ids, size as length, prohibited, case when far then 'detour-suppressed' when row_number() over (partition by id, far order by turn) > 3 then 'candidate-budget' else 'candidate' end as state from told"""


def line_samples(spark, sf_dir):
    """Requests as samples of a height along each line within 120 m, with their rise and fall."""
    samples = _requests(spark, sf_dir).withColumnRenamed("point_id", "sample_id").withColumn("value", (F.col("sample_id") * 7 % 100).cast("double"))
    lines = _lines(spark, sf_dir)
    found = K.samples_on_lines(samples, lines, NEAR_M, SIDE_M)
    rows = K.variation(found, lines.select("id", F.lit(0.0).alias("length_m")))
    return rows.select("line_id", "n_samples", "rise", "fall")


SAMPLES = f"""with {LINES_SQL}, {REQUESTS_SQL},
    near as (select point_id, t.id, min(row(d, seq, m)) as b from (select point_id, t.id, t.seq, {_to_leg('px', 'py', 't')} as d, t.from_m + ({_fraction('px', 'py', 't')}) * t.size as m from req join sized t on t.size > 0) t where d <= {NEAR_M} group by point_id, t.id),
    kept as (select id, max(row(point_id, b[3])) as k from near group by id, round(b[3], 6)),
    v as (select id, k[2] as m, cast(k[1] * 7 % 100 as double) as h from kept), s as (select id, h - lag(h) over (partition by id order by m) as d from v)
    select lines.id as line_id, count(s.id) as n_samples, case when count(s.id) > 0 then coalesce(sum(greatest(d, 0.0)), 0.0) end as rise, case when count(s.id) > 0 then coalesce(sum(greatest(-d, 0.0)), 0.0) end as fall from lines left join s using (id) group by lines.id"""


def continuous_linework(spark, sf_dir):
    """Streets between near points put together to lines through points of two streets."""
    _, e = _near(spark, sf_dir)
    rows = K.chains(e.where("src < dst").select(F.concat_ws("-", "src", "dst").alias("edge_id"), F.col("src").alias("a"), F.col("dst").alias("b")))
    return rows.select(F.concat_ws("/", "line.edge_id", "line.way").alias("line"), "place", "edge_id", "way")


PLANS = {
    "candidate_sets": (candidate_sets, CANDIDATES),
    "line_samples": (line_samples, SAMPLES),
    "continuous_linework": (continuous_linework, None),
    "places_on_lines": (places_on_lines, PLACES),
    "nodes_on_lines": (nodes_on_lines, NODES),
    "point_attachments": (point_attachments, ATTACHMENTS),
    "best_point_attachment": (best_point_attachment, BEST),
    "reuse_advantage": (reuse_advantage, REUSE),
    "interval_difference": (interval_difference, DIFFERENCE),
    "witness_paths": (witness_paths, WITNESS),
    "directness": (directness, DIRECT),
    "connector_lineage": (connector_lineage, LINEAGE),
    "circle_witnesses": (circle_witnesses, None),
    "cell_portals": (cell_portals, PORTALS),
    "top_portals": (top_portals, TOP),
    "gateways": (gateways, GATEWAYS),
    "seeded_alignment": (seeded_alignment, SEEDED),
    "planar_faces": (planar_faces, None),
    "low_traffic_cells": (low_traffic_cells, None),
    "area_portals": (area_portals, None),
    "area_graph": (area_graph, None),
}
