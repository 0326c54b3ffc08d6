"""Attachment, tie, control and severance queries over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import routing as R
from .network import NEAR_SQL, _near
from .tables import TRANSITIONS_SQL, table, transitions

#: Nodes are named after an event type and one of nine numbers; nodes of one type are a group.
DAY = dt.date(1996, 6, 1)


def _edges(spark, sf_dir):
    return transitions(spark, sf_dir).select("src", "dst", "weight")


def _groups(spark, sf_dir):
    nodes = _edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.select(F.element_at(F.split("node", "-"), 1).alias("group_id"), "node")


# All costs of ways over reciprocal edges, from every node.
COSTS_SQL = f"""{TRANSITIONS_SQL}, two as (select src, dst, min(weight) as weight from edges e where exists (select 1 from edges r where r.src = e.dst and r.dst = e.src) group by src, dst),
    nodes as (select src as node from edges union select dst from edges), g as (select node, split_part(node, '-', 1) as group_id from nodes),
    walk(root, node, cost) using key (root, node) as (select node, node, 0::bigint from nodes
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join two e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst)"""


def group_bounds(spark, sf_dir):
    return R.group_bounds(_groups(spark, sf_dir), _edges(spark, sf_dir))


BOUNDS = f"""with recursive {COSTS_SQL} select a.group_id as left_id, b.group_id as right_id, min(cost) as bound from walk join g a on a.node = root join g b on b.node = walk.node where a.group_id < b.group_id group by 1, 2"""


def attachment(spark, sf_dir):
    """The best places at which each kind of event attaches to the next one by name; a place's snap comes of its number, and nodes of number 0 are excluded as pairs."""
    number = lambda c: F.element_at(F.split(c, "-"), -1).cast("long")
    g = _groups(spark, sf_dir)
    kinds = g.select("group_id").distinct()
    after = kinds.join(kinds.withColumnRenamed("group_id", "next_id"), F.col("next_id") > F.col("group_id")).groupBy(F.col("group_id").alias("request_id")).agg(F.min("next_id").alias("group_id"))
    starts = g.select(F.col("group_id").alias("request_id"), "node", (number("node") * 3 % 7).alias("snap"))
    ends = g.join(after, "group_id").select("request_id", "node", (number("node") * 5 % 8).alias("snap"))
    same = starts.select("request_id", F.col("node").alias("start")).join(ends.select("request_id", F.col("node").alias("end")), "request_id").where(number("start") + number("end") == 0)
    return R.best_attachment(starts, ends, _edges(spark, sf_dir), same)


ATTACHMENT = f"""with recursive {COSTS_SQL}, kinds as (select distinct group_id from g), after as (select a.group_id as request_id, min(b.group_id) as group_id from kinds a join kinds b on b.group_id > a.group_id group by 1),
    c as (select a.group_id as request_id, a.node as start, b.node as "end", split_part(a.node, '-', 2)::bigint * 3 % 7 as start_snap, split_part(b.node, '-', 2)::bigint * 5 % 8 as end_snap, cost
        from walk join g a on a.node = root join g b on b.node = walk.node join after on after.request_id = a.group_id and after.group_id = b.group_id where split_part(a.node, '-', 2)::bigint + split_part(b.node, '-', 2)::bigint > 0),
    k as (select *, start_snap + cost + end_snap as total, row_number() over (partition by request_id order by start_snap + cost + end_snap, start_snap, end_snap, start, "end") as place from c)
    select request_id, start, "end", start_snap, end_snap, cost, total from k where place = 1"""


def route_ties(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return R.route_ties(e.where("src like '%-0'").select(F.col("src").alias("origin"), F.col("dst").alias("destination")), e)


TIES = f"""with recursive {TRANSITIONS_SQL}, asked as (select distinct src as origin, dst as destination from edges where src like '%-0'),
    walk(root, node, cost) using key (root, node) as (select distinct origin, origin, 0::bigint from asked
        union select w.root, e.dst, min(w.cost + e.weight) from walk w join edges e on e.src = w.node left join recurring.walk r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst),
    pred as (select w.root, w.node, e.src as previous from walk w join edges e on e.dst = w.node join walk p on p.root = w.root and p.node = e.src and p.cost + e.weight = w.cost where w.node <> w.root),
    fork as (select root, node from pred group by root, node having count(*) > 1),
    back(origin, destination, node) as (select origin, destination, destination from asked union select b.origin, b.destination, p.previous from back b join pred p on p.root = b.origin and p.node = b.node)
    select a.origin, a.destination, cast(w.cost as double) as cost, exists (select 1 from back b join fork f on f.root = b.origin and f.node = b.node where b.origin = a.origin and b.destination = a.destination) as tied
    from asked a join walk w on w.root = a.origin and w.node = a.destination"""


def _ledger(spark, sf_dir):
    """Orders as decisions on their customers."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(key % 7 == 0, "rejected").when(key % 11 == 0, "superseded").otherwise("active")
    until = F.when(key % 3 > 0, F.date_add(F.to_date("o_orderdate"), 900))
    action = F.when(F.col("o_orderstatus") == "F", "exclude-from-routing").otherwise("mark")
    rows = o.select(key.alias("decision_id"), F.col("o_custkey").alias("target_id"), action.alias("action"), status.alias("status"), F.to_date("o_orderdate").alias("effective_from"), until.alias("effective_until"))
    return R.ledger_states(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id")), DAY)


def officer_overlay(spark, sf_dir):
    return _ledger(spark, sf_dir).select("decision_id", "target_id", "action", "state")


LEDGER_SQL = f"""ledger as (select o_orderkey as decision_id, o_custkey as target_id, case when o_orderstatus = 'F' then 'exclude-from-routing' else 'mark' end as action,
    case when o_custkey not in (select c_custkey from customer) then 'unknown-target' when o_orderkey % 7 <> 0 and o_orderkey % 11 = 0 then 'superseded'
        when o_orderkey % 7 <> 0 and cast(o_orderdate as date) <= date '{DAY}' and (o_orderkey % 3 = 0 or date '{DAY}' <= cast(o_orderdate as date) + 900) then 'applied' else 'rejected' end as state from orders)"""
OVERLAY = f"with {LEDGER_SQL} select * from ledger"


def route_controls(spark, sf_dir):
    """Ways from nodes of number 0 when every edge whose customer has an applied exclusion is taken out; customers are bound to edges by a hash of both names."""
    e = transitions(spark, sf_dir).select(F.concat_ws(">", "src", "dst").alias("edge_id"), "src", "dst", "weight")
    bound = e.select("edge_id", (F.conv(F.substring(F.md5("edge_id"), 1, 4), 16, 10).cast("long") % 150 + 1).alias("target_id"))
    kept = R.controlled_edges(e, bound, _ledger(spark, sf_dir))
    return R.controlled_routes(e.where("src like '%-0'").select(F.col("src").alias("origin"), F.col("dst").alias("destination")), e, kept)


def _walk(name: str, edges: str) -> str:
    return f"""{name}(root, node, cost) using key (root, node) as (select distinct origin, origin, 0::bigint from asked
        union select w.root, e.dst, min(w.cost + e.weight) from {name} w join {edges} e on e.src = w.node left join recurring.{name} r on r.root = w.root and r.node = e.dst where r.cost is null or r.cost > w.cost + e.weight group by w.root, e.dst)"""


CONTROLS = f"""with recursive {TRANSITIONS_SQL}, {LEDGER_SQL}, asked as (select distinct src as origin, dst as destination from edges where src like '%-0'),
    kept as (select * from edges where ('0x' || substring(md5(src || '>' || dst), 1, 4))::bigint % 150 + 1 not in (select target_id from ledger where state = 'applied' and action = 'exclude-from-routing')),
    {_walk('free', 'edges')}, {_walk('held', 'kept')}
    select origin, destination, f.cost as base_cost, h.cost as controlled_cost, case when f.cost is null then 'no-path' when h.cost is null then 'severed' when h.cost > f.cost then 'detour' else 'unchanged' end as state
    from asked a left join free f on f.root = a.origin and f.node = a.destination left join held h on h.root = a.origin and h.node = a.destination"""


def severance(spark, sf_dir):
    """Bridges that part a point from the one of the next id but one."""
    nodes, links = _near(spark, sf_dir)
    edges = links.where("src < dst").select(F.concat_ws("-", "src", "dst").alias("edge_id"), "src", "dst")
    asked = nodes.select(F.col("node").alias("obligation_id"), F.col("node").alias("a"), (F.col("node") + 2).alias("b")).union(links.where("src < dst").select((F.col("src") * 1000000 + F.col("dst")).alias("obligation_id"), "src", "dst"))
    return G.severance(asked, edges)


SEVERANCE = f"""with recursive {NEAR_SQL}, e as (select src || '-' || dst as edge_id, src, dst from links where src < dst),
    asked as (select vec_id as obligation_id, vec_id as a, vec_id + 2 as b from pts union all select src * 1000000 + dst, src, dst from e),
    walk(edge_id, node) as (select edge_id, src from e union select w.edge_id, l.dst from walk w join links l on l.src = w.node where least(l.src, l.dst) || '-' || greatest(l.src, l.dst) <> w.edge_id),
    bridge as (select edge_id, src, dst from e where not exists (select 1 from walk w where w.edge_id = e.edge_id and w.node = e.dst)),
    far(edge_id, node) as (select edge_id, dst from bridge union select f.edge_id, l.dst from far f join links l on l.src = f.node where least(l.src, l.dst) || '-' || greatest(l.src, l.dst) <> f.edge_id)
    select o.obligation_id, b.edge_id from bridge b join walk s on s.edge_id = b.edge_id join far f on f.edge_id = b.edge_id join asked o on (o.a = s.node and o.b = f.node) or (o.b = s.node and o.a = f.node)"""

PLANS = {
    "group_bounds": (group_bounds, BOUNDS),
    "attachment": (attachment, ATTACHMENT),
    "route_ties": (route_ties, TIES),
    "officer_overlay": (officer_overlay, OVERLAY),
    "route_controls": (route_controls, CONTROLS),
    "severance": (severance, SEVERANCE),
}
