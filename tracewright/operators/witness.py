"""Witness paths: one way of least cost for each pair, as its edges in order, always the same one; directness; ways between named roots.

Costs are found from all origins forwards and from all destinations backwards.  Where both add up to the least cost a node lies on a way; each such node
points at its next one, and doubling these pointers gives the path's edges in a number of rounds that grows with its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import millimetres
from . import trees
from .attachment import nodes_on_lines
from .components import checkpointed
from .graph import shortest_paths

_PAIR = ["origin", "destination"]


def least(pairs: DataFrame, edges: DataFrame, max_cost: int | None = None) -> DataFrame:
    """(origin, destination, cost) of the pairs that have a way.  ``edges``: src, dst, weight."""
    asked = pairs.select(*_PAIR).distinct()
    found = shortest_paths(asked.select(F.col("origin").alias("node")), edges, max_cost=max_cost)
    return asked.join(found.select(F.col("root").alias("origin"), F.col("node").alias("destination"), "cost"), _PAIR)


def witness_paths(pairs: DataFrame, edges: DataFrame, by: str = "edge", max_cost: int | None = None) -> DataFrame:
    """The edges of each pair's path in order: origin, destination, place (from 0), edge_id, src, dst, cost (of the whole path).

    ``pairs``: origin, destination.  ``edges``: edge_id, src, dst, weight (a whole number above 0), directed.  Of several ways of least cost the one is
    taken whose edge_ids come first, compared one after the other from the origin; with ``by="node"`` the one whose nodes do (and between two nodes the first
    edge).  Pairs without a way, and those of one node, have no rows.
    """
    asked = pairs.select(*_PAIR).where("origin <> destination").distinct()
    bad = edges.where("weight is null or weight <= 0").select("edge_id").first()
    if bad:
        raise ValueError(f"edge {bad[0]} has no positive weight")
    plain = checkpointed(edges.where("src <> dst").select("edge_id", "src", "dst", "weight"))
    there = checkpointed(shortest_paths(asked.select(F.col("origin").alias("node")), plain, max_cost=max_cost).select(F.col("root").alias("origin"), "node", F.col("cost").alias("gone")))
    turned = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    back = shortest_paths(asked.select(F.col("destination").alias("node")), turned, max_cost=max_cost).select(F.col("root").alias("destination"), "node", F.col("cost").alias("left"))
    total = asked.join(there.select("origin", F.col("node").alias("destination"), F.col("gone").alias("cost")), _PAIR)
    on_way = checkpointed(total.join(there, "origin").where("gone <= cost").join(back, ["destination", "node"]).where("gone + left = cost").select(*_PAIR, "node", "gone", "cost"))
    step = on_way.join(plain, F.col("node") == F.col("src")).withColumn("then", F.col("gone") + F.col("weight"))
    step = step.join(on_way.select(*_PAIR, F.col("node").alias("dst"), F.col("gone").alias("then")), [*_PAIR, "dst", "then"])
    rank = ["edge_id", "dst"] if by == "edge" else ["dst", "edge_id"]
    first = checkpointed(step.groupBy(*_PAIR, "node", "cost").agg(F.min(F.struct(*rank)).alias("s")).select(*_PAIR, F.col("node").alias("src"), "cost", "s.edge_id", "s.dst"))
    key = lambda node: F.struct("origin", "destination", F.col(node).alias("node"))
    chain = first.select(key("src").alias("item"), key("dst").alias("next"), F.lit(1).cast("long").alias("steps"))
    ends = first.select(key("destination").alias("item"), F.lit(None).cast(chain.schema["next"].dataType).alias("next"), F.lit(0).cast("long").alias("steps")).distinct()
    chain = checkpointed(chain.union(ends))
    length = trees.along(chain, ["steps"]).where(F.col("item.node") == F.col("item.origin")).select(F.col("item").alias("node"), (F.col("steps") - 1).alias("steps"))
    table = trees.ancestors(chain.select(F.col("item").alias("node"), F.col("next").alias("up")))
    nodes = trees.ways_up(length, table).select("node.origin", "node.destination", F.col("node.node").alias("src"), "at")
    return nodes.join(first, [*_PAIR, "src"]).select(*_PAIR, F.col("at").alias("place"), "edge_id", "src", "dst", "cost")


def directness(obligations: DataFrame, nodes: DataFrame, known: DataFrame, unknown: DataFrame) -> DataFrame:
    """How much longer than the straight line each obligation's way is, over known edges alone.

    ``obligations``: obligation_id, origin, destination.  ``nodes``: node, x, y.  ``known``, ``unknown``: src, dst, weight (mm), directed.  An obligation
    without a way is ``unknown`` if edges of unknown access would give one, else ``no-path``.  Returns obligation_id, network_mm, straight_mm,
    ratio (null without both, or where the ends are one place) and state.
    """
    spot = lambda end: nodes.select(F.col("node").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    rows = obligations.join(least(obligations, known).withColumnRenamed("cost", "network_mm"), _PAIR, "left")
    closed = checkpointed(rows.where("network_mm is null").select(*_PAIR).distinct())
    maybe = least(closed, known.select("src", "dst", "weight").union(unknown.select("src", "dst", "weight"))).select(*_PAIR, F.lit(True).alias("maybe"))
    rows = rows.join(maybe, _PAIR, "left").join(spot("origin"), "origin", "left").join(spot("destination"), "destination", "left")
    straight = millimetres(F.hypot(F.col("origin_x") - F.col("destination_x"), F.col("origin_y") - F.col("destination_y")))
    state = F.when(F.col("network_mm").isNotNull(), "available").when(F.col("maybe"), "unknown").otherwise("no-path")
    rows = rows.select("obligation_id", "network_mm", straight.alias("straight_mm"), state.alias("state"))
    return rows.withColumn("ratio", F.when(F.col("straight_mm") > 0, F.col("network_mm") / F.col("straight_mm")))


def named_root_paths(requests: DataFrame, roots: DataFrame, nodes: DataFrame, edges: DataFrame, closure_m: float, exact_m: float = 0.01, side: float | None = None) -> DataFrame:
    """The way between two named roots over noded linework: request_id, start, end, total_mm, state.

    ``requests``: request_id, from_root, to_root.  ``roots``: root_id, points.  ``nodes``: node, x, y.  ``edges``: edge_id, src, dst, weight (mm), one
    direction each, walked both ways.  A root is met by the nodes within ``exact_m`` of it, or if there are none by nodes of one edge within ``closure_m``.  Of all pairs
    of different nodes the least sum of both gaps and the way counts, then the nodes.  ``state`` is traversed, beyond-closure (a root has no
    node), disconnected-exact or disconnected.  ``witness_paths(..., by="node")`` gives the way itself.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    near = nodes_on_lines(nodes, roots.withColumnRenamed("root_id", "id"), max(closure_m, exact_m), side).join(ends, "node", "left")
    near = near.withColumn("exact", F.col("distance") <= exact_m)
    best = near.groupBy("id").agg(F.max("exact").alias("any_exact"))
    near = near.join(best, "id").where((F.col("exact") | ~F.col("any_exact")) & (F.col("exact") | (F.col("degree") == 1)))
    near = checkpointed(near.select(F.col("id").alias("root"), "node", millimetres(F.col("distance")).alias("gap"), "exact"))
    met = checkpointed(best.select(F.col("id").alias("root"), "any_exact"))
    side_of = lambda which, node: near.select(F.col("root").alias(f"{which}_root"), F.col("node").alias(node), F.col("gap").alias(f"{node}_gap"))
    pairs = requests.join(side_of("from", "start"), "from_root").join(side_of("to", "end"), "to_root").where("start <> end")
    pairs = checkpointed(pairs.select("request_id", "start", "end", (F.col("start_gap") + F.col("end_gap")).alias("gaps")))
    cost = least(pairs.select(F.col("start").alias("origin"), F.col("end").alias("destination")), both).select(F.col("origin").alias("start"), F.col("destination").alias("end"), "cost")
    row: Column = F.struct((F.col("gaps") + F.col("cost")).alias("total_mm"), "start", "end")
    found = pairs.join(cost, ["start", "end"]).groupBy("request_id").agg(F.min(row).alias("r"))
    known = lambda which: met.select(F.col("root").alias(f"{which}_root"), F.col("any_exact").alias(f"{which}_exact"))
    rows = requests.join(found, "request_id", "left").join(known("from"), "from_root", "left").join(known("to"), "to_root", "left")
    state = F.when(F.col("r").isNotNull(), "traversed").when(F.col("from_exact").isNull() | F.col("to_exact").isNull(), "beyond-closure").when(F.col("from_exact") & F.col("to_exact"), "disconnected-exact").otherwise("disconnected")
    return rows.select("request_id", "r.start", "r.end", "r.total_mm", state.alias("state"))
