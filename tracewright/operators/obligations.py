"""Corridor obligations: which pairs of endpoints a network owes a corridor, from demand first and from declared pairings after it.

Flows above a threshold are routed, cut into seeds along their path and clustered by density in network distance: two seeds are as far apart as the
mean of the ways between their origins and between their destinations, in the cheaper direction.  A cluster's medoid stands for it.  Seeds of one pair of
nodes lie at distance 0, so clusters are made of weighted node pairs, not of seeds.  Only flows within ``budget`` are routed, the others keep their own
disposition; so distances are between at most ``budget`` node pairs, found by joins from the ways between nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed, stored
from .graph import components, shortest_paths

_OUT = ["seed_id", "flow_id", "origin", "destination", "value", "segment", "start", "end", "disposition", "distance", "cluster", "medoid"]
_PAIR = ["origin_endpoint", "destination_endpoint", "source", "basis", "disposition", "distance"]


class Obligations(NamedTuple):
    """``seeds``, ``pairs`` and ``obligations``, see ``derive``."""

    seeds: DataFrame
    pairs: DataFrame
    obligations: DataFrame


def _distances(left: DataFrame, right: DataFrame, ways: DataFrame, same_cluster: bool = False) -> DataFrame:
    """(a, b, apart) of node pairs, in the cheaper direction; only those that ``ways`` joins, and of one cluster if that is asked for."""
    side = lambda rows, n: rows.select(*[F.col(c).alias(f"{n}_{c}") for c in ("od", "origin", "destination", *["cluster"] * same_cluster)])
    way = lambda a, b, cost: ways.select(F.col("root").alias(a), F.col("node").alias(b), F.col("cost").alias(cost))
    met = side(left, "a").join(way("a_origin", "b_origin", "x"), "a_origin").join(side(right, "b"), ["b_origin"])
    if same_cluster:
        met = met.where("a_cluster = b_cluster")
    met = met.join(way("a_destination", "b_destination", "y"), ["a_destination", "b_destination"]).select(F.col("a_od").alias("a"), F.col("b_od").alias("b"), ((F.col("x") + F.col("y")) / 2).alias("apart"))
    return met.union(met.select("b", "a", "apart")).groupBy("a", "b").agg(F.min("apart").alias("apart"))


def cluster(pairs: DataFrame, ways: DataFrame, epsilon: float, min_samples: int) -> DataFrame:
    """(od, cluster, medoid) of weighted node pairs: density clusters in network distance.

    ``pairs``: od, origin, destination, weight.  ``ways``: root, node, cost between their nodes.  A core has ``min_samples`` seeds within ``epsilon``, its own
    included.  All others join, in the order of od, the nearest cluster that a core or an earlier one of them within ``epsilon`` belongs to (ties: the smaller name), or begin
    their own.  A cluster is named by its smallest core or its founder; the medoid has the least weighted sum of distances to all members (one without a way counts as
    infinite), ties to the smaller od.
    """
    pairs = checkpointed(pairs)
    near = stored(_distances(pairs, pairs, ways.where(F.col("cost") <= 2 * epsilon)).where(F.col("apart") <= epsilon))
    core = near.join(pairs.select(F.col("od").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("od"))
    core = checkpointed(core)
    end = lambda n: core.withColumnRenamed("od", n)
    inner = near.where("a < b").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    settled = components(core.withColumnRenamed("od", "node"), inner).select(F.col("node").alias("od"), F.col("component").alias("cluster"), F.lit(True).alias("core"))
    # Tables of their own, since planning rounds of checkpoints joined with each other takes longer each time.
    settled = stored(settled)
    loose = stored(pairs.join(core, "od", "left_anti").select("od"))
    # Each round settles those without an earlier open neighbour; nothing depends on the order of rows.
    while not loose.isEmpty():
        waiting = near.join(loose.withColumnRenamed("od", "a"), "a").join(loose.withColumnRenamed("od", "b"), "b").where("b < a").select(F.col("a").alias("od")).distinct()
        ready = loose.join(waiting, "od", "left_anti")
        hosts = near.join(settled.withColumnRenamed("od", "b"), "b").where("core or b < a").groupBy(F.col("a").alias("od")).agg(F.min_by("cluster", F.struct("apart", "cluster")).alias("host"))
        joined = ready.join(hosts, "od", "left").select("od", F.coalesce("host", "od").alias("cluster"), F.lit(False).alias("core"))
        settled = stored(settled.union(joined))
        loose = stored(loose.join(settled.select("od"), "od", "left_anti"))
    placed = checkpointed(pairs.join(settled.select("od", "cluster"), "od"))
    within = _distances(placed, placed, ways, same_cluster=True).join(placed.select(F.col("od").alias("b"), "weight"), "b")
    sums = within.groupBy(F.col("a").alias("od")).agg(F.sum(F.col("weight") * F.col("apart")).alias("total"), F.sum("weight").alias("reached"))
    sizes = placed.groupBy("cluster").agg(F.sum("weight").alias("size"))
    cost = F.when(F.col("reached") == F.col("size"), F.col("total")).otherwise(F.lit(float("inf")))
    best = placed.join(sums, "od").join(sizes, "cluster").groupBy("cluster").agg(F.min_by("od", F.struct(cost, "od")).alias("best"))
    return placed.join(best, "cluster").select("od", "cluster", (F.col("od") == F.col("best")).alias("medoid"))


def _verdict(distance_limit: float, none: str) -> Column:
    """What the ``distance`` of a pair makes of it; ``none`` where there is no way."""
    return F.when(F.col("distance").isNull(), none).when(F.col("distance") > distance_limit, "over-distance").otherwise("eligible")


def _declared(endpoints: DataFrame, hierarchy: Sequence[tuple[str, str]], gateways: Sequence[str]) -> DataFrame:
    """Pairs of endpoints by the declared rules, and neighbours in the roster for coverage: stage, origin_endpoint, destination_endpoint, their nodes and the basis."""
    side = lambda rows, n: rows.select(F.col("endpoint_id").alias(f"{n}_endpoint"), F.col("node").alias(n))
    kind = lambda k: endpoints.where(F.col("kind") == k)
    rules = [(kind("place").where(F.col("category") == a), kind("place").where(F.col("category") == b), "place-hierarchy") for a, b in hierarchy]
    rules += [(kind(a), kind(b), "gateway-rule") for a, b in (rule.split("-") for rule in gateways)]
    order = Window.orderBy(F.when(F.col("kind") == "place", 1).when(F.col("kind") == "destination", 2).otherwise(3), "endpoint_id")
    # The roster is configured, so one task may put it in order.
    follows = endpoints.select(F.col("endpoint_id").alias("origin_endpoint"), F.col("node").alias("origin"), F.lead("endpoint_id").over(order).alias("destination_endpoint"), F.lead("node").over(order).alias("destination"))
    columns = ["origin_endpoint", "origin", "destination_endpoint", "destination"]
    rows = follows.where("destination_endpoint is not null").select(F.lit(len(hierarchy) + 1).alias("stage"), *columns, F.lit("coverage-only").alias("basis"))
    for i, (left, right, basis) in enumerate(rules):
        stage = i + 1 if i < len(hierarchy) else i + 2
        rows = rows.union(side(left, "origin").join(side(right, "destination"), how="cross").select(F.lit(stage), *columns, F.lit(basis)))
    return rows.where("origin_endpoint <> destination_endpoint")


def derive(
    flows: DataFrame, nodes: DataFrame, edges: DataFrame, endpoints: DataFrame, threshold: float, percentile: bool = False, distance_limit: float = 50_000, max_path_length: float | None = None, segment_length: float = 500,
    max_segments: int = 3, epsilon: float = 1000, min_samples: int = 2, budget: int = 2048, max_obligations: int = 256, hierarchy: Sequence[tuple[str, str]] = (), gateways: Sequence[str] = (), fallbacks: Sequence[str] = ("place-hierarchy", "coverage-only"),
) -> Obligations:
    """Seeds of all flows, all pairs that were looked at, and the obligations.

    ``flows``: flow_id (text), origin, destination, value, state (evidenced, unmatched, conflicting, unknown; null is unknown).  ``nodes``: node.  ``edges``: src, dst, weight.
    ``endpoints``: endpoint_id, kind (place, destination, gateway), category, node; two of one node raise.  ``threshold`` is a value, or a percentile of usable values.
    ``hierarchy``: pairs of categories of places.  ``gateways``: place-gateway, gateway-place or gateway-destination.  A product of two categories is what such a rule asks for.

    Every flow is in ``seeds`` with a disposition: eligible (a row for each segment), below-threshold, unmatched, conflicting, unknown-demand, missing-endpoint, missing-value, disconnected-island,
    budget-exceeded, failed-path or over-distance.  ``pairs`` holds rejected flows, medoids and declared pairs, of which later ones of one pair of endpoints are duplicates.
    ``obligations`` holds the first of each pair, at most ``max_obligations`` in the order of their ids.  A node without an endpoint is called node:<node>.  Declared hierarchies add
    to demand that has medoids; without any usable flow the first of ``fallbacks`` that gives a pair is used.
    """
    if not endpoints.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("endpoints are ambiguous at a node")
    usable = (F.col("state") == "evidenced") & F.col("origin").isNotNull() & F.col("destination").isNotNull() & F.col("value").isNotNull()
    good = flows.where(usable)
    bar = good.agg(F.coalesce(F.percentile("value", threshold / 100), F.lit(float("inf"))).alias("bar")) if percentile else flows.sparkSession.createDataFrame([(float(threshold),)], "bar double")
    weak = components(nodes, edges.select("src", "dst"))
    anchors = weak.join(endpoints.select("node"), "node", "left_semi").select("component").distinct().withColumn("anchored", F.lit(True))
    weak = checkpointed(weak.join(anchors, "component", "left").select("node", "component", F.coalesce("anchored", F.lit(False)).alias("anchored")))
    part = lambda n: weak.select(F.col("node").alias(n), F.col("component").alias(f"{n}_part"), F.col("anchored").alias(f"{n}_anchored"))
    any_anchor = not endpoints.isEmpty()
    apart = F.when(F.col("origin_part") == F.col("destination_part"), ~F.col("origin_anchored") & F.lit(any_anchor)).otherwise(~(F.col("origin_anchored") & F.col("destination_anchored")))
    state = F.col("state")
    first = (
        F.when(state == "unmatched", "unmatched").when(state == "conflicting", "conflicting").when(state.isNull() | (state != "evidenced"), "unknown-demand")
        .when(F.col("origin").isNull() | F.col("destination").isNull(), "missing-endpoint").when(F.col("value").isNull(), "missing-value").when(F.col("value") < F.col("bar"), "below-threshold")
        .when(F.coalesce(apart, F.lit(False)), "disconnected-island")
    )
    rows = flows.join(F.broadcast(bar), how="cross").join(part("origin"), "origin", "left").join(part("destination"), "destination", "left")
    rows = checkpointed(rows.select("flow_id", "origin", "destination", "value", first.alias("early")))
    routed = checkpointed(rows.where("early is null").orderBy("flow_id").limit(budget))
    declared = checkpointed(_declared(endpoints, hierarchy, gateways))
    roots = routed.select(F.explode(F.array("origin", "destination")).alias("node")).union(declared.select("origin")).distinct()
    ends = roots.union(declared.select("destination")).distinct()
    longest = None if max_path_length is None else max(max_path_length, distance_limit)
    ways = stored(shortest_paths(roots, edges, 10_000, longest, checkpointed(ends)).select("root", "node", "cost"))
    usual = ways if max_path_length is None else ways.where(F.col("cost") <= max_path_length)
    to = usual.select(F.col("root").alias("origin"), F.col("node").alias("destination"), F.col("cost").alias("distance"))
    verdict = _verdict(distance_limit, "failed-path" if max_path_length is None else "over-distance")
    tried = routed.join(to, ["origin", "destination"], "left").withColumn("disposition", verdict)
    rest = rows.join(routed.select("flow_id"), "flow_id", "left_anti").withColumn("disposition", F.coalesce("early", F.lit("budget-exceeded"))).withColumn("distance", F.lit(None).cast("long"))
    columns = ["flow_id", "origin", "destination", "value", "disposition", "distance"]
    count = F.when(F.col("disposition") == "eligible", F.least(F.lit(max_segments), F.greatest(F.lit(1), F.ceil(F.col("distance") / segment_length)))).otherwise(F.lit(1)).cast("int")
    seeds = tried.select(*columns).union(rest.select(*columns)).withColumn("segment", F.explode(F.sequence(F.lit(0), count - 1)))
    seeds = checkpointed(seeds.withColumn("seed_id", F.format_string("%s#%03d", "flow_id", "segment")))
    pairs = seeds.where("disposition = 'eligible'").groupBy("origin", "destination").agg(F.min("seed_id").alias("od"), F.count("*").alias("weight"))
    found = cluster(pairs.select("od", "origin", "destination", "weight"), ways.where(F.col("cost") <= distance_limit), epsilon, min_samples)
    named = checkpointed(found.join(pairs.select("od", "origin", "destination"), "od").select("origin", "destination", F.col("od").alias("lead"), "cluster", "medoid"))
    cut = lambda s: F.when(F.col("disposition") == "eligible", F.least(F.col("distance").cast("double"), s * F.lit(float(segment_length))))
    seeds = seeds.join(named.withColumn("disposition", F.lit("eligible")), ["origin", "destination", "disposition"], "left")
    seeds = seeds.select("*", cut(F.col("segment")).alias("start"), cut(F.col("segment") + 1).alias("end")).withColumn("medoid", F.coalesce(F.col("medoid") & (F.col("seed_id") == F.col("lead")), F.lit(False)))
    seeds = checkpointed(seeds.select(*_OUT))

    name = lambda n: endpoints.select(F.col("node").alias(n), F.col("endpoint_id").alias(f"{n}_endpoint"))
    called = seeds.where("medoid or disposition in ('below-threshold', 'failed-path', 'over-distance', 'disconnected-island')").join(name("origin"), "origin", "left").join(name("destination"), "destination", "left")
    for n in ("origin", "destination"):
        called = called.withColumn(f"{n}_endpoint", F.coalesce(f"{n}_endpoint", F.concat(F.lit("node:"), F.col(n).cast("string"))))
    called = called.where("origin_endpoint <> destination_endpoint").select(F.lit(0).alias("stage"), "origin_endpoint", "destination_endpoint", F.col("seed_id").alias("source"), F.lit("demand-led").alias("basis"), "disposition", "distance", "medoid")
    paths = declared.join(to, ["origin", "destination"], "left").select("stage", "origin_endpoint", "destination_endpoint", F.lit(None).cast("string").alias("source"), "basis", _verdict(distance_limit, "failed-path").alias("disposition"), "distance", F.lit(True).alias("medoid"))
    uses = {"gateway-rule"}
    if good.isEmpty():
        offered = {r.basis for r in declared.select("basis").distinct().collect()}
        uses |= set([f for f in fallbacks if f in offered][:1])
    elif not seeds.where("medoid").isEmpty():
        uses.add("place-hierarchy")
    chosen = called.union(paths.where(F.col("basis").isin(*uses)))
    turn = F.row_number().over(Window.partitionBy("origin_endpoint", "destination_endpoint", "medoid").orderBy("stage", "source"))
    chosen = checkpointed(chosen.withColumn("turn", F.when(F.col("medoid"), turn)))
    told = chosen.select("origin_endpoint", "destination_endpoint", "source", "basis", F.when(F.col("turn") > 1, "duplicate").otherwise(F.col("disposition")).alias("disposition"), "distance")
    owed = chosen.where("turn = 1").select(F.concat_ws(">", "origin_endpoint", "destination_endpoint").alias("obligation_id"), *_PAIR).orderBy("obligation_id").limit(max_obligations)
    return Obligations(seeds, told, owed)
