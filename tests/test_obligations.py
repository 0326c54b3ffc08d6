"""Corridor obligations: clusters against a plain sequential walk, dispositions and pairings by hand."""

import random
from collections import Counter

import pytest

from tracewright.operators import obligations, selection

FLOWS = "flow_id string, origin long, destination long, value long, state string"
ENDPOINTS = "endpoint_id string, kind string, category string, node long"
EDGES = "src long, dst long, weight long"
INF = float("inf")


def plain_ways(nodes, edges):
    cost = {(a, b): 0 if a == b else INF for a in nodes for b in nodes}
    for a, b, w in edges:
        cost[a, b] = min(cost[a, b], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                cost[a, b] = min(cost[a, b], cost[a, k] + cost[k, b])
    return cost


def plain_clusters(seeds, cost, epsilon, least):
    """One seed after another; ``seeds``: od -> (origin, destination, weight)."""
    one = lambda a, b: (cost[seeds[a][0], seeds[b][0]] + cost[seeds[a][1], seeds[b][1]]) / 2
    apart = {(a, b): min(one(a, b), one(b, a)) for a in seeds for b in seeds}
    near = {a: [b for b in seeds if apart[a, b] <= epsilon] for a in seeds}
    core = {a for a in seeds if sum(seeds[b][2] for b in near[a]) >= least}
    cluster = {}
    for a in sorted(core):
        stack = [] if a in cluster else [a]
        while stack:
            b = stack.pop()
            if b not in cluster:
                cluster[b] = a
                stack += [c for c in near[b] if c in core]
    for a in sorted(set(seeds) - core):
        hosts = [(apart[a, b], cluster[b]) for b in near[a] if b in cluster]
        cluster[a] = min(hosts)[1] if hosts else a
    medoids = {}
    for name in set(cluster.values()):
        own = [a for a in seeds if cluster[a] == name]
        medoids[name] = min(own, key=lambda a: (sum(seeds[b][2] * apart[a, b] for b in own), a))
    return cluster, medoids, core


@pytest.mark.parametrize("least", [2, 4])
def test_clusters_are_those_of_a_sequential_walk(spark, least):
    rng = random.Random(least)
    nodes = range(30)
    edges = [(a, rng.choice([b for b in nodes if b // 15 == a // 15 and b != a]), rng.randrange(1, 60)) for a in nodes for _ in range(3)]
    cost = plain_ways(nodes, edges)
    seeds = {f"{k:03d}": (rng.randrange(30), rng.randrange(30), rng.randrange(1, 3)) for k in range(70)}
    ways = [(a, b, c) for (a, b), c in cost.items() if c <= 100]
    got = obligations.cluster(
        spark.createDataFrame([(k, *v) for k, v in seeds.items()], "od string, origin long, destination long, weight long"), spark.createDataFrame(ways, "root long, node long, cost long"), 20, least
    ).collect()
    cluster, medoids, core = plain_clusters(seeds, {k: c if c <= 100 else INF for k, c in cost.items()}, 20, least)
    assert {r.od: r.cluster for r in got} == cluster
    assert {r.cluster: r.od for r in got if r.medoid} == medoids
    assert len(set(cluster.values())) > 5 and any(n > 2 for n in Counter(cluster.values()).values())
    if least == 4:
        assert any(a not in core and cluster[a] != a for a in seeds)


@pytest.fixture
def street(spark):
    """1 - 2 - 3 - 4 both ways, 100 m each; 7 - 8 apart from it, 9 alone."""
    ways = [(1, 2, 100), (2, 3, 100), (3, 4, 100), (7, 8, 50)]
    edges = spark.createDataFrame([*ways, *[(b, a, w) for a, b, w in ways]], EDGES)
    return spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 7, 8, 9)], "node long"), edges


def test_every_flow_has_a_disposition(spark, street):
    flows = [
        ("a", 1, 3, 10, "evidenced"), ("b", 1, 4, 10, "evidenced"), ("c", 1, 2, 1, "evidenced"), ("d", 7, 8, 10, "evidenced"), ("e", 1, 9, 10, "evidenced"), ("f", 1, None, 10, "evidenced"), ("g", 2, 3, None, "evidenced"),
        ("h", 1, 2, 10, "unmatched"), ("i", 1, 2, 10, "conflicting"), ("j", 1, 2, 10, None), ("k", 2, 1, 10, "evidenced"), ("l", 2, 99, 10, "evidenced"),
    ]
    endpoints = [("P1", "place", "town", 1), ("P2", "place", "village", 2), ("D3", "destination", None, 3), ("G4", "gateway", None, 4)]
    got = obligations.derive(
        spark.createDataFrame(flows, FLOWS), *street, spark.createDataFrame(endpoints, ENDPOINTS), 5, distance_limit=250, segment_length=80, max_segments=5, epsilon=60, min_samples=2, hierarchy=[("town", "village"), ("village", "town")],
        gateways=["gateway-destination"], budget=4,
    )
    seeds = {(r.flow_id, r.segment): r for r in got.seeds.collect()}
    want = {"b": "over-distance", "c": "below-threshold", "d": "disconnected-island", "e": "disconnected-island", "f": "missing-endpoint", "g": "missing-value", "h": "unmatched", "i": "conflicting", "j": "unknown-demand", "l": "failed-path"}
    assert {f: seeds[f, 0].disposition for f in want} == want
    assert [(seeds["a", i].start, seeds["a", i].end) for i in range(3)] == [(0, 80), (80, 160), (160, 200)] and ("a", 3) not in seeds
    assert {k for k, r in seeds.items() if r.medoid} == {("a", 0), ("k", 0)}
    pairs = Counter((r.origin_endpoint, r.destination_endpoint, r.basis, r.disposition) for r in got.pairs.collect())
    assert pairs == Counter({
        ("P1", "D3", "demand-led", "eligible"): 1, ("P1", "G4", "demand-led", "over-distance"): 1, ("P1", "P2", "demand-led", "below-threshold"): 1, ("node:7", "node:8", "demand-led", "disconnected-island"): 1,
        ("P1", "node:9", "demand-led", "disconnected-island"): 1, ("P2", "P1", "demand-led", "eligible"): 1, ("P2", "node:99", "demand-led", "failed-path"): 1, ("P1", "P2", "place-hierarchy", "eligible"): 1,
        ("P2", "P1", "place-hierarchy", "duplicate"): 1, ("G4", "D3", "gateway-rule", "eligible"): 1,
    })
    assert [r.obligation_id for r in got.obligations.collect()] == ["G4>D3", "P1>D3", "P1>P2", "P2>P1"]
    few = obligations.derive(spark.createDataFrame(flows, FLOWS), *street, spark.createDataFrame(endpoints, ENDPOINTS), 5, budget=1, max_obligations=1)
    assert {r.flow_id for r in few.seeds.where("disposition = 'budget-exceeded'").collect()} == {"b", "k", "l"} and few.obligations.count() == 1


def test_without_usable_demand_the_fallbacks_follow(spark, street):
    flows, endpoints = spark.createDataFrame([], FLOWS), [("P1", "place", "town", 1), ("P2", "place", "town", 2), ("D3", "destination", None, 3), ("G8", "gateway", None, 8)]
    rows = spark.createDataFrame(endpoints, ENDPOINTS)
    by_hierarchy = obligations.derive(flows, *street, rows, 50, percentile=True, hierarchy=[("town", "town")])
    assert {(r.obligation_id, r.basis) for r in by_hierarchy.obligations.collect()} == {("P1>P2", "place-hierarchy"), ("P2>P1", "place-hierarchy")}
    by_order = obligations.derive(flows, *street, rows, 50, percentile=True, hierarchy=[("city", "town")]).obligations.collect()
    assert [(r.obligation_id, r.disposition) for r in by_order] == [("D3>G8", "failed-path"), ("P1>P2", "eligible"), ("P2>D3", "eligible")]
    with pytest.raises(ValueError):
        obligations.derive(flows, *street, spark.createDataFrame([*endpoints, ("X", "place", None, 1)], ENDPOINTS), 1)


def test_fallbacks_decide_one_after_another(spark):
    rows = [("a", 1, True, 1, 1), ("a", 2, False, 9, 9), ("b", 1, False, 5, 1), ("b", 2, False, 5, 3), ("b", 3, False, None, 9), ("c", 2, False, 4, 2), ("c", 1, False, 4, 2), ("d", 7, None, None, None), (None, 3, False, 1, 1), (None, 4, False, 2, 1)]
    frame = spark.createDataFrame(rows, "part string, id long, preferred boolean, population long, quality long")
    got = {r.part: (r.route_id, r.n_routes, r.decided_by) for r in selection.fallback_route(frame, "part", ["preferred", "population", "quality"], "id").collect()}
    assert got == {"a": (1, 2, "preferred"), "b": (2, 3, "quality"), "c": (1, 2, "route-id"), "d": (7, 1, "preferred"), None: (4, 2, "population")}
    assert selection.fallback_route(frame.limit(0), "part", ["quality"], "id").count() == 0


def test_observations_keep_what_became_of_them(spark):
    seen = spark.createDataFrame([(1, "s", "c", "observed", "asset"), (2, "t", "c", "observed", "road"), (3, "s", " ", "observed", "road"), (4, None, "c", "observed", "road"), (None, "s", "c", "observed", "road"), (1, "s", "c", "observed", "asset")], "observation_id long, subject_id string, claim string, state string, source_kind string")
    edges = spark.createDataFrame([("s>", "s"), ("s<", "s"), ("s>", "s"), ("u>", "u"), ("x", None)], "edge_id string, source_id string")
    got = Counter((r.observation_id, r.result, tuple(r.edge_ids or ())) for r in selection.bind_observations(seen, edges).collect())
    assert got == Counter({(1, "bound", ("s<", "s>")): 2, (2, "unmatched-observation", ()): 1, (3, "invalid-observation", ()): 1, (4, "invalid-observation", ()): 1, (None, "invalid-observation", ()): 1})
    assert {r.result for r in selection.bind_observations(seen, edges.limit(0)).collect()} == {"unmatched-observation", "invalid-observation"}
