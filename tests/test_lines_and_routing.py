"""Lines, attachment, ties, controls, severance and nearest rows against plain code."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import identity, tags
from tracewright.functions import lines as L
from tracewright.operators import graph, linear, lines, routing, selection, spatial
from tracewright.operators.components import connected_components

LINE = "id long, points array<struct<x:double,y:double>>"


def line_frame(spark, rows):
    return spark.createDataFrame([(i, None if p is None else [(float(x), float(y)) for x, y in p]) for i, p in rows], LINE)


def to_segment(p, a, b):
    square = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / square)) if square else 0.0
    return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))


def sampled_share(line, corridor, buffer, n=4000):
    """Share of a line near a corridor, by evenly spaced samples."""
    legs = list(zip(line, line[1:]))
    sizes = [math.dist(a, b) for a, b in legs]
    hit = total = 0
    for (a, b), size in zip(legs, sizes):
        k = max(1, round(n * size / sum(sizes)))
        for i in range(k):
            f = (i + 0.5) / k
            p = (a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1]))
            hit += any(to_segment(p, c, d) <= buffer for route in corridor for c, d in zip(route, route[1:]))
            total += 1
    return hit / total


def walk(rng, steps, size):
    at, out = (rng.uniform(0, 400), rng.uniform(0, 400)), []
    for _ in range(steps):
        out.append(at)
        at = (at[0] + rng.uniform(-size, size), at[1] + rng.uniform(-size, size))
    return out


def test_corridor_share_matches_samples(spark):
    rng = random.Random(1)
    routes = [walk(rng, 4, 150) for _ in range(5)]
    edges = [walk(rng, 3, 120) for _ in range(25)] + [[(0, 0), (0, 0)], [(10, 10)], [(0, 0), (0, 0), (300, 300)]]
    got = {r.id: r for r in lines.mark_edges(line_frame(spark, list(enumerate(edges)) + [(90, None)]), line_frame(spark, list(enumerate(routes))), 30.0, side=50.0).collect()}
    for i, edge in enumerate(edges):
        if len(set(edge)) > 1:
            assert got[i].share == pytest.approx(sampled_share(edge, routes, 30.0), abs=2e-3), i
            assert got[i].marked == (got[i].share >= 0.5)
        else:
            assert (got[i].share, got[i].marked) == (0.0, False)
    assert got[90].share == 0.0


def test_split_scopes(spark):
    line = [(0, 0), (100, 0), (100, 100)]
    places = spark.createDataFrame([(1, 50.0, 0.0), (2, 60.0, 0.0), (3, 1000.0, 1000.0)], "id long, x double, y double")
    got = sorted((r.id, r.scope, round(r.start_m, 6), round(r.end_m, 6), [(round(p.x, 6), round(p.y, 6)) for p in r.points]) for r in lines.split_scopes(line_frame(spark, [(1, line), (2, [(0, 500), (0, 600)])]), places, 20.0).collect())
    assert got == [(1, "rural", 0.0, 30.0, [(0.0, 0.0), (30.0, 0.0)]), (1, "rural", 80.0, 200.0, [(80.0, 0.0), (100.0, 0.0), (100.0, 100.0)]), (1, "urban", 30.0, 80.0, [(30.0, 0.0), (80.0, 0.0)]), (2, "rural", 0.0, 100.0, [(0.0, 500.0), (0.0, 600.0)])]


def test_line_positions(spark):
    rows = line_frame(spark, [(1, [(0, 0), (10, 0), (10, 10)])])
    row = rows.select(L.length(F.col("points")).alias("m"), L.along(F.col("points"), F.lit(12.0), F.lit(4.0)).alias("at"), L.along(F.col("points"), F.lit(-3.0), F.lit(1.0)).alias("before")).first()
    assert (row.m, row.at, row.before) == (20.0, 14.0, 0.0)


def test_line_match_dispositions(spark):
    sources = [(1, [(0, 0), (100, 0)]), (2, [(0, 300), (100, 300)]), (3, [(0, 5000), (50, 5000)]), (4, [(7, 7)]), (5, None), (6, [(0, 0), (1, 1)]), (6, [(0, 0), (2, 2)]), (7, [(0, 600), (0, 700)])]
    targets = [(10, [(0, 3), (120, 3)]), (20, [(100, 302), (0, 302)]), (21, [(0, 298), (90, 298)]), (30, [(-50, 605), (60, 605)]), (40, [(1, 1), (1, 1)]), (50, [(0, 0), (9, 9)]), (50, [(0, 0), (9, 9)])]
    got = {}
    for r in lines.match_lines(line_frame(spark, sources), line_frame(spark, targets), 10.0, 20.0, 30.0).collect():
        got.setdefault(r.source_id, []).append((r.target_id, r.state, r.reason, r.distance_mm, r.orientation))
    assert got[1] == [(10, "accepted", "within-profile", 3000, "same")]
    assert sorted(got[2]) == [(20, "ambiguous", "multiple-targets-within-profile", 2000, "reversed"), (21, "ambiguous", "multiple-targets-within-profile", 2000, "same")]
    assert got[3][0][:3] == (30, "unmatched", "distance-outside-tolerance") and len(got[3]) == 1
    assert got[4][0][:3] == got[5][0][:3] == (None, "unmatched", "invalid-source-geometry")
    assert got[6] == [(None, "conflicting", "duplicate-source-id", None, None)]
    assert got[7][0][:4] == (30, "unmatched", "bearing-outside-tolerance", 0)
    none = lines.match_lines(line_frame(spark, sources[:1]), line_frame(spark, []), 10.0, 20.0, 30.0).collect()
    assert [(r.source_id, r.target_id, r.reason) for r in none] == [(1, None, "no-target-lines")]


def plain_match(line, targets, tolerance, bearing, least):
    """Dispositions of one source by walking all targets: (target, state, reason, distance, shared)."""

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def gap(a, b, c, d):
        cross = turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
        return 0.0 if cross else min(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))

    def along(p, path):
        gone, best = 0.0, (math.inf, 0.0)
        for a, b in zip(path, path[1:]):
            size, d = math.dist(a, b), to_segment(p, a, b)
            if d < best[0]:
                best = d, gone + (max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size**2)) * size if size else 0.0)
            gone += size
        return best[1]

    legs = lambda path: [leg for leg in zip(path, path[1:]) if leg[0] != leg[1]]
    size = lambda path: sum(math.dist(a, b) for a, b in zip(path, path[1:]))
    rows = []
    for i, path in targets:
        d = round(min(gap(*a, *b) for a in legs(line) for b in legs(path)) * 1000)
        (sx, sy), (tx, ty) = ((p[-1][0] - p[0][0], p[-1][1] - p[0][1]) for p in (line, path))
        norm = math.hypot(sx, sy) * math.hypot(tx, ty)
        turned = round((math.degrees(math.acos(min(1.0, abs(sx * tx + sy * ty) / norm))) if norm else 180.0) * 1000)
        shared = round(min(size(line), abs(along(line[-1], path) - along(line[0], path)), size(path)) * 1000)
        reason = "distance-outside-tolerance" if d > tolerance * 1000 else "bearing-outside-tolerance" if turned > bearing * 1000 else "shared-length-below-minimum" if shared < least * 1000 else "within-profile"
        rows.append((d, turned, i, reason, shared))
    good = [r for r in rows if r[3] == "within-profile"]
    state, reason = ("accepted", None) if len(good) == 1 else ("ambiguous", "multiple-targets-within-profile") if good else ("unmatched", None)
    return sorted((r[2], state, reason or r[3], r[0], r[4]) for r in good or [min(rows)])


def test_lines_meet_in_blocks_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines.meeting, "BLOCK", 4)
    rng = random.Random(12)
    sources = [(i, walk(rng, rng.randint(2, 6), 90)) for i in range(40)] + [(100 + i, [(10, 10), (60, 20), (60, 20), (90, 15)]) for i in range(9)]
    sources += [(200, [(9000, 9000), (9050, 9000)]), (201, [(-40000, 0), (-40000, 90), (-40000, 0)])]
    targets = [(i, walk(rng, rng.randint(2, 6), 90)) for i in range(30)] + [(100 + i, [(12, 14), (95, 18)]) for i in range(7)] + [(300, [(0, -5000), (3000, -5000), (3000, 9000)])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = lines.match_lines(line_frame(spark, sources), line_frame(spark, targets), 15.0, 40.0, 12.0, side=50.0)
        got = {}
        for r in found.collect():
            got.setdefault(r.source_id, []).append((r.target_id, r.state, r.reason, r.distance_mm, r.shared_mm))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i: sorted(rows) for i, rows in got.items()} == {i: plain_match(path, targets, 15.0, 40.0, 12.0) for i, path in sources}
    assert {state for rows in got.values() for _, state, *_ in rows} == {"accepted", "ambiguous", "unmatched"}
    assert "hashpartitioning(source_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_with_odd_and_far_rows(spark):
    rng = random.Random(4)
    right = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 5e6, -4e6)]
    left = [(i, rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for i in range(60)] + [(100, 1e7, 1e7), (101, None, 5.0), (102, float("nan"), 5.0), (103, float("inf"), 0.0), (104, 4.9e6, -4e6)]
    schema = "id long, x double, y double"
    frames = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r.id: (r.near_id, r.distance) for r in spatial.nearest(*frames, "id", "id", 5.0).collect()}
    for i, x, y in left:
        if x is None or not math.isfinite(x):
            assert i not in got
        else:
            d, j = min((math.hypot(x - a, y - b), j) for j, a, b in right if a is not None and math.isfinite(a))
            assert got[i] == (j, pytest.approx(d))
    states = {r.id: r.state for r in spatial.match_disposition(*frames, 20.0).collect()}
    assert {states[i] for i in (101, 102, 103)} == {"unlocated"} and states[100] == "unmatched"
    empty = spatial.match_disposition(frames[0], frames[1].where("id > 5000"), 20.0).collect()
    assert len(empty) == len(left) and {r.state for r in empty} == {"unmatched", "unlocated"}


def test_components_of_a_hub_and_of_words(spark):
    hub = [(0, i) for i in range(1, 300)] + [(400, 401), (402, 401), (None, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(hub, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(300)} | {400: 400, 401: 400, 402: 400}
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    assert {r.component for r in connected_components(spark.createDataFrame(path, "src string, dst string")).collect()} == {"n000"}


def grid(n):
    edges = []
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n:
                    edges += [(f"{i}{j}", f"{a}{b}", 1), (f"{a}{b}", f"{i}{j}", 1)]
    return edges


def test_ties_and_attachment(spark):
    edges = spark.createDataFrame(grid(3) + [("22", "end", 5), ("end", "22", 5), ("x", "y", 1)], "src string, dst string, weight long")
    pairs = spark.createDataFrame([("00", "11"), ("00", "02"), ("00", "end"), ("00", "y"), ("00", "00")], "origin string, destination string")
    got = {r.destination: (r.cost, r.tied) for r in routing.route_ties(pairs, edges).collect()}
    assert got == {"11": (2.0, True), "02": (2.0, False), "end": (9.0, True), "y": (None, False), "00": (0.0, False)}
    starts = spark.createDataFrame([(1, "00", 5), (1, "02", 0), (2, "x", 0), (3, "11", 1)], "request_id long, node string, snap long")
    ends = spark.createDataFrame([(1, "22", 0), (1, "20", 1), (2, "00", 0), (3, "11", 2), (3, "12", 9)], "request_id long, node string, snap long")
    best = {r.request_id: (r.start, r.end, r.total) for r in routing.best_attachment(starts, ends, edges).collect()}
    assert best == {1: ("02", "22", 2), 3: ("11", "11", 3)}
    out = spark.createDataFrame([(1, "02", "22")], "request_id long, start string, end string")
    best = {r.request_id: (r.start, r.end, r.total) for r in routing.best_attachment(starts, ends, edges, out, allow_stationary=False).collect()}
    assert best == {1: ("02", "20", 5), 3: ("11", "12", 11)}
    groups = spark.createDataFrame([("a", "00"), ("a", "01"), ("b", "22"), ("b", "02"), ("c", "x")], "group_id string, node string")
    assert [tuple(r) for r in routing.group_bounds(groups, edges).collect()] == [("a", "b", 1)]


def test_decisions_and_controls(spark):
    day = dt.date(2024, 5, 1)
    rows = [(1, "t1", "exclude-from-routing", "active", dt.date(2024, 1, 1), None), (2, "t2", "exclude-from-routing", "active", dt.date(2024, 6, 1), None), (3, "t2", "exclude-from-routing", "superseded", dt.date(2023, 1, 1), None), (4, "t1", "mark", "active", dt.date(2023, 1, 1), dt.date(2024, 4, 30)), (5, "t2", "mark", "rejected", dt.date(2023, 1, 1), None)]
    decisions = spark.createDataFrame(rows, "decision_id long, target_id string, action string, status string, effective_from date, effective_until date")
    targets = spark.createDataFrame([("t1",), ("t2",)], "target_id string")
    states = routing.ledger_states(decisions, targets, day)
    assert {r.decision_id: r.state for r in states.collect()} == {1: "applied", 2: "rejected", 3: "superseded", 4: "rejected", 5: "rejected"}
    edges = spark.createDataFrame([("e1", "a", "b", 1), ("e2", "a", "c", 2), ("e3", "c", "b", 2), ("e4", "a", "d", 1)], "edge_id string, src string, dst string, weight long")
    bound = spark.createDataFrame([("t1", "e1"), ("t1", "e4"), ("t2", "e2")], "target_id string, edge_id string")
    kept = routing.controlled_edges(edges, bound, states)
    assert sorted(r.edge_id for r in kept.collect()) == ["e2", "e3"]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "a")], "origin string, destination string")
    assert {r.destination: r.state for r in routing.controlled_routes(pairs.where("origin = 'a'"), edges, kept).collect()} == {"b": "detour", "c": "unchanged", "d": "severed"}
    with pytest.raises(ValueError, match="unknown target"):
        routing.controlled_edges(edges, bound, routing.ledger_states(decisions, targets.limit(1), day))


def test_severance_matches_removal(spark):
    rng = random.Random(9)
    edges = [(f"e{k}", a, b) for k, (a, b) in enumerate({tuple(sorted((rng.randrange(i), i))) for i in range(1, 26)} | {tuple(sorted(rng.sample(range(25), 2))) for _ in range(6)} | {(30, 31), (31, 32)})]

    def linked(a, b, without):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for e, s, t in edges:
                if e != without and x in (s, t) and (y := s + t - x) not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    pairs = [(k, *rng.sample(range(33), 2)) for k in range(40)]
    want = {(k, e) for k, a, b in pairs for e, _, _ in edges if linked(a, b, None) and not linked(a, b, e)}
    got = graph.severance(spark.createDataFrame(pairs, "obligation_id long, a long, b long"), spark.createDataFrame(edges, "edge_id string, src long, dst long"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_shortest_paths_merge_rounds(spark):
    """A path longer than the rounds between two merges."""
    edges = spark.createDataFrame([(i, i + 1, 2) for i in range(20)] + [(0, 15, 100)], "src long, dst long, weight long")
    got = {r.node: r.cost for r in graph.shortest_paths(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {i: 2 * i for i in range(21)}


def test_parallel_relations_match_all_pairs(spark):
    rng = random.Random(2)
    routes = {i: (i % 3, {rng.randrange(14) for _ in range(rng.randrange(1, 9))}) for i in range(60)}
    for threshold in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a in routes for b in routes if a < b and routes[a][0] == routes[b][0] and len(routes[a][1] & routes[b][1]) / max(len(routes[a][1]), len(routes[b][1])) >= threshold}
        frame = spark.createDataFrame([(i, e, x) for i, (e, s) in routes.items() for x in s], "route_id long, ends long, item long")
        assert {(r.a_id, r.b_id) for r in graph.parallel_relations(frame, threshold).collect()} == want


def test_stretches_are_merged_where_they_are_measured(spark):
    shape = "id long, points array<struct<x double, y double>>"
    rng = random.Random(5)
    route = lambda: [(rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(3)]
    a = spark.createDataFrame([(i, route()) for i in range(8)] + [(8, [(0.0, 0.0), (100.0, 0.0)])], shape).coalesce(1)
    b = spark.createDataFrame([(i, route()) for i in range(60)] + [(60, [(20.0, 5.0), (40.0, 5.0)]), (61, [(5.0, 5.0), (5.0, 5.0)])], shape).coalesce(1)
    met = lines.near_segments(lines.segments(a), lines.segments(b), 12.0, 300.0).coalesce(1)
    plain = lines.inside_stretches(met, 12.0).selectExpr("s_id as id", "s_from_m + low * s_size as start_m", "s_from_m + high * s_size as end_m")
    union = lambda df: sorted(tuple(r)[:3] for r in lines.merge_intervals(df, ["id"], "start_m", "end_m").collect())
    few = lines.merged_stretches(met, 12.0)
    want, got = union(plain), union(few)
    assert len(got) == len(want) and all(g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want))
    assert few.count() < plain.count() / 3


def test_identity_escapes(spark):
    texts = ["plain", 'quo"te', "back\\slash", "tab\tnew\nline", "é日本🙂", "\x01\x7f", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", identity.quoted(F.col("t")).alias("q")).collect()
    assert [r.q for r in got] == [None if t is None else json.dumps(t) for t in texts]
    ids = spark.createDataFrame([("a", None), ("a", "b")], "p string, q string").select(identity.stable_id("x", F.col("p"), F.col("q")).alias("i")).collect()
    assert len({r.i for r in ids}) == 2 and all(len(r.i) == 14 for r in ids)


def test_official_class_synonyms(spark):
    want = {"A": "a-road", "class A": "a-road", "A_Road": "a-road", "a-road": "a-road", "C": "classified-unnumbered", "U": "unclassified", " Not  Classified ": "not-classified", "lane": "unknown", None: "unknown"}
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", tags.official_class(F.col("c")).alias("k")).collect()
    assert {r.c: r.k for r in got} == want


def test_traffic_in_two_dimensions(spark):
    schema = "{} long, count_point long, road string, junction string, x double, y double"
    seen = spark.createDataFrame([(1, 5, None, None, 0.0, 0.0), (2, None, " A4 ", None, 0.0, 0.0), (3, None, None, None, 10.0, 10.0), (4, None, None, None, 10.0, 90.0), (5, 5, "a4", None, 10.0, 10.0)], schema.format("observation_id"))
    targets = spark.createDataFrame([(10, 5, "B1", None, 99.0, 99.0), (11, None, "a4", "J1", 99.0, 0.0), (12, None, None, None, 12.0, 12.0)], schema.format("target_id"))
    got = {r.observation_id: (r.target_id, r.relation, r.state) for r in selection.match_traffic(seen, targets, 5.0).collect()}
    assert got == {1: (10, "count-point", "matched"), 2: (11, "link-identity", "matched"), 3: (12, "buffer", "matched"), 4: (None, "none", "unmatched"), 5: (10, "count-point", "matched")}


def test_collapse_folds_stretches(spark):
    rows = [(1, 0.0, 0.0), (1, 0.2, 10.0), (1, 0.4, 20.0), (1, 0.6, 30.0), (1, 5.0, 1.0), (1, 10.0, 2.0), (2, 0.0, 7.0)]
    got = sorted(tuple(r) for r in linear.collapse(spark.createDataFrame(rows, "line_id long, at_m double, height_mm double"), 10.0).collect())
    assert [(r[0], round(r[1], 3), r[3]) for r in got] == [(1, 0.2, 3), (1, 0.6, 1), (1, 5.0, 1), (1, 10.0, 1), (2, 0.0, 1)]


def test_costs_walked_in_tasks_are_those_of_rounds(spark):
    rng = random.Random(12)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), rng.randrange(4)) for _ in range(130)], "src long, dst long, weight long")
    seeds = spark.createDataFrame([(r, rng.randrange(40), rng.randrange(3)) for r in range(6) for _ in range(2)], "root long, node long, cost long")
    told = lambda **more: {tuple(r) for r in graph.least_costs(seeds, edges, **more).select("root", "node", "cost", "via").collect()}
    assert told() == told(block_edges=0) and told(max_cost=4) == told(max_cost=4, block_edges=0) and told()


def test_costs_to_targets_alone(spark):
    rng = random.Random(15)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30), rng.randrange(4)) for _ in range(90)], "src long, dst long, weight long")
    seeds, targets = spark.createDataFrame([(r, r, 0) for r in range(4)], "root long, node long, cost long"), spark.createDataFrame([(n,) for n in (0, 2, 7, 8, 8, 99)], "node long")
    told = lambda **more: {tuple(r) for r in graph.least_costs(seeds, edges, **more).select("root", "node", "cost", "via").collect()}
    want = {r for r in told() if r[1] in (0, 2, 7, 8)}
    assert want == told(targets=targets) == told(targets=targets, block_edges=0) and len(want) > 4


def test_walks_in_tasks_take_nodes_of_several_columns(spark):
    rng = random.Random(13)
    edges = spark.createDataFrame([(("a", rng.randrange(12)), ("ab"[rng.random() < 0.2], rng.randrange(12)), rng.randrange(4)) for _ in range(60)], "src struct<kind string, n long>, dst struct<kind string, n long>, weight long")
    seeds = spark.createDataFrame([(r, ("a", rng.randrange(12)), 0) for r in range(3)], "root long, node struct<kind string, n long>, cost long")
    told = lambda **more: {(r.root, tuple(r.node), r.cost, r.via) for r in graph.least_costs(seeds, edges, **more).select("root", "node", "cost", "via").collect()}
    assert told() == told(block_edges=0) and any(r[3] for r in told())


def test_ways_of_a_thousand_edges_settle(spark):
    # Rounds stop at 500, and each was a few joins.
    edges = spark.range(1200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))
    rows = graph.shortest_paths(spark.range(1).withColumnRenamed("id", "node"), edges)
    assert rows.count() == 1201 and rows.where("cost <> node").isEmpty()


def test_attachment_walks_no_farther_than_a_stay_costs(spark):
    n = 60
    edges = spark.createDataFrame([e for i in range(n - 1) for e in ((i, i + 1, 10), (i + 1, i, 10))], "src long, dst long, weight long")
    starts = spark.createDataFrame([(i, i, 12) for i in range(n)] + [(i, i + 1, 3) for i in range(n - 1)] + [(n, 0, 1)], "request_id long, node long, snap long")
    ends = spark.createDataFrame([(i, i, 4) for i in range(n)] + [(i, n - 1 - i, 0) for i in range(n)] + [(n, 59, 2)], "request_id long, node long, snap long")
    costs = routing._costs_needed(starts, ends, edges, None, True, None).collect()
    # Request 60 stays nowhere, so its one start goes all the way; the others go no farther than 13 of 16.
    assert max(r.cost for r in costs if r.root) == 10 and max(r.cost for r in costs if not r.root) == 590 and len(costs) < 4 * n + n
    pairs = {}
    for q, s, a in starts.collect():
        for p, e, b in ends.collect():
            if p == q:
                pairs.setdefault(q, []).append((a + 10 * abs(s - e) + b, a, b, s, e))
    got = {r.request_id: (r.total, r.start_snap, r.end_snap, r.start, r.end) for r in routing.best_attachment(starts, ends, edges).collect()}
    assert got == {q: min(p) for q, p in pairs.items()}


def test_parallel_copies_meet_as_one_class_and_links_stay_few(spark, monkeypatch):
    from tracewright.operators import parallel

    monkeypatch.setattr(parallel, "BLOCK", 16)
    monkeypatch.setattr(parallel, "STRETCHES", 4)
    monkeypatch.setattr(parallel, "COPIES", 3)
    rng = random.Random(5)
    kinds = [(e, {rng.randrange(12) for _ in range(rng.randrange(1, 9))}) for e in range(2) for _ in range(30)]
    routes = {i: kinds[i % 60] for i in range(180)}
    frame = spark.createDataFrame([(f"r{i}", e, x) for i, (e, s) in routes.items() for x in s], "route_id string, ends long, item long")
    name = sorted(routes, key=lambda i: f"r{i}")
    want = {}
    for at, a in enumerate(name):
        for b in name[at + 1 :]:
            share = len(routes[a][1] & routes[b][1]) / max(len(routes[a][1]), len(routes[b][1]))
            if routes[a][0] == routes[b][0] and share >= 0.5:
                want[f"r{a}", f"r{b}"] = share
    rows = graph.parallel_relations(frame, 0.5).collect()
    assert {(r.a_id, r.b_id): r.coverage for r in rows} == want and len(rows) == len(want)
    links = graph.parallel_links(frame, 0.5)
    assert links.count() < len(want) / 4
    whole = spark.createDataFrame(list(want), "src string, dst string")
    part = lambda df: {r.node: r.component for r in connected_components(df).collect()}
    assert part(links) == part(whole)


def test_collapse_folds_wide_stretches_together(spark, monkeypatch):
    monkeypatch.setattr(linear, "FOLDED", 20)
    rng = random.Random(8)
    rows = [(line, x / 10, float(rng.randrange(50))) for line in range(6) for x in sorted(rng.sample(range(400), 60))]
    want = []
    for line in range(6):
        clusters = []
        for _, x, h in (r for r in rows if r[0] == line):
            if clusters and x - clusters[-1][0][0] <= 0.5:
                clusters[-1].append((x, h))
            else:
                clusters.append([(x, h)])
        middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        made = [(middle([x for x, _ in c]), middle([h for _, h in c]), len(c)) for c in clusters]
        for k, (x, h, n) in enumerate(made):
            if 0 < k < len(made) - 1 and n > 1 and (h - made[k - 1][1]) * (made[k + 1][1] - h) < 0:
                h = made[k - 1][1] + (made[k + 1][1] - made[k - 1][1]) * (x - made[k - 1][0]) / (made[k + 1][0] - made[k - 1][0])
            want.append((line, round(x, 6), round(h, 6), n))
    got = linear.collapse(spark.createDataFrame(rows, "line_id long, at_m double, height_mm double"), 10.0).collect()
    assert sorted((r.line_id, round(r.at_m, 6), round(r.height_mm, 6), r.n) for r in got) == sorted(want)


def test_reach_near_is_reach_over_near_pairs(spark):
    rng = random.Random(17)
    spots = {i: (rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(90)} | {90: (900.0, 0.0)}
    want, front, hops = {i: 0 for i in spots if i % 30 == 1}, {i for i in spots if i % 30 == 1}, 0
    while front:
        hops += 1
        front = {b for b in spots if b not in want and any(math.dist(spots[a], spots[b]) <= 45 for a in front)}
        want |= dict.fromkeys(front, hops)
    frame = spark.createDataFrame([(i, *p) for i, p in spots.items()], "node long, x double, y double")
    rows = spatial.reach_near(frame, frame.where("node % 30 = 1"), 45.0).collect()
    assert {r.node: r.hops for r in rows} == want and len(rows) == len(want) and max(want.values()) > 2
