"""Attachment, interval sets, planar faces, witness paths, lineages, portals and shapes against plain computations."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import attachment, intervals, lineage, planar, portals, shapes, witness
from tracewright.operators.lines import near_segments, segments

LINE = "id long, points array<struct<x double, y double>>"
POINT = "point_id long, x double, y double"


def line(*spots):
    return [(float(x), float(y)) for x, y in spots]


def nearest_on(points, x, y):
    best, gone = (math.inf, 0, 0.0), 0.0
    for seq, ((ax, ay), (bx, by)) in enumerate(itertools.pairwise(points)):
        size = math.hypot(bx - ax, by - ay)
        if not size:
            continue
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size**2))
        d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
        if (d, seq) < best[:2]:
            best = (d, seq, gone + t * size)
        gone += size
    return best[0], best[2]


def wander(rng, n, step=30):
    spots = [(rng.uniform(0, 300), rng.uniform(0, 300))]
    for _ in range(n):
        spots.append((spots[-1][0] + rng.uniform(-step, step), spots[-1][1] + rng.uniform(-step, step)))
    return line(*spots)


def test_places_and_nodes_on_lines(spark):
    rng = random.Random(1)
    lines = {i: wander(rng, rng.randrange(1, 6)) for i in range(25)} | {90: line((5, 5), (5, 5))}
    points = {i: (rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(40)} | {70: lines[3][1]}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(99, None, 1.0)], POINT)
    shapes_ = spark.createDataFrame(list(lines.items()), LINE)
    got = {(r.point_id, r.line_id): (r.distance, r.at_m) for r in attachment.places_on_lines(df, shapes_, 40.0, 60.0).collect()}
    want = {(p, i): w for p, (x, y) in points.items() for i, pts in lines.items() if (w := nearest_on(pts, x, y))[0] <= 40}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and (70, 3) in want
    rows = attachment.nodes_on_lines(df.withColumnRenamed("point_id", "node"), shapes_, 40.0).collect()
    for i in lines:
        order = sorted((want[p, j][0], p) for p, j in want if j == i)
        assert [(r.node, r.place) for r in sorted(rows, key=lambda r: r.place) if r.id == i] == [(p, k + 1) for k, (_, p) in enumerate(order)]


def test_places_on_long_lines_and_without_a_shuffle_of_pairs(spark):
    rng = random.Random(7)
    lines = {1: wander(rng, 200), 2: wander(rng, 3, 400), 3: wander(rng, 1), 4: line((0, 0), (0, 0), (50, 0)), 5: line((0, 0), (0, 0), (50, 0), (50, 0), (0, 0.5)), 6: line((0, 0), (3000, 10), (0, 20))}
    points = {i: (rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(60)} | {90: (10.0, -0.25), 91: (-5.0, 0.0)}
    df, shapes_ = spark.createDataFrame([(i, *p) for i, p in points.items()], POINT), spark.createDataFrame(list(lines.items()), LINE)
    rows = attachment.near_places(df, shapes_, 40.0, 60.0)
    got = {(r.point_id, r.id): (r.distance, r.at_m) for r in rows.collect()}
    want = {(p, i): w for p, (x, y) in points.items() for i, pts in lines.items() if (w := nearest_on(pts, x, y))[0] <= 40}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and (91, 4) in want and (90, 6) in want
    assert "hashpartitioning(point_id" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 4096])
def test_shares_of_bent_streets_are_measured_pair_by_pair(spark, monkeypatch, few):
    monkeypatch.setattr(attachment, "FEW", few)
    bent, other = line((0, 0), (100, 0), (100, 100)), line((0, 10), (110, 10), (110, 40))
    # The second pair lies where the first does, but its own other line is far off.
    pairs = spark.createDataFrame([(1, bent, other), (2, bent, line((0, 900), (100, 900), (100, 990))), (3, bent, line((5, 5)))], "id long, points array<struct<x double, y double>>, other array<struct<x double, y double>>")
    got = {r.id: round(r.share, 6) for r in attachment.pair_shares(pairs, 20.0, 50.0).collect()}
    whole = (100 + 40 + math.sqrt(20**2 - 10**2)) / 200
    assert got == {1: round(whole, 6), 2: 0.0, 3: 0.0}
    met = near_segments(segments(pairs.select("id", "points")), segments(pairs.select("id", pairs.other.alias("points"))), 20.0, 50.0, own=True)
    assert {(r.s_id, r.t_id) for r in met.collect()} == {(1, 1)}


def test_points_attach_to_nodes_and_inside_edges(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 100.0, 100.0), ("d", 0.0, 100.0)], "node string, x double, y double")
    go, bend = line((0, 0), (100, 0)), line((100, 100), (900, 900), (0, 100))
    edges = [("ab", "a", "b", 100.0, go), ("ba", "b", "a", 100.0, go[::-1]), ("bc", "b", "c", 120.0, line((100, 0), (100, 100))), ("cd", "c", "d", 100.0, line((100, 100), (0, 100))), ("dc", "d", "c", 2000.0, bend[::-1])]
    edges = spark.createDataFrame(edges, "edge_id string, src string, dst string, length double, points array<struct<x double, y double>>")
    points = spark.createDataFrame([(1, 30.0, 10.0), (2, 95.0, 50.0), (3, 50.0, 104.0), (4, 100.0, 0.0), (5, 30.0, -40.0)], POINT)
    rows = attachment.point_attachments(points, nodes, edges, 33.0, 50.0).collect()
    got = sorted(((r.point_id, r.node, r.edge_id, r.reverse_edge_id, round(r.association_m, 6), round(r.prefix_m, 6), round(r.routing_m, 6)) for r in rows), key=str)
    # bc has no way back, dc does not run along cd; b itself is the end of both edges.
    near = round(math.hypot(30, 10), 6)
    assert got == [(1, "a", None, None, near, 0.0, near), (1, "a", "ba", "ab", 10.0, 30.0, 40.0), (1, "b", "ab", "ba", 10.0, 70.0, 80.0), (4, "b", None, None, 0.0, 0.0, 0.0)]
    ways = edges.select("src", "dst", (F.col("length") * 1000).cast("long").alias("weight"))
    ends = spark.createDataFrame([(1, "b", 5), (4, "a", 0), (2, "a", 0)], "request_id long, node string, snap long")
    best = {r.request_id: (r.start, r.end, r.edge_id, r.association_mm, r.prefix_mm, r.total) for r in attachment.best_point_attachment(attachment.point_attachments(points, nodes, edges, 33.0, 50.0), ends, ways).collect()}
    assert best == {1: ("b", "b", "ab", 10000, 70000, 80005), 4: ("b", "a", None, 0, 0, 100000)}
    moved = attachment.best_point_attachment(attachment.point_attachments(points, nodes, edges, 33.0, 50.0), ends, ways, allow_stationary=False).where("request_id = 1").first()
    assert (moved.start, moved.end, moved.edge_id, moved.total) == ("a", "b", None, 31623 + 100000 + 5)


SPAN = "id long, start_m double, end_m double"


def cover(rows, n=40):
    return {i: {m for a, b in ((a, b) for j, a, b in rows if j == i) for m in range(int(a), int(b))} for i in range(4)}


@pytest.mark.parametrize("operation", ["union", "intersection", "difference"])
def test_interval_sets(spark, operation):
    rng = random.Random(3)
    make = lambda: [(rng.randrange(4), float(a), float(a + rng.randrange(0, 9))) for a in rng.sample(range(40), 20)]
    a, b = make(), make()
    got = intervals.combine(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["id"], operation).collect()
    one, two = cover(a), cover(b)
    want = {i: {"union": one[i] | two[i], "intersection": one[i] & two[i], "difference": one[i] - two[i]}[operation] for i in range(4)}
    assert cover([tuple(r) for r in got]) == want
    for i in range(4):  # merged: nothing touches
        own = sorted((r.start_m, r.end_m) for r in got if r.id == i)
        assert all(x[1] < y[0] for x, y in itertools.pairwise(own))


def test_reuse_advantage(spark):
    rng = random.Random(6)
    lines = [(i, 30.0) for i in range(4)] + [(7, 0.0), (8, 12.0)]
    rows = [(rng.randrange(4), e, float(s := rng.randrange(-2, 30)), float(s + rng.randrange(1, 8)), bool(e % 2), e % 3 == 0, e % 5 == 0, e % 4 == 0) for e in range(14) for _ in range(2)]
    matches = spark.createDataFrame(rows, "id long, evidence_id long, start_m double, end_m double, recognised boolean, reusable boolean, declassified boolean, delivered boolean")
    got = {r.id: r for r in intervals.reuse_advantage(spark.createDataFrame(lines, "id long, length_m double"), matches, 4.0).collect()}
    assert got.keys() == {i for i, _ in lines} and got[8].unknown_m == 12.0 and got[7].matched_share == 0.0

    def runs(cells):
        out, last = [], None
        for m in sorted(cells):
            if last is None or m != last + 1:
                out.append([])
            out[-1].append(m)
            last = m
        return out

    for i in range(4):
        own = {}
        for j, e, a, b, *flags in rows:
            if j == i:
                own.setdefault(e, (set(), flags))[0].update(m for m in range(int(a), int(b)) if 0 <= m < 30)
        good = {m for run in runs(set().union(*(c for c, _ in own.values()))) if len(run) >= 4 for m in run}
        on = lambda k: {m for c, f in own.values() if f[k] for m in c} & good
        want = (len(good), len(on(0)), len(on(1)), len(on(2) - on(0)), 30 - len(good), len(on(3)), max(map(len, runs(good)), default=0), max(map(len, runs(on(0))), default=0), max(map(len, runs(on(1))), default=0))
        r = got[i]
        assert (r.matched_m, r.recognised_m, r.reusable_m, r.declassified_m, r.unknown_m, r.delivered_m, r.longest_m, r.longest_recognised_m, r.longest_reusable_m) == want


def test_faces_of_random_linework(spark):
    """Noding leaves no crossing; faces are those of a plain walk; Euler's formula holds."""
    rng = random.Random(8)
    lines = [(i, line(*[(rng.randrange(0, 100), rng.randrange(0, 100)) for _ in range(3)])) for i in range(12)] + [(50, line((0, 0), (100, 0))), (51, line((50, 0), (100, 0), (100, 40))), (52, line((200, 200), (210, 200), (210, 210), (200, 200)))]
    edges = planar.noded(spark.createDataFrame(lines, LINE), 30.0)
    rows = edges.collect()
    nodes = {n for r in rows for n in (r.a, r.b)}
    halves = planar.half_edges(edges).collect()
    assert len(halves) == 2 * len(rows)
    out = {}
    for h in halves:
        out.setdefault(h.src, []).append((math.atan2(h.by - h.ay, h.bx - h.ax), h.edge_id, h.way, h.dst))
    walked = {}
    for h in halves:
        if (h.edge_id, h.way) in walked:
            continue
        face, at = [], (h.edge_id, h.way, h.dst)
        while at[:2] not in walked:
            walked[at[:2]] = (h.edge_id, h.way)
            face.append(at)
            around = sorted(out[at[2]])
            k = next(k for k, o in enumerate(around) if o[1:3] == (at[0], 1 - at[1]))
            at = around[k - 1][1:]
    label = {}
    for h in halves:
        label.setdefault(walked[h.edge_id, h.way], set()).add(tuple(h.face))
    assert all(len(v) == 1 for v in label.values()) and len({min(v) for v in label.values()}) == len(label)
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        parent[root(r.a)] = root(r.b)
    parts = len({root(n) for n in nodes})
    found = planar.faces(planar.half_edges(edges)).collect()
    # One outer circuit a component; V - E + F = 1 + C with one outer face in all.
    assert len(nodes) - len(rows) + (len(found) - parts + 1) == 1 + parts
    assert sum(f.area for f in found) == pytest.approx(0, abs=1e-6) and sum(f.area < 0 for f in found) >= 1
    crossing = planar.noded(spark.createDataFrame([(k, [(r.ax, r.ay), (r.bx, r.by)]) for k, r in enumerate(rows)], LINE), 30.0)
    assert {(r.a, r.b) for r in crossing.collect()} == {(r.a, r.b) for r in rows}


def test_rings_hold_points(spark):
    rng = random.Random(9)
    rings = {k: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(7)] for k in range(6)}
    legs = [(k, *a, *b) for k, r in rings.items() for a, b in zip(r, r[1:] + r[:1])]
    points = [(i, rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(80)]

    def held(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                odd = not odd
        return odd

    got = planar.inside_rings(spark.createDataFrame(points, POINT), spark.createDataFrame(legs, "ring long, ax double, ay double, bx double, by double"), 15.0)
    assert {tuple(r) for r in got.collect()} == {(i, k) for i, x, y in points for k, r in rings.items() if held(r, x, y)}


def test_low_traffic_cells(spark):
    """Two squares with a common governed side; a third one is open along an ungoverned side."""
    walls = [(1, line((0, 0), (200, 0))), (2, line((0, 100), (200, 100))), (3, line((0, 0), (0, 100))), (4, line((100, 0), (100, 100))), (5, line((200, 0), (200, 100))), (6, line((200, 0), (300, 0), (300, 100), (200, 100)))]
    boundaries = spark.createDataFrame([(i, p, i != 6) for i, p in walls], LINE + ", governed boolean")
    ways = [(11, line((20, 0), (20, 60)), True), (12, line((20, 60), (90, 60)), False), (13, line((90, 60), (150, 60)), True), (14, line((150, 60), (150, 100)), True), (15, line((250, 10), (250, 40)), True), (16, line((250, 40), (260, 60)), True), (17, line((20, 30), (40, 30)), False)]
    streets = spark.createDataFrame(ways, LINE + ", residential boolean")
    cells, doors, pairs = planar.low_traffic_cells(boundaries, streets, 40.0)
    assert sorted((r.area, r.perimeter, r.n_streets, r.n_portals) for r in cells.collect()) == [(10000.0, 400.0, 2, 1), (10000.0, 400.0, 3, 1)] or sorted((round(r.area), r.n_streets) for r in cells.collect()) == [(10000, 2), (10000, 3)]
    assert sorted((r.boundary_id, r.x_mm, r.y_mm) for r in doors.collect()) == [(1, 20000, 0), (2, 150000, 100000), (4, 100000, 60000)]
    assert [r.n_common for r in pairs.collect()] == [1]


def dijkstra(edges, origin, goal, key):
    queue, done = [(0, (), origin, ())], {}
    while queue:
        cost, rank, node, ids = heapq.heappop(queue)
        if node in done:
            continue
        done[node] = (cost, ids)
        for e, a, b, w in edges:
            if a == node and b not in done:
                heapq.heappush(queue, (cost + w, rank + (key(e, b),), b, ids + (e,)))
    return done.get(goal)


@pytest.mark.parametrize("by", ["edge", "node"])
def test_witness_paths_with_ties(spark, by):
    rng = random.Random(5)
    names = list(range(200))
    rng.shuffle(names)
    edges = [(names.pop(), a, b, rng.randrange(1, 4)) for a, b in ((rng.randrange(22), rng.randrange(22)) for _ in range(80)) if a != b]
    pairs = [(a, b) for a in range(0, 24, 3) for b in range(1, 24, 4)] + [(2, 2)]
    key = (lambda e, b: (e, b)) if by == "edge" else (lambda e, b: (b, e))
    got = {}
    for r in witness.witness_paths(spark.createDataFrame(pairs, "origin long, destination long"), spark.createDataFrame(edges, "edge_id long, src long, dst long, weight long"), by).collect():
        got.setdefault((r.origin, r.destination, r.cost), []).append((r.place, r.edge_id))
    want = {(a, b, f[0]): f[1] for a, b in pairs if a != b and (f := dijkstra(edges, a, b, key))}
    assert {k: tuple(e for _, e in sorted(v)) for k, v in got.items()} == want and len(want) > 20
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in got.values())
    with pytest.raises(ValueError, match="positive"):
        witness.witness_paths(spark.createDataFrame(pairs, "origin long, destination long"), spark.createDataFrame([(1, 0, 1, 0)], "edge_id long, src long, dst long, weight long"))


def test_directness_and_named_roots(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 5000), ("e2", "b", "c", 5000)], "edge_id string, src string, dst string, weight long")
    hidden = spark.createDataFrame([("c", "d", 1000)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 6.0, 0.0), ("d", 7.0, 0.0)], "node string, x double, y double")
    asked = spark.createDataFrame([(1, "a", "c"), (2, "a", "d"), (3, "c", "a"), (4, "a", "a")], "obligation_id long, origin string, destination string")
    got = {r.obligation_id: (r.network_mm, r.straight_mm, r.ratio and round(r.ratio, 6), r.state) for r in witness.directness(asked, nodes, edges.drop("edge_id"), hidden).collect()}
    assert got == {1: (10000, 6000, round(10 / 6, 6), "available"), 2: (None, 7000, None, "unknown"), 3: (None, 6000, None, "no-path"), 4: (0, 0, None, "available")}
    roots = spark.createDataFrame([(1, line((0, -5), (0, 5))), (2, line((6.5, -5), (6.5, 5))), (3, line((50, 0), (60, 0))), (4, line((3, 4), (3, 9)))], "root_id long, points array<struct<x double, y double>>")
    requests = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 2, 1)], "request_id long, from_root long, to_root long")
    rows = {r.request_id: (r.start, r.end, r.total_mm, r.state) for r in witness.named_root_paths(requests, roots, nodes.where("node <> 'd'"), edges, 1.0).collect()}
    assert rows == {1: ("a", "c", 10500, "traversed"), 2: (None, None, None, "beyond-closure"), 3: ("a", "b", 5000, "traversed"), 4: ("c", "a", 10500, "traversed")}


def test_lineages_and_circles(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b"), ("x", "y"), ("y", "x"), ("a", None)], "item string, parent string")
    starts = spark.createDataFrame([(1, "c"), (1, "d"), (2, "x"), (3, "q")], "start_id long, item string")
    got = {(r.start_id, r.item): r.steps for r in lineage.lineage(starts, parents).collect()}
    assert got == {(1, "c"): 0, (1, "d"): 0, (1, "b"): 1, (1, "a"): 2, (2, "x"): 0, (2, "y"): 1, (3, "q"): 0}
    meetings = spark.createDataFrame([(1, "c", "d", 7)], "meeting_id long, from_place string, to_place string, length_mm long")
    links = spark.createDataFrame([("k1", "c", "b", "B1", 1), ("k2", "b", "a", "B1", 2), ("k3", "d", "b", "B2", 4)], "connection_id string, place string, parent_place string, branch_id string, length_mm long")
    r = lineage.connectors(meetings, links).first()
    assert (r.n_connections, r.n_branches, list(r.roots), r.first_branch, r.depth, r.length_mm) == (3, 2, ["a"], "B1", 2, 14)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (2, 4), (1, 3)]
    rows = lineage.circle_witnesses(spark.createDataFrame(edges, "src long, dst long")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append((r.src, r.dst))
    assert set(by) == {3, 5, 8} and all(set(v) <= set(edges) for v in by.values())
    for v in by.values():  # each is one closed walk
        step = dict(v)
        at = seen = v[0][0]
        for _ in v:
            at = step[at]
        assert at == seen and len(step) == len(v)
    assert lineage.circle_witnesses(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def test_cell_portals(spark):
    lines = [(1, line((5, 5), (25, 15))), (2, line((0, 0), (20, 20))), (3, line((10, 2), (10, 8))), (4, line((1, 1), (2, 2))), (5, line((-5, 5), (5, 5), (-5, 6)))]
    got = {}
    for r in portals.cell_portals(spark.createDataFrame(lines, LINE), 10.0).collect():
        got.setdefault(r.id, set()).add(((r.left_x, r.left_y), (r.right_x, r.right_y), r.x_mm / 1000, r.y_mm / 1000))
    assert got[1] == {((0, 0), (1, 0), 10.0, 7.5), ((1, 1), (2, 1), 20.0, 12.5), ((1, 0), (1, 1), 15.0, 10.0)}
    corner = lambda k: {((k - 1, r), (k, r), 10.0 * k, 10.0 * k) for r in (k - 1, k)} | {((c, k - 1), (c, k), 10.0 * k, 10.0 * k) for c in (k - 1, k)}
    assert got[2] == corner(0) | corner(1) | corner(2)
    assert got[3] == {((0, 0), (1, 0), 10.0, 2.0), ((0, 0), (1, 0), 10.0, 8.0)}
    assert 4 not in got and {p[2:] for p in got[5]} == {(0.0, 5.0), (0.0, 5.5)}


def test_gateways_and_top_portals(spark):
    ring = [(1, *a, *b) for a, b in zip([(0, 0), (10, 0), (10, 10), (0, 10)], [(10, 0), (10, 10), (0, 10), (0, 0)])]
    rings = spark.createDataFrame([(k, *map(float, r)) for k, *r in ring], "ring long, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([(1, line((5, 5), (20, 5))), (2, line((5, 6), (20, 7))), (3, line((5, 5), (5, -9))), (4, line((2, 2), (4, 14), (6, 2)))], LINE)
    centres = spark.createDataFrame([("east", 40.0, 5.0), ("south", 5.0, -30.0), ("west", -20.0, 5.0)], "centre_id string, x double, y double")
    got = {r.centre_id: (r.line_id, round(r.x, 3), round(r.y, 3)) for r in portals.gateways(lines, rings, centres, 8.0).collect()}
    assert got["east"] == (1, 10.0, 5.0) and got["south"] == (3, 5.0, 0.0) and got[None][0] == 4 and set(got) == {"east", "south", None}
    spots = spark.createDataFrame([("a", float(i), 0.0) for i in (1, 2, 3, 4, 5, 5)] + [("b", 1.0, 1.0)], "area string, x double, y double")
    top = portals.top_portals(spots, spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0)], "area string, cx double, cy double"), "area")
    assert sorted((r.area, r.place, r.x) for r in top.collect()) == [("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 3.0), ("a", 4, 2.0), ("b", 1, 1.0)]


def far(one, other):
    gap = lambda x, y, sets: min(nearest_on(s, x, y)[0] for s in sets)
    return max(max(gap(x, y, other) for s in one for x, y in s), max(gap(x, y, one) for s in other for x, y in s))


def test_hausdorff_and_seeded_alignment(spark):
    rng = random.Random(12)
    left = {i: [wander(rng, 4) for _ in range(rng.randrange(1, 3))] for i in range(15)}
    right = {i: [wander(rng, 4) for _ in range(rng.randrange(1, 3))] for i in range(3, 18)}
    rows = lambda d: spark.createDataFrame([(i, p) for i, v in d.items() for p in v], LINE)
    got = {r.id: r.distance for r in shapes.hausdorff(rows(left), rows(right), 10.0).collect()}
    assert got.keys() == left.keys() & right.keys() and all(got[i] == pytest.approx(far(left[i], right[i])) for i in got)
    options = spark.createDataFrame([(1, "x", line((0, 0), (50, 30), (100, 0))), (1, "y", line((0, 0), (50, 5), (100, 0))), (2, "z", line((0, 500), (9, 500)))], "group_id long, option_id string, points array<struct<x double, y double>>")
    references = spark.createDataFrame([(1, line((0, 2), (60, 2))), (2, line((60, 2), (100, 2))), (3, line((0, 900), (1, 900)))], LINE)
    ends = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 500.0, 9.0, 500.0)], "group_id long, ax double, ay double, bx double, by double")
    assert [(r.group_id, r.option_id, round(r.distance, 6), r.n_references) for r in shapes.seeded_alignment(options, references, ends, 110.0).collect()] == [(1, "y", 3.0, 2)]


def test_bindings(spark):
    shape = {"p": line((0, 0), (10, 0)), "q": line((0, 3), (10, 3)), "r": line((0, 40), (10, 40))}
    assets = spark.createDataFrame([("A", shape["p"], ["s1", "u"]), ("B", shape["q"], ["s1"]), ("C", shape["r"], ["s1"]), ("D", shape["q"], ["s2"]), ("E", shape["q"][::-1], ["s2"])], "asset_id string, points array<struct<x double, y double>>, identities array<string>")
    near = line((0, 0.5), (10, 0.5))
    candidates = spark.createDataFrame([(1, near), (2, shape["q"]), (3, line((0, 1.5), (10, 1.5))), (4, line((0, 20), (10, 20))), (5, near), (6, near), (7, shape["q"])], "candidate_id long, points array<struct<x double, y double>>")
    claims = spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s1"), (4, "s1"), (5, "u"), (5, "s1"), (7, "s2")], "candidate_id long, identity string")
    got = {(r.candidate_id, r.asset_id, r.state) for r in shapes.bind_geometry(candidates, assets, claims, 1.9).collect()}
    assert got == {(1, "A", "nearest"), (2, "B", "exact"), (3, None, "ambiguous"), (4, None, "unbound"), (5, "A", "identity"), (6, None, "unclaimed"), (7, None, "ambiguous")}


def test_equal_distances_tie_as_roots_of_squares_do(spark):
    # Lines that come back over their own way: both legs are as near, and the last digit decides, as it does in SQL.
    cases = [((-124.0, -1536.0), (-52.0, -1399.0), (-124.0, -1536.0), (-186.0, -1436.0)), ((-169.0, 45.0), (-219.0, -121.0), (-169.0, 45.0), (-93.0, -73.0)), ((-1734.0, 250.0), (-1782.0, 66.0), (-1686.0, 434.0), (-1866.0, 130.0))]
    lines = spark.createDataFrame([(i, line(*c[:3])) for i, c in enumerate(cases)], LINE)
    points = spark.createDataFrame([(i, *c[3]) for i, c in enumerate(cases)], POINT)
    got = {r.point_id: (r.distance, r.at_m) for r in attachment.places_on_lines(points, lines, 500.0, 200.0).where("point_id = line_id").collect()}
    for i, (a, b, c, p) in enumerate(cases):
        found, gone = [], 0.0
        for q, r in ((a, b), (b, c)):
            dx, dy = r[0] - q[0], r[1] - q[1]
            size = math.sqrt(dx * dx + dy * dy)
            t = max(0.0, min(1.0, ((p[0] - q[0]) * dx + (p[1] - q[1]) * dy) / (dx * dx + dy * dy)))
            u, v = p[0] - (q[0] + t * dx), p[1] - (q[1] + t * dy)
            found.append((math.sqrt(u * u + v * v), gone + t * size))
            gone += size
        assert got[i] == min(found, key=lambda f: f[0])


def test_near_segments_meet_once(spark):
    rng = random.Random(6)
    legs = spark.createDataFrame([(i, [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(2)]) for i in range(60)], LINE)
    own = segments(legs).cache()
    met = [(r.s_id, r.t_id) for r in near_segments(own, own, 25.0, 70.0).select("s_id", "t_id").collect()]
    rows = own.collect()
    apart = lambda s, t, lo, hi: max(min(s[lo], s[hi]) - max(t[lo], t[hi]), min(t[lo], t[hi]) - max(s[lo], s[hi]))
    want = {(s.id, t.id) for s in rows for t in rows if max(apart(s, t, "ax", "bx"), apart(s, t, "ay", "by")) <= 25}
    assert len(met) == len(set(met)) and set(met) == want


def test_seeded_alignment_measures_blocks_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(shapes, "GROUPS", 3)
    monkeypatch.setattr(shapes, "LINES", 4)
    rng = random.Random(31)
    references, options = {i: wander(rng, 4) for i in range(40)}, {(g, o): wander(rng, 4) for g in range(12) for o in range(2)}
    xy = lambda p: [(q["x"], q["y"]) if isinstance(q, dict) else tuple(q) for q in p]
    ends = {g: (*xy(options[g, 0])[0], *xy(options[g, 0])[-1]) for g in range(12)}

    def off(x, y, points):
        gaps = []
        for (ax, ay), (bx, by) in zip(points, points[1:]):
            dx, dy = bx - ax, by - ay
            if dx or dy:
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                gaps.append(math.hypot(x - ax - t * dx, y - ay - t * dy))
        return min(gaps)

    want, radius = {}, 60.0
    for g, (ax, ay, bx, by) in ends.items():
        near = [xy(p) for p in references.values() if off(ax, ay, xy(p)) <= radius and off(bx, by, xy(p)) <= radius]
        if near:
            far = [(max(max(min(off(x, y, p) for p in near) for x, y in xy(options[g, o])), max(off(x, y, xy(options[g, o])) for p in near for x, y in p)), o) for o in range(2)]
            want[g] = (min(far)[1], pytest.approx(min(far)[0]), len(near))
    frame = spark.createDataFrame([(g, o, p) for (g, o), p in options.items()], "group_id long, option_id long, points array<struct<x double, y double>>")
    tips = spark.createDataFrame([(g, *e) for g, e in ends.items()], "group_id long, ax double, ay double, bx double, by double")
    rows = shapes.seeded_alignment(frame, spark.createDataFrame(list(references.items()), LINE), tips, radius).collect()
    assert len(want) > 3 and {r.group_id: (r.option_id, r.distance, r.n_references) for r in rows} == want


def test_connectors_send_no_table_through_the_driver(spark):
    k = F.col("id")
    meetings = spark.range(1, 40).select(k.alias("meeting_id"), k.alias("from_place"), (k * 7 % 40).alias("to_place"), F.lit(1).cast("long").alias("length_mm"))
    links = spark.range(1, 40).select(F.concat(F.lit("c"), k).alias("connection_id"), k.alias("place"), F.floor(k / 3).alias("parent_place"), F.lit("b").alias("branch_id"), F.lit(2).cast("long").alias("length_mm"))
    rows = lineage.connectors(meetings, links)

    def above(x):
        return set() if x == 0 else {x} | above(x // 3)

    assert {r.meeting_id: r.n_connections for r in rows.collect()} == {m: len(above(m) | above(m * 7 % 40)) for m in range(1, 40)}
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
