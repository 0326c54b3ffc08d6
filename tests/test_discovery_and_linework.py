"""Candidate sets against an enumeration of all simple paths; chains, samples and road graphs by hand."""

import random

import pytest

from tracewright.operators import discovery, linework

EDGES = "edge_id long, src long, dst long, allowed boolean, length long, hills long"


def simple(edges, at, goal, seen=(), ids=()):
    if at == goal and ids:
        yield ids, (*seen, at)
        return
    for e, a, b, *_ in edges:
        if a == at and b not in (*seen, at):
            yield from simple(edges, b, goal, (*seen, at), (*ids, e))


@pytest.mark.parametrize("width", [2, 64])
def test_candidates_are_the_cheapest_simple_paths(spark, width):
    rng = random.Random(14)
    edges = [(k, a, b, rng.random() < 0.8, rng.randrange(1, 9), rng.randrange(0, 5)) for k, (a, b) in enumerate((rng.randrange(8), rng.randrange(8)) for _ in range(34)) if a != b]
    info = {e[0]: e for e in edges}
    pairs = [(i, *p) for i, p in enumerate([(0, 5), (1, 6), (2, 3), (4, 7), (0, 9), (3, 3)])]
    frame, asked = spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "obligation_id long, origin long, destination long")
    got = {}
    paths, _ = discovery.best_paths(asked, frame, ["length", "hills"], 3, width)
    for r in paths.collect():
        got[r.obligation_id, r.strategy, r.place] = tuple(r.edge_ids)
    want, sets = {}, {}
    for i, a, b in pairs:
        every = list(simple(edges, a, b)) if a != b else []
        for s, column in (("length", 4), ("hills", 5)):
            order = sorted(every, key=lambda p: (sum(info[e][column] for e in p[0]), p[1], p[0]))[:3]
            for k, p in enumerate(order):
                want[i, s, k + 1] = p[0]
                sets.setdefault(i, {}).setdefault(p[0], []).append(s)
    assert got == want and len(want) >= 10
    if width == 64:
        rows, told = discovery.discover(asked, frame, ["length", "hills"], k=3, detour_ceiling=1.4, max_candidates=2, width=width)
        size = lambda p: sum(info[e][4] for e in p)
        states = {(r.obligation_id, tuple(r.edge_ids)): (sorted(r.strategies), r.length, r.prohibited, r.state) for r in rows.collect()}
        assert {k: (v[0], v[1]) for k, v in states.items()} == {(i, p): (sorted(s), size(p)) for i, ps in sets.items() for p, s in ps.items()}
        for i, a, b in pairs:
            free = [size(p) for p, _ in simple([e for e in edges if e[3]], a, b)] if a != b else [0]
            direct = min(free, default=min((size(p) for p, _ in simple(edges, a, b)), default=None))
            r = told.where(f"obligation_id = {i}").first()
            own = [v for (o, _), v in states.items() if o == i]
            assert r.direct == direct and (r.reason == "no-path") == (direct is None) and r.n_candidates == sum(v[3] == "candidate" for v in own) <= 2
            assert all((v[3] == "detour-suppressed") == (v[1] > direct * 1.4 + 1e-9 and not v[2]) for v in own)


def test_budgets_cut_searches_short(spark):
    edges = [(10 * a + b, a, b, True, 1, 1) for a in range(7) for b in range(7) if a != b]
    asked = spark.createDataFrame([(1, 0, 6)], "obligation_id long, origin long, destination long")
    found, cut = discovery.best_paths(asked, spark.createDataFrame(edges, EDGES), ["length"], 200, 4, max_settlements=8)
    assert cut.count() == 1 and 0 < found.count() < 200


def test_lower_bound_factor(spark):
    schema = "cost double, length double, joined boolean"
    one = lambda rows: tuple(discovery.lower_bound_factor(spark.createDataFrame(rows, schema)).first())
    assert one([(8.0, 10.0, True), (30.0, 10.0, True)]) == (0.8, None) and one([(30.0, 10.0, True)]) == (1.0, None)
    assert one([(8.0, 10.0, False)])[1] == "non-canonical-edge-endpoints" and one([(0.0, 1.0, True)])[1] == "non-positive-or-non-finite-edge-cost"
    assert one([(1.0, float("nan"), True)])[1] == "non-positive-or-non-finite-geometry" and one([])[1] == "no-edges"


PIECES = "edge_id long, a string, b string, points array<struct<x double, y double>>"


def test_chains_and_rings(spark):
    at = {"a": (0.0, 0.0), "b": (1.0, 0.0), "c": (2.0, 0.0), "d": (2.0, 1.0), "e": (3.0, 0.0), "p": (9.0, 9.0), "q": (9.0, 8.0), "r": (8.0, 8.0), "z": (5.0, 5.0)}
    ends = [(1, "a", "b"), (2, "c", "b"), (3, "c", "d"), (4, "c", "e"), (5, "p", "q"), (6, "q", "r"), (7, "r", "p"), (8, "z", "z")]
    pieces = spark.createDataFrame([(i, a, b, [at[a], at[b]] if a != b else [at[a], (6.0, 5.0), at[a]]) for i, a, b in ends], PIECES)
    lines = {}
    for r in linework.chains(pieces).collect():
        lines.setdefault(tuple(r.line), []).append((r.place, r.edge_id))
    assert sorted(tuple(sorted(e for _, e in v)) for v in lines.values()) == [(1, 2), (3,), (4,), (5, 6, 7), (8,)]
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in lines.values())
    whole = sorted([tuple(p) for p in r.points] for r in linework.continuous(pieces).collect())
    assert [at["a"], at["b"], at["c"]] in whole or [at["c"], at["b"], at["a"]] in whole
    ring = next(w for w in whole if at["q"] in w)
    assert len(ring) == 4 and ring[0] == ring[-1] and len(whole) == 5


def test_pieces_between_junctions_are_not_written(spark, monkeypatch):
    ends = [(10 * a + b, str(a), str(b)) for a in range(9) for b in range(a)] + [(100, "0", "x"), (101, "y", "x"), (102, "8", "8"), (103, "s", "t")]
    written, plain = [], linework.checkpointed

    def kept(df):
        df = plain(df)
        written.append(df.count())
        return df

    monkeypatch.setattr(linework, "checkpointed", kept)
    got = sorted((tuple(r.line), r.place, r.edge_id, r.way) for r in linework.chains(spark.createDataFrame(ends, "edge_id long, a string, b string")).collect())
    assert got == sorted([((e, 0), 0, e, 0) for e, _, _ in ends if e not in (100, 101)] + [((100, 1), 0, 101, 0), ((100, 1), 1, 100, 1)])
    assert max(written) <= 4


def test_samples_along_lines(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 500.0), (10.0, 500.0)])], "id long, points array<struct<x double, y double>>")
    rows = [(1, 10.0, 1.0, 5.0), (2, 10.0, -1.0, 6.0), (3, 60.0, 0.0, 4.0), (4, 90.0, 3.0, 9.0), (5, 50.0, 40.0, 1.0), (6, 70.0, 0.0, None), (7, 70.0, 0.0, float("nan"))]
    found = linework.samples_on_lines(spark.createDataFrame(rows, "sample_id long, x double, y double, value double"), lines, 5.0)
    assert sorted((r.place, r.sample_id, r.at_m, r.value) for r in found.collect()) == [(1, 2, 10.0, 6.0), (2, 3, 60.0, 4.0), (3, 4, 90.0, 9.0)]
    sized = spark.createDataFrame([(1, 100.0), (2, 10.0)], "id long, length_m double")
    assert sorted(tuple(r) for r in linework.variation(found, sized).collect()) == [(1, 3, 5.0, 2.0, 50.0), (2, 0, None, None, None)]


def test_road_graph(spark):
    rows = [("e1", 1, 2, 5, False), ("e2", 2, 3, 5, None), ("e3", 3, 4, 5, True), ("e4", 2, 1, 9, False), ("e5", 1, 2, 3, True), ("e6", 8, 9, 1, False)]
    edges = spark.createDataFrame(rows, "edge_id string, src long, dst long, length long, oneway boolean")
    got, nodes = linework.road_graph(edges)
    assert sorted((r.edge_id, r.src, r.dst, r.reciprocal) for r in got.collect()) == [("e2", 2, 3, True), ("e2:reverse", 3, 2, True), ("e3", 3, 4, False), ("e4", 2, 1, True), ("e5", 1, 2, True), ("e6", 8, 9, True), ("e6:reverse", 9, 8, True)]
    assert not any(r.dominant for r in nodes.collect())
    kept, nodes = linework.road_graph(edges, 0.5)
    assert sorted(r.edge_id for r in kept.collect()) == ["e2", "e2:reverse", "e4", "e5"] and {r.node for r in nodes.where("dominant").collect()} == {1, 2, 3}
