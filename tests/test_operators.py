"""Hand-computed cases for the planning operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import bands, geometry, identity, projection, tags
from tracewright.operators import demand, graph, line_evidence, linear, monitoring, priority, rules, selection, spatial, store, trees
from tracewright.operators.components import connected_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_extensive_law_and_dispositions(spark):
    matches = spark.createDataFrame([("a", "t", 30, 100, "accepted"), ("b", "t", 70, 100, "accepted"), ("c", "u", 10, 50, "accepted"), ("d", "v", 5, 50, "accepted"), ("a", "w", 9, 9, "ambiguous")], "source_id string, target_id string, shared_mm long, target_mm long, state string")
    seen = spark.createDataFrame([("a", "1", 10, "x"), ("b", "1", 20, "y"), ("c", "1", 5, "x"), ("c", "2", 6, "x")], "source_id string, observation_id string, value int, category string")
    seen = seen.withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = {r.target_id: (r.state, r.value) for r in line_evidence.aggregate(matches, seen, "extensive").collect()}
    assert out == {"t": ("available", 17.0), "u": ("conflicting", None), "v": ("no-data", None)}
    assert {r.target_id: r.value for r in line_evidence.aggregate(matches, seen, "share", "y").collect()}["t"] == 0.7
    assert rows(line_evidence.conflicts(seen)) == [("c", 2, 2, "contradictory-observations")]
    with pytest.raises(ValueError):
        line_evidence.aggregate(matches, seen, "median")


def test_low_demand_equality_place_is_kept(spark):
    points = spark.createDataFrame([("p", 0.0, 51.0, True), ("q", 0.1, 51.0, False), ("r", 0.2, 51.0, False)], "point_id string, lon double, lat double, equality boolean")
    flows = spark.createDataFrame([("1", "s", "p", "q", 3.0, "u"), ("2", "s", "q", "r", 3.0, "u"), ("3", "s", "q", "r", 8.0, "u")], "flow_id string, scenario_id string, origin_id string, destination_id string, trips double, unit string")
    lines = demand.desire_lines(points, flows, [demand.Scale("local", 0, 50, 10, True), demand.Scale("far", 10, 50, 1)])
    got = {(r.scale, r.origin_id): (r.retained, r.reason, r.trips) for r in lines.collect()}
    assert got[("local", "p")] == (True, "equality-access", 3.0)
    assert got[("local", "q")] == (True, "filters-passed", 11.0)
    assert got[("far", "p")] == (False, "filtered", 3.0)
    assert lines.count() == 4 and demand.filter_outcomes(lines).count() == 12


def test_missing_measure_gives_no_total_and_ties_share_a_rank(spark):
    measures = [priority.Measure("a", "x", "higher", 0, 10, 1), priority.Measure("b", "y", "lower", 0, 10, 1)]
    items = spark.createDataFrame([(1, 5.0, 5.0), (2, 6.0, 6.0), (3, 10.0, None), (4, 0.0, 9.0)], "intervention_id long, a double, b double")
    got = {r.intervention_id: (r.total, r["rank"], r.tied) for r in priority.ranked(priority.scores(items, measures)).collect()}
    assert got == {1: (0.5, 1, 1), 2: (0.5, 1, 1), 3: (None, None, 0), 4: (0.05, 3, 0)}


def test_schedule_fits_budgets_and_dependencies(spark):
    schema = "programme_id string, intervention_id long, rank long, upper_cost double, depends_on array<long>, excludes array<long>"
    items = spark.createDataFrame([("p", 1, 1, 60.0, [3], []), ("p", 2, 2, 60.0, [], [4]), ("p", 3, 3, 40.0, [], []), ("p", 4, 4, 1.0, [], [2]), ("p", 5, 5, None, [], []), ("p", 6, 6, 5.0, [99], [])], schema)
    got = {r.intervention_id: r.phase for r in priority.schedule(items, (100.0, 70.0)).collect()}
    assert got == {3: 0, 1: 1, 2: 0, 4: None, 5: None, 6: None}


def test_gradients_islands_and_profile(spark):
    s = spark.createDataFrame([(1, 0, 0), (1, 10, 200), (1, 20, 400), (1, 30, 100)], "line_id long, at_m long, height_mm long")
    g = linear.gradients(s)
    assert [(r.gradient_pct, r.band, r.direction) for r in g.orderBy("start_m").collect()] == [(2.0, "gentle", "forward"), (2.0, "gentle", "forward"), (-3.0, "gentle", "reverse")]
    assert [(r.start_m, r.end_m, r.gradient_pct) for r in linear.merge_sections(g).orderBy("start_m").collect()] == [(0, 20, 2.0), (20, 30, -3.0)]
    p = linear.profile(g).first()
    assert (p.ascent_mm, p.descent_mm) == (400, 300)


def test_interpolation_clamps_and_hits(spark):
    s = spark.createDataFrame([(1, 10, 100), (1, 20, 300)], "line_id long, at_m long, height_mm long")
    t = spark.createDataFrame([(1, x) for x in (0.0, 10.0, 12.5, 20.0, 99.0)] + [(2, 1.0)], "line_id long, target_m double")
    assert [r.height_mm for r in linear.interpolate(s, t).orderBy("line_id", "target_m").collect()] == [100, 100, 150, 300, 300, None]


def test_sections_follow_scope(spark):
    lines = spark.createDataFrame([(1, 300)], "line_id long, length_m long")
    urban = spark.createDataFrame([(1, 0, 150, "urban")], "line_id long, start_m long, end_m long, scope string")
    ranges = linear.fill_scopes(lines, urban, "rural")
    got = [(r.start_m, r.end_m, r.scope) for r in linear.sections(ranges).orderBy("section").collect()]
    assert got == [(0, 100, "urban"), (100, 150, "urban"), (150, 250, "rural"), (250, 300, "rural")]


def test_touching_intervals_merge(spark):
    i = spark.createDataFrame([("k", 0.0, 5.0), ("k", 5.0, 7.0), ("k", 8.0, 9.0), ("k", 1.0, 2.0)], "k string, start_at double, end_at double")
    assert rows(linear.merge_intervals(i, ["k"])) == [("k", 0.0, 7.0, 3), ("k", 8.0, 9.0, 1)]


def test_sustained_and_collapsed_samples(spark):
    s = spark.createDataFrame([(1, float(x), float(h)) for x, h in ((0, 0), (4, 1), (10, 2), (12, 9), (25, 3))], "line_id long, at_m double, height_mm double")
    assert [r.at_m for r in linear.sustained(s, 10).orderBy("at_m").collect()] == [0, 10, 25]
    near = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 50.0), (1, 10.2, 52.0), (1, 20.0, 10.0)], "line_id long, at_m double, height_mm double")
    got = linear.collapse(near, 100.0).orderBy("at_m").collect()
    assert [(r.at_m, r.n) for r in got] == [(0.0, 1), (10.1, 2), (20.0, 1)]
    assert got[1].height_mm == pytest.approx(5.05)


def test_distance_join_is_inclusive_and_complete(spark):
    import random

    rng = random.Random(0)
    pts = [(i, rng.randrange(-300, 300), rng.randrange(-300, 300)) for i in range(150)] + [(150, 0, 0), (151, 30, 40)]
    df = spark.createDataFrame(pts, "id long, x long, y long")
    want = sorted((a, c) for a, x, y in pts for c, u, v in pts if math.hypot(x - u, y - v) <= 50)
    assert rows(spatial.within(df, df, 50).select("id", "near_id")) == want
    near = {r.id: r.near_id for r in spatial.nearest(df.where("id < 20"), df.where("id >= 20"), "id", "id", 5).collect()}
    for a, x, y in pts[:20]:
        assert near[a] == min((math.hypot(x - u, y - v), c) for c, u, v in pts[20:])[1]
    assert spatial.nearest(df, df.limit(0), "id", "id", 5).count() == 0


def test_match_dispositions(spark):
    s = spark.createDataFrame([(1, 0, 0), (2, 100, 0), (3, 900, 0)], "id long, x long, y long")
    t = spark.createDataFrame([(7, 5, 0), (8, 95, 0), (9, 103, 0)], "id long, x long, y long")
    assert rows(spatial.match_disposition(s, t, 10).select("id", "target_id", "state")) == [(1, 7, "accepted"), (2, 8, "ambiguous"), (2, 9, "ambiguous"), (3, 9, "unmatched")]


def test_shared_and_exclusive_residents(spark):
    options = spark.createDataFrame([("a", 0, 0), ("b", 10, 0)], "option_id string, x long, y long")
    areas = spark.createDataFrame([(1, 5, -6, 0), (2, 7, 5, 0), (3, 11, 300, 0)], "oa_id long, residents long, x long, y long")
    records = spatial.reach_records(options, areas, [8.0], 3.0, F.lit(True))
    assert records.count() == 6
    got = {r.option_id: (r.total_residents, r.shared_residents, r.exclusive_residents) for r in spatial.reach_summary(records).collect()}
    assert got == {"a": (12, 7, 5), "b": (7, 7, 0)}
    top = spatial.reach_sensitivity(spatial.reach_summary(records), 0, 50).first()
    assert (top.winner, top.margin, top.near_equivalent, top.order_differs) == ("a", 5, True, False)


def test_store_query_refuses_unknown_columns(spark):
    f = spark.createDataFrame([(1, 0, 0, 1500, 10, "x"), (2, 9000, 0, 9001, 1, None)], "feature_id long, min_x long, min_y long, max_x long, max_y long, kind string")
    cells = store.cells(f, 1000.0)
    assert rows(store.query(cells, (1200, 0, 1300, 5), "intersects", {}, ["kind"])) == [(1, "x")]
    assert rows(store.query(cells, (8000, -5, 9500, 5), "within", {"kind": None}, [])) == [(2,)]
    with pytest.raises(ValueError):
        store.query(cells, (0, 0, 1, 1), "intersects", {"nope": 1})
    assert rows(store.owners(f, 1000.0)) == [(1, 0, 0), (2, 9, 0)]


def test_refresh_stitch_and_equivalence(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, f string")
    asked = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "k string, f string")
    assert rows(store.refresh_plan(held, asked, "k", "f")) == [("a", "retained"), ("b", "reused"), ("c", "replaced"), ("d", "missing")]
    assert rows(store.missing(asked.select("k"), held)) == [("d",)]
    assert store.equivalent(held, held.orderBy(F.desc("k"))).count() == 0
    assert store.equivalent(held, asked).count() == 4


def test_graph_basics(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 5), ("d", "e", 1), ("a", "d", 9), ("x", "x", 1)], "src string, dst string, weight long")
    n = spark.createDataFrame([(c,) for c in "abcdexz"], "node string")
    assert dict(rows(graph.components(n, e))) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x", "z": "z"}
    assert {r.node: r.component for r in graph.strong_components(n, e).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "e", "x": "x", "z": "z"}
    assert dict(rows(graph.reach(n.where("node = 'a'"), e, 2).select("node", "hops"))) == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r.node: (r.cost, r.via) for r in graph.shortest_paths(n.where("node = 'a'"), e).collect()} == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (7, "c"), "e": (8, "d")}
    assert {r.node: r.kind for r in graph.degrees(n, e).collect()}["z"] == "isolated"
    assert {(r.src, r.dst): r.state for r in graph.reciprocity(e.where("src <> dst")).collect()}[("a", "b")] == "one-way"


def test_components_of_a_long_path_and_no_edges(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(path).select("component").distinct().collect()[0].component == 0
    assert connected_components(path.limit(0)).count() == 0


def test_dependency_levels_leave_cycles_open(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "item long")
    need = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (4, 5), (5, 4)], "item long, on long")
    assert dict(rows(graph.dependency_levels(items, need).fillna(-1))) == {0: 0, 1: 1, 2: 2, 3: 0, 4: -1, 5: -1}


def test_selection_rules(spark):
    c = spark.createDataFrame([("s", 1, "x", 9.0, 1), ("s", 2, "x", 8.0, 2), ("s", 3, "y", 1.0, 3), ("s", 4, "x", 7.0, 1)], "s string, candidate_id long, class string, score double, shape int")
    assert {r.candidate_id: r.disposition for r in selection.admit_diverse(c, "s", ["y", "x"], 2).collect()} == {1: "class-representative", 2: "over-maximum", 3: "class-representative", 4: "duplicate-shape"}
    w = spark.createDataFrame([("s", 1, None, 1), ("s", 2, 5, 3), ("s", 3, 5, 2), ("s", 4, 99, 0)], "s string, k long, reach int, size int")
    assert rows(selection.cascade(w, "s", F.col("k") < 4, [("reach", True), ("size", False)], "k")) == [("s", 3, 1, 4)]
    d = spark.createDataFrame([("s", "good", 1, 17.0), ("s", "short", 3, 10.0)], "s string, option_id string, class_rank int, length double")
    assert selection.detour_displacement(d, "s", 1.6).first().winner == "short"
    assert selection.detour_displacement(d, "s", 1.7).first().winner == "good"


def test_observations_of_a_source_are_shuffled_once(spark):
    seen = [("a", "1", 5.0, "x"), ("a", "2", 5.0, "x"), ("b", "1", 5.0, "x"), ("b", "1", 5.0, "x"), ("c", "1", 5.0, None), ("c", "2", 5.0, "x"), ("d", None, 5.0, "x"), ("e", "1", None, None), ("e", "2", None, None)]
    seen = spark.createDataFrame(seen, "source_id string, observation_id string, value double, category string")
    matches = spark.createDataFrame([(s, s.upper(), 10, 20, "accepted") for s in "abcdef"], "source_id string, target_id string, shared_mm long, target_mm long, state string")
    out = line_evidence.aggregate(matches, seen, "extensive")
    assert {r.target_id: (r.state, r.value, r.n_observations) for r in out.collect()} == {"A": ("available", 2.5, 2), "B": ("conflicting", None, 2), "C": ("conflicting", None, 2), "D": ("conflicting", None, 1), "E": ("available", None, 2), "F": ("no-data", None, 0)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_traffic_pairs_are_made_once(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda *v: rng.choice(v)
    kind = "count_point long, road string, junction string, at double"
    o = [(i, some(None, None, 1, 2, 77), some(None, "a", "b", "z"), some(None, None, "J", "k"), float(rng.randrange(300))) for i in range(60)]
    t = [(i, some(None, None, None, 1, 2), some(None, "A", "b"), some(None, "j", "k", "l"), float(rng.randrange(300))) for i in range(40)]
    written, plain = [], selection.checkpointed

    def kept(df):
        df = plain(df)
        written.append(df.count())
        return df

    monkeypatch.setattr(selection, "checkpointed", kept)
    got = sorted(rows(selection.match_traffic(spark.createDataFrame(o, "observation_id long, " + kind), spark.createDataFrame(t, "target_id long, " + kind), 5.0)), key=str)
    want, low = [], lambda s: s and s.lower()
    for i, cp, road, junction, at in o:
        hits = {"count-point": [], "link-identity": [], "buffer": []}
        for j, tcp, troad, tjunction, tat in t:
            pair = [(low(road), low(troad)), (low(junction), low(tjunction))]
            if cp is not None and cp == tcp:
                hits["count-point"].append(j)
            if all(a is None or b is None or a == b for a, b in pair) and any(a is not None and a == b for a, b in pair):
                hits["link-identity"].append(j)
            if abs(at - tat) <= 5:
                hits["buffer"].append(j)
        relation = next((k for k, v in hits.items() if v), "none")
        want += [(i, j, relation, "ambiguous" if len(hits[relation]) > 1 else "matched") for j in hits[relation]] if relation != "none" else [(i, None, "none", "unmatched")]
    assert got == sorted(want, key=str) and len(got) > 300
    assert max(written) <= len(o)


def test_traffic_precedence(spark):
    kind = "count_point string, road string, junction string, at double"
    o = spark.createDataFrame([(1, "c1", "A4", None, 0.0), (2, None, " a4 ", None, 0.0), (3, None, None, None, 52.0), (4, None, "B1", "j", 500.0), (5, None, "zz", None, 900.0)], "observation_id long, " + kind)
    t = spark.createDataFrame([(1, "c1", "B9", "k", 999.0), (2, "c2", "A4", None, 50.0), (3, None, "A4", "q", 54.0), (4, None, "B1", "other", 700.0)], "target_id long, " + kind)
    got = {(r.observation_id, r.target_id): (r.relation, r.state) for r in selection.match_traffic(o, t, 5.0).collect()}
    assert got == {(1, 1): ("count-point", "matched"), (2, 2): ("link-identity", "ambiguous"), (2, 3): ("link-identity", "ambiguous"), (3, 2): ("buffer", "ambiguous"), (3, 3): ("buffer", "ambiguous"), (4, None): ("none", "unmatched"), (5, None): ("none", "unmatched")}


def test_as_of_states_and_indicator(spark):
    day = dt.date
    u = spark.createDataFrame([("k", "design", "done", "unverified", day(2024, 3, 1), day(2024, 3, 1), 3), ("k", "design", "begun", "verified", day(2024, 1, 1), day(2024, 1, 2), 1), ("k", "design", "late", "verified", day(2024, 1, 1), day(2024, 1, 1), 2)], "id string, dimension string, state string, verification string, observed_on date, recorded_on date, update_id long")
    r = monitoring.effective_states(u, ["id", "dimension"]).first()
    assert (r.effective_state, r.n_unverified) == ("begun", 1)
    i = spark.createDataFrame([("i", 10.0, day(2025, 1, 1), "at-least", 30)], "indicator_id string, target_value double, target_date date, direction string, frequency_days int")
    o = spark.createDataFrame([("i", "a", 12.0, "monitoring", "verified", day(2024, 1, 1), day(2024, 1, 9), day(2024, 1, 5))], "indicator_id string, observation_id string, value double, kind string, verification string, period_end date, recorded_on date, due_on date")
    at = lambda d: monitoring.indicator_status(i, o, F.lit(d).cast("date")).first()
    assert (at("2024-02-04").target_status, at("2024-02-04").n_late, at("2024-02-05").target_status) == ("met", 1, "missing-data")


def test_scalar_functions(spark):
    assert value(spark, geometry.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195080)
    assert value(spark, geometry.millimetres(F.lit(0.0025))) == 2 and value(spark, geometry.millimetres(F.lit(0.0035))) == 4
    assert value(spark, geometry.bearing_difference_degrees(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(1.0))) == pytest.approx(45)
    assert [value(spark, bands.gradient_band(F.lit(x))) for x in (3.0, 3.1, 12.5, 12.6)] == ["gentle", "noticeable", "very-steep", "severe"]
    assert [value(spark, bands.freshness(F.lit(y), 2024, 3)) for y in (2021, 2020, 2025)] == ["fresh", "stale", "unknown"]
    assert value(spark, identity.canonical_json(b=F.lit(1), a=identity.quoted(F.lit("x")))) == '{"a":"x","b":1}'


def test_tags(spark):
    assert value(spark, tags.tag_values(F.lit("['A4', 'B2']"))) == ["A4", "B2"]
    assert value(spark, tags.tag_values(F.lit(" A4 ; ;B2"))) == ["A4", "B2"] and value(spark, tags.tag_values(F.lit(None).cast("string"))) == []
    assert value(spark, tags.is_a_road(F.lit("B1;A36"))) and not value(spark, tags.is_a_road(F.lit("Avenue")))
    assert value(spark, tags.school_kind(F.lit("school"), F.lit("St Ann Primary and Secondary"), F.lit(None).cast("string"))) == "all-through"
    assert value(spark, tags.official_class(F.lit(" A Road "))) == "a-road"
    assert not value(spark, tags.usable_entrance(F.lit("main"), F.lit(None).cast("string"), F.lit("private")))


def test_projection_of_a_published_point(spark):
    east, north = projection.project(F.lit(52 + 39 / 60 + 27.2531 / 3600), F.lit(1 + 43 / 60 + 4.5177 / 3600))
    assert value(spark, east) == pytest.approx(651409.903, abs=0.01) and value(spark, north) == pytest.approx(313177.270, abs=0.01)
    east, north = projection.wgs84_to_grid(F.lit(52.657979), F.lit(1.716052))
    assert value(spark, east) == pytest.approx(651409.8, abs=8) and value(spark, north) == pytest.approx(313177.4, abs=8)


def test_interval_transitions_and_pruning(spark):
    i = spark.createDataFrame([("l", 1, 0, 10), ("l", 2, 5, 20), ("l", 3, 30, 40)], "line string, evidence_id long, start_m long, end_m long")
    assert rows(rules.transitions(i, "line")) == [("l", 0, 5, 1, 1), ("l", 5, 10, 2, 1), ("l", 10, 20, 1, 2), ("l", 30, 40, 1, 3)]
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "c", "a")], "edge_id long, a string, b string")
    none = spark.createDataFrame([], "node string")
    assert [r.edge_id for r in graph.prune_leaves(e, none).orderBy("edge_id").collect()] == [1, 2, 4]
    assert graph.prune_leaves(e, e.select(F.col("b").alias("node"))).count() == 4


def test_spanning_forest_costs_no_more_than_any_other(spark):
    import random

    rng = random.Random(2)
    edges = [(i, rng.randrange(25), rng.randrange(25), rng.randrange(9)) for i in range(90)]
    parent = list(range(25))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for i, a, b, c in sorted(edges, key=lambda e: (e[3], e[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add(i)
    df = spark.createDataFrame(edges, "edge_id long, src long, dst long, cost long")
    assert {r.edge_id for r in trees.spanning_forest(df).collect()} == want
    assert trees.spanning_forest(df.limit(0)).count() == 0


def test_raster_states_and_samples(spark):
    pixels = spark.createDataFrame([(0, 0, 1, 0, 5.0), (0, 0, 0, 0, -4e38)], "tile_x long, tile_y long, row long, col long, value double")
    places = spark.createDataFrame([(1, 10, 10), (2, 10, 60), (3, 500, 10)], "sample_id long, x long, y long")
    assert rows(rules.sample_raster(places, pixels, 100, 50)) == [(1, 5.0, "available"), (2, None, "no-data"), (3, None, "explicit-unknown")]
    r = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 40.0), (2, 1.0, 1.0, 1.0, 1.0)], "route_id long, x0 double, y0 double, x1 double, y1 double")
    assert rows(rules.samples(r, 20).select("route_id", "at_m", "x", "y")) == [(1, 0.0, 0.0, 0.0), (1, 20.0, 12.0, 16.0), (1, 40.0, 24.0, 32.0), (1, 50.0, 30.0, 40.0), (2, 0.0, 1.0, 1.0)]


def test_hybrids_are_new_simple_sequences(spark):
    r = spark.createDataFrame([("r", "e", list("abcz")), ("s", "e", list("axcyz")), ("t", "e", list("abcyz"))], "route_id string, ends string, nodes array<string>")
    c = spark.createDataFrame([("c",)], "node string")
    assert rows(rules.hybrids(r, c)) == [("e", "s", "r", "c", 4)]
    assert rows(rules.parallel_sections(r.where("route_id = 'r'"), c)) == [("r", 0, "a", "c", 2), ("r", 1, "c", "z", 1)]


def test_bridges_with_parallel_edges_and_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "c", "d"), (5, "d", "e"), (6, "e", "d"), (7, "e", "f"), (8, "x", "x"), (9, "y", "z")], "edge_id long, src string, dst string")
    assert rows(graph.bridges(e)) == [(4,), (7,), (9,)]
    assert graph.bridges(e.limit(0)).count() == 0


def test_simple_paths_in_order(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "d", 1), ("a", "c", 1), ("c", "d", 1), ("a", "d", 5), ("b", "a", 1), ("c", "b", 1)], "src string, dst string, weight long")
    o = spark.createDataFrame([("o", "a", "d"), ("none", "d", "a")], "obligation_id string, origin string, destination string")
    got = [(r.cost, "".join(r.nodes)) for r in graph.simple_paths(o, e, 3, 3).orderBy("place").collect()]
    assert got == [(2, "abd"), (2, "acd"), (3, "acbd")]


def test_backbone_grows_like_taking_the_nearest_again_and_again(spark):
    import heapq
    import random

    rng = random.Random(8)
    nodes = [f"n{i:02d}" for i in range(30)]
    edges = [(a, b, rng.randrange(1, 12)) for a in nodes for b in nodes if a < b and rng.random() < 0.07]
    both = edges + [(b, a, w) for a, b, w in edges]
    places, spine, most = nodes[3:30:3], nodes[:3], 14

    def costs(starts):
        best, heap = {s: 0 for s in starts}, [(0, s) for s in starts]
        while heap:
            c, x = heapq.heappop(heap)
            for a, b, w in both:
                if a == x and c <= best[x] and c + w < best.get(b, 10**9):
                    best[b] = c + w
                    heapq.heappush(heap, (c + w, b))
        return best

    served, total, left = list(spine), 0, set(places)
    while left:
        # Passing through a served place starts there, so the cost is from the nearest served one.
        best = costs(served)
        c, x = min((best.get(p, 10**9), p) for p in left)
        if c > most:
            break
        served.append(x)
        left.discard(x)
        total += c
    df = spark.createDataFrame(both, "src string, dst string, weight long")
    one = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    tree, state = graph.grow_backbone(one(places), one(spine), df, most)
    assert {r.node for r in state.collect() if r.state == "gap"} == left
    assert sum(r.cost for r in tree.collect()) == total and tree.count() == len(served) - len(spine)


def test_hybrids_of_many_like_routes_meet_once(spark):
    # Two kinds of 40,000 routes each: they met in pairs before, 6.4 thousand million of them.
    from tracewright.operators import rules as more_rules

    kinds = F.when(F.col("id") % 2 == 0, F.array(*[F.lit(x) for x in (1, 2, 4, 5, 9)])).otherwise(F.array(*[F.lit(x) for x in (1, 3, 4, 6, 9)]))
    routes = spark.range(80_000).select(F.col("id").alias("route_id"), F.lit("1-9").alias("ends"), kinds.alias("nodes"))
    rows = more_rules.hybrids(routes, spark.createDataFrame([(4,)], "node int")).collect()
    assert sorted((r.first_id, r.second_id, r.node, r.n_nodes) for r in rows) == [(0, 1, 4, 5), (1, 0, 4, 5)]
