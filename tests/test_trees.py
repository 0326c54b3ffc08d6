"""Forests, tours, ancestors and what is told by them, distributed and in one task, against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph, trees

EDGES = "edge_id long, src long, dst long, cost long"


def tangle(rng, n, extra):
    """A few trees, some edges more, a loop and two parallel edges."""
    pairs = [(rng.randrange(max(0, i - 6), i), i) for i in range(1, n) if i % 17] + [tuple(rng.sample(range(n), 2)) for _ in range(extra)] + [(3, 3), (1, 2), (1, 2)]
    return [(i, a, b, rng.randrange(9)) for i, (a, b) in enumerate(pairs)]


def walk(edges, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for e, a, b, _ in edges:
            if e != without and x in (a, b) and (y := a + b - x) not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.mark.parametrize("one_task", [0, 5, trees.ONE_TASK])
def test_forest_is_the_same_however_it_is_found(spark, one_task):
    edges = tangle(random.Random(4), 60, 25)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for e, a, b, cost in sorted(edges, key=lambda r: (r[3], r[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add(e)
    chosen, tree = trees.forest(spark.createDataFrame(edges, EDGES), one_task=one_task)
    assert {r.edge_id for r in chosen.collect()} == want
    label = {r.node: r.tree for r in tree.collect()}
    assert all((label[a] == label[b]) == (root(a) == root(b)) for a in label for b in label) and all(label[t] == t for t in label.values())


def test_forest_shuffles_few_edges(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(i, a, b, rng.randrange(30)) for i, (a, b) in enumerate((a, b) for a in range(40) for b in range(a))]
    written, plain = [], trees.checkpointed

    def kept(df):
        df = plain(df)
        written.append(df.count())
        return df

    monkeypatch.setattr(trees, "checkpointed", kept)
    chosen = {r.edge_id for r in trees.spanning_forest(spark.createDataFrame(edges, EDGES).coalesce(1)).collect()}
    assert len(chosen) == 39 and written[0] == 39
    import pyarrow as pa

    table = pa.table({"edge_id": [str(e[0]) for e in edges], "cost": [e[3] for e in edges], "a": [str(e[1]) for e in edges], "b": [str(e[2]) for e in edges]})
    monkeypatch.setattr(trees, "THIN_EDGES", 100)
    parts = pa.Table.from_batches(trees._thinned(iter(table.to_batches(max_chunksize=30))))
    assert len(parts) < 100 and set(trees._least(parts).column("edge_id").to_pylist()) == set(trees._least(table).column("edge_id").to_pylist())


def test_rooted_totals(spark):
    rng = random.Random(7)
    edges = [(i, rng.randrange(i), i, 0) for i in range(1, 40)] + [(50, 60, 61, 0)]
    frame = spark.createDataFrame(edges, EDGES).selectExpr("edge_id", "src as a", "dst as b")
    weights = spark.createDataFrame([(i, i * i) for i in (*range(40), 60, 61)], "node long, weight long")
    marks = spark.createDataFrame([(i, hash((i, 5))) for i in range(40)], "node long, mark long")
    got = {r.child: r for r in trees.rooted(frame, spark.createDataFrame([(0,), (61,)], "node long"), weights, marks).collect()}
    assert got[60].parent == 61 and got[60].weight == 3600 and 61 not in got
    for e, a, b, _ in edges[:-1]:
        below = walk(edges, b, e)
        mark = 0
        for x in below:
            mark ^= hash((x, 5))
        assert (got[b].parent, got[b].edge_id, got[b].weight, got[b].mark) == (a, e, sum(x * x for x in below), mark)
        assert all((got[b].begin >= got[x].begin and got[b].end <= got[x].end) for x in below)


def test_ways_up_and_circles(spark):
    parents = spark.createDataFrame([(i, i - 1 if i % 37 else None) for i in range(80)], "node long, up long")
    table = trees.ancestors(parents)
    asked = spark.createDataFrame([(x, x % 37, f"q{x}") for x in (0, 1, 36, 37, 73, 60, 5)], "node long, steps long, name string")
    got = {}
    for r in trees.ways_up(asked, table).collect():
        got.setdefault(r.name, []).append((r.at, r.node))
    assert {k: sorted(v) for k, v in got.items()} == {f"q{x}": [(k, x - k) for k in range(x % 37 + 1)] for x in (0, 1, 36, 37, 73, 60, 5)}
    ring = spark.createDataFrame([(i, i + 1 if (i + 1) % 9 else i - 8) for i in range(45)], "item long, next long")
    assert {(r.item, r.circle) for r in trees.circles(ring).collect()} == {(i, i - i % 9) for i in range(45)}
    with pytest.raises(RuntimeError, match="circle"):
        trees.last(ring)


def test_circles_of_all_lengths_leave_when_they_have_ended(spark):
    rng, at, want, rows = random.Random(21), list(range(400)), {}, []
    rng.shuffle(at)
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 33, 64, 100):
        ring, at = at[:size], at[size:]
        rows += zip(ring, ring[1:] + ring[:1])
        want |= dict.fromkeys(ring, min(ring))
    got = trees.numbered_circles(spark.createDataFrame(rows, "at long, to long")).collect()
    assert len(got) == len(want) and {r["at"]: r.circle for r in got} == want


def test_bridges_severance_and_pruning_by_removal(spark):
    rng = random.Random(11)
    edges = tangle(rng, 50, 12)
    frame = spark.createDataFrame(edges, EDGES)
    reach = {x: walk(edges, x) for x in range(50)}
    want = {e for e, a, b, _ in edges if a != b and b not in walk(edges, a, e)}
    assert {r.edge_id for r in graph.bridges(frame).collect()} == want and want
    asked = [(k, *rng.choices(range(52), k=2)) for k in range(60)]
    parted = {(k, e) for k, a, b in asked if b in reach.get(a, ()) for e in want if b not in walk(edges, a, e)}
    assert {tuple(r) for r in graph.severance(spark.createDataFrame(asked, "obligation_id long, a long, b long"), frame).collect()} == parted and parted
    anchors = rng.sample(range(50), 6)
    left = list(edges)
    while True:
        ends = [x for _, a, b, _ in left for x in (a, b)]
        keep = [r for r in left if not any(ends.count(x) == 1 and x not in anchors for x in r[1:3])]
        if len(keep) == len(left):
            break
        left = keep
    got = graph.prune_leaves(frame.selectExpr("edge_id", "src as a", "dst as b"), spark.createDataFrame([(x,) for x in anchors], "node long"))
    assert {r.edge_id for r in got.collect()} == {r[0] for r in left} and len(left) < len(edges)


def test_a_path_of_many_edges(spark):
    """Rounds grow with the logarithm: 200 edges end to end, all of them bridges."""
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(200)], "edge_id long, src long, dst long")
    assert graph.bridges(edges).count() == 200
    assert graph.severance(spark.createDataFrame([(1, 20, 190), (2, 5, 5)], "obligation_id long, a long, b long"), edges).count() == 170
    assert graph.bridges(edges.limit(0)).count() == 0 and graph.severance(edges.selectExpr("edge_id as obligation_id", "src as a", "dst as b"), edges.limit(0)).count() == 0


def test_rounds_of_doubling_plan_in_steady_time(spark):
    # Each round is a join of the table with itself; what Spark knew of a checkpoint's plan doubled with it, to minutes at 16 rounds.
    n = 40_000
    items = spark.range(n).select(F.struct(F.col("id").alias("edge_id"), F.lit(0).alias("way")).alias("item"), F.when(F.col("id") < n - 1, F.struct((F.col("id") + 1).alias("edge_id"), F.lit(0).alias("way"))).alias("next"), F.lit(1).cast("long").alias("steps"), F.col("id").alias("mark"))
    began = time.time()
    told = trees.along(items, ["steps"], ["mark"])
    assert time.time() - began < 60
    assert told.where("last.edge_id <> 39999 or steps <> 40000 - item.edge_id").count() == 0 and told.count() == n
