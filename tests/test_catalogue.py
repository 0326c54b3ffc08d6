"""Every planning query against its SQL on the smallest driver tables, if these are there."""

import os

import duckdb
import pandas as pd
import pytest

from tracewright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


#: Queries without SQL that have rows on the smallest tables, too.
NOT_EMPTY = {"spanning_forest", "anchored_spines", "planar_faces", "low_traffic_cells", "area_portals", "area_graph", "circle_witnesses", "continuous_linework"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    rows = frame.collect()
    assert frame.columns and (rows or name not in NOT_EMPTY)


def test_anchored_spines_are_those_of_plain_pruning(spark, con):
    from tracewright.plans.network import NEAR_SQL

    left = con.execute(f"with {NEAR_SQL} select src || '-' || dst, src, dst from links where src < dst").fetchall()
    while True:
        ends = {}
        for _, a, b in left:
            ends[a], ends[b] = ends.get(a, 0) + 1, ends.get(b, 0) + 1
        keep = [r for r in left if not any(ends[x] == 1 and x % 4 for x in r[1:])]
        if len(keep) == len(left):
            break
        left = keep
    assert {r.edge_id for r in catalogue.queries()["anchored_spines"](spark, FOLDER).collect()} == {r[0] for r in left} and left


def test_spanning_forest_is_the_cheapest(spark, con):
    """As many edges as join anything, no cycle, and the total of Kruskal's algorithm."""
    from tracewright.plans.network import NEAR_SQL

    pairs = con.execute(f"with {NEAR_SQL} select src || '-' || dst, src, dst, cast(round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) * 1000) as bigint) from links join pts p on p.vec_id = src join pts q on q.vec_id = dst where src < dst").fetchall()

    def kruskal(rows):
        parent, total, n = {}, 0, 0

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for _, a, b, cost in sorted(rows, key=lambda r: r[3]):
            if root(a) != root(b):
                parent[root(a)] = root(b)
                total, n = total + cost, n + 1
        return total, n

    chosen = {r.edge_id for r in catalogue.queries()["spanning_forest"](spark, FOLDER).collect()}
    tree = [r for r in pairs if r[0] in chosen]
    assert len(tree) == len(chosen) == kruskal(tree)[1] > 0
    assert kruskal(tree) == kruskal(pairs)


def test_profiles_keep_their_samples(spark):
    rows = catalogue.queries()["near_duplicate_collapse"](spark, FOLDER).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_priority_schedule_gives_each_item_once(spark):
    rows = catalogue.queries()["priority_schedule"](spark, FOLDER).collect()
    assert rows and any(r.phase is not None for r in rows) and len({r.intervention_id for r in rows}) == len(rows)
