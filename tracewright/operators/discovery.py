"""Candidate sets for obligations: the cheapest simple paths under several strategies, with ceilings, budgets and what became of every path.

The search is best-first for all obligations at once.  A partial path is bounded from below by its cost and the least cost from its end to the destination, found
backwards from all destinations.  Every round the ``width`` best open paths of each obligation and strategy are extended; complete ones lower the bound above
which open ones go.  It ends when nothing open can be among the best, so a narrow width costs rounds and not paths; only the settlement budget cuts a
search short, and then says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed
from .graph import least_costs

_SEARCH = ["obligation_id", "strategy"]


def lower_bound_factor(edges: DataFrame) -> DataFrame:
    """One row: the factor by which straight distances bound costs from below, or why there is none.

    ``edges``: cost, length (of the drawn line), joined (whether the line begins and ends at its nodes).  The factor is the least ratio of cost and
    length, at most 1.  ``reason``: no-edges, non-canonical-edge-endpoints, non-positive-or-non-finite-edge-cost or non-positive-or-non-finite-geometry.
    """
    whole = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    row = edges.agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce("joined", F.lit(False))).alias("apart"), F.count_if(~whole("cost")).alias("costs"), F.count_if(~whole("length")).alias("lengths"),
        F.min(F.when(whole("cost") & whole("length"), F.col("cost") / F.col("length"))).alias("ratio"),
    )
    reason = F.when(F.col("n") == 0, "no-edges").when(F.col("apart") > 0, "non-canonical-edge-endpoints").when(F.col("costs") > 0, "non-positive-or-non-finite-edge-cost").when(F.col("lengths") > 0, "non-positive-or-non-finite-geometry")
    return row.withColumn("reason", reason).select(F.when(F.col("reason").isNull(), F.least(F.lit(1.0), "ratio")).alias("factor"), "reason")


def best_paths(obligations: DataFrame, edges: DataFrame, strategies: Sequence[str], k: int, width: int = 32, max_settlements: int | None = None, limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The ``k`` cheapest simple paths of each obligation under each strategy, and searches that the budget cut short.

    ``obligations``: obligation_id, origin, destination.  ``edges``: edge_id, src, dst and a column of costs (whole numbers, not negative) for each of
    ``strategies``.  Ties go to the smaller sequence of nodes, then of edges.  Returns (obligation_id, strategy, cost, edge_ids, nodes, place) and
    (obligation_id, strategy).  With ``max_settlements`` a search that has extended that many paths ends with what it found.
    """
    rows = edges.where("src <> dst").select("edge_id", "src", "dst", F.explode(F.create_map(*[x for s in strategies for x in (F.lit(s), F.col(s).cast("long"))])).alias("strategy", "step"))
    rows = checkpointed(rows)
    node = lambda c: F.struct("strategy", F.col(c).alias("node"))
    goals = checkpointed(obligations.select("destination").distinct())
    # One graph holds all strategies, each on nodes of its own.
    turned = rows.select(node("dst").alias("src"), node("src").alias("dst"), F.col("step").alias("weight"))
    seeds = goals.join(rows.select("strategy").distinct(), how="cross").select(F.col("destination").alias("root"), node("destination").alias("node"), F.lit(0).cast("long").alias("cost"))
    left = least_costs(seeds, turned, limit)
    left = checkpointed(left.select(F.col("root").alias("destination"), F.col("node.strategy").alias("strategy"), F.col("node.node").alias("node"), F.col("cost").alias("left")))
    start = obligations.where("origin <> destination").select("obligation_id", "destination", F.col("origin").alias("node")).join(left, ["destination", "node"])
    ids = F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>")
    open_paths = checkpointed(start.select(*_SEARCH, "destination", "node", F.lit(0).cast("long").alias("cost"), F.col("left").alias("bound"), F.array("node").alias("nodes"), ids.alias("edge_ids")))
    best = Window.partitionBy(*_SEARCH).orderBy("cost", "nodes", "edge_ids")
    first = Window.partitionBy(*_SEARCH).orderBy("bound", "nodes", "edge_ids")
    found, cut, done = None, None, None
    for _ in range(limit):
        if open_paths.isEmpty():
            break
        ranked = open_paths.withColumn("n", F.row_number().over(first))
        now, later = ranked.where(F.col("n") <= width), ranked.where(F.col("n") > width).drop("n")
        step = now.drop("n").join(rows.select("strategy", F.col("src").alias("node"), "dst", "edge_id", "step"), ["strategy", "node"]).where("not array_contains(nodes, dst)")
        step = step.join(left.select("destination", "strategy", F.col("node").alias("dst"), "left"), ["destination", "strategy", "dst"])
        cost = F.col("cost") + F.col("step")
        step = step.select(*_SEARCH, "destination", F.col("dst").alias("node"), cost.alias("cost"), (cost + F.col("left")).alias("bound"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        step = checkpointed(step)
        hit = step.where("node = destination").select(*_SEARCH, "cost", "nodes", "edge_ids")
        found = hit if found is None else found.union(hit)
        found = checkpointed(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n"))
        most = found.groupBy(*_SEARCH).agg(F.count("*").alias("have"), F.max("cost").alias("most")).where(F.col("have") >= k)
        rest = later.union(step.where("node <> destination")).join(most.select(*_SEARCH, "most"), _SEARCH, "left").where("most is null or bound <= most").drop("most")
        if max_settlements is not None:
            spent = now.groupBy(*_SEARCH).agg(F.count("*").alias("spent"))
            done = checkpointed(spent if done is None else done.union(spent).groupBy(*_SEARCH).agg(F.sum("spent").alias("spent")))
            over = done.where(F.col("spent") >= max_settlements).select(*_SEARCH)
            stopped = checkpointed(rest.join(over, _SEARCH, "left_semi").select(*_SEARCH).distinct())
            cut = stopped if cut is None else cut.union(stopped)
            rest = rest.join(over, _SEARCH, "left_anti")
        open_paths = checkpointed(rest)
    else:
        raise RuntimeError(f"searches did not end in {limit} rounds")
    none = start.select(*_SEARCH).limit(0)
    if found is None:
        found = open_paths.select(*_SEARCH, "cost", "nodes", "edge_ids")
    return found.withColumn("place", F.row_number().over(best)), cut.distinct() if cut is not None else none


def discover(obligations: DataFrame, edges: DataFrame, strategies: Sequence[str], length: str = "length", k: int = 3, detour_ceiling: float = 1.5, max_candidates: int = 5, width: int = 32, max_settlements: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of each obligation with what became of each path found, and the disposition of each obligation.

    ``edges``: edge_id, src, dst, allowed (boolean), ``length`` and the strategies' cost columns, all whole numbers.  Prohibited edges are searched too, and a
    path over one is kept for review whatever its length.  Paths: (obligation_id, strategies, edge_ids, length, prohibited, state): ``candidate``, ``detour-suppressed`` (longer than
    ``detour_ceiling`` times the shortest allowed way, or any way if none is allowed) or ``candidate-budget`` (beyond ``max_candidates`` in order of strategy and
    place).  A path that several strategies find is one row with all of them.  Dispositions: (obligation_id, direct, n_candidates, n_suppressed, truncated,
    state): ``candidates`` or ``gap``, and reason ``no-path``, ``only-prohibited`` or null.
    """
    kept = checkpointed(edges.select("edge_id", "src", "dst", F.coalesce("allowed", F.lit(False)).alias("allowed"), F.col(length).cast("long").alias("length_"), *strategies))
    asked = checkpointed(obligations.select("obligation_id", "origin", "destination").distinct())

    def shortest(rows: DataFrame, name: str) -> DataFrame:
        seeds = asked.select(F.col("origin").alias("root"), F.col("origin").alias("node"), F.lit(0).cast("long").alias("cost"))
        costs = least_costs(seeds, rows.select("src", "dst", F.col("length_").alias("weight")))
        return costs.select(F.col("root").alias("origin"), F.col("node").alias("destination"), F.col("cost").alias(name))

    direct = asked.join(shortest(kept.where("allowed"), "free"), ["origin", "destination"], "left").join(shortest(kept, "any_way"), ["origin", "destination"], "left")
    direct = checkpointed(direct.select("obligation_id", F.coalesce("free", "any_way").alias("direct"), (F.col("free").isNull() & F.col("any_way").isNotNull()).alias("only_prohibited")))
    paths, cut = best_paths(asked, kept, strategies, k, width, max_settlements)
    paths = checkpointed(paths)
    legs = paths.select(*_SEARCH, "place", F.explode("edge_ids").alias("edge_id")).join(kept.select("edge_id", "allowed", "length_"), "edge_id")
    measured = legs.groupBy(*_SEARCH, "place").agg(F.sum("length_").alias("length"), F.max(~F.col("allowed")).alias("prohibited"))
    order = F.element_at(F.create_map(*[x for i, s in enumerate(strategies) for x in (F.lit(s), F.lit(i))]), F.col("strategy"))
    rows = paths.join(measured, [*_SEARCH, "place"]).withColumn("turn", F.struct(order.alias("s"), "place"))
    one = rows.groupBy("obligation_id", "edge_ids").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"), F.min("turn").alias("turn"), F.first("length").alias("length"), F.first("prohibited").alias("prohibited"))
    one = one.join(direct, "obligation_id").withColumn("far", (F.col("length") > F.col("direct") * detour_ceiling + 1e-9) & ~F.col("prohibited"))
    number = F.row_number().over(Window.partitionBy("obligation_id", "far").orderBy("turn"))
    state = F.when(F.col("far"), "detour-suppressed").when(F.col("number") > max_candidates, "candidate-budget").otherwise("candidate")
    one = checkpointed(one.withColumn("number", number).select("obligation_id", "strategies", "edge_ids", "length", "prohibited", state.alias("state")))
    n = one.groupBy("obligation_id").agg(F.count_if(F.col("state") == "candidate").alias("n_candidates"), F.count_if(F.col("state") != "candidate").alias("n_suppressed"))
    short = cut.select("obligation_id").distinct().withColumn("truncated", F.lit(True))
    told = direct.join(n, "obligation_id", "left").join(short, "obligation_id", "left")
    zero = F.lit(0).cast("long")
    told = told.select("obligation_id", "direct", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_suppressed", zero).alias("n_suppressed"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.when(F.col("n_candidates") > 0, "candidates").otherwise("gap").alias("state"), F.when(F.col("direct").isNull(), "no-path").when(F.col("only_prohibited"), "only-prohibited").alias("reason"))
    return one, told
