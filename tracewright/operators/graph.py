"""Directed graphs as edge tables: degrees, reach, shortest paths, components, parallel routes.

Frontiers advance by joins; every round is checkpointed, and a loop that does not settle raises.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import trees
from .components import checkpointed, connected_components, stored
from .parallel import parallel_links as parallel_links, parallel_relations as parallel_relations


#: Graphs of this many edges or fewer are walked inside tasks, roots in blocks, each block with the edges; the result is the same.
BLOCK_EDGES = 100_000
#: As many where ways are walked to the end, which takes a round for each of their edges.
WHOLE_EDGES = 500_000
#: About so many rows (roots times nodes) for each block.
BLOCK_ROWS = 1_000_000


def best_edges(edges: DataFrame, order: str = "length") -> DataFrame:
    """The shortest edge of each directed pair; of equals the first by edge_id."""
    w = Window.partitionBy("src", "dst").orderBy(order, "edge_id")
    return edges.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def reciprocity(edges: DataFrame) -> DataFrame:
    """Whether each edge has a way back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back_")).distinct()
    return edges.join(back, ["src", "dst"], "left").withColumn("state", F.when(F.col("back_"), "reciprocal").otherwise("one-way")).drop("back_")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of each node without regard to direction: 0 is isolated, 1 a dangle, 3 or more a junction."""
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("node"))
    rows = nodes.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return rows.select("node", "degree", F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "dangle").when(F.col("degree") == 2, "through").otherwise("junction").alias("kind"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak components of all nodes, named by their smallest node."""
    found = connected_components(edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, limit: int = 200) -> DataFrame:
    """Fewest hops from any seed to each node that can be reached, within ``max_hops``."""
    step = edges.select("src", "dst").distinct()
    seen = checkpointed(seeds.select("node", F.lit(0).alias("hops")).distinct())
    front, hops = seen, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        if hops > limit:
            raise RuntimeError(f"reach did not settle in {limit} hops")
        front = checkpointed(front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hops % 8 == 0:
            seen = checkpointed(seen)
    return seen


def shortest_paths(roots: DataFrame, edges: DataFrame, limit: int = 500, max_cost: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Least cost, up to ``max_cost``, from each root to each node, or only to ``targets``.  ``roots``, ``targets``: node."""
    seeds = roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("cost")).distinct()
    return least_costs(seeds, edges, limit, max_cost, BLOCK_EDGES if targets is None else WHOLE_EDGES, targets)


def _frozen(value):
    """The value, a node of several columns too, as a key of a dict."""
    return tuple((k, _frozen(v)) for k, v in value.items()) if isinstance(value, dict) else tuple(map(_frozen, value)) if isinstance(value, list) else value


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type as a schema told by its names has it: what lies inside of it may be null."""
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _walked(seeds: DataFrame, edges: DataFrame, n: int, max_cost: int | None, targets: DataFrame | None = None) -> DataFrame:
    """``least_costs`` over ``n`` edges, one for each pair of nodes."""
    wanted = lambda rows, c: rows.withColumn("wanted", F.lit(True)) if targets is None else rows.join(targets.select(F.col("node").alias(c), F.lit(True).alias("wanted")).distinct(), c, "left")
    given = checkpointed(seeds.groupBy("root", "node").agg(F.min("cost").cast("long").alias("cost")))
    nodes = (edges.select(F.explode(F.array("src", "dst")).alias("node")) if targets is None else targets.select("node")).distinct().count()
    blocks = int(min(20_000, 24 + given.select("root").distinct().count() * nodes // BLOCK_ROWS))
    kind = given.schema["node"].dataType.simpleString()
    # These are the same as text here and in Spark.
    plain = edges.schema["src"].dataType.simpleString() in ("int", "bigint", "string")

    def walk(key, starts: pa.Table, ways: pa.Table) -> pa.Table:
        # Nodes are numbers here, whatever they are in the tables.
        code, names = {}, [t.column(c).combine_chunks().cast(_nullable(t.schema.field(c).type)) for t, c in ((ways, "src"), (ways, "dst"), (starts, "node"))]
        src, dst, begun = ([code.setdefault(_frozen(v), len(code)) for v in column.to_pylist()] for column in names)
        out, into, of = defaultdict(list), defaultdict(list), defaultdict(list)
        text = dict(zip(src, map(str, ways.column("src").to_pylist()) if plain else ways.column("text").to_pylist()))
        kept = {n for nodes, t in ((dst, ways), (begun, starts)) for n, x in zip(nodes, t.column("wanted").to_pylist()) if x}
        for a, b, w in zip(src, dst, ways.column("weight").to_pylist()):
            out[a].append((b, w))
            if b in kept:
                into[b].append((a, w))
        first, root_code = [], {}
        for i, (root, node, cost) in enumerate(zip(starts.column("root").to_pylist(), begun, starts.column("cost").to_pylist())):
            n = root_code.setdefault(_frozen(root), len(root_code))
            if n == len(first):
                first.append(i)
            of[n].append((cost, node))
        rows = []
        for root, begin in of.items():
            own, done, todo = {node: cost for cost, node in begin}, {}, list(begin)
            least = dict(own)
            heapq.heapify(todo)
            while todo:
                cost, node = heapq.heappop(todo)
                if node in done:
                    continue
                done[node] = cost
                for b, w in out.get(node, ()):
                    there = cost + w
                    if (b not in least or there < least[b]) and (max_cost is None or there <= max_cost):
                        least[b] = there
                        heapq.heappush(todo, (there, b))
            for node, cost in done.items():
                if node not in kept:
                    continue
                via = None if own.get(node) == cost else min(text[a] for a, w in into[node] if a in done and done[a] + w == cost)
                rows.append((first[root], node, cost, via))
        roots, nodes, costs, vias = zip(*rows) if rows else [[]] * 4
        at = {}
        for i, n in enumerate([*src, *dst, *begun]):
            at.setdefault(n, i)
        named = pa.concat_arrays(names).take(pa.array([at[n] for n in nodes], pa.int64()))
        root = starts.column("root").combine_chunks().cast(_nullable(starts.schema.field("root").type)).take(pa.array(roots, pa.int64()))
        return pa.table([root, named, pa.array(costs, pa.int64()), pa.array(vias, pa.string())], names=["root", "node", "cost", "via"])

    dealt = wanted(given.where("node is not null"), "node").withColumn("block", F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int"))
    every = wanted(edges.where("src is not null and dst is not null"), "dst").withColumn("text", F.lit(None).cast("string") if plain else F.col("src").cast("string")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(walk, f"root {given.schema['root'].dataType.simpleString()}, node {kind}, cost long, via string")
    return checkpointed(found)


def least_costs(seeds: DataFrame, edges: DataFrame, limit: int = 500, max_cost: int | None = None, block_edges: int = BLOCK_EDGES, targets: DataFrame | None = None) -> DataFrame:
    """Least cost from any seed of a root to each node: relaxation of the nodes that changed, for all roots at once.

    ``seeds``: root, node, cost; a root may have several.  ``edges``: src, dst, weight (not negative).  Ties do not change a
    cost; ``via``, the node before, is the smallest of equals (as text), null at a seed.  Each round is a few joins, so ways of many
    edges take long; a graph of whole weights with at most ``block_edges`` edges is walked in tasks instead, all roots of a block one after the other.
    With ``targets`` (node) only their rows are given.
    """
    if block_edges and {edges.schema["weight"].dataType.simpleString(), seeds.schema["cost"].dataType.simpleString()} <= {"int", "bigint"}:
        plain = checkpointed(edges.where("weight is not null").groupBy("src", "dst").agg(F.min("weight").cast("long").alias("weight")))
        n = plain.count()
        if n <= block_edges:
            return _walked(seeds, plain, n, max_cost, targets)
    best = checkpointed(seeds.groupBy("root", "node").agg(F.min("cost").alias("cost")).withColumn("via", F.lit(None).cast("string")))
    least = lambda rows: rows.groupBy("root", "node").agg(F.min(F.struct("cost", "via")).alias("o")).select("root", "node", "o.*")
    changed = best
    for turn in range(1, limit + 1):
        offers = changed.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").cast("string").alias("via"))
        if max_cost is not None:
            offers = offers.where(F.col("cost") <= max_cost)
        offers = checkpointed(least(offers))
        # Improvements are kept apart from what is known and merged now and then; a round writes only its own.
        known = least(best.join(offers.select("root", "node"), ["root", "node"], "left_semi")).select("root", "node", F.col("cost").alias("old"), F.col("via").alias("old_via"))
        better = F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("via") < F.col("old_via")))
        new = checkpointed(offers.join(known, ["root", "node"], "left").where(better))
        best = best.union(new.select("root", "node", "cost", "via"))
        changed = new.where("old is null or cost < old").select("root", "node", "cost", "via")
        if changed.isEmpty():
            return least(best if targets is None else best.join(targets.select("node").distinct(), "node", "left_semi").select(*best.columns))
        if turn % 8 == 0:
            best = checkpointed(least(best))
    raise RuntimeError(f"paths did not settle in {limit} rounds")


def strong_components(nodes: DataFrame, edges: DataFrame, limit: int = 100, rounds: int = 2000) -> DataFrame:
    """Strong components, named by their largest node.

    Colours (the largest node that reaches a node) spread forwards; a component is what reaches its colour's own node backwards
    inside the colour.  Components that are found leave, and the rest goes round again.  Raises if ``rounds`` steps do
    not spread the colours, or ``limit`` rounds leave nodes.
    """
    left, step = checkpointed(nodes.select("node").distinct()), checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    for _ in range(limit):
        colour = left.withColumn("colour", F.col("node"))
        for _ in range(rounds):
            spread = colour.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "colour")
            new = checkpointed(colour.union(spread).groupBy("node").agg(F.max("colour").alias("colour")))
            moved = not new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").isEmpty()
            colour = new
            if not moved:
                break
        else:
            raise RuntimeError(f"colours did not spread in {rounds} rounds")
        inside = step.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = reach(colour.where("node = colour").select("node"), back).select("node").join(colour, "node")
        own = checkpointed(own.select("node", F.col("colour").alias("component")))
        found = own if found is None else found.union(own)
        left = checkpointed(left.join(own, "node", "left_anti"))
        if left.isEmpty():
            return found
        step = checkpointed(step.join(left.withColumnRenamed("node", "src"), "src").join(left.withColumnRenamed("node", "dst"), "dst").select("src", "dst"))
    raise RuntimeError(f"components did not settle in {limit} rounds")


def dependency_levels(items: DataFrame, depends: DataFrame, limit: int = 100) -> DataFrame:
    """Level of each item: 0 without dependencies, else one more than the highest level it depends on; items on a cycle have none.

    ``depends``: item, on.  An item is placed when all that it depends on is.
    """
    need = depends.join(items.withColumnRenamed("item", "on"), "on", "left_semi").distinct()
    placed = checkpointed(items.join(need, "item", "left_anti").select("item", F.lit(0).alias("level")))
    for level in range(1, limit + 1):
        open_items = need.join(placed.select(F.col("item").alias("on"), "level"), "on", "left").groupBy("item").agg(F.count_if(F.col("level").isNull()).alias("waiting"))
        ready = open_items.where("waiting = 0").select("item").join(placed, "item", "left_anti").withColumn("level", F.lit(level))
        ready = checkpointed(ready)
        if ready.isEmpty():
            return items.join(placed, "item", "left")
        placed = checkpointed(placed.union(ready))
    raise RuntimeError(f"levels did not settle in {limit} rounds")


def _cuts(edges: DataFrame, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A spanning forest with its bridges told.

    Every edge outside the forest gives a 64-bit hash of its id to both its ends; the hashes cancel wherever a subtree holds both.  They leave
    0 below a bridge, and below another edge with a chance of 2**-64.  Returns the rooted tree edges with ``cut`` (whether it is a bridge) and ``weight`` (ends of other edges
    and ``anchors`` in the subtree), the tree of each node, and the weight of each node that has one.
    """
    rows = checkpointed(edges.select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))
    chosen, tree = trees.forest(rows.select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).cast("long").alias("cost")))
    chosen = checkpointed(chosen.select("edge_id"))
    spare = rows.join(chosen, "edge_id", "left_anti").select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("edge_id").alias("mark"), F.lit(1).alias("n"))
    if anchors is not None:
        spare = spare.union(anchors.select("node", F.lit(0).cast("long"), F.lit(1)).distinct())
    held = checkpointed(spare.groupBy("node").agg(F.bit_xor("mark").alias("mark"), F.sum("n").alias("weight")))
    laid = trees.rooted(rows.join(chosen, "edge_id"), tree.select(F.col("tree").alias("node")).distinct(), held.select("node", "weight"), held.select("node", "mark"))
    return laid.withColumn("cut", F.col("mark") == 0), tree, held


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose loss would part a component, without regard to direction.  ``edges``: edge_id, src, dst.

    All subtrees of a spanning forest are summed up at once along its Euler tour, in a logarithmic number of rounds.
    """
    return _cuts(edges)[0].where("cut").select("edge_id")


def severance(obligations: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose loss would part an obligation's ends, each with the obligation: (obligation_id, edge_id).

    ``obligations``: obligation_id, a, b.  ``edges``: edge_id, src, dst, without regard to direction.  Bridges point at the next bridge above them in a
    spanning forest.  From each end of an obligation the bridges lead up to the first whose subtree holds the other end too; that climb doubles its
    steps, and what it passed is taken apart afterwards.  Obligations whose ends are not connected anyhow have no row here.
    """
    laid, tree, _ = _cuts(edges)
    # The bridge at or above each node: nodes below other edges point at their parents.
    place = laid.select(F.col("child").alias("item"), F.when(~F.col("cut"), F.col("parent")).alias("next")).union(tree.select("tree", F.lit(None).cast(tree.schema["tree"].dataType)).distinct())
    cut = checkpointed(laid.where("cut").select(F.col("child").alias("node"), "edge_id", "parent", "begin", "end"))
    above = checkpointed(trees.last(place).select(F.col("item").alias("node"), F.col("last").alias("top")))
    over = cut.select("node", "parent").join(above.withColumnsRenamed({"node": "parent", "top": "up"}), "parent").join(cut.select(F.col("node").alias("up")), "up", "left_semi")
    table = trees.ancestors(over.select("node", "up"))
    span = stored(cut.select(F.col("node").alias("up"), F.col("begin").alias("up_begin"), F.col("end").alias("up_end")))
    # Each end with the place of the other; a root lies outside all subtrees.
    spot = tree.join(laid.select(F.col("child").alias("node"), "begin"), "node", "left").join(above, "node").select("node", "tree", "top", F.coalesce("begin", F.lit(2**62)).alias("begin"))
    of = lambda end: spot.select(*[F.col(c).alias(n) for c, n in (("node", end), ("tree", f"{end}_tree"), ("top", f"{end}_top"), ("begin", f"{end}_begin"))])
    ends = checkpointed(obligations.select("obligation_id", "a", "b").join(of("a"), "a").join(of("b"), "b").where("a_tree = b_tree and a_top <> b_top"))
    sides = ends.select("obligation_id", F.col("a_top").alias("up"), F.col("b_begin").alias("other")).union(ends.select("obligation_id", "b_top", "a_begin"))
    outside = ~((F.col("other") <= F.col("up_begin")) & (F.col("other") >= F.col("up_end")))
    now = stored(sides.join(span, "up").where(outside).select("obligation_id", F.col("up").alias("node"), "other"))
    passed = None
    for k in range(len(table) - 1, -1, -1):
        step = now.join(table[k], "node", "left").join(span, "up", "left").withColumn("go", F.coalesce(outside, F.lit(False)))
        step = stored(step.select("obligation_id", "node", "other", F.when(F.col("go"), F.col("up")).alias("to")))
        part = step.where("to is not null").select("obligation_id", "node", F.lit(k).alias("k"), F.lit(0).cast("long").alias("at"))
        passed = part if passed is None else passed.union(part)
        now = step.select("obligation_id", F.coalesce("to", "node").alias("node"), "other")
    part = now.select("obligation_id", "node", F.lit(0).alias("k"), F.lit(0).cast("long").alias("at"))
    passed = part if passed is None else passed.union(part)
    return trees.unrolled(passed, table).join(cut.select("node", "edge_id"), "node").select("obligation_id", "edge_id").distinct()


def prune_leaves(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges left when dangling ones whose free end is no anchor are taken away until none is.  ``edges``: edge_id, a, b.  ``anchors``: node.

    An edge stays if it lies on a circle, or if both sides of it hold an anchor or a circle; both are told by sums over subtrees.
    """
    laid, tree, held = _cuts(edges.select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst")), anchors)
    total = tree.join(held, "node").groupBy("tree").agg(F.sum("weight").alias("total"))
    free = laid.where("cut").join(tree.withColumnRenamed("node", "child"), "child").join(total, "tree", "left").where("weight = 0 or coalesce(total, 0) - weight = 0")
    return edges.join(free.select("edge_id"), "edge_id", "left_anti")


def simple_paths(obligations: DataFrame, edges: DataFrame, max_edges: int, k: int, beam: int | None = None) -> DataFrame:
    """The ``k`` cheapest simple paths of at most ``max_edges`` edges for each obligation; ties go to the smaller sequence of nodes.

    ``obligations``: obligation_id, origin, destination.  ``edges``: src, dst, weight.  Paths of one more edge are made in every round; with ``beam`` only
    so many of an obligation go on from each node, the cheapest, which bounds the work but may miss a path.
    """
    step = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    front = obligations.select("obligation_id", "destination", F.col("origin").alias("node"), F.lit(0).cast("long").alias("cost"), F.array("origin").alias("nodes"))
    found = None
    for _ in range(max_edges):
        front = front.join(step, F.col("node") == F.col("src")).where("not array_contains(nodes, dst)")
        front = front.select("obligation_id", "destination", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("nodes", F.array("dst")).alias("nodes"))
        if beam is not None:
            w = Window.partitionBy("obligation_id", "node").orderBy("cost", "nodes")
            front = front.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= beam).drop("n_")
        front = checkpointed(front)
        hit = front.where("node = destination").select("obligation_id", "cost", "nodes")
        found = hit if found is None else found.union(hit)
        front = front.where("node <> destination")
    place = F.row_number().over(Window.partitionBy("obligation_id").orderBy("cost", "nodes"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def grow_backbone(communities: DataFrame, spine: DataFrame, edges: DataFrame, max_cost: int) -> tuple[DataFrame, DataFrame]:
    """Communities attached outward from the spine, nearest first, each accepted one a start for the next; and what each is in the end.

    Taking the nearest open community again and again is Prim's order from the spine, so its connections are the shortest spanning tree over
    spine and communities under path costs; they are found for all at once.  ``communities``, ``spine``: node (string).  ``edges``: src, dst,
    weight, both directions listed.  Returns connections (a, b, cost; the spine as one node named ``*``) and states (node, connected or gap).
    """
    on = spine.select("node", F.lit("*").alias("name")).distinct()
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(on.withColumnsRenamed({"node": end, "name": f"{end}_name"}), end, "left").withColumn(end, F.coalesce(f"{end}_name", end)).drop(f"{end}_name")
    rows = checkpointed(rows.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    places = communities.select("node").join(spine, "node", "left_anti").distinct()
    named = checkpointed(places.union(spine.limit(1).select(F.lit("*"))))
    costs = shortest_paths(named, rows, max_cost=max_cost).where("root < node").join(named, "node", "left_semi")
    pairs = costs.select(F.concat_ws("|", "root", "node").alias("edge_id"), F.col("root").alias("src"), F.col("node").alias("dst"), "cost")
    pairs = checkpointed(pairs)
    tree = trees.spanning_forest(pairs).join(pairs.drop("cost"), "edge_id").select(F.col("src").alias("a"), F.col("dst").alias("b"), "cost")
    tree = checkpointed(tree)
    part = connected_components(tree, "a", "b")
    home = part.where("node = '*'").select("component", F.lit(True).alias("home"))
    state = communities.select("node").distinct().join(spine.select("node", F.lit(True).alias("itself")).distinct(), "node", "left").join(part, "node", "left").join(home, "component", "left")
    state = state.select("node", F.when(F.col("itself") | F.col("home"), "connected").otherwise("gap").alias("state"))
    kept = tree.join(part.select(F.col("node").alias("a"), "component"), "a").join(home, "component", "left_semi").select("a", "b", "cost")
    return kept, state
