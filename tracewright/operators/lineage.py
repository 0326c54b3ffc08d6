"""Lineages through parents, and circles where there should be none."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .components import checkpointed, stored
from .graph import strong_components


def lineage(starts: DataFrame, parents: DataFrame, limit: int = 1000) -> DataFrame:
    """All items that each start comes from, with the fewest steps: (start_id, item, steps); the start's own items have 0.

    ``starts``: start_id, item; a start may have several items, such as both ends of a meeting.  ``parents``: item, parent; an item may have several.  Every round
    only the items that are new go on.  Circles do no harm; raises if ``limit`` rounds do not suffice.
    """
    # All joins are merges: a table that still just fits a broadcast would go through the driver in every round.
    links = checkpointed(parents.where("parent is not null").select("item", "parent").distinct()).hint("merge")
    seen = front = checkpointed(starts.select("start_id", "item", F.lit(0).alias("steps")).distinct())
    for steps in range(1, limit + 1):
        front = front.join(links, "item").select("start_id", F.col("parent").alias("item")).distinct()
        front = checkpointed(front.join(seen.hint("merge"), ["start_id", "item"], "left_anti").withColumn("steps", F.lit(steps)))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if steps % 8 == 0:
            seen = checkpointed(seen)
    raise RuntimeError(f"lineages did not end in {limit} rounds")


def connectors(meetings: DataFrame, connections: DataFrame) -> DataFrame:
    """Each meeting of two branches with everything that both sides come from, each connection once.

    ``meetings``: meeting_id, from_place, to_place, length_mm.  ``connections``: connection_id, place (that it attaches), parent_place (null at a spine),
    branch_id, length_mm.  Returns meeting_id, n_connections, n_branches, roots (places without a connection that were reached, in order), first_branch,
    depth and length_mm of the whole chain.
    """
    ends = meetings.select(F.col("meeting_id").alias("start_id"), F.explode(F.array("from_place", "to_place")).alias("item"))
    reached = checkpointed(lineage(ends, connections.select(F.col("place").alias("item"), F.col("parent_place").alias("parent"))))
    rows = reached.withColumnRenamed("item", "place").join(connections.select("place", "connection_id", "branch_id", "length_mm").hint("merge"), "place", "left")
    rows = rows.groupBy(F.col("start_id").alias("meeting_id")).agg(
        F.count("connection_id").alias("n_connections"), F.countDistinct("branch_id").alias("n_branches"), F.array_sort(F.collect_set(F.when(F.col("connection_id").isNull(), F.col("place")))).alias("roots"),
        F.min("branch_id").alias("first_branch"), F.max("steps").cast("long").alias("depth"), F.coalesce(F.sum("length_mm"), F.lit(0)).alias("length"),
    )
    return meetings.select("meeting_id", F.col("length_mm").alias("own")).join(rows.hint("merge"), "meeting_id").withColumn("length_mm", F.col("own") + F.col("length")).drop("own", "length")


def circle_witnesses(edges: DataFrame) -> DataFrame:
    """A circle of each strong component that has one: (component, circle, src, dst), the edges along it; empty where levels exist for all.

    ``edges``: src, dst.  Inside a component every node points at its smallest successor there; nodes that are still pointed at after as many steps as there
    are nodes lie on circles, and pointers are doubled to get there.
    """
    plain = checkpointed(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    loops = plain.where("src = dst").select(F.col("src").alias("component"), F.col("src").alias("circle"), "src", "dst")
    nodes = plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    part = checkpointed(strong_components(nodes, plain)) if not plain.isEmpty() else nodes.withColumn("component", F.col("node"))
    inside = plain.where("src <> dst").join(part.withColumnsRenamed({"node": "src", "component": "c"}), "src").join(part.withColumnsRenamed({"node": "dst", "component": "d"}), "dst").where("c = d")
    step = checkpointed(inside.groupBy(F.col("c").alias("component"), F.col("src").alias("item")).agg(F.min("dst").alias("next")))
    n, far = step.count(), step.select("item", "next")
    for turn in range(math.ceil(math.log2(n)) if n > 1 else 0):
        far = far.join(far.select(F.col("item").alias("next"), F.col("next").alias("then")), "next").select("item", F.col("then").alias("next"))
        if turn % trees.TOGETHER:
            far = stored(far)
    on = step.join(far.select(F.col("next").alias("item")).distinct(), "item", "left_semi")
    on = checkpointed(on)
    named = trees.circles(on.select("item", "next"))
    found = on.join(named, "item").select("component", "circle", F.col("item").alias("src"), F.col("next").alias("dst"))
    keep = found.groupBy("component").agg(F.min("circle").alias("circle"))
    return found.join(keep, ["component", "circle"], "left_semi").select("component", "circle", "src", "dst").union(loops)
