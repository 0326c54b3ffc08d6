"""Routes that run parallel for a share of their stretches.

Routes of the very same stretches are one class; classes meet in blocks, by the rarest stretches that they have in common, and a task compares two blocks
as a whole.  So pairs are neither shuffled nor told apart afterwards: what goes between tasks are blocks of routes and, at the end, pairs of classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed

#: Routes of a block, stretches of one product of matrices, copies of a route in one array.
BLOCK, STRETCHES, COPIES = 2048, 4096, 256


def _ranked(routes: DataFrame) -> DataFrame:
    """A row for each route and its ends: stretches from the rarest on, how many, and the class: the smallest route of the same ends and stretches."""
    items = routes.select("route_id", "ends", "item").distinct()
    often = items.groupBy("ends", "item").agg(F.count("*").alias("often"))
    rows = items.join(often, ["ends", "item"]).groupBy("route_id", "ends").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("s"))
    rows = rows.where("route_id is not null").select("route_id", "ends", F.col("s.item").alias("items"), F.size("s").alias("size"))
    return checkpointed(rows.withColumn("class", F.min("route_id").over(Window.partitionBy("ends", "items"))))


def _shared(row: np.ndarray, code: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many codes each left row has in common with each right row; ``row`` and ``code`` list what the ``n`` rows hold, each once."""
    out = np.zeros((len(left), len(right)), np.float32)
    often = np.bincount(code, minlength=1)
    again = often[code] > 1
    number = np.cumsum(often > 1) - 1
    row, code = row[again], number[code[again]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, STRETCHES):
        a, b = np.searchsorted(code, [low, low + STRETCHES])
        held = np.zeros((n, int(code[b - 1]) - low + 1), np.float32)
        held[row[a:b], code[a:b] - low] = 1
        out += held[left] @ held[right].T
    return out


def _met(table: pa.Table, threshold: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of two blocks (or of one) in order of class, and the pairs of them (places, first before second) that are parallel: common, longer size."""
    table = table.take(pc.sort_indices(table.column("class")))
    n, lists = table.num_rows, table.column("items").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
    left, right = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
    common = _shared(row, code, n, left, right)
    longer = np.maximum.outer(size[left], size[right])
    take = common >= longer * threshold - 1e-3
    # A pair with a rarer stretch in common is told where that one brings it together.
    before = place < table.column("pos").to_numpy()[row]
    take &= _shared(row[before], code[before], n, left, right) == 0
    if low[0] == high[0]:
        take &= left[:, None] < right[None, :]
    i, j = np.nonzero(take)
    same, most = np.rint(common[i, j]).astype(np.int64), longer[i, j]
    good = same / most >= threshold
    a, b = left[i[good]], right[j[good]]
    return table, np.minimum(a, b), np.maximum(a, b), same[good], most[good]


def _blocks(classes: DataFrame, threshold: float):
    """Classes dealt to pairs of blocks for each of the stretches, one of which a parallel pair must have in common."""
    first = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    heads = classes.select("ends", "class", "items", F.posexplode(F.slice("items", F.lit(1), first)).alias("pos", "item"))
    count = heads.groupBy("ends", "item").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = heads.join(count, ["ends", "item"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("ends", "item", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "items", "pos")
    return dealt.groupBy("ends", "item", "low", "high")


def _class_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(ends, a, b, common, coverage) of classes that are parallel."""
    ends, name = (classes.schema[c].dataType.simpleString() for c in ("ends", "class"))

    def pairs(table: pa.Table) -> pa.Table:
        table, a, b, same, most = _met(table, threshold)
        of = table.column("class").combine_chunks()
        at = table.column("ends").combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
        return pa.table([at, of.take(pa.array(a)), of.take(pa.array(b)), pa.array(same), pa.array(same / most)], names=["ends", "a", "b", "common", "coverage"])

    return _blocks(classes, threshold).applyInArrow(pairs, f"ends {ends}, a {name}, b {name}, common long, coverage double")


def parallel_relations(routes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of routes with the same ends whose common stretches are at least ``threshold`` (above 0) of the longer one's.

    ``routes``: route_id, ends, item (a stretch of the route).  A pair must have one of its rarest stretches in common: of ``n`` stretches, in order of
    rarity, the first ``n - threshold * n + 1``.  Pairs of copies are written out last, from arrays of at most ``COPIES`` routes or so.
    """
    rows = _ranked(routes)
    classes = rows.where("route_id = class")
    deal = F.pmod(F.xxhash64("route_id"), F.ceil(F.count("*").over(Window.partitionBy("ends", "class")) / COPIES))
    copies = checkpointed(rows.select("ends", "class", "size", "route_id", deal.alias("part")).groupBy("ends", "class", "size", "part").agg(F.collect_list("route_id").alias("ids")))
    side = lambda x: copies.select("ends", F.col("class").alias(x), F.col("ids").alias(f"{x}_ids"))
    apart = _class_pairs(classes, threshold).join(side("a"), ["ends", "a"]).join(side("b"), ["ends", "b"]).select("ends", "common", "coverage", "a_ids", "b_ids")
    alike = copies.select("ends", F.col("class").alias("a"), F.col("size").cast("long").alias("common"), F.lit(1.0).alias("coverage"), F.col("ids").alias("a_ids"), F.col("part").alias("a_part"))
    alike = alike.join(copies.select("ends", F.col("class").alias("a"), F.col("ids").alias("b_ids"), F.col("part").alias("b_part")), ["ends", "a"]).where(F.lit(1.0) >= threshold)
    pair = lambda df: df.withColumn("x", F.explode("a_ids")).withColumn("y", F.explode("b_ids"))
    out = pair(apart).select("ends", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), "common", "coverage")
    return out.union(pair(alike).where("x < y").select("ends", F.col("x").alias("a_id"), F.col("y").alias("b_id"), "common", "coverage"))


def parallel_links(routes: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): links that hold together what ``parallel_relations`` relates, fewer than all of them.

    A copy is linked with its class; of the pairs in two blocks only a forest goes on.
    """
    rows = _ranked(routes)
    name = rows.schema["class"].dataType.simpleString()

    def links(table: pa.Table) -> pa.Table:
        table, a, b, _, _ = _met(table, threshold)
        near = np.concatenate([b, a])[np.argsort(np.concatenate([a, b]), kind="stable")]
        begin = np.searchsorted(np.sort(np.concatenate([a, b])), np.arange(table.num_rows + 1))
        root, seen = np.arange(table.num_rows), np.zeros(table.num_rows, bool)
        for start in range(table.num_rows):
            todo = [] if seen[start] else [start]
            seen[start] = True
            while todo:
                at = todo.pop()
                new = near[begin[at] : begin[at + 1]]
                new = np.unique(new[~seen[new]])
                seen[new], root[new] = True, start
                todo.extend(new.tolist())
        held, of = np.flatnonzero(root != np.arange(table.num_rows)), table.column("class").combine_chunks()
        return pa.table([of.take(pa.array(root[held])), of.take(pa.array(held))], names=["src", "dst"])

    found = _blocks(rows.where("route_id = class"), threshold).applyInArrow(links, f"src {name}, dst {name}")
    alike = rows.where("route_id <> class").select(F.col("class").alias("src"), F.col("route_id").alias("dst"))
    return (found.union(alike) if threshold <= 1 else found).distinct()
