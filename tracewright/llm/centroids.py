"""Centroid clustering by kd-tree filtering, exact in integers.

Vectors are dealt in blocks of bounded size, and each block becomes a kd-tree whose nodes hold the number of their
vectors, the integer sums of their components and their bounding box.  The trees are written once and read in
every round.  A round takes the centroids down the trees: at a node, each centroid goes that is strictly farther than another one
from every point of the box (so a tie is never decided there); where one is left the whole node is its own, by count and sums; in leaves
the vectors meet the centroids that are left.  Only counts and sums for each centroid are added up over blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, ROUNDS, WIDTH = 16, 3, 64
#: Vectors of a tree and, at most, of a leaf.
BLOCK, LEAF = 4096, 16
#: Components up to here keep squared distances inside 63 bits for up to 64 components; larger ones are computed as Python integers.
_SMALL = 1 << 26


def kept(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, vector): floor(64 * x) of each component as decimal integers, of vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x * 64) < 1e37))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == width) & whole)
    # floor() of a double is a long in Spark; beyond 2**53 a double is an integer as it is.
    floor = lambda x: F.when(F.abs(x * 64) < 2.0**53, F.floor(x * 64).cast("decimal(38,0)")).otherwise((x * 64).cast("decimal(38,0)"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, floor).alias("vector"))


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest SHA-256 of ``1:<vec_id>``, in that order; of one vec_id the smaller vectors first."""
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    return [[int(x) for x in r["vector"]] for r in hashed.orderBy("hash", "vector").limit(k).collect()]


def _numbers(rows: list[list[int]] | np.ndarray, width: int) -> np.ndarray:
    """Integers as int64, or as Python integers where squares might not fit."""
    x = np.array(rows, dtype=object).reshape(-1, width)
    return x.astype(np.int64) if not x.size or max(abs(int(x.max())), abs(int(x.min()))) < _SMALL else x


class Tree:
    """A complete kd-tree over the rows of ``x``: node 1 is the root, 2n and 2n + 1 the halves of n; ``order`` sorts rows by leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        self.order = np.arange(len(x))
        self.begin, self.end = {1: 0}, {1: len(x)}
        for node in range(1, 1 << self.depth):
            b, e = self.begin[node], self.end[node]
            part = x[self.order[b:e]]
            side = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if e > b else 0
            half = (b + e) // 2
            by = np.argsort(part[:, side], kind="stable")
            self.order[b:e] = self.order[b:e][by]
            self.begin[2 * node], self.end[2 * node], self.begin[2 * node + 1], self.end[2 * node + 1] = b, half, half, e
        self.x = x[self.order]
        nodes = range(1, 2 << self.depth)
        self.begin, self.end = (np.array([0] + [side[n] for n in nodes]) for side in (self.begin, self.end))
        self.counts = self.end - self.begin
        empty = np.zeros(x.shape[1], dtype=x.dtype)
        pick = lambda f: np.stack([empty] + [f(self.x[b:e]) if e > b else empty for b, e in zip(self.begin[1:], self.end[1:])])
        self.sums, self.low, self.high = pick(lambda p: p.sum(axis=0)), pick(lambda p: p.min(axis=0)), pick(lambda p: p.max(axis=0))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and centroids."""
    limit = max(int(abs(x).max()) if x.size else 0, int(abs(c).max()) if c.size else 0)
    if x.dtype != object and c.dtype != object and limit < 1 << 22:
        x, c = x.astype(np.float64), c.astype(np.float64)  # every sum stays an integer below 2**53
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def filtered(tree: Tree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(cluster of each row in tree order, counts and sums of each centroid, what was done) for centroids ``c``."""
    k, wide = len(c), object if tree.x.dtype == object or c.dtype == object else np.int64
    counts, sums, owner = np.zeros(k, dtype=np.int64), np.zeros((k, c.shape[1]), dtype=wide), np.zeros(len(tree.x), dtype=np.int32)
    done = {"whole": 0, "pruned": 0, "compared": 0}
    c, low, high, total = c.astype(wide), tree.low.astype(wide), tree.high.astype(wide), tree.sums.astype(wide)
    square = (c * c).sum(axis=1)
    nodes, alive = np.array([1]), np.ones((1, k), dtype=bool)
    far = np.iinfo(np.int64).max
    for level in range(tree.depth + 1):
        some = tree.counts[nodes] > 0
        nodes, alive = nodes[some], alive[some]
        if not len(nodes):
            break
        # The centroid nearest to the middle of the box (twice the middle, to stay in integers).
        middle = np.where(alive, distances(low[nodes] + high[nodes], 2 * c), far).argmin(axis=1)
        for m in np.unique(middle):
            at = np.flatnonzero(middle == m)
            step = c - c[m]
            # |x - m|^2 - |x - c|^2 = |m|^2 - |c|^2 + 2 x.(c - m) is largest at a corner of the box.
            most = square[m] - square + 2 * (high[nodes[at]] @ np.maximum(step, 0).T + low[nodes[at]] @ np.minimum(step, 0).T)
            gone = (most < 0) & alive[at]
            done["pruned"] += int(gone.sum())
            alive[at] &= ~gone
        single = alive.sum(axis=1) == 1
        for node, m in zip(nodes[single], alive[single].argmax(axis=1)):
            counts[m] += tree.counts[node]
            sums[m] += total[node]
            owner[tree.begin[node] : tree.end[node]] = m
            done["whole"] += 1
        nodes, alive = nodes[~single], alive[~single]
        if level < tree.depth:
            nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
    if len(nodes):
        rows = np.concatenate([np.arange(tree.begin[n], tree.end[n]) for n in nodes])
        may = np.repeat(alive, tree.counts[nodes], axis=0)
        done["compared"] = int(may.sum())
        m = np.where(may, distances(tree.x[rows], c), far).argmin(axis=1)
        owner[rows] = m
        counts += np.bincount(m, minlength=k)
        np.add.at(sums, m, tree.x[rows].astype(wide))
    return owner, counts, sums, done


def _trees(width: int, leaf: int):
    """Rows of a partition to trees of at most ``BLOCK`` rows, each as one row: ids in tree order, and the tree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                tree = Tree(_numbers(part.column("vector").to_pylist(), width), leaf)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)[tree.order]
                yield pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return build


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for ids, tree in zip(batch.column("ids"), batch.column("tree")):
            yield ids.values, pickle.loads(tree.as_py())


def _sums(c: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tree in _read(batches):
            _, counts, sums, _ = filtered(tree, c)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array([[str(v) for v in sums[m]] for m in some], pa.list_(pa.string()))})

    return add


def _owners(c: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches):
            owner = filtered(tree, c)[0]
            far = ((tree.x - c[owner]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(owner, pa.int32()), "distance": pa.array([int(v) for v in far], pa.int64())})

    return assign


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, leaf: int = LEAF) -> DataFrame:
    """Assign each vector of ``width`` components to one of ``k`` centroids after ``rounds`` rounds.

    Components become floor(64 * x).  Centroids start as the vectors with the smallest SHA-256 of ``1:<vec_id>``.  A round assigns
    every vector to the nearest centroid (ties: smaller number) and replaces every non-empty centroid by floor(sum / count) of its
    vectors; then vectors are assigned once more.  Null vectors, those of another size or with a null or non-finite component, and rows with a
    null vec_id take no part; nor do those with a component of 1e37 / 64 or more, which no integer type here holds.  Rows that repeat a vec_id
    are vectors of their own.  With fewer than ``k`` vectors each is a centroid; with none there are no rows.  A squared distance that does
    not fit 63 bits is an error.  Other columns are ignored.

    Returns vec_id, cluster, distance, cluster_inertia, inertia (both sums of distances) and centroid_sha256.
    """
    spark = vectors.sparkSession
    rows = cut(kept(vectors, width))
    start = first_centroids(rows, k)
    c = _numbers(start, width)
    trees = cut(rows.mapInArrow(_trees(width, leaf), "ids array<long>, tree binary"))
    exact: Column = F.transform("sums", lambda s: s.cast("decimal(38,0)"))
    for _ in range(rounds if start else 0):
        part = trees.mapInArrow(_sums(c), "cluster int, n long, sums array<string>").withColumn("sums", exact)
        part = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        new = [[int(v) for v in row] for row in c]
        for r in part.collect():  # one row for each centroid
            new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        c = _numbers(new, width)
    out = cut(trees.mapInArrow(_owners(c), "vec_id long, cluster int, distance long"))
    inertia = F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia")
    per = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).select("cluster", "cluster_inertia", inertia)
    text = [(i, ",".join(str(int(v)) for v in row)) for i, row in enumerate(c)]
    names = spark.createDataFrame(text, "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    # One row for each centroid: ``k`` rows.
    return out.join(F.broadcast(per.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """DuckDB SQL for ``cluster`` over ``embeddings``."""
    near = "list_sum(list_transform(range(1, {w} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".replace("{w}", str(width))
    text = f"""
    with v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
        where vec_id is not null and embedding is not null and len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    c0 as materialized (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as integer) as cluster, v as c from v qualify cluster < {k})"""
    for r in range(rounds + 1):
        text += f""",
    a{r} as materialized (select vec_id, v, arg_min(cluster, {{'d': d, 'cluster': cluster}}) as cluster, min(d) as distance
        from (select vec_id, v, cluster, cast({near} as bigint) as d from v, c{r}) group by vec_id, v)"""
        if r < rounds:
            text += f""",
    s{r} as (select cluster, i, cast(sum(v[i]) as hugeint) as s, count(*) as n from a{r}, range(1, {width} + 1) t(i) group by cluster, i),
    c{r + 1} as materialized (select c{r}.cluster, coalesce(m, c) as c from c{r} left join
        (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{r} group by cluster) using (cluster))"""
    return text + f"""
    select vec_id, a{rounds}.cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by a{rounds}.cluster) as bigint) as cluster_inertia,
        cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.cluster = a{rounds}.cluster"""
