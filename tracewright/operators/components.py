"""Connected components by alternating star contraction.

Every round replaces edges by edges to smaller neighbours, with map-side minima.  The joins shuffle both sides
anew on a key of their own, so that adaptive execution can split a hub's rows over tasks.  The number of rounds
grows with the logarithm of the longest path.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges for each task of a round, beside the least number of tasks.  Spark's partitions are only merged to that many, so parts
#: of a hub that adaptive execution has split stay apart in large graphs, and small graphs take few tasks.
EDGES_PER_TASK, LEAST_TASKS = 100_000, 4


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set a temporary one is chosen, but only on a local master: executors elsewhere would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: its rows go to the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, with nothing that Spark knew of its plan: for results that are joined with themselves again and again."""
    path = f"{shared_folder(df.sparkSession)}/table_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _anew(df: DataFrame) -> DataFrame:
    """``u`` wrapped as another key: a join on it shuffles both sides anew, so that Spark can split a hub's rows."""
    return df.select(F.struct("u").alias("key"), *[c for c in df.columns if c != "u"])


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none to a smaller one."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("edges"), F.lit(0).alias("leaves")).union(stars.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("edges").alias("edges"), F.max("leaves").alias("leaves"))
    return ends.where("edges > 1 or (edges > 0 and leaves > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut: Callable[[DataFrame], DataFrame] = stored, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges``; the component is its smallest node.

    Loops and edges with a null end are ignored; directions do not matter.  Raises if ``max_rounds``
    do not suffice (a path of 2**60 nodes).  Rounds are tables of their own, as planning joins of checkpoints with each other takes longer each time.
    """
    a, b = F.col(src), F.col(dst)
    stars = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    # Rounds only merge edges, so tasks for the edges of the beginning suffice; a small graph takes few.
    parts = stars.count() // EDGES_PER_TASK + LEAST_TASKS
    for _ in range(max_rounds):
        if _settled(stars):
            roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Written out in between, so that neither half is planned or computed twice.
        large = cut(_anew(both.where("v > u")).join(_anew(least), "key").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _anew(large).join(_anew(low), "key").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
