"""Snapshots, staged publication and retained stages, through Hadoop file systems only."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Name (the path below ``folder``), size and SHA-256 of every file below a folder.

    A file is read whole by one task, so one above ``most_bytes`` is refused.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    fs, root = _fs(spark, folder)
    root = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    name = F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(F.element_at(F.split("path", "/"), -1))
    whole = F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.lit("file too large for one task: "), F.col("path"))).cast("binary")).otherwise(F.col("content"))
    return rows.select(name.alias("name"), "length", F.sha2(whole, 256).alias("sha256"))


def verify(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Files missing, added or changed against an expected manifest; none for an intact snapshot."""
    now = manifest(spark, folder).select("name", F.col("sha256").alias("is"))
    rows = expected.select("name", F.col("sha256").alias("was")).join(now, "name", "full")
    return rows.where(~F.col("is").eqNullSafe(F.col("was"))).select("name", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("changed").alias("state"))


def publish(spark: SparkSession, layers: Mapping[str, DataFrame], target: str, partition_by: Mapping[str, Sequence[str]] | None = None, validate: Callable[[str], None] | None = None) -> None:
    """Write all layers to a folder beside the target, validate it, and swap it in by renames.

    A failure leaves the target as it was: if the new folder cannot take its place the old one is renamed back.  Between
    the two renames there is no target; readers that must never see that use a pointer of their own to the folder.
    """
    staged, old = f"{target}.staged-{uuid.uuid4().hex}", f"{target}.old-{uuid.uuid4().hex}"
    fs, to = _fs(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        for name, df in layers.items():
            writer = df.write
            keys = (partition_by or {}).get(name)
            (writer.partitionBy(*keys) if keys else writer).parquet(f"{staged}/{name}")
        counts = {name: spark.read.parquet(f"{staged}/{name}").count() for name in layers}
        spark.createDataFrame(sorted(counts.items()), "layer string, n_rows long").coalesce(1).write.json(f"{staged}/_layers")
        if validate:
            validate(staged)
    except BaseException:
        fs.delete(path(staged), True)
        raise
    had = fs.exists(to)
    if had and not fs.rename(to, path(old)):
        fs.delete(path(staged), True)
        raise OSError(f"{target} cannot be renamed")
    moved = False
    try:
        moved = fs.rename(path(staged), to)
    finally:
        # Hadoop's rename may say no rather than raise.
        if not moved and had and not fs.exists(to):
            fs.rename(path(old), to)
    if not moved:
        fs.delete(path(staged), True)
        raise OSError(f"{staged} cannot be renamed to {target}")
    fs.delete(path(old), True)


class RetainedStages:
    """Stage outputs under the fingerprint of what made them; an unchanged stage is read, not computed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def identity(self, stage: str, specification: Mapping, upstream: Sequence[str] = ()) -> str:
        text = json.dumps({"stage": stage, "specification": specification, "upstream": sorted(upstream)}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    def get_or_make(self, stage: str, specification: Mapping, upstream: Sequence[str], make: Callable[[], DataFrame]) -> tuple[str, DataFrame, bool]:
        """Identity, rows and whether they were retained already."""
        name = self.identity(stage, specification, upstream)
        target = f"{self.folder}/{stage}/{name}"
        fs, path = _fs(self.spark, f"{target}/_SUCCESS")
        hit = fs.exists(path)
        if not hit:
            make().write.mode("overwrite").parquet(target)
        return name, self.spark.read.parquet(target), hit


def unreachable(artifacts: DataFrame, pins: DataFrame, limit: int = 200) -> DataFrame:
    """Artifacts that no pin reaches through upstream ids, for collection.  ``artifacts``: artifact_id, upstream (array)."""
    from ..operators.graph import reach

    edges = artifacts.select(F.col("artifact_id").alias("src"), F.explode("upstream").alias("dst"))
    live = reach(pins.select(F.col("artifact_id").alias("node")), edges, limit=limit)
    return artifacts.join(live.select(F.col("node").alias("artifact_id")), "artifact_id", "left_anti")


def sharded(df: DataFrame, layer: str, by: Sequence[str]) -> DataFrame:
    """Rows with the content name of their shard: the hash of layer and key values."""
    return df.withColumn("shard", F.sha2(F.to_json(F.struct(F.lit(layer).alias("layer"), *by), {"ignoreNullFields": "false"}), 256))


def network_collection(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All layers as one table of features, columns united, each with its feature_type."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("feature_type", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
