"""Evidence store: pinned queries, refresh plans, coverage, partitions by cell, halos and stitching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell

PREDICATES = {
    "intersects": lambda lo, hi, x0, y0, x1, y1: (hi["x"] >= x0) & (lo["x"] <= x1) & (hi["y"] >= y0) & (lo["y"] <= y1),
    "within": lambda lo, hi, x0, y0, x1, y1: (lo["x"] >= x0) & (hi["x"] <= x1) & (lo["y"] >= y0) & (hi["y"] <= y1),
    "contains": lambda lo, hi, x0, y0, x1, y1: (lo["x"] <= x0) & (hi["x"] >= x1) & (lo["y"] <= y0) & (hi["y"] >= y1),
}


def query(rows: DataFrame, bbox: Sequence[float], predicate: str = "intersects", filters: Mapping[str, object] | None = None, projection: Sequence[str] = (), key: str = "feature_id", size: float = 1000.0) -> DataFrame:
    """Rows whose extent stands in ``predicate`` to the selector, with equality or null filters, once for each key and content.

    ``rows``: cell_x, cell_y, min_x, min_y, max_x, max_y.  Cells prune first; partitioned tables skip the other cells' files.
    Unknown columns are refused.
    """
    wanted = [*(filters or {}), *projection, key]
    unknown = sorted(set(wanted) - set(rows.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate}")
    x0, y0, x1, y1 = bbox
    out = rows.where(F.col("cell_x").between(int(x0 // size), int(x1 // size)) & F.col("cell_y").between(int(y0 // size), int(y1 // size))) if predicate != "contains" else rows
    lo, hi = {"x": F.col("min_x"), "y": F.col("min_y")}, {"x": F.col("max_x"), "y": F.col("max_y")}
    out = out.where(PREDICATES[predicate](lo, hi, x0, y0, x1, y1))
    for name, value in sorted((filters or {}).items()):
        out = out.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return out.select(key, *sorted(projection)).distinct()


def availability(rows: DataFrame, by: Sequence[str], state: str = "availability") -> DataFrame:
    """Counts of available, no-data and unknown evidence, and a fingerprint of the rows' fingerprints in order."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(state) == s).alias(f"n_{s.replace('-', '_')}") for s in ("available", "no-data", "explicit-unknown")])


def refresh_plan(held: DataFrame, requested: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What a refresh does with each partition: reused, replaced, missing (to be read) or retained (not asked for)."""
    h = held.select(F.col(key).alias("key"), F.col(fingerprint).alias("held"), F.lit(1).alias("h"))
    r = requested.select(F.col(key).alias("key"), F.col(fingerprint).alias("asked"), F.lit(1).alias("r"))
    rows = h.join(r, "key", "full")
    action = F.when(F.col("r").isNull(), "retained").when(F.col("h").isNull(), "missing").when(F.col("held").eqNullSafe(F.col("asked")), "reused").otherwise("replaced")
    return rows.select(F.col("key").alias(key), action.alias("action"))


def missing(requested: DataFrame, attested: DataFrame) -> DataFrame:
    """Requested keys without an attestation."""
    return requested.distinct().join(attested.select(*requested.columns).distinct(), requested.columns, "left_anti")


def append_new(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it does not hold."""
    return table.unionByName(rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti"))


def cells(features: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a feature's extent touches."""
    rows = features.withColumn("cell_x", F.explode(F.sequence(cell(F.col("min_x"), size), cell(F.col("max_x"), size))))
    return rows.withColumn("cell_y", F.explode(F.sequence(cell(F.col("min_y"), size), cell(F.col("max_y"), size))))


def owners(features: DataFrame, size: float, key: str = "feature_id") -> DataFrame:
    """Each feature's owner: the smallest cell that it touches."""
    return cells(features, size).groupBy(key).agg(F.min(F.struct("cell_x", "cell_y")).alias("owner")).select(key, F.col("owner.cell_x").alias("cell_x"), F.col("owner.cell_y").alias("cell_y"))


def halo_references(features: DataFrame, size: float, halo: int = 1, key: str = "feature_id") -> DataFrame:
    """For each owned cell, the features owned elsewhere that touch it or the ``halo`` cells around it."""
    own = owners(features, size, key)
    core = own.select("cell_x", "cell_y").distinct()
    around = F.sequence(F.lit(-halo), F.lit(halo))
    touched = cells(features, size).select(key, F.col("cell_x").alias("tx"), F.col("cell_y").alias("ty"))
    spread = touched.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select(key, (F.col("tx") + F.col("dx")).alias("cell_x"), (F.col("ty") + F.col("dy")).alias("cell_y")).distinct()
    return spread.join(core, ["cell_x", "cell_y"]).join(own, [key, "cell_x", "cell_y"], "left_anti").select("cell_x", "cell_y", key)


def stitch(parts: DataFrame, key: str, content: str, partition: str) -> DataFrame:
    """Features of all partitions once, owned by the smallest partition; different contents under one key are a conflict."""
    return parts.groupBy(key).agg(F.min(partition).alias("owner"), F.count("*").alias("n_copies"), F.countDistinct(content).alias("n_contents")).withColumn("state", F.when(F.col("n_contents") > 1, "conflict").otherwise("stitched"))


def equivalent(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their side, that make two tables differ; none if they hold the same rows as often."""
    names = left.columns
    return left.exceptAll(right.select(*names)).withColumn("side", F.lit("left")).unionByName(right.select(*names).exceptAll(left).withColumn("side", F.lit("right")))


def precedence(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n_ = 1").drop("n_")
