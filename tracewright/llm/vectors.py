"""Vector tables: cleaning, and comparing a query set with all rows in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding) of rows whose vector is whole: not null or empty, no null or non-finite component.

    With ``nonzero`` vectors go too whose length is zero or not finite as a double.  Rows with a null vec_id take no part.  Of rows that repeat a
    vec_id the one with the smallest array counts.
    """
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & good)
    if nonzero:
        square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
        rows = rows.where((square > 0) & (square < float("inf")))
    return cut(rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")))


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled up with zeros to the longest or to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(lengths.max()))
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def both(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two list columns as matrices of one width."""
    a, b = matrix(left), matrix(right)
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def numbers(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))


def split(rows: DataFrame, value: str, size: int, classes: int, block: str, key: str) -> tuple[DataFrame, int]:
    """``rows`` with a column ``block``: numbers of blocks of about ``size`` rows by descending ``value``, and how many there are.

    At most ``classes`` ranges of the value are told apart; a range of more rows is dealt evenly by a hash of ``key``.
    """
    n = rows.count()
    ranges = max(1, min(classes, -(-n // size)))
    cuts = rows.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10000)).first()[0] if ranges > 1 and n else []
    rank = sum((F.when(F.col(value) < c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    rows = rows.withColumn("class_", rank)
    sizes = sorted((r["class_"], r["count"]) for r in rows.groupBy("class_").count().collect())
    number, total = F.lit(0), 0
    for c, s in sizes:
        parts = -(-s // size)
        number = F.when(F.col("class_") == c, F.lit(total) + F.pmod(F.xxhash64(key), F.lit(parts))).otherwise(number)
        total += parts
    return rows.withColumn(block, number.cast("int")).drop("class_"), total


def grid(blocks: DataFrame, queries: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """``compare(rows, queries)`` for each pair of a block of rows and a block of queries that any query asks for.

    ``blocks`` has a column ``block``; ``queries`` too, and ``query_block``.  Rows are sent only where they are asked for.
    """
    # New names first, so that the two sides of the cogroup share no attribute.
    asked = queries.select(F.col("block").alias("b_"), F.col("query_block").alias("q_")).distinct().select((F.col("b_") + 0).alias("block"), (F.col("q_") + 0).alias("query_block"))
    rows = blocks.join(asked, "block")
    return rows.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(compare, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
