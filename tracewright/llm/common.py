"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpointed as cut  # noqa: F401

#: One word, as every operator here counts words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += int(n)
        yield batch.slice(begin)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The keys under other names and complemented: a join on them shuffles both sides anew, so that Spark can split a hot key's rows."""
    return df.select(*[F.bitwise_not(F.col(k)).alias(f"{k}_") for k in keys], *[c for c in df.columns if c not in keys])


def lower_ascii(column):
    """A-Z to a-z, all else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
