"""Structured Streaming versions of the as-of folds and of distance-like windows in time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import shared_folder
from ..sources.publish import _fs


def effective_states(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last verified state for each key as updates arrive; the aggregation buffer is one struct a key, whatever comes late."""
    verified = F.col("verification") == "verified"
    return updates.groupBy(*keys).agg(
        F.max_by(F.when(verified, F.col("state")), F.when(verified, F.struct("observed_on", "recorded_on", "update_id"))).alias("effective_state"),
        F.max(F.when(verified, F.col("update_id"))).alias("last_verified_id"),
        F.count_if(F.col("verification") == "unverified").alias("n_unverified"),
        F.count_if(F.col("verification") == "contradicted").alias("n_contradicted"),
    )


def window_counts(events: DataFrame, by: Sequence[str], every: str, slide: str | None = None, late: str = "2 days", at: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums over tumbling or sliding windows.

    Written in append or update mode, windows close ``late`` after the newest event and rows that come later are left out;
    in complete mode all windows stay open and nothing is.
    """
    w = F.window(at, every, slide) if slide else F.window(at, every)
    rows = events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, by: str, gap: str, late: str = "2 days", at: str = "ts") -> DataFrame:
    """Runs of events of one key that are less than ``gap`` apart; ``late`` acts as in ``window_counts``."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return rows.select(by, "first_at", "last_at", "n")


def status_changes(updates: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """A row whenever the state of a key changes: a custom stateful fold that keeps one state a key and expires with the watermark.

    ``updates``: key, state (string), recorded_at (timestamp).
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["recorded_at", "state"])
        out = []
        for r in rows.itertuples(index=False):
            moment = r.recorded_at.value
            if at is not None and moment < at:
                continue
            if r.state != last:
                out.append((k[0], last, r.state, r.recorded_at))
            last, at = r.state, moment
        state.update((last, at))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, at // 1_000_000 + 86_400_000 * 30))
        if out:
            yield pd.DataFrame(out, columns=[key, "was", "state", "recorded_at"])

    kind = dict(updates.dtypes)[key]
    return updates.withWatermark("recorded_at", late).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, was string, state string, recorded_at timestamp", "state string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def read_files(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over a parquet table of a folder: one file, or a directory of part files."""
    path = f"{folder}/{name}"
    fs, at = _fs(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if fs.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, mode: str = "complete", keys: Sequence[str] = ()) -> DataFrame:
    """All results of a stream over what is there now, in files of a new folder under ``spark.checkpoint.dir``.

    In complete mode each trigger replaces the files; else each adds its rows, and in update mode the last row of ``keys`` counts.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/drained_{uuid.uuid4().hex}"
    batches = set()

    def save(rows: DataFrame, batch: int) -> None:
        batches.add(batch)
        to = f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch_={batch}"
        rows.write.mode("overwrite").parquet(to)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_", LongType())])).parquet(f"{folder}/rows")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch_").alias("row_")).select("row_.*")
    return rows.select(*stream.columns)


def write(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Append a stream to parquet, exactly once for each trigger."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start().awaitTermination()


def verification(event_type: Column) -> Column:
    return F.when(event_type == "error", "contradicted").when(event_type == "purchase", "verified").otherwise("unverified")
