"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of each class that a classifier is fitted on, and the longest text among them.
PER_CLASS, LONGEST = 2000, 1 << 16


def remainder(doc_id, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = PER_CLASS) -> DataFrame:
    """Texts (UTF-8) and labels of at most ``per_class`` rows of each class, the first in the order of a hash.

    ``usable`` says which labels (by their doc_id) may be learnt from.  Only the chosen ids meet the documents,
    so the documents are not shuffled.  Where a doc_id repeats, the smallest of its texts is learnt from.
    """
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = docs.where(F.length("text") <= LONGEST).select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, train: Callable[[list[bytes], list[int]], Any]) -> Any:
    """What ``train`` makes of the rows of ``labelled``, in the order of doc_id.

    The sample is bounded, so one task learns from it; the driver gets the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")))), key=lambda row: row[0])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train([text for *_, text in rows], [y for _, y, _ in rows]))], pa.binary())})

    models = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0].model) if models else train([], [])
