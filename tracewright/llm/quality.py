"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each byte has a learned
embedding; learned filters slide over a chunk and are max-pooled in it.  A document's features are the largest, the
mean and the smallest chunk maximum of each filter, and a logistic layer turns them into one probability.  The
smallest maximum tells chunks of little variety, such as one word repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts
from .sampling import PER_CLASS, fitted, labelled, remainder

CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 2, 6, 32
STEPS, BATCH, TRAIN_CHUNKS, RATE, DECAY, SEED = 600, 48, 12, 0.01, 1e-3, 11
#: Chunks that go through the filters at once.
PASS = 512


class Network(NamedTuple):
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def chunks(data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of bytes, and where each text's chunks begin."""
    step = CHUNK - WIDTH
    sizes = np.array([len(t or b"") for t in data], dtype=np.int64)
    number = np.maximum(1, -(-(sizes - WIDTH) // step))
    first = np.concatenate([[0], np.cumsum(number)])
    flat = np.frombuffer(b"".join(t or b"" for t in data) + bytes(1), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(data)), number)
    at = (np.arange(first[-1]) - first[owner]) * step
    rows = np.zeros((first[-1], CHUNK), dtype=np.uint8)
    for i in range(0, len(rows), PASS):
        inside = at[i : i + PASS, None] + np.arange(CHUNK)[None, :]
        good = inside < sizes[owner[i : i + PASS], None]
        rows[i : i + PASS][good] = flat[(inside + begin[owner[i : i + PASS], None])[good]]
    return rows, first


def _windows(embedded: np.ndarray) -> np.ndarray:
    last = CHUNK - WIDTH + 1
    return np.concatenate([embedded[:, w : w + last : STRIDE] for w in range(WIDTH)], axis=2)


def _maxima(net: Network, rows: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), FILTERS), dtype=np.float32)
    for i in range(0, len(rows), PASS):
        seen = _windows(net.embed[rows[i : i + PASS]])
        out[i : i + PASS] = (seen.reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(seen), -1, FILTERS).max(axis=1)
    return np.maximum(out + net.bias, 0)


def _pool(maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = first[:-1]
    mean = np.add.reduceat(maxima, at) / np.diff(first)[:, None]
    return np.concatenate([np.maximum.reduceat(maxima, at), mean, np.minimum.reduceat(maxima, at)], axis=1)


def probabilities(net: Network, data: list[bytes | None]) -> np.ndarray:
    if not data:
        return np.zeros(0)
    rows, first = chunks(data)
    z = _pool(_maxima(net, rows), first).astype(np.float64) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(data: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network | float:
    """A network fitted by Adam on balanced batches; with one class only, that class's share."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.05, 3 * FILTERS), np.zeros(1)]
    parameters = [p.astype(np.float32) for p in parameters]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    rows, first = chunks(data)
    classes = [np.flatnonzero(y == v) for v in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        # Neighbouring chunks of a document, so that the smallest and largest mean what they mean later.
        own = []
        for d in pick:
            n = first[d + 1] - first[d]
            begin = first[d] + (rng.integers(0, n - TRAIN_CHUNKS + 1) if n > TRAIN_CHUNKS else 0)
            own.append(np.arange(begin, min(first[d + 1], begin + TRAIN_CHUNKS)))
        at = np.concatenate([[0], np.cumsum([len(o) for o in own])])
        bytes_ = rows[np.concatenate(own)]
        embed, filters, bias, weights, offset = parameters
        seen = _windows(embed[bytes_])
        values = (seen.reshape(-1, WIDTH * EMBED) @ filters).reshape(len(seen), -1, FILTERS)
        place = values.argmax(axis=1)
        maxima = np.maximum(np.take_along_axis(values, place[:, None], axis=1)[:, 0] + bias, 0)
        pooled = _pool(maxima, at)
        p = 1 / (1 + np.exp(-np.clip(pooled @ weights + offset[0], -30, 30)))
        error = ((p - y[pick]) / len(pick)).astype(np.float32)
        toward = error[:, None] * weights[None, :]
        owner = np.repeat(np.arange(len(pick)), np.diff(at))
        top, low = pooled[:, :FILTERS][owner] == maxima, pooled[:, 2 * FILTERS :][owner] == maxima
        count = np.diff(at)[owner][:, None]
        share = lambda hit: hit / np.add.reduceat(hit.astype(np.float32), at[:-1])[owner]
        g = toward[owner, :FILTERS] * share(top) + toward[owner, FILTERS : 2 * FILTERS] / count + toward[owner, 2 * FILTERS :] * share(low)
        g = (g * (maxima > 0)).astype(np.float32)
        i, f = np.nonzero(g)
        where = seen[i, place[i, f]]
        d_filters = np.zeros_like(filters)
        np.add.at(d_filters.T, f, where * g[i, f][:, None])
        d_where = (filters.T[f] * g[i, f][:, None]).reshape(len(i), WIDTH, EMBED)
        source = bytes_[i[:, None], place[i, f][:, None] * STRIDE + np.arange(WIDTH)[None, :]]
        d_embed = np.zeros_like(embed)
        np.add.at(d_embed, source.reshape(-1), d_where.reshape(-1, EMBED))
        grads = [d_embed + 1e-5 * embed, d_filters + 1e-5 * filters, g.sum(axis=0), pooled.T @ error + DECAY * weights, np.array([error.sum()])]
        for parameter, gradient, (m, v) in zip(parameters, grads, moments):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            parameter -= (RATE * (1 - 0.9 * step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Network(*parameters[:4], float(parameters[4][0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """Fit on at most ``per_class`` labelled rows of each class whose crc32 modulo 3 is not 1."""
    return fitted(labelled(docs, labels, "quality", remainder("doc_id", 3) != 1, per_class), train)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """Quality of every whole text.

    Null texts count as empty, and empty texts are scored like any other.  Repeated rows are scored each, an
    empty table gives no rows, other columns than doc_id and text are no inputs.  Returns doc_id, held_out,
    score and predicted; held_out is false for a null doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            data = texts(batch.column("text"))
            p = probabilities(model, data) if isinstance(model, Network) else np.full(len(data), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            data = texts(batch.column("text"))
            p = probabilities(model, data) if isinstance(model, Network) else np.full(len(data), model)
            yield batch.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)
