"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt to shards of bounded size.  In each shard every tree is a sorted array of long hash
strings (signs of random projections).  A query descends in all trees to its longest matching prefixes and then
ascends in all trees at once, one bit at a time, until the ranges hold PER_ROW entries for each row of the
shard.  Vectors that these ranges hold clearly more often than an average one are ranked by exact cosine, and the
shards' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, both, grid, numbers, usable

#: Rows of a shard, queries that one group of a shard serves and those looked at together, trees and bits of a hash string.
SHARD, QUERIES, SLICE, TREES, BITS, SEED = 8192, 16384, 256, 192, 32, 17
#: Entries for each row of a shard at which the ascent stops, and how many times the average number of a vector's entries
#: makes it a candidate.  On random vectors this scores about an eighth of the rows; structured ones need fewer.
PER_ROW, OFTEN = 2.0, 1.7
#: Trees whose projections are computed at once.
AT_ONCE = 8


def hash_strings(x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The hash string of each vector in each tree, as integers of ``bits`` bits."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
    signs = (x @ planes > 0).reshape(len(x), trees, bits)
    return (signs.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def ranges(sorted_codes: np.ndarray, codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Where entries with a query's first ``l`` bits begin and end, for l = 0 .. bits."""
    lo, hi = (np.zeros((bits + 1, len(codes)), dtype=np.int64) for _ in range(2))
    for level in range(bits + 1):
        span = np.uint64(1 << (bits - level))
        prefix = codes & ~(span - np.uint64(1))
        lo[level], hi[level] = np.searchsorted(sorted_codes, prefix), np.searchsorted(sorted_codes, prefix + span)
    return lo, hi


class Trees:
    """The sorted arrays of a shard's vectors, built once for all its queries."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int):
        self.rows, self.trees, self.bits, self.seed = len(x), trees, bits, seed
        self.codes, self.order = np.empty((trees, len(x)), dtype=np.uint64), np.empty((trees, len(x)), dtype=np.int32)
        for t, codes in self._hashed(x):
            self.order[t] = np.argsort(codes, kind="stable")
            self.codes[t] = codes[self.order[t]]

    def _hashed(self, x: np.ndarray):
        for begin in range(0, self.trees, AT_ONCE):
            some = min(AT_ONCE, self.trees - begin)
            codes = hash_strings(x, some, self.bits, self.seed + begin)
            yield from ((begin + t, codes[:, t]) for t in range(some))

    def counts(self, q: np.ndarray, per_row: float):
        """For each query how often the ranges at its last level of the ascent hold each row."""
        lo, hi = (np.empty((self.trees, self.bits + 1, len(q)), dtype=np.int32) for _ in range(2))
        for t, codes in self._hashed(q):
            lo[t], hi[t] = ranges(self.codes[t], codes, self.bits)
        enough = (hi - lo).sum(axis=0) >= min(per_row, self.trees) * self.rows
        level = self.bits - np.argmax(enough[::-1], axis=0)
        flat, base = self.order.reshape(-1), np.arange(self.trees) * self.rows
        for i in range(len(q)):
            begin, size = lo[:, level[i], i] + base, hi[:, level[i], i] - lo[:, level[i], i]
            ends = np.cumsum(size)
            yield np.bincount(flat[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)], minlength=self.rows)


def candidates(counts: np.ndarray, often: float, least: int) -> np.ndarray:
    """Rows that are held ``often`` times as often as the average, and in any case the ``least`` commonest ones."""
    bar = often * counts.mean()
    if len(counts) > least:
        bar = min(bar, np.partition(counts, -least)[-least])
    return np.flatnonzero(counts >= bar) if len(counts) > least else np.arange(len(counts))


def _compare(k: int, trees: int, bits: int, per_row: float, often: float, seed: int):
    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            x, q = both(rows.column("embedding"), queries.column("query"))
            ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            norms, query_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            forest = Trees(x / norms[:, None], trees, bits, seed)
            for begin in range(0, len(q), SLICE):
                part = q[begin : begin + SLICE] / query_norms[begin : begin + SLICE, None]
                for i, counts in enumerate(forest.counts(part, per_row), begin):
                    at = candidates(counts, often, k + 1)
                    at = at[ids[at] != query_ids[i]]
                    scores = (x[at] * q[i]).sum(axis=1) / (norms[at] * query_norms[i])
                    if len(at) > k:
                        near = scores >= np.partition(scores, -k)[-k]
                        at, scores = at[near], scores[near]
                    first = np.lexsort((ids[at], -scores))[:k]
                    out["query_id"].append(np.full(len(first), query_ids[i]))
                    out["vec_id"].append(ids[at[first]])
                    out["score"].append(scores[first])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *v]).astype(kinds[c]) for c, v in out.items()})

    return compare


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, trees: int = TREES, bits: int = BITS, per_row: float = PER_ROW, often: float = OFTEN, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest vectors found, by cosine, of each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own.  A shard's trees are built once for every QUERIES queries.  Null, empty and zero vectors and those with a null or
    non-finite component take no part, nor do those whose squares overflow or vanish in double precision; vectors of other
    lengths are filled up with zeros.  Equal
    vectors have equal hash strings and are found together.  A table without such rows gives none;
    columns other than vec_id and embedding are ignored.  Returns query_id, rank, vec_id and score.
    """
    rows = usable(vectors.select("vec_id", "embedding"), nonzero=True)
    n = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    shards, blocks = -(-n // shard), -(-asked.count() // QUERIES)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, shards))).cast("int"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).withColumn("query_block", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(max(1, blocks))).cast("int")).withColumn("block", numbers(shards))
    found = grid(dealt, asked, _compare(k, trees, bits, per_row, often, seed), "query_id long, vec_id long, score double")
    return best(found, k)
