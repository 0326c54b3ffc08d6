"""Exact top-k inner products over norm-sorted blocks.

Vectors are put in blocks by descending length.  The block of the longest ones gives every query a first
threshold.  A block whose longest vector cannot reach a query's threshold (Cauchy-Schwarz) does not meet
it: queries are put in blocks by the length that they need, and rows go only to query blocks that ask for them.  Inside a block vectors are rotated by its SVD; the partial product over the leading directions
plus the product of the two residual lengths bounds the rest, and only what may still reach the
threshold is computed in full, exactly, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, both, grid, numbers, split, usable

#: Rows of a block, queries of a block and those compared at once, most ranges of lengths, rows between two raises
#: of the threshold, and leading directions.
ROWS, QUERIES, SLICE, CLASSES, STEP, LEADING = 8192, 8192, 512, 256, 2048, 24


def quantized(embedding):
    """floor(64 * x) of each component."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * 64).cast("double"))


def block_scores(x: np.ndarray, q: np.ndarray, ids: np.ndarray, own: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of (query, row) were computed in full, and their scores; the rest cannot be among the best k."""
    lengths = np.sqrt((x * x).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    x, lengths = x[order], lengths[order]
    _, _, v = np.linalg.svd(x if len(x) >= x.shape[1] else np.vstack([x, np.zeros((x.shape[1] - len(x), x.shape[1]))]), full_matrices=False)
    head = min(LEADING, x.shape[1])
    xr, qr = x @ v.T, q @ v.T
    x_rest, q_rest = np.sqrt((xr[:, head:] ** 2).sum(axis=1)), np.sqrt((qr[:, head:] ** 2).sum(axis=1))
    q_length = np.sqrt((q * q).sum(axis=1))
    exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2**52
    scores = np.zeros((len(q), len(x)), dtype=np.int64)
    done = np.zeros((len(q), len(x)), dtype=bool)
    threshold = threshold.astype(np.float64).copy()
    slack = 1e-6 * (1 + q_length * lengths.max(initial=0))
    for at in range(0, len(x), STEP):
        end = min(at + STEP, len(x))
        some = np.flatnonzero(q_length * lengths[at] + slack >= threshold)
        if not len(some):
            continue
        bound = qr[some, :head] @ xr[at:end, :head].T + q_rest[some, None] * x_rest[None, at:end]
        may = bound + slack[some, None] >= threshold[some, None]
        rows = np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        part = x[at + rows]
        values = q[some] @ part.T if exact else (q[some].astype(np.int64) @ part.astype(np.int64).T)
        cells = np.ix_(some, at + rows)
        scores[cells] = np.rint(values).astype(np.int64) if exact else values
        done[cells] = may[:, rows]
        seen = np.where(done & (ids[order][None, :] != own[:, None]), scores, np.iinfo(np.int64).min)[:, :end]
        if end >= k:
            kth = np.partition(seen, -k, axis=1)[:, -k].astype(np.float64)
            threshold = np.maximum(threshold, kth)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return done[:, back], scores[:, back]


def _compare(k: int):
    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), dtype=np.int64)]
        if rows.num_rows and queries.num_rows:
            x, q = both(rows.column("vector"), queries.column("query_vector"))
            ids, own = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            by_id = np.argsort(ids)
            x, ids = x[by_id], ids[by_id]
            threshold = queries.column("threshold").to_numpy(zero_copy_only=False).astype(np.float64)
            for begin in range(0, len(q), SLICE):
                some = slice(begin, begin + SLICE)
                done, scores = block_scores(x, q[some], ids, own[some], threshold[some], k)
                done &= ids[None, :] != own[some, None]
                for i in range(len(done)):
                    at = np.flatnonzero(done[i])
                    if len(at) > k:
                        at = at[scores[i, at] >= np.partition(scores[i, at], -k)[-k]]
                    at = at[np.argsort(-scores[i, at], kind="stable")[:k]]
                    found.append(np.stack([np.full(len(at), own[begin + i]), ids[at], scores[i, at]]))
        table = np.concatenate(found, axis=1)
        return pa.table({"query_id": table[0], "vec_id": table[1], "score": table[2]})

    return compare


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int = ROWS) -> DataFrame:
    """The ``k`` highest inner products of each row whose vec_id is divisible by ``every``.

    Components become floor(64 * x).  Candidates are all rows but the query's own; ties go to the smaller
    vec_id.  Null and empty vectors and those with a null or non-finite component take no part;
    shorter vectors are filled up with zeros.  Products are exact up to 2**63.  A table without such rows
    gives none; columns other than vec_id and embedding are ignored.  Returns query_id, rank, vec_id and score.
    """
    rows = usable(vectors.select("vec_id", "embedding"), nonzero=False).select("vec_id", quantized(F.col("embedding")).alias("vector"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    rows, total = split(rows, "length", block_rows, CLASSES, "block", "vec_id")
    rows = cut(rows)
    longest = rows.groupBy("block").agg(F.max("length").alias("longest"))
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("length").alias("query_length"))
    schema, columns = "query_id long, vec_id long, score long", ["query_id", "query_vector", "query_block", "block", "threshold"]
    blocks = max(1, -(-asked.count() // QUERIES))
    open_query = asked.withColumn("query_block", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(blocks)).cast("int")).withColumn("block", F.lit(0)).withColumn("threshold", F.lit(float("-inf")))
    first = cut(grid(rows.where("block = 0").select("vec_id", "vector", "block"), open_query.select(*columns), _compare(k), schema))
    threshold = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("have"))
    threshold = threshold.select("query_id", F.when(F.col("have") >= k, F.col("kth").cast("double")).alias("kth"))
    asked = asked.join(threshold, "query_id", "left").withColumn("threshold", F.coalesce("kth", F.lit(float("-inf"))))
    need = F.when(F.col("threshold") > 0, F.col("threshold") / F.greatest("query_length", F.lit(1e-300))).otherwise(F.lit(0.0))
    asked, _ = split(cut(asked.withColumn("need", need)), "need", QUERIES, CLASSES, "query_block", "query_id")
    rest = asked.withColumn("block", numbers(total)).where("block > 0")
    rest = rest.join(longest, "block").where(F.col("query_length") * F.col("longest") * (1 + 1e-9) >= F.col("threshold")).select(*columns)
    found = first.union(grid(rows.where("block > 0").select("vec_id", "vector", "block"), rest, _compare(k), schema))
    return best(found, k)


def oracle(every: int = 20, k: int = 20) -> str:
    """DuckDB SQL for ``top_k`` over ``embeddings``."""
    return f"""
    with v as (select vec_id, list_transform(min(embedding), lambda x: floor(64 * cast(x as double))) as vector from embeddings
        where vec_id is not null and embedding is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
    scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.vector, c.vector) as bigint) as score
        from v q join v c on c.vec_id <> q.vec_id where q.vec_id % {every} = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
    select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= {k}"""
