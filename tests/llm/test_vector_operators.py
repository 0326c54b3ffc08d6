"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from tracewright.llm import ann_forest, exact_topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:400] = x[7]  # one vector for a fifth of the rows
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    return out + [(2000, None), (2050, []), (2100, [float("nan")] * 16), (2150, [None] + [1.0] * 15), (2200, [float("inf")] + [0.0] * 15), (2250, [0.0] * 16), (2300, [1.0, 2.0]), (20, out[20][1])]


def usable(rows, nonzero):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v)):
            v = list(np.float32(v).astype(float)) + [0.0] * (16 - len(v))
            good[i] = min(good.get(i, v), v)
    return np.array(sorted(good)), np.array([good[i] for i in sorted(good)])


def test_exact_top_k(spark, rows):
    ids, x = usable(rows, False)
    v = np.floor(64 * x).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:20]
        want += [(ids[q], k + 1, ids[j], s[j]) for k, j in enumerate(order)]
    for block in (8192, 200):
        got = sorted(tuple(r) for r in exact_topk.top_k(frame(spark, rows), block_rows=block).collect())
        assert got == sorted(tuple(int(a) for a in w) for w in want)


def test_pruning_leaves_out_most_of_a_skewed_table():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((3000, 32)) * np.geomspace(60, 1, 3000)[:, None] * np.geomspace(8, 0.2, 32)[None, :])
    done, scores = exact_topk.block_scores(x, x[:5], np.arange(3000), np.arange(5), np.full(5, -np.inf), 20)
    assert done.mean() < 0.9
    for i in range(5):
        best = np.sort((x @ x[i])[np.arange(3000) != i])[-20:]
        kept = np.sort(scores[i][done[i] & (np.arange(3000) != i)])[-20:]
        assert (best == kept).all()


def test_nearest_recall_scores_and_ties(spark, rows):
    ids, x = usable(rows, True)
    norms = np.sqrt((x * x).sum(axis=1))
    got = {}
    for r in ann_forest.nearest(frame(spark, rows), shard=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(axis=1) / (norms * norms[q])
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        found = sorted(got[ids[q]])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        for _, i, score in found:
            assert score == pytest.approx(s[np.searchsorted(ids, i)], abs=1e-12)
        hit += len({ids[j] for j in order} & {f[1] for f in found})
        total += 5
    assert hit / total > 0.9
    assert [f[1] for f in sorted(got[100])] == [7, 101, 102, 103, 104]


def test_recall_and_rows_scored_at_default_parameters(spark):
    """Random vectors of 64 dimensions, the worst case: recall above 0.9 with under a fifth of the rows scored."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    forest = ann_forest.Trees(x, ann_forest.TREES, ann_forest.BITS, ann_forest.SEED)
    hit, scored, queries = 0, 0, np.arange(0, 4000, 50)
    for q, counts in zip(queries, forest.counts(x[queries], ann_forest.PER_ROW)):
        at = ann_forest.candidates(counts, ann_forest.OFTEN, 6)
        order = [j for j in np.argsort(-(x @ x[q])) if j != q][:5]
        hit, scored = hit + len(set(order) & set(at.tolist())), scored + len(at)
    assert hit / (5 * len(queries)) > 0.9
    assert scored / (len(queries) * len(x)) < 0.2
    frame_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann_forest.nearest(frame_).collect()}
    want = {(int(q), int(j)) for q in queries for j in [j for j in np.argsort(-(x @ x[q])) if j != q][:5]}
    assert len(got & want) / len(want) > 0.9


def test_vectors_whose_squares_overflow(spark):
    frame_ = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e200, 1e200]), (2, [2.0, 4.0]), (50, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann_forest.nearest(frame_).collect()] == [(0, 2)]


def test_small_tables(spark):
    assert exact_topk.top_k(frame(spark, [])).collect() == []
    assert ann_forest.nearest(frame(spark, [])).collect() == []
    assert ann_forest.nearest(frame(spark, [(3, [1.0]), (4, [2.0])])).collect() == []
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    assert [tuple(r) for r in exact_topk.top_k(two).collect()] == [(0, 1, 1, 64 * 32)]
    assert [(r.query_id, r.vec_id) for r in ann_forest.nearest(two).collect()] == [(0, 1)]


def test_ranges_are_prefix_matches():
    codes = np.sort(np.array([0b0000, 0b0011, 0b0100, 0b1000, 0b1111], dtype=np.uint64))
    lo, hi = ann_forest.ranges(codes, np.array([0b0010], dtype=np.uint64), bits=4)
    assert [(int(a), int(b)) for a, b in zip(lo[:, 0], hi[:, 0])] == [(0, 5), (0, 3), (0, 2), (1, 2), (1, 1)]


def test_matrix_fills_up_short_vectors(spark):
    import pyarrow as pa

    assert vectors.matrix(pa.chunked_array([pa.array([[1.0, 2.0], [3.0]])])).tolist() == [[1.0, 2.0], [3.0, 0.0]]
