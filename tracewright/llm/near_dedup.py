"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets are one class.  Each class has a signature of ``COORDINATES``
minimum hashes of 64 bits, and is posted under every (coordinate, value) pair.  Pairs with one posting are
skipped; a class that shares fewer than ``MATCHES`` of its pairs with anybody cannot have a partner and leaves.
The first ``PREFIX`` coordinates of the rest are merged:

1. every list links its members to one leader, the member whose values are the commonest, so that a
   large group of copies costs one pair a member; pairs that collide often enough are confirmed;
2. lists whose members are by then in one component are skipped.  In the others a class stays only if
   enough of its shingles occur in another such class at all (exact counts over full sets).  Classes
   that share two coordinates are chained to clusters, and inside a cluster pairs of different
   components with enough collisions are compared, in blocks; only links come out.

A value is the whole minimum, so lists hold classes that share a shingle, however many documents there are.
All links are confirmed on full sets.  A link of similarity 0.75 is missed with a probability of about 3e-6
(fewer than two collisions in 12, or fewer than 5 in 20 coordinates), more similar ones far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import words as W
from .common import apart, by_bytes, cut, texts

COORDINATES, MATCHES, PREFIX, COLLISIONS, LEADER_COLLISIONS = 20, 5, 12, 2, 6
SIMILARITY = 75
#: Members of a cluster that one task compares with as many others.
BLOCK = 512
_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        values, first = W.shingles(W.split(texts(batch.column("text")), lower=True))
        n = np.diff(first)
        some = n > 0
        at = first[:-1][some]
        signature = np.zeros((batch.num_rows, COORDINATES), dtype=np.uint64)
        a = np.zeros(batch.num_rows, dtype=np.uint64)
        b = np.zeros(batch.num_rows, dtype=np.uint64)
        if some.any():
            for j in range(COORDINATES):
                signature[some, j] = np.minimum.reduceat(values * _ODD[j] + _ODD[-1 - j], at)
            # The coordinate goes into the value, so that one number stands for the pair of both.
            signature[some] = W.mix(signature[some] + np.arange(COORDINATES, dtype=np.uint64) * _ODD[0])
            a[some] = np.add.reduceat(values, at)
            b[some] = np.add.reduceat(W.mix(values ^ _ODD[0]), at)
        flat = pa.array(signature.reshape(-1).view(np.int64))
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * COORDINATES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(offsets, flat)],
            names=["doc_id", "n", "a", "b", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full shingle sets, as sorted 64-bit values."""
    for batch in by_bytes(batches, "text"):
        values, first = W.shingles(W.split(texts(batch.column("text")), lower=True))
        data = values.astype("<u8").tobytes()
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "members": pa.array([data[8 * i : 8 * j] for i, j in zip(first[:-1], first[1:])], pa.binary())})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "members"):
        sets = batch.column("members").to_pylist()
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"id": np.repeat(ids, [len(s) // 8 for s in sets]), "shingle": np.frombuffer(b"".join(sets), dtype="<i8")})


def _confirm(similarity: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "left_set"):
            keep = []
            for x, y in zip(batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist()):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (src, dst) that are similar enough on full sets."""
    both = pairs.join(sets.select(F.col("id").alias("src"), F.col("members").alias("left_set")), "src").join(
        sets.select(F.col("id").alias("dst"), F.col("members").alias("right_set")), "dst"
    )
    return both.select("src", "dst", "left_set", "right_set").mapInArrow(_confirm(similarity), "src long, dst long")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, number of shingles, two sums that identify the shingle set, and the signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signatures, "doc_id long, n long, a long, b long, signature array<long>"
    )


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * intersection >= similarity * union``.

    Words are lower-cased (A-Z) runs of non-space bytes, a set holds the distinct 5-word shingles, or the
    whole sequence of a shorter text.  Null and empty texts have empty sets and are linked with nothing.
    Rows that repeat a doc_id are linked each by its own text; a null doc_id takes no part and keeps a null
    component.  An empty table gives no rows; columns other than doc_id and text are ignored.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and
    kept (doc_id = component_id).
    """
    signed = cut(signatures(docs))
    whole = ["n", "a", "b"]
    classes = cut(signed.where("n > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    posted = classes.select("id", F.explode("signature").alias("post"))
    shared = posted.groupBy("post").agg(F.count("*").alias("length")).where("length > 1")
    hits = apart(posted, "post").join(apart(shared, "post"), "post_")
    able = hits.groupBy("id").agg(F.count("*").alias("matches"), F.sum("length").alias("weight")).where(F.col("matches") >= MATCHES)
    able = cut(able.select("id", "weight"))
    prefix = F.slice("signature", 1, PREFIX)
    lists = cut(classes.join(able, "id").select("id", "n", "weight", prefix.alias("prefix"))).withColumn("post", F.explode("prefix"))
    leaders = lists.groupBy("post").agg(F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("lead"), F.count("*").alias("size")).where("size > 1")
    pairs = apart(lists, "post").join(apart(leaders, "post"), "post_").select(F.col("id").alias("src"), (-F.col("lead.back")).alias("dst")).where("src <> dst")
    pairs = pairs.groupBy("src", "dst").count().where(F.col("count") >= LEADER_COLLISIONS).select("src", "dst")
    # Both directions of a pair may come up; confirming it twice costs less than another shuffle.
    sets = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(able.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "id long, members binary"))
    links = cut(_confirmed(pairs, sets, similarity))
    found = connected_components(links, cut=cut)
    more = cut(_across(lists, found, sets, similarity))
    found = connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more), cut=cut)
    named = classes.join(found, F.col("id") == F.col("node"), "left").select(*whole, F.coalesce("component", "id").alias("component"))
    rows = signed.join(named, whole, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _across(lists: DataFrame, found: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between different components.

    Members of mixed lists keep only if enough of their shingles occur in another member at all.  The rest are
    chained to clusters by the pairs of coordinates that they share, and a cluster is compared in blocks of
    about BLOCK members with BLOCK others, each inside one task; only links come out.
    """
    lists = lists.join(found, F.col("id") == F.col("node"), "left").select("id", "n", "prefix", "post", F.coalesce("component", "id").alias("component"))
    mixed = lists.groupBy("post").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("post")
    rows = apart(lists, "post").join(apart(mixed, "post"), "post_", "left_semi")
    rows = rows.groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.first("prefix").alias("prefix"), F.sort_array(F.collect_list(F.bitwise_not("post_"))).alias("posts"))
    rows = cut(rows.where(F.size("posts") >= COLLISIONS))
    members = sets.join(rows.select("id"), "id", "left_semi").mapInArrow(_members, "id long, shingle long")
    own = members.groupBy("shingle").agg(F.count("*").alias("owners"), F.min("id").alias("id")).where("owners = 1").groupBy("id").agg(F.count("*").alias("own"))
    rows = rows.join(own, "id", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).where(100 * F.col("common") >= similarity * F.col("n"))
    rows = cut(rows.select("id", "n", "component", "common", "prefix", "posts"))
    # One row for every two posts of a class, at most PREFIX * (PREFIX - 1) / 2.
    twos = F.transform("posts", lambda x, i: F.transform(F.slice("posts", i + 2, PREFIX), lambda y: F.xxhash64(x, y)))
    twos = rows.select("id", F.explode(F.flatten(twos)).alias("two"))
    heads = twos.groupBy("two").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("two", "head")
    chained = apart(twos, "two").join(apart(heads, "two"), "two_").where("id <> head")
    clusters = connected_components(chained, "id", "head", cut=cut)
    rows = rows.join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id").drop("posts")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = rows.join(sizes.select("cluster", F.ceil(F.col("size") / BLOCK).alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n", "component", "common", "prefix", "members")
    return rows.groupBy("cluster", "low", "high").applyInArrow(_compare(similarity), "src long, dst long")


def _compare(similarity: int):
    def compare(table: pa.Table) -> pa.Table:
        n, common, component, block = (table.column(c).to_numpy() for c in ("n", "common", "component", "block"))
        prefix = np.array(table.column("prefix").to_pylist(), dtype=np.int64).reshape(-1, PREFIX)
        sets = [np.frombuffer(x, dtype="<u8") for x in table.column("members").to_pylist()]
        ids, parent, links = table.column("id").to_numpy(), {}, []

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        within = block.min() == block.max()
        for i in range(len(n)):
            others = np.arange(i + 1, len(n)) if within else np.flatnonzero(block != block[i])
            if not within and block[i] != block.min():
                continue
            most = np.minimum(common[i], common[others])
            others = others[(component[others] != component[i]) & (100 * most >= similarity * (n[i] + n[others] - most))]
            hits = (prefix[others] == prefix[i]).sum(axis=1)
            others = others[hits >= COLLISIONS][np.argsort(-hits[hits >= COLLISIONS], kind="stable")]
            for j in others:
                a, b = root(component[i]), root(component[j])
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= similarity * (n[i] + n[j] - both):
                        parent[a] = b
                        links.append((ids[i], ids[j]))
        found = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"src": found[:, 0], "dst": found[:, 1]})

    return compare
