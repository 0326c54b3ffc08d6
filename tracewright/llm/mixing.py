"""Mixing sources to target weights with exact budgets.

Each source's documents get hash-random keys and are range-sorted by them; the key's leading digits
are the ranges.  Token sums of the ranges give distributed prefix sums, and each source is cut at
its exact budget.  A budget above the source's size repeats whole epochs first.  A range holds at
most 1/4096 of its source, so a hot source is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS, RANGE_DIGITS = 1.5, 2, 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of each source from (source, source_size): ``share`` of all sizes, split by weight.

    Sources in code point order, null last, take the weights in turn.  No target exceeds ``most``
    times its source's size; the excess is shared again by weight until none is above.  That is
    the level L at which the targets least(cap, L * weight) use up the budget: sources in order of
    cap / weight fill up first.  One row per source, so the windows here hold few rows.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("filled", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return rows.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: str = "") -> DataFrame:
    """How many words of each document the mix takes.

    A document's size is its number of words (0 for a null text).  The random key is the MD5 of
    ``seed`` and the doc_id, so reruns agree; rows of one doc_id (or of none: null doc_ids share one key) come in the
    order of a hash of their texts, equal rows in any order.  A null source is a source of its
    own.  An empty table gives no rows; columns other than doc_id, text and source are ignored.
    Returns doc_id, size, source_size, target and taken, and beside them source, the key and text_hash.
    """
    digits = RANGE_DIGITS
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    ).withColumn("range", F.substring("key", 1, digits))
    # Words are counted once; the ranges' sums and the cuts read the counts.
    base = cut(base)
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = offsets.alias("o").join(targets.alias("t"), same(offsets, targets)).select(
        F.col("o.source").alias("of"), F.col("o.range").alias("at"), "offset", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("epochs", whole).withColumn("taken", F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least("size", rest - F.col("offset") - F.col("ahead"))))
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "key", "text_hash")


def oracle(weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> str:
    """DuckDB SQL for ``mix`` over ``documents``."""
    ladder = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return rf"""
    with base as (select doc_id, source, md5(cast(doc_id as varchar)) as key,
             cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
    sizes as (select source, cast(sum(size) as bigint) as source_size,
             row_number() over (order by source is null, source) as turn from base group by source),
    capped as (select *, cast(source_size * {most} as double) as cap, case (turn - 1) % {len(weights)} {ladder} end as weight from sizes),
    filling as (select *, coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0.0) as filled,
             sum(weight) over (order by cap / weight, turn rows between current row and unbounded following) as remaining,
             cast(sum(source_size) over () as bigint) * cast({share} as double) as budget from capped),
    levels as (select *, (budget - filled) / remaining as level from filling),
    found as (select *, max(case when level <= cap / weight then level end) over () as found_level from levels),
    targets as (select source, source_size, case when found_level is null then cap else least(cap, found_level * weight) end as target from found),
    walk as (select b.*, t.source_size, t.target, cast(round(t.target) as bigint) as want,
             cast(sum(size) over (partition by b.source order by key, doc_id rows unbounded preceding) as bigint) - size as ahead
             from base b join targets t on b.source is not distinct from t.source),
    cutting as (select *, case when source_size > 0 then want // source_size else 0 end as epochs from walk)
    select doc_id, size, source_size, target,
           cast(size * epochs + greatest(0, least(size, want - epochs * source_size - ahead)) as bigint) as taken, source, key
    from cutting"""
