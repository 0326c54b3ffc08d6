"""Prioritisation: scores, views, ranks with ties, sensitivity and phased schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Measure(NamedTuple):
    """``transform``: higher, lower or threshold."""

    name: str
    view: str
    transform: str
    minimum: float
    maximum: float
    weight: float


def transformed(measure: Measure, value):
    scaled = (value - measure.minimum) / (measure.maximum - measure.minimum)
    if measure.transform == "lower":
        return 1 - scaled
    if measure.transform == "threshold":
        return F.when(value >= measure.maximum, 1.0).when(value.isNotNull(), 0.0)
    return scaled


def scores(items: DataFrame, measures: Sequence[Measure], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Total and view scores of each item: weighted means of transformed measures.

    ``items``: intervention_id and one column for each measure.  An item that lacks any measure keeps its row and its
    view scores but has no total: missing is not zero.
    """
    weight = {m.name: (weights or {}).get(m.name, m.weight) for m in measures}
    part = {m.name: F.round(transformed(m, F.col(m.name)) * weight[m.name], 8) for m in measures}

    def mean(own: Sequence[Measure]):
        value = sum((F.coalesce(part[m.name], F.lit(0.0)) for m in own), F.lit(0.0))
        total = sum((F.when(F.col(m.name).isNotNull(), weight[m.name]).otherwise(0.0) for m in own), F.lit(0.0))
        return F.when(total > 0, F.round(value / total, 8))

    missing = F.array_compact(F.array(*[F.when(F.col(m.name).isNull(), m.name) for m in sorted(measures)]))
    views = sorted({m.view for m in measures})
    return items.select(
        *items.columns,
        F.when(F.size(missing) == 0, mean(measures)).alias("total"),
        F.array_join(missing, ",").alias("missing"),
        *[mean([m for m in measures if m.view == v]).alias(f"view_{v}") for v in views],
    )


#: Ranges that distinct totals are dealt to for ranking.
RANGES = 256


def ranked(scored: DataFrame) -> DataFrame:
    """Competition ranks (1, 1, 3) by total, and the peers that share a total; items without a total have no rank.

    The rank is the number of items with a higher total, plus one: those in higher ranges of totals, and those above in the same
    range, so that no task holds all totals.
    """
    totals = scored.where("total is not null").groupBy("total").agg(F.count("*").alias("peers"))
    cuts = totals.agg(F.percentile_approx("total", [i / RANGES for i in range(1, RANGES)], 10000)).first()[0] or []
    above = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    totals = totals.withColumn("range", F.size(F.filter(above, lambda c: F.col("total") < c)))
    # One row for each range; there are RANGES at most.
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    higher = totals.groupBy("range").agg(F.sum("peers").alias("inside")).select("range", F.coalesce(F.sum("inside").over(order), F.lit(0)).alias("higher"))
    own = Window.partitionBy("range").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    places = totals.join(higher, "range").withColumn("rank", (F.col("higher") + F.coalesce(F.sum("peers").over(own), F.lit(0)) + 1).cast("long"))
    places = places.select(F.col("total").alias("of"), "peers", "rank")
    return scored.join(places, F.col("total") == F.col("of"), "left").drop("of").withColumn("tied", F.coalesce(F.col("peers") - 1, F.lit(0)).cast("long")).drop("peers")


def rank_changes(base: DataFrame, other: DataFrame) -> DataFrame:
    """How a second run of scores moves each item."""
    b = base.select("intervention_id", F.col("total").alias("base_total"), F.col("rank").alias("base_rank"))
    o = other.select("intervention_id", F.col("total").alias("case_total"), F.col("rank").alias("case_rank"))
    joined = b.join(o, "intervention_id", "full")
    return joined.withColumn("rank_delta", F.col("case_rank") - F.col("base_rank")).withColumn("score_delta", F.round(F.col("case_total") - F.col("base_total"), 8))


#: Most items of one programme.
MOST_ITEMS = 1_000_000


def schedule(items: DataFrame, budgets: Sequence[float], programme: str = "programme_id") -> DataFrame:
    """First phase with room for each item, in rank order, within each programme.

    ``items``: programme, intervention_id, rank, upper_cost, depends_on (array), excludes (array).  An item goes at least one
    phase after those it depends on and not at all beside one that it excludes.  A dependency is visited before
    what needs it.  The fold is sequential within a programme, so a programme is one group; programmes run in parallel,
    and one of more than MOST_ITEMS items is refused.
    """
    large = items.where("rank is not null").groupBy(programme).count().where(F.col("count") > MOST_ITEMS).first()
    if large:
        raise ValueError(f"programme {large[0]} has {large[1]} items, more than {MOST_ITEMS}")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.intervention_id: r for r in pdf.sort_values(["rank", "intervention_id"]).itertuples(index=False)}
        order, seen = [], set()
        for start in rows:
            stack = [(start, False)]
            while stack:
                item, ready = stack.pop()
                if ready:
                    order.append(item)
                elif item not in seen:
                    seen.add(item)
                    stack.append((item, True))
                    stack += [(d, False) for d in reversed(list(rows[item].depends_on)) if d in rows and d not in seen]
        spent, phase = [0.0] * len(budgets), {}
        for item in order:
            r = rows[item]
            if pd.isna(r.upper_cost) or any(x in phase for x in r.excludes) or any(d not in phase for d in r.depends_on):
                continue
            for k in range(max((phase[d] + 1 for d in r.depends_on), default=0), len(budgets)):
                if spent[k] + r.upper_cost <= budgets[k]:
                    phase[item] = k
                    spent[k] += r.upper_cost
                    break
        return pd.DataFrame({programme: pdf[programme].iloc[0], "intervention_id": list(rows), "phase": pd.array([phase.get(i) for i in rows], dtype="Int64")})

    kinds = dict(items.dtypes)
    return items.where("rank is not null").groupBy(programme).applyInPandas(fold, f"{programme} {kinds[programme]}, intervention_id {kinds['intervention_id']}, phase long")
