"""Evidence carried from source lines to target lines: conflicts and aggregation laws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAWS = ("extensive", "intensive", "maximum", "minimum", "share")


def conflicts(observations: DataFrame) -> DataFrame:
    """Sources whose observations repeat an id or contradict each other in value or category.

    ``observations``: source_id, observation_id, value, category.
    """
    grouped = observations.groupBy("source_id").agg(
        F.count("*").alias("n_observations"),
        F.countDistinct("observation_id").alias("ids"),
        F.countDistinct(F.struct("value", "category")).alias("n_values"),
    )
    reason = F.when(F.col("ids") < F.col("n_observations"), "duplicate-observation-id").when(F.col("n_values") > 1, "contradictory-observations")
    return grouped.withColumn("reason", reason).where("reason is not null").select("source_id", "n_observations", "n_values", "reason")


def aggregate(matches: DataFrame, observations: DataFrame, law: str, category: str | None = None) -> DataFrame:
    """Value of each target from the sources matched to it, by one law.

    ``matches``: source_id, target_id, shared_mm, target_mm, state; only accepted ones count.  A target with a
    conflicting source has no value, one without observations is kept as no-data.  Products are summed
    as decimals, so the order of rows does not matter.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law}")
    accepted = matches.where("state = 'accepted'")
    # Agreeing observations of one source are one contribution.  Both groupings and the join go by source, so observations are shuffled once.
    same = F.struct("value", "category")
    each = observations.repartition("source_id").groupBy("source_id", "observation_id").agg(F.count("*").alias("n"), F.min(same).alias("low"), F.max(same).alias("high"))
    twice = F.max((F.col("n") > 1) | F.col("observation_id").isNull())
    per_source = each.groupBy("source_id").agg(
        F.sum("n").alias("n"), F.min_by("low", "observation_id").alias("first"), (twice | ~F.min("low").eqNullSafe(F.max("high"))).alias("conflicting")
    )
    rows = accepted.join(per_source.select("source_id", "n", "first.value", "first.category", "conflicting"), "source_id", "left")
    bad_row, seen = F.coalesce("conflicting", F.lit(False)), F.col("n").isNotNull()
    value, shared = F.col("value").cast("decimal(18,4)"), F.col("shared_mm").cast("decimal(15,0)")
    grouped = rows.groupBy("target_id").agg(
        F.max(bad_row).alias("conflicting"),
        F.count_if(seen).alias("seen"),
        F.max("target_mm").alias("target_length"),
        F.sum("shared_mm").alias("all_shared"),
        F.sum(F.when(seen, F.col("shared_mm"))).alias("seen_shared"),
        F.sum("n").alias("seen_n"),
        F.sum(F.when(bad_row, F.col("n"))).alias("bad_n"),
        F.count_if(bad_row).alias("bad_sources"),
        F.sum(value * shared).alias("weighted"),
        F.max("value").alias("largest"),
        F.min("value").alias("smallest"),
        F.sum(F.when(F.col("category") == F.lit(category), F.col("shared_mm"))).alias("of_category"),
    )
    result = {
        "extensive": F.col("weighted").cast("double") / F.col("target_length"),
        "intensive": F.col("weighted").cast("double") / F.col("seen_shared"),
        "maximum": F.col("largest").cast("double"),
        "minimum": F.col("smallest").cast("double"),
        "share": F.coalesce("of_category", F.lit(0)).cast("double") / F.col("target_length"),
    }[law]
    state = F.when(F.col("conflicting"), "conflicting").when(F.col("seen") == 0, "no-data").otherwise("available")
    pick = lambda a, b: F.when(F.col("conflicting"), a).otherwise(F.coalesce(b, F.lit(0)))
    return grouped.withColumn("state", state).select(
        "target_id", "state", F.when(F.col("state") == "available", F.round(result, 6)).alias("value"),
        pick(F.col("bad_n"), F.col("seen_n")).cast("long").alias("n_observations"),
        pick(F.col("bad_sources"), F.col("seen")).cast("long").alias("n_sources"),
        pick(F.col("all_shared"), F.col("seen_shared")).cast("long").alias("shared_length"),
        "target_length",
        F.when(F.col("conflicting"), "conflicting-source-observations").when(F.col("seen") == 0, "no-observations").otherwise(f"aggregated-{law}").alias("reason"),
    )
