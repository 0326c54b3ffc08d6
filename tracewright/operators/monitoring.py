"""As-of views over updates and observations, evidence coverage, conformance, audits and release differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_states(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last verified state for each key, with counts of unverified and contradicted updates.

    ``updates``: the keys, state, verification, observed_on, recorded_on, update_id.
    """
    order = F.struct("observed_on", "recorded_on", "update_id")
    verified = F.col("verification") == "verified"
    return updates.groupBy(*keys).agg(
        F.max_by(F.when(verified, F.col("state")), F.when(verified, order)).alias("effective_state"),
        F.max(F.when(verified, F.col("update_id"))).alias("last_verified_id"),
        F.count_if(F.col("verification") == "unverified").alias("n_unverified"),
        F.count_if(F.col("verification") == "contradicted").alias("n_contradicted"),
    )


def indicator_status(indicators: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """Target status of each indicator: contradictory, then unverified, then missing, not due, met or not met.

    ``indicators``: indicator_id, target_value, target_date, direction, frequency_days.  ``observations``: indicator_id,
    observation_id, value, kind, verification, period_end, recorded_on, due_on.
    """
    own = F.col("kind") == "monitoring"
    good = own & (F.col("verification") == "verified")
    grouped = observations.groupBy("indicator_id").agg(
        F.max_by(F.when(good, F.struct("observation_id", "value")), F.when(good, F.struct("period_end", "recorded_on", "observation_id"))).alias("latest"),
        F.max_by("due_on", F.struct("due_on", "recorded_on", "observation_id")).alias("last_due"),
        F.count_if(own & (F.col("verification") == "contradicted")).alias("n_contradicted"),
        F.count_if(own & (F.col("verification") == "unverified")).alias("n_unverified"),
        F.count_if(F.col("recorded_on") > F.col("due_on")).alias("n_late"),
    )
    rows = indicators.join(grouped, "indicator_id").withColumn("next_due_on", F.date_add("last_due", F.col("frequency_days").cast("int")))
    value = F.col("latest.value")
    met = F.when(F.col("direction") == "at-least", value >= F.col("target_value")).otherwise(value <= F.col("target_value"))
    status = (
        F.when(F.col("n_contradicted") > 0, "contradictory-data")
        .when((F.col("n_unverified") > 0) & F.col("latest").isNull(), "unverified-data")
        .when(as_of > F.col("next_due_on"), "missing-data")
        .when(F.col("latest").isNull(), F.when(as_of < F.col("target_date"), "not-due").otherwise("missing-data"))
        .otherwise(F.when(met, "met").otherwise("not-met"))
    )
    return rows.select("indicator_id", status.alias("target_status"), F.col("latest.observation_id").alias("latest_observation_id"), "next_due_on", "n_late", "n_unverified", "n_contradicted")


#: Issues in the order in which they are listed.
ISSUES = ("missing", "non-reproducible", "stale", "low-quality", "spatially-incomplete", "licence-restricted")


def evidence_coverage(requirements: DataFrame, items: DataFrame, reference_date: Column) -> DataFrame:
    """What the items of each family lack against its requirement.

    ``requirements``: family, max_age_days, min_quality, required_units (array), required_use.  ``items``: family, available,
    has_artifact, observed_to, quality (higher is better), units (array), uses (array), licence.
    """
    ok = F.col("available")
    grouped = items.groupBy("family").agg(
        F.count("*").alias("n_items"),
        F.count_if(ok).alias("n_available"),
        F.count_if("has_artifact").alias("n_artifacts"),
        F.max(F.when(ok, F.col("observed_to"))).alias("freshest"),
        F.max(F.when(ok, F.col("quality"))).alias("best_quality"),
        F.array_distinct(F.flatten(F.collect_set(F.when(ok, F.col("units"))))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_set(F.when(ok, F.col("uses"))))).alias("uses"),
    )
    rows = requirements.join(grouped, "family", "left")
    n = F.coalesce("n_available", F.lit(0))
    lacking = F.sort_array(F.array_except("required_units", F.coalesce("covered", F.array().cast("array<string>"))))
    tests = (
        n == 0,
        (F.col("n_items") > 0) & (F.col("n_artifacts") == 0),
        F.datediff(reference_date, F.col("freshest")) > F.col("max_age_days"),
        F.col("best_quality") < F.col("min_quality"),
        (n > 0) & (F.size("lacking") > 0),
        (n > 0) & ~F.array_contains("uses", F.col("required_use")),
    )
    issues = F.array_compact(F.array(*[F.when(t, name) for name, t in zip(ISSUES, tests)]))
    return rows.withColumn("lacking", lacking).select("family", n.alias("n_available"), "freshest", "best_quality", F.array_join("lacking", ",").alias("missing_units"), F.array_join(issues, ",").alias("issues"))


def conformance(requirements: DataFrame, assessments: DataFrame) -> DataFrame:
    """Every requirement with its state; without an assessment it is unresolved."""
    rows = requirements.join(assessments, "requirement_id", "left")
    state = F.coalesce("state", F.lit("not-assessed"))
    return rows.select("requirement_id", "mandatory", state.alias("state"), (F.col("mandatory") & ~state.isin("met", "not-applicable")).alias("unresolved"))


def compile_audit(subjects: DataFrame, requirements: DataFrame, observations: DataFrame) -> DataFrame:
    """Each subject against each requirement of its kind: observed, or unknown with an evidence request.

    ``subjects``: subject_id, kind.  ``requirements``: kind, requirement_id.  ``observations``: subject_id, requirement_id, outcome.
    """
    rows = subjects.join(requirements, "kind").join(observations, ["subject_id", "requirement_id"], "left")
    outcome = F.coalesce("outcome", F.lit("unknown"))
    disposition = F.when(outcome == "unknown", "evidence-request").when(outcome == "fail", "deficiency").otherwise("none")
    return rows.select("subject_id", "requirement_id", outcome.alias("outcome"), disposition.alias("disposition"))


def release_diff(before: DataFrame, after: DataFrame, key: str, geometry: str, attributes: str) -> DataFrame:
    """Keys added, removed or changed between two releases; ``geometry`` and ``attributes`` are fingerprints."""
    b = before.select(F.col(key).alias("key"), F.col(geometry).alias("g0"), F.col(attributes).alias("a0"), F.lit(True).alias("old"))
    a = after.select(F.col(key).alias("key"), F.col(geometry).alias("g1"), F.col(attributes).alias("a1"), F.lit(True).alias("new"))
    rows = b.join(a, "key", "full")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(~F.col("g0").eqNullSafe(F.col("g1")), "geometry-changed").when(~F.col("a0").eqNullSafe(F.col("a1")), "attributes-changed").otherwise("unchanged")
    )
    return rows.select(F.col("key").alias(key), change.alias("change"))
