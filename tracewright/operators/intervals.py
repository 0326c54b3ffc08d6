"""Sets of intervals along lines as one sweep, and the reuse of existing alignments told by it.

Every set operation counts, between neighbouring ends, how many intervals of each side cover the stretch.  A line's ends are put in order in one
sort; nothing meets anything in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretches(intervals: DataFrame, by: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Stretches between neighbouring ends on each line, with how many intervals of each kind cover them.

    ``intervals``: the ``by`` columns, start_m, end_m and what ``counts`` names: new columns by conditions on rows.  Intervals without a length or with a null
    end cover nothing, but part the line at their ends.
    """
    one = intervals.where("start_m is not null and end_m is not null and start_m <= end_m")
    ends = F.explode(F.array(F.struct(F.col("start_m").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_m").alias("at"), F.lit(-1).alias("d"))))
    rows = one.select(*by, *[F.coalesce(test, F.lit(False)).cast("int").alias(name) for name, test in counts.items()], ends.alias("e"))
    rows = rows.groupBy(*by, F.col("e.at").alias("at")).agg(*[F.sum(F.col(name) * F.col("e.d")).alias(name) for name in counts])
    order = Window.partitionBy(*by).orderBy("at")
    out = rows.select(*by, F.col("at").alias("start_m"), F.lead("at").over(order).alias("end_m"), *[F.sum(name).over(order).alias(name) for name in counts])
    return out.where("end_m is not null")


def runs(rows: DataFrame, by: Sequence[str], label: str | None = None) -> DataFrame:
    """Neighbouring stretches (of one ``label``) that touch, as one: by, label, start_m, end_m."""
    order = Window.partitionBy(*by).orderBy("start_m")
    apart = F.coalesce(F.col("start_m") > F.lag("end_m").over(order), F.lit(True))
    if label is not None:
        apart = apart | ~F.col(label).eqNullSafe(F.lag(label).over(order))
    parts = rows.withColumn("new_", apart.cast("int")).withColumn("run_", F.sum("new_").over(order))
    names = [*by, *([label] if label else [])]
    return parts.groupBy(*names, "run_").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m")).drop("run_")


def combine(left: DataFrame, right: DataFrame, by: Sequence[str], operation: str) -> DataFrame:
    """The union, intersection or difference of two sets of intervals on each line, merged: by, start_m, end_m."""
    both = left.select(*by, "start_m", "end_m", F.lit(True).alias("left_")).union(right.select(*by, "start_m", "end_m", F.lit(False)))
    rows = stretches(both, by, {"a_": F.col("left_"), "b_": ~F.col("left_")})
    keep = {"union": "a_ + b_ > 0", "intersection": "a_ > 0 and b_ > 0", "difference": "a_ > 0 and b_ = 0"}
    return runs(rows.where(keep[operation]), by)


def union(intervals: DataFrame, by: Sequence[str], least_m: float = 0.0) -> DataFrame:
    """Merged intervals of each line, without runs shorter than ``least_m``."""
    found = runs(stretches(intervals, by, {"n_": F.lit(True)}).where("n_ > 0"), by)
    return found.where(F.col("end_m") - F.col("start_m") >= least_m) if least_m > 0 else found


def reuse_transitions(lines: DataFrame, matches: DataFrame, least_m: float) -> DataFrame:
    """Each line cut wherever the evidence that covers it changes, with what the evidence says there.

    ``lines``: id, length_m.  ``matches``: id, evidence_id, start_m, end_m, recognised, reusable, declassified, delivered (booleans of the evidence).
    Runs of the union of all matches that are shorter than ``least_m`` do not count, and each evidence counts within the other runs alone.  Returns id,
    start_m, end_m, n_evidence, recognised, reusable, declassified (only where nothing recognised is), delivered.  A line without matches is one stretch.
    """
    inside = matches.join(lines.select("id", "length_m"), "id").withColumn("start_m", F.greatest("start_m", F.lit(0.0))).withColumn("end_m", F.least("end_m", "length_m")).drop("length_m")
    # One row an evidence and stretch: two matches of one evidence that overlap count once.
    merged = runs(stretches(inside, ["id", "evidence_id", "recognised", "reusable", "declassified", "delivered"], {"n_": F.lit(True)}).where("n_ > 0"), ["id", "evidence_id", "recognised", "reusable", "declassified", "delivered"])
    kept = union(merged, ["id"], least_m).withColumn("kind", F.lit("run"))
    whole = lines.select("id", F.lit(0.0).alias("start_m"), F.col("length_m").alias("end_m"), F.lit("line").alias("kind"))
    rows = merged.withColumn("kind", F.lit("evidence")).unionByName(kept, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True)
    flags = ("recognised", "reusable", "declassified", "delivered")
    is_evidence = F.col("kind") == "evidence"
    counted = stretches(rows, ["id"], {"runs": F.col("kind") == "run", "on": F.col("kind") == "line", "n": is_evidence, **{f"n_{c}": is_evidence & F.col(c) for c in flags}})
    good = F.col("runs") > 0
    out = counted.where("on > 0").select("id", "start_m", "end_m", F.when(good, F.col("n")).otherwise(F.lit(0)).alias("n_evidence"), *[(good & (F.col(f"n_{c}") > 0)).alias(c) for c in flags])
    out = out.withColumn("declassified", F.col("declassified") & ~F.col("recognised"))
    # Ends of what does not count part nothing.
    gaps = runs(out.where("n_evidence = 0"), ["id"]).select("id", "start_m", "end_m", F.lit(0).cast(out.schema["n_evidence"].dataType).alias("n_evidence"), *[F.lit(False).alias(c) for c in flags])
    return out.where("n_evidence > 0").union(gaps)


def longest(rows: DataFrame, by: str, test: Column) -> DataFrame:
    """(by, longest_m): the longest run of touching stretches that all pass ``test``."""
    found = runs(rows.where(test).select(by, "start_m", "end_m"), [by])
    return found.groupBy(by).agg(F.max(F.col("end_m") - F.col("start_m")).alias("longest_m"))


def reuse_advantage(lines: DataFrame, matches: DataFrame, least_m: float) -> DataFrame:
    """How much of each line existing alignments cover, by length, share and longest run; see ``reuse_transitions`` for the inputs.

    Returns id, length_m, matched_m, recognised_m, reusable_m, declassified_m, unknown_m, delivered_m, longest_m, longest_recognised_m,
    longest_reusable_m, matched_share, recognised_share, reusable_share and n_stretches.  A line without length has shares of 0.
    """
    cut = reuse_transitions(lines, matches, least_m)
    size = F.col("end_m") - F.col("start_m")
    tests = {"matched": F.col("n_evidence") > 0, "recognised": F.col("recognised"), "reusable": F.col("reusable"), "declassified": F.col("declassified"), "unknown": F.col("n_evidence") == 0, "delivered": F.col("delivered")}
    zero = F.lit(0.0)
    total = cut.groupBy("id").agg(F.count("*").alias("n_stretches"), *[F.coalesce(F.sum(F.when(t, size)), zero).alias(f"{name}_m") for name, t in tests.items()])
    out = lines.select("id", "length_m").join(total, "id", "left")
    for name, column in (("matched", "longest_m"), ("recognised", "longest_recognised_m"), ("reusable", "longest_reusable_m")):
        out = out.join(longest(cut, "id", tests[name]).withColumnRenamed("longest_m", column), "id", "left")
    filled = [F.coalesce(c, zero).alias(c) for c in (*[f"{n}_m" for n in tests], "longest_m", "longest_recognised_m", "longest_reusable_m")]
    out = out.select("id", "length_m", F.coalesce("n_stretches", F.lit(0).cast("long")).alias("n_stretches"), *filled)
    share = lambda c: F.when(F.col("length_m") > 0, F.col(f"{c}_m") / F.col("length_m")).otherwise(zero).alias(f"{c}_share")
    return out.select("*", share("matched"), share("recognised"), share("reusable"))
