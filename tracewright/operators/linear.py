"""Linear referencing: samples, sections and intervals along lines.

Rows are keyed by line; windows are partitioned by it, so every line is handled by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import gradient_band
from .components import checkpointed


def gradients(samples: DataFrame) -> DataFrame:
    """Gradient of each pair of neighbouring samples.  ``samples``: line_id, at_m, height_mm; one sample at each place."""
    order = Window.partitionBy("line_id").orderBy("at_m")
    rows = samples.select("line_id", F.lag("at_m").over(order).alias("start_m"), F.col("at_m").alias("end_m"), (F.col("height_mm") - F.lag("height_mm").over(order)).alias("rise_mm"))
    rows = rows.where("start_m is not null").withColumn("length_m", F.col("end_m") - F.col("start_m")).withColumn("gradient_pct", F.col("rise_mm") / (F.col("length_m") * 10))
    direction = F.when(F.col("rise_mm") > 0, "forward").when(F.col("rise_mm") < 0, "reverse").otherwise("level")
    return rows.withColumn("band", gradient_band(F.col("gradient_pct"))).withColumn("direction", direction)


def profile(sections: DataFrame) -> DataFrame:
    """Ascent and descent of each line, forwards; backwards they change places."""
    return sections.groupBy("line_id").agg(
        F.sum(F.greatest("rise_mm", F.lit(0))).alias("ascent_mm"), F.sum(F.greatest(-F.col("rise_mm"), F.lit(0))).alias("descent_mm"), F.max(F.abs("gradient_pct")).alias("steepest_pct"), F.sum("length_m").alias("length_m")
    )


def islands(rows: DataFrame, by: Sequence[str], order: str, same: Sequence[str], breaks: Column | None = None) -> DataFrame:
    """``rows`` with ``island``: the number of the run of neighbours that agree in ``same``; ``breaks`` starts one more."""
    w = Window.partitionBy(*by).orderBy(order)
    differs = F.lag(F.lit(1)).over(w).isNull()
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if breaks is not None:
        differs = differs | breaks
    return rows.withColumn("starts_", differs.cast("int")).withColumn("island", F.sum("starts_").over(w)).drop("starts_")


def merge_sections(sections: DataFrame) -> DataFrame:
    """Neighbouring sections of one band and direction as one, with the gradient over its whole length."""
    rows = islands(sections, ["line_id"], "start_m", ["band", "direction"])
    return rows.groupBy("line_id", "island", "band", "direction").agg(
        F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.sum("length_m").alias("length_m"),
        (F.sum("rise_mm") / (F.sum("length_m") * 10)).alias("gradient_pct"), F.max(F.abs("gradient_pct")).alias("steepest_pct"), F.count("*").alias("n_sections"),
    ).drop("island")


def interpolate(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Heights at target places: clamped at the ends, exact at a sample, linear between.

    ``targets``: line_id, target_m.  Samples and targets are laid in one order, and each target looks at the last sample
    before and the first after it; no target meets all samples.  Lines without samples give null.
    """
    s = samples.select("line_id", F.col("at_m").cast("double").alias("at"), F.struct(F.col("at_m").cast("double").alias("at"), F.col("height_mm").cast("double").alias("height")).alias("sample"), F.lit(None).cast("double").alias("target_m"))
    t = targets.select("line_id", F.col("target_m").cast("double").alias("at"), F.lit(None).cast(s.schema["sample"].dataType).alias("sample"), F.col("target_m").cast("double").alias("target_m"))
    order = Window.partitionBy("line_id").orderBy("at", F.col("sample").isNull())
    back = Window.partitionBy("line_id").orderBy(F.desc("at"), F.col("sample").isNull())
    rows = s.union(t).withColumn("l", F.last("sample", ignorenulls=True).over(order)).withColumn("r", F.last("sample", ignorenulls=True).over(back)).where("target_m is not null")
    left, right = F.coalesce("l", "r"), F.coalesce("r", "l")
    rows = rows.select("line_id", "target_m", left.alias("l"), right.alias("r"))
    slope = (F.col("r.height") - F.col("l.height")) * ((F.col("target_m") - F.col("l.at")) / (F.col("r.at") - F.col("l.at")))
    height = F.when(F.col("l.at") >= F.col("r.at"), F.col("l.height")).when(F.col("target_m") <= F.col("l.at"), F.col("l.height")).otherwise(F.col("l.height") + slope)
    return rows.select("line_id", "target_m", height.alias("height_mm"))


def rolling_gradients(samples: DataFrame, windows_m: Sequence[int] = (20, 50), step_m: int = 10, max_spacing_m: float = 12.5) -> DataFrame:
    """Gradients over windows that start every ``step_m``, of lines whose samples are dense enough; samples begin at 0."""
    order = Window.partitionBy("line_id").orderBy("at_m")
    spaced = samples.withColumn("gap", F.col("at_m") - F.coalesce(F.lag("at_m").over(order), F.lit(0)))
    lines = spaced.groupBy("line_id").agg(F.floor(F.max("at_m")).cast("long").alias("end"), F.max("gap").alias("gap")).where(F.col("gap") <= max_spacing_m + 1e-6)
    starts = lines.withColumn("window_m", F.explode(F.array(*[F.lit(w) for w in windows_m]))).where("end >= window_m")
    starts = starts.select("line_id", "window_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("window_m"), F.lit(step_m).cast("long"))).alias("start_m"))
    starts = starts.withColumn("end_m", F.col("start_m") + F.col("window_m"))
    places = starts.select("line_id", F.explode(F.array("start_m", "end_m")).alias("target_m")).distinct()
    heights = interpolate(samples, places)
    for side in ("start", "end"):
        h = heights.select("line_id", F.col("target_m").cast("long").alias(f"{side}_m"), F.col("height_mm").alias(f"{side}_mm"))
        starts = starts.join(h, ["line_id", f"{side}_m"])
    pct = (F.col("end_mm") - F.col("start_mm")) / (F.col("window_m") * 10)
    return starts.select("line_id", "window_m", "start_m", "end_m", pct.alias("gradient_pct"), gradient_band(pct).alias("band"))


def fill_scopes(lines: DataFrame, spans: DataFrame, default: str) -> DataFrame:
    """Spans of each line with the stretches between them filled by ``default``.

    ``lines``: line_id, length_m.  ``spans``: line_id, start_m, end_m, scope, without overlaps.
    """
    w = Window.partitionBy("line_id").orderBy("start_m")
    rows = spans.join(lines, "line_id")
    before = rows.select("line_id", F.coalesce(F.lag("end_m").over(w), F.lit(0)).alias("start_m"), F.col("start_m").alias("end_m"), F.lit(default).alias("scope"))
    after = lines.join(spans.groupBy("line_id").agg(F.max("end_m").alias("last")), "line_id", "left").select("line_id", F.coalesce("last", F.lit(0)).alias("start_m"), F.col("length_m").alias("end_m"), F.lit(default).alias("scope"))
    return rows.select("line_id", "start_m", "end_m", "scope").unionByName(before).unionByName(after).where("start_m < end_m")


def merge_intervals(intervals: DataFrame, by: Sequence[str], start: str = "start_at", end: str = "end_at", touch: float = 1e-9) -> DataFrame:
    """Intervals that overlap or touch as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("starts_", F.coalesce((F.col(start) > reach + touch).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("starts_").over(w))
    return rows.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("island")


def sections(ranges: DataFrame, length_m: int = 100) -> DataFrame:
    """Sections of ``length_m`` along each range, begun anew at each range; the last may be shorter.

    ``ranges``: line_id, start_m, end_m, scope.
    """
    rows = ranges.where("start_m < end_m").withColumn("from_m", F.explode(F.sequence(F.col("start_m").cast("long"), F.col("end_m").cast("long") - 1, F.lit(length_m).cast("long"))))
    rows = rows.withColumn("to_m", F.least(F.col("from_m") + length_m, F.col("end_m").cast("long")))
    order = Window.partitionBy("line_id").orderBy("from_m")
    return rows.select("line_id", (F.row_number().over(order) - 1).cast("long").alias("section"), F.col("from_m").alias("start_m"), F.col("to_m").alias("end_m"), "scope")


def material_runs(sections_: DataFrame, pairs: DataFrame, absolute: float, relative_pct: float, persistence_m: float) -> DataFrame:
    """Runs of sections of one line that hold materially more residents than the nearest section of another.

    ``sections_``: line_id, section, start_m, end_m, residents.  ``pairs``: line_id, other_id.  Nearest is by the fraction of the
    line at the section's middle, ties to the earlier section.
    """
    length = Window.partitionBy("line_id")
    rows = sections_.withColumn("middle", (F.col("start_m") + F.col("end_m")) / 2 / F.max("end_m").over(length))
    mine = rows.join(pairs, "line_id")
    other = rows.select(F.col("line_id").alias("other_id"), F.col("section").alias("other_section"), F.col("middle").alias("other_middle"), F.col("residents").alias("other_residents"))
    # As-of from both sides: only the neighbours of a middle can be nearest.
    key = ["line_id", "other_id"]
    side = mine.select(*key, "middle", F.lit(None).cast("struct<m:double,s:bigint,r:bigint>").alias("o"), F.struct("section", "start_m", "end_m", "residents").alias("own"))
    there = pairs.join(other, "other_id").select(*key, F.col("other_middle").alias("middle"), F.struct(F.col("other_middle").alias("m"), F.col("other_section").cast("long").alias("s"), F.col("other_residents").cast("long").alias("r")).alias("o"), F.lit(None).cast(side.schema["own"].dataType).alias("own"))
    up = Window.partitionBy(*key).orderBy("middle", F.col("o").isNull())
    down = Window.partitionBy(*key).orderBy(F.desc("middle"), F.col("o").isNull())
    near = side.union(there).withColumn("l", F.last("o", ignorenulls=True).over(up)).withColumn("r", F.last("o", ignorenulls=True).over(down)).where("own is not null")
    left, right = F.col("middle") - F.col("l.m"), F.col("r.m") - F.col("middle")
    chosen = F.when(F.col("r").isNull() | (left < right) | ((left == right) & (F.col("l.s") <= F.col("r.s"))), F.col("l.r")).otherwise(F.col("r.r"))
    chosen = F.when(F.col("l").isNull(), F.col("r.r")).otherwise(chosen)
    rows = near.select(*key, "own.*", chosen.alias("compared"))
    gain = F.col("residents") - F.col("compared")
    relative = F.when(F.col("compared") > 0, gain * 100.0 / F.col("compared")).when(F.col("residents") > 0, 1e6).otherwise(0.0)
    rows = rows.withColumn("gain", gain).withColumn("relative", relative).withColumn("material", (F.col("gain") >= absolute) & (F.col("relative") >= relative_pct))
    w = Window.partitionBy(*key).orderBy("start_m")
    rows = islands(rows, key, "start_m", ["material"], F.abs(F.col("start_m") - F.lag("end_m").over(w)) > 0.001).where("material")
    runs = rows.groupBy(*key, "island").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.sum(F.col("end_m") - F.col("start_m")).alias("length_m"), F.min("gain").alias("min_gain"), F.min("relative").alias("min_relative"), F.count("*").alias("n_sections"))
    return runs.where(F.col("length_m") + 1e-9 >= persistence_m).drop("island")


def sustained(samples: DataFrame, spacing_m: float) -> DataFrame:
    """Samples at least ``spacing_m`` apart, first and last included: a fold over each line's sorted samples."""
    line = samples.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct(F.col("at_m").cast("double").alias("at_m"), F.col("height_mm").cast("double").alias("height_mm")))).alias("s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    inner = F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0)))
    kept = F.aggregate(inner, F.array(first), lambda acc, x: F.when(x["at_m"] - F.element_at(acc, -1)["at_m"] >= spacing_m, F.concat(acc, F.array(x))).otherwise(acc))
    tail = F.when((last["at_m"] - F.element_at("kept", -1)["at_m"] < spacing_m) & (F.size("kept") > 1), F.concat(F.slice("kept", F.lit(1), F.size("kept") - 1), F.array(last))).otherwise(F.concat("kept", F.array(last)))
    short = last["at_m"] - first["at_m"] <= spacing_m
    rows = line.withColumn("kept", kept).withColumn("out", F.when(short, F.array(first, last)).otherwise(tail))
    return rows.select("line_id", F.explode("out").alias("o")).select("line_id", "o.*")


#: Samples of wide stretches that one task folds at a time, about.
FOLDED = 100_000


def collapse(samples: DataFrame, minimum_spacing_m: float) -> DataFrame:
    """Near-duplicate samples as their median, and lone anomalies of such clusters flattened.

    A cluster starts at its first sample and takes what lies within the tolerance of it.  It cannot span a gap above the
    tolerance, so each stretch between such gaps is told by itself; one no longer than the tolerance is one cluster, and only longer ones are folded
    sample by sample, many of them in one task.
    """
    tolerance = min(0.5, minimum_spacing_m / 20)
    kind = dict(samples.dtypes)["line_id"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_id", "stretch", "at_m", "height_mm"], ignore_index=True)
        fresh = ((pdf["line_id"] != pdf["line_id"].shift()) | (pdf["stretch"] != pdf["stretch"].shift())).to_numpy()
        ids, number, start = [], -1, None
        for x, new in zip(pdf["at_m"].to_numpy(), fresh):
            if new or x - start > tolerance:
                number, start = number + 1, x
            ids.append(number)
        return pdf.groupby(pd.Series(ids, index=pdf.index)).agg(line_id=("line_id", "first"), at_m=("at_m", "median"), height_mm=("height_mm", "median"), n=("at_m", "size"))

    rows = samples.select("line_id", F.col("at_m").cast("double").alias("at_m"), F.col("height_mm").cast("double").alias("height_mm"))
    along = Window.partitionBy("line_id").orderBy("at_m")
    rows = rows.withColumn("new", F.coalesce(F.col("at_m") - F.lag("at_m").over(along) > tolerance, F.lit(True)).cast("int"))
    rows = rows.withColumn("stretch", F.sum("new").over(along)).drop("new")
    whole = Window.partitionBy("line_id", "stretch")
    rows = checkpointed(rows.withColumn("wide", F.coalesce(F.max("at_m").over(whole) - F.min("at_m").over(whole) > tolerance, F.lit(False))))
    narrow = rows.where("not wide").groupBy("line_id", "stretch").agg(F.percentile("at_m", 0.5).alias("at_m"), F.coalesce(F.percentile(F.when(~F.isnan("height_mm"), F.col("height_mm")), 0.5), F.max("height_mm")).alias("height_mm"), F.count("*").alias("n"))
    alone = narrow.select("line_id", "at_m", "height_mm", "n")
    wide = rows.where("wide").select("line_id", "stretch", "at_m", "height_mm")
    part = F.pmod(F.xxhash64("line_id", "stretch"), F.lit(1 + wide.count() // FOLDED))
    folded = wide.groupBy(part.alias("part")).applyInPandas(fold, f"line_id {kind}, at_m double, height_mm double, n long")
    before, after = (lambda c: F.lag(c).over(along)), (lambda c: F.lead(c).over(along))
    turn = (F.col("n") > 1) & ((F.col("height_mm") - before("height_mm")) * (after("height_mm") - F.col("height_mm")) < 0)
    span = after("at_m") - before("at_m")
    flat = before("height_mm") + (after("height_mm") - before("height_mm")) * (F.col("at_m") - before("at_m")) / span
    out = alone.union(folded)
    return out.withColumn("flat", F.when(turn & (span > 0), flat)).select("line_id", "at_m", F.coalesce("flat", "height_mm").alias("height_mm"), "n")
