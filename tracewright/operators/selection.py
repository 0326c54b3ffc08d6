"""Choosing among options: admission, cascades, displacement, route choice, traffic precedence, gates and accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band, freshness
from .components import checkpointed
from .spatial import within


def admit_diverse(candidates: DataFrame, by: str, class_order: Sequence[str], maximum: int) -> DataFrame:
    """At most ``maximum`` of each set: first the best of each class in class order, then the best of the rest.

    ``candidates``: the set, candidate_id, class, score, shape.  Of equal shapes only the best is considered.  Every candidate
    keeps its disposition.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in class_order]), F.col("class")), F.lit(0)).cast("int")
    place = F.when(place == 0, len(class_order) + 1).otherwise(place)
    best = [F.desc("score"), "candidate_id"]
    rows = candidates.withColumn("copy", F.row_number().over(Window.partitionBy(by, "shape").orderBy(*best)))
    single = rows.where("copy = 1").withColumn("in_class", F.row_number().over(Window.partitionBy(by, "class").orderBy(*best)))
    lead = F.when(F.col("in_class") == 1, place).otherwise(len(class_order) + 2)
    single = single.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(lead, *best)))
    picked = single.withColumn("disposition", F.when(F.col("place") > maximum, "over-maximum").when(F.col("in_class") == 1, "class-representative").otherwise("admitted"))
    names = [*candidates.columns, "disposition"]
    return picked.select(*names).union(rows.where("copy > 1").withColumn("disposition", F.lit("duplicate-shape")).select(*names))


def cascade(rows: DataFrame, by: str, gates: Column, criteria: Sequence[tuple[str, bool]], key: str) -> DataFrame:
    """The winner of each set: hard gates, then criteria in order (column, higher is better), then the key; missing values come last.

    One struct holds the order, so a set is reduced by a minimum and never sorted.
    """
    parts = []
    for i, (name, higher) in enumerate(criteria):
        value = F.col(name).cast("double")
        parts += [F.col(name).isNull().alias(f"m{i}"), (-value if higher else value).alias(f"v{i}")]
    order = F.struct(*parts, F.col(key).alias("k"))
    return rows.groupBy(by).agg(F.min(F.when(gates, order)).alias("w"), F.count_if(~gates).alias("n_gated"), F.count("*").alias("n_considered")).select(by, F.col("w.k").alias("winner"), "n_gated", "n_considered")


def detour_displacement(rows: DataFrame, by: str, ratio: float) -> DataFrame:
    """The best class wins unless it is more than ``ratio`` times as long as the shortest option, which then displaces it.

    ``rows``: the set, option_id, class_rank (1 is best), length.
    """
    best = F.min_by(F.struct("option_id", "length"), F.struct("class_rank", "length", "option_id"))
    short = F.min_by(F.struct("option_id", "length"), F.struct("length", "class_rank", "option_id"))
    out = rows.groupBy(by).agg(best.alias("best_"), short.alias("short_")).withColumn("displaced", F.col("best_.length") > F.col("short_.length") * ratio)
    return out.select(by, F.when(F.col("displaced"), F.col("short_.option_id")).otherwise(F.col("best_.option_id")).alias("winner"), F.col("best_.option_id").alias("preferred"), "displaced")


def choose_alignment(options: DataFrame) -> DataFrame:
    """Alignment by role: mostly A road and at most 1.5 times the direct length, else a cycle route or a quiet road at most 1.35 times, else direct.

    ``options``: pair_id, direct_m, strategic_m, a_road_share, ncn_m, quiet_m; a missing length rules the role out.
    """
    choice = (
        F.when((F.col("a_road_share") >= 0.8) & (F.col("strategic_m") <= 1.5 * F.col("direct_m")), "strategic")
        .when(F.col("ncn_m") <= 1.35 * F.col("direct_m"), "ncn").when(F.col("quiet_m") <= 1.35 * F.col("direct_m"), "low-traffic").otherwise("direct")
    )
    return options.select("pair_id", choice.alias("role"))


#: Tasks that one key's observations are dealt to.
PARTS = 32


def match_traffic(observations: DataFrame, targets: DataFrame, buffer: float) -> DataFrame:
    """Targets of each observation by the strongest relation that any target has to it: count point, else link identity, else nearness.

    ``observations``: observation_id, count_point, road, junction, x, y.  ``targets``: target_id, count_point, road, junction, x, y; a column ``at`` stands for
    places along one line instead.  Link identity:
    every field known on both sides agrees without regard to case, and one at least is known on both.  Nearness is distance in the plane, up to
    ``buffer``.  Only observations that a stronger relation left over meet the next one.  Several targets are ambiguous; none leaves the
    observation unmatched.
    """
    observations, targets = (df.withColumn("x", F.col("at").cast("double")).withColumn("y", F.lit(0.0)) if "x" not in df.columns else df for df in (observations, targets))
    fold = lambda df: df.withColumn("road", F.lower(F.trim("road"))).withColumn("junction", F.lower(F.trim("junction")))
    left, t = fold(observations), fold(targets).select("target_id", *[F.col(c).alias(f"t_{c}") for c in ("count_point", "road", "junction")])
    agree = lambda c: F.col(c).isNull() | F.col(f"t_{c}").isNull() | (F.col(c) == F.col(f"t_{c}"))
    spots = targets.select("target_id", "x", "y")

    def count_point(o: DataFrame) -> DataFrame:
        return o.join(t, F.col("count_point") == F.col("t_count_point"))

    def link_identity(o: DataFrame) -> DataFrame:
        road = o.join(t, F.col("road") == F.col("t_road")).where(agree("junction"))
        return road.union(o.join(t, F.col("junction") == F.col("t_junction")).where(F.col("road").isNull() | F.col("t_road").isNull()))

    def near(o: DataFrame) -> DataFrame:
        return within(o.select("observation_id", "x", "y"), spots, buffer).withColumnRenamed("near_target_id", "target_id")

    many = lambda df, c: not df.groupBy(c).count().where("count > 1").isEmpty()
    if many(observations, "observation_id") or many(targets, "target_id"):
        # Ids that repeat: a pair counts once, however many of their rows meet, so the pairs themselves are counted.
        found = None
        for kind, relate in (("count-point", count_point), ("link-identity", link_identity), ("buffer", near)):
            pairs = checkpointed(relate(left).select("observation_id", "target_id").distinct())
            left = left.join(pairs.select("observation_id").distinct(), "observation_id", "left_anti")
            pairs = pairs.withColumn("relation", F.lit(kind))
            found = pairs if found is None else found.union(pairs)
        counts = found.groupBy("observation_id").agg(F.count("*").alias("n"))
        out = observations.select("observation_id").join(found.join(counts, "observation_id"), "observation_id", "left")
        return out.select("observation_id", "target_id", F.coalesce("relation", F.lit("none")).alias("relation"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("state"))

    # How many targets an observation has comes of counts of targets by what identifies them, so the pairs, most of the work, are only made once and go nowhere.
    zero = lambda c: F.coalesce(c, F.lit(0))
    by = lambda keys, **n: t.groupBy(*[F.col(f"t_{c}").alias(c) for c in keys]).agg(*[F.count_if(v).alias(k) for k, v in n.items()])
    told = left.join(by(["count_point"], n_point=F.lit(True)), "count_point", "left")
    told = told.join(by(["road"], n_road=F.lit(True), n_road_open=F.col("t_junction").isNull()), "road", "left")
    told = told.join(by(["junction"], n_junction=F.lit(True), n_junction_open=F.col("t_road").isNull()), "junction", "left").join(by(["road", "junction"], n_both=F.lit(True)), ["road", "junction"], "left")
    on_road = F.when(F.col("junction").isNull(), F.col("n_road")).otherwise(zero("n_road_open") + zero("n_both"))
    at_junction = F.when(F.col("road").isNull(), F.col("n_junction")).otherwise(F.col("n_junction_open"))
    told = told.withColumn("n_link", zero(on_road) + zero(at_junction)).withColumn("n_point", zero("n_point"))
    known = F.col("observation_id").isNotNull()
    kind = F.when(known & (F.col("n_point") > 0), "count-point").when(known & (F.col("n_link") > 0), "link-identity")
    told = checkpointed(told.select(*left.columns, kind.alias("relation"), F.when(F.col("n_point") > 0, F.col("n_point")).otherwise(F.col("n_link")).alias("n")))

    def pairs(o: DataFrame, c: str, right: DataFrame) -> DataFrame:
        # A key of many observations and targets is dealt to many tasks.
        o, right = o.withColumn("part_", F.pmod(F.xxhash64("observation_id"), F.lit(PARTS))), right.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        return o.join(right.withColumnRenamed("part_", "t_part_"), (F.col(c) == F.col(f"t_{c}")) & (F.col("part_") == F.col("t_part_")))

    row = lambda df: df.select("observation_id", "target_id", "relation", F.when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("state"))
    link = told.where("relation = 'link-identity'")
    out = row(pairs(told.where("relation = 'count-point'"), "count_point", t)).union(row(pairs(link, "road", t).where(agree("junction"))))
    out = out.union(row(pairs(link.where("road is null"), "junction", t))).union(row(pairs(link.where("road is not null"), "junction", t.where("t_road is null"))))
    open_o = told.where("relation is null")
    beside = checkpointed(near(open_o.where(known)).select("observation_id", "target_id"))
    counts = beside.groupBy("observation_id").agg(F.count("*").alias("n"))
    rest = open_o.select("observation_id").join(beside.join(counts, "observation_id").withColumn("relation", F.lit("buffer")), "observation_id", "left")
    state = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return out.union(rest.select("observation_id", "target_id", F.coalesce("relation", F.lit("none")), state))


def traffic_claims(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Claims on one (count point, year, direction): a single value, identical repeats, or a conflict."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n_claims"), F.countDistinct(value).alias("n_values"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return g.withColumn("state", F.when(F.col("n_values") > 1, "conflicting").when(F.col("n_claims") > 1, "identical").otherwise("single"))


def traffic_bands(rows: DataFrame, value: str, year: str, bands: Sequence[tuple[str, float | None]], as_at: int, max_age: int) -> DataFrame:
    return rows.withColumn("band", band(F.col(value), bands)).withColumn("freshness", freshness(F.col(year), as_at, max_age))


def gate(connections: DataFrame, ledger: DataFrame, offered: Mapping[str, Sequence[str]]) -> DataFrame:
    """Outcome of each connection: green is accepted, grey a gap; amber and red follow a valid decision, else amber is accepted with review and red a gap.

    ``connections``: request_id, status, dependency_fingerprint.  ``ledger``: request_id, dependency_fingerprint, choice.  A decision is valid only
    if request and fingerprint match and the choice was on offer for the status.
    """
    menu = F.lit(False)
    for status, choices in offered.items():
        menu = menu | ((F.col("status") == status) & F.col("choice").isin(list(choices)))
    rows = connections.join(ledger.withColumnRenamed("dependency_fingerprint", "seen"), "request_id", "left")
    valid = F.coalesce(F.col("seen").eqNullSafe(F.col("dependency_fingerprint")) & menu, F.lit(False))
    outcome = (
        F.when(F.col("status") == "green", "accept").when(F.col("status") == "grey", "gap").when(valid, F.col("choice"))
        .when(F.col("status") == "amber", "accept-with-review").otherwise("gap")
    )
    note = F.when(F.col("choice").isNull(), "no-decision").when(valid, "replayed").otherwise("stale-or-not-offered")
    return rows.select("request_id", "status", outcome.alias("outcome"), note.alias("decision"))


def account(assets: DataFrame, participations: DataFrame) -> DataFrame:
    """Disposition of every asset: selected, candidate only, rejected only or unused, with its counts.

    ``participations``: asset_id, state (selected, candidate, rejected).
    """
    g = participations.groupBy("asset_id").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("selected", "candidate", "rejected")])
    zero = F.lit(0).cast("long")
    rows = assets.join(g, "asset_id", "left")
    state = F.when(F.col("n_selected") > 0, "selected").when(F.col("n_candidate") > 0, "candidate").when(F.col("n_rejected") > 0, "rejected").otherwise("unused")
    return rows.select("asset_id", state.alias("disposition"), *[F.coalesce(f"n_{s}", zero).alias(f"n_{s}") for s in ("selected", "candidate", "rejected")])


def option_access(options: DataFrame, sites: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each option against each site of its region: the evidence's status, or a network gap."""
    rows = options.join(sites, "region_id").join(evidence, ["option_id", "site_id"], "left")
    return rows.select("option_id", "site_id", F.coalesce("status", F.lit("network-gap")).alias("status"))


def compare_plan(plan: DataFrame, reference: DataFrame) -> DataFrame:
    """Plan routes by the share of their stretches that the reference has (match from 0.7, deviation above 0, else addition), and reference routes that no plan touches (omission).

    Both sides: route_id, item.
    """
    p, r = plan.select("route_id", "item").distinct(), reference.select("item").distinct().withColumn("hit", F.lit(1))
    share = p.join(r, "item", "left").groupBy("route_id").agg((F.count("hit") / F.count("*")).alias("share"))
    kind = F.when(F.col("share") >= 0.7, "match").when(F.col("share") > 0, "deviation").otherwise("addition")
    q = reference.select("route_id", "item").distinct().join(p.select("item").distinct().withColumn("hit", F.lit(1)), "item", "left").groupBy("route_id").agg(F.count("hit").alias("hits")).where("hits = 0")
    return share.select(F.lit("plan").alias("side"), "route_id", "share", kind.alias("kind")).union(q.select(F.lit("reference"), "route_id", F.lit(0.0), F.lit("omission")))


def crossings(lines: DataFrame, size: float) -> DataFrame:
    """Pairs of straight lines that cross inside both and share no end.  ``lines``: line_id, ax, ay, bx, by (floating point)."""
    from ..functions.geometry import cell, segments_cross

    rows = lines.withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx"), size), cell(F.greatest("ax", "bx"), size))))
    rows = rows.withColumn("cy", F.explode(F.sequence(cell(F.least("ay", "by"), size), cell(F.greatest("ay", "by"), size))))
    a, b = rows, rows.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("line_id", "ax", "ay", "bx", "by")])
    pairs = a.join(b, ["cx", "cy"]).where("line_id < o_line_id")
    # Of the cells that both boxes touch the first one counts, so a pair comes once and none is told apart by a shuffle.
    for c in "xy":
        l, o = (F.col(f"a{c}"), F.col(f"b{c}")), (F.col(f"o_a{c}"), F.col(f"o_b{c}"))
        pairs = pairs.where((F.col(f"c{c}") == F.greatest(cell(F.least(*l), size), cell(F.least(*o), size))) & (F.least(*l) <= F.greatest(*o)) & (F.least(*o) <= F.greatest(*l)))
    return pairs.where(segments_cross(*[F.col(c) for c in ("ax", "ay", "bx", "by", "o_ax", "o_ay", "o_bx", "o_by")])).select("line_id", F.col("o_line_id").alias("other_id"), F.lit("amber").alias("status"))


def fallback_route(routes: DataFrame, by: str, criteria: Sequence[str], route_id: str) -> DataFrame:
    """One route for each ``by``: the largest of each criterion in turn, null last, then the smallest id.

    A flag such as the compiler's preference is a criterion too; where no route has it, it decides nothing.  ``decided_by`` names the criterion that left one route, or
    ``route-id``.  Two rounds of sums, so that a group of any size stays split over tasks.
    """
    marks = [F.struct(F.col(c).isNull().alias("none"), (-F.col(c).cast("double")).alias("least")).alias(f"mark_{c}") for c in criteria]
    rows = routes.select(by, F.col(route_id).alias("id"), *marks)
    best = rows.groupBy(by).agg(F.min(F.struct(*[f"mark_{c}" for c in criteria], "id")).alias("best"), F.count("*").alias("n_routes"))
    both = rows.join(best, rows[by].eqNullSafe(best[by])).drop(rows[by])
    alike, left = F.lit(True), []
    for c in criteria:
        alike = alike & (F.col(f"mark_{c}") == F.col(f"best.mark_{c}"))
        left.append(F.count_if(alike).alias(f"left_{c}"))
    sums = both.groupBy(by).agg(F.first("best.id").alias("route_id"), F.first("n_routes").alias("n_routes"), *left)
    decided = F.coalesce(*[F.when(F.col(f"left_{c}") == 1, c) for c in criteria], F.lit("route-id"))
    return sums.select(by, "route_id", "n_routes", decided.alias("decided_by"))


def bind_observations(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """Observations with the directed edges that carry their subject's identity.

    ``observations``: observation_id, subject_id, claim, state, source_kind.  ``edges``: edge_id, source_id.  Every observation stays: ``bound`` with its edges in order,
    ``unmatched-observation`` with none, ``invalid-observation`` where the id, subject, claim or state is missing or blank.  An edge's identity has few directions; repeated edges count once.
    """
    known = edges.where("source_id is not null").groupBy(F.col("source_id").alias("subject_id")).agg(F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    blank = F.lit(False)
    for c in ("observation_id", "subject_id", "claim", "state"):
        blank = blank | F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    rows = observations.withColumn("invalid", blank).join(known, "subject_id", "left")
    result = F.when(F.col("invalid"), "invalid-observation").when(F.col("edge_ids").isNull(), "unmatched-observation").otherwise("bound")
    return rows.select("observation_id", "subject_id", "claim", "state", "source_kind", F.when(~F.col("invalid"), F.col("edge_ids")).alias("edge_ids"), result.alias("result"))
