"""Queries over line evidence, priorities, monitoring and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import line_evidence as L
from ..operators import monitoring as M
from ..operators import priority as P
from .tables import table


def _matches(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    size = items.groupBy("l_orderkey").agg((F.sum("l_quantity") + 10).cast("long").alias("target_mm"))
    return items.join(size, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"), F.col("l_orderkey").alias("target_id"), F.col("l_quantity").cast("long").alias("shared_mm"), "target_mm",
        F.when(F.col("l_linestatus") == "O", "accepted").otherwise("ambiguous").alias("state"),
    )


def _observations(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("not (l_linenumber = 4 and l_returnflag = 'N')")
    value = F.col("l_extendedprice").cast("decimal(18,2)")
    source = F.concat_ws("-", "l_orderkey", "l_linenumber")
    one = items.select(source.alias("source_id"), F.lit("a").alias("observation_id"), value.alias("value"), F.col("l_returnflag").alias("category"))
    two = items.where("l_tax > 0.07").select(source.alias("source_id"), F.when(F.col("l_linenumber") == 1, "a").otherwise("b").alias("observation_id"), F.when(F.col("l_discount") > 0.05, value + 1).otherwise(value).cast("decimal(18,2)").alias("value"), F.col("l_returnflag").alias("category"))
    return one.union(two)


EVIDENCE_SQL = """size as (select l_orderkey, cast(sum(l_quantity) + 10 as bigint) as target_mm from lineitem group by l_orderkey),
    matches as (select l_orderkey || '-' || l_linenumber as source_id, l_orderkey as target_id, cast(l_quantity as bigint) as shared_mm, target_mm
        from lineitem join size using (l_orderkey) where l_linestatus = 'O'),
    seen as (select * from lineitem where not (l_linenumber = 4 and l_returnflag = 'N')),
    obs as (select l_orderkey || '-' || l_linenumber as source_id, 'a' as observation_id, cast(l_extendedprice as decimal(18,2)) as value, l_returnflag as category from seen
        union all select l_orderkey || '-' || l_linenumber, case when l_linenumber = 1 then 'a' else 'b' end,
            cast(l_extendedprice as decimal(18,2)) + case when l_discount > 0.05 then 1 else 0 end, l_returnflag from seen where l_tax > 0.07),
    persource as (select source_id, count(*) as n, count(distinct observation_id) as ids, count(distinct (value, category)) as n_values,
        arg_min(value, observation_id) as value, min(category) as category from obs group by source_id)"""


def line_conflicts(spark, sf_dir):
    return L.conflicts(_observations(spark, sf_dir))


CONFLICTS = f"""with {EVIDENCE_SQL} select source_id, n as n_observations, n_values,
    case when ids < n then 'duplicate-observation-id' else 'contradictory-observations' end as reason from persource where ids < n or n_values > 1"""


def _law(law):
    def query(spark, sf_dir):
        return L.aggregate(_matches(spark, sf_dir), _observations(spark, sf_dir), law, "R")

    value = {
        "extensive": "sum(cast(value as decimal(18,4)) * cast(shared_mm as decimal(15,0)))::double / max(target_mm)",
        "intensive": "sum(cast(value as decimal(18,4)) * cast(shared_mm as decimal(15,0)))::double / sum(case when n is not null then shared_mm end)",
        "maximum": "cast(max(value) as double)",
        "minimum": "cast(min(value) as double)",
        "share": "cast(coalesce(sum(case when category = 'R' then shared_mm end), 0) as double) / max(target_mm)",
    }[law]
    sql = f"""with {EVIDENCE_SQL}, joined as (select m.*, p.n, p.value, p.category, coalesce(p.ids < p.n or p.n_values > 1, false) as bad from matches m left join persource p using (source_id)),
    g as (select target_id, bool_or(bad) as conflicting, count(n) as seen, max(target_mm) as target_length, sum(shared_mm) as all_shared, sum(case when n is not null then shared_mm end) as seen_shared,
        sum(n) as seen_n, sum(case when bad then n end) as bad_n, count(*) filter (where bad) as bad_sources, {value} as result from joined group by target_id)
    select target_id, case when conflicting then 'conflicting' when seen = 0 then 'no-data' else 'available' end as state,
        case when not conflicting and seen > 0 then round(result, 6) end as value,
        cast(case when conflicting then bad_n else coalesce(seen_n, 0) end as bigint) as n_observations,
        cast(case when conflicting then bad_sources else seen end as bigint) as n_sources,
        cast(case when conflicting then all_shared else coalesce(seen_shared, 0) end as bigint) as shared_length, target_length,
        case when conflicting then 'conflicting-source-observations' when seen = 0 then 'no-observations' else 'aggregated-{law}' end as reason from g"""
    return query, sql


MEASURES = (P.Measure("price", "value", "higher", 900.0, 2000.0, 3.0), P.Measure("size", "delivery", "lower", 1.0, 50.0, 2.0), P.Measure("quantity", "demand", "threshold", 0.0, 700.0, 2.0))


def _items(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    part = table(spark, sf_dir, "part")
    rows = part.join(sold, part.p_partkey == sold.l_partkey, "left")
    return rows.select(F.col("p_partkey").alias("intervention_id"), F.round("p_retailprice", 0).alias("price"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_size").cast("double")).alias("size"), "quantity", F.substring("p_brand", 1, 8).alias("programme_id"))


ITEMS_SQL = """items as (select p_partkey as intervention_id, round(p_retailprice, 0) as price, case when p_partkey % 17 <> 0 then cast(p_size as double) end as size, quantity, substring(p_brand, 1, 8) as programme_id
    from part left join (select l_partkey, sum(l_quantity) as quantity from lineitem group by l_partkey) on l_partkey = p_partkey)"""


def _scores_sql(name: str, weights=(3.0, 2.0, 2.0)) -> str:
    a, b, c = weights
    return f"""{name}_parts as (select *, round((price - 900.0) / (2000.0 - 900.0) * {a}, 8) as c1, round((1 - (size - 1.0) / (50.0 - 1.0)) * {b}, 8) as c2,
        round((case when quantity >= 700.0 then 1.0 when quantity is not null then 0.0 end) * {c}, 8) as c3 from items),
    {name}_scored as (select intervention_id, price, size, quantity, programme_id,
        case when price is not null and size is not null and quantity is not null then round((c1 + c2 + c3) / ({a} + {b} + {c}), 8) end as total,
        concat_ws(',', case when price is null then 'price' end, case when quantity is null then 'quantity' end, case when size is null then 'size' end) as missing,
        round(c3 / {c}, 8) as view_demand, round(c2 / {b}, 8) as view_delivery, round(c1 / {a}, 8) as view_value from {name}_parts),
    {name} as (select *, case when total is not null then rank() over (order by total desc nulls last) end as rank,
        case when total is null then 0 else count(*) over (partition by total) - 1 end as tied from {name}_scored)"""


def priority_scores(spark, sf_dir):
    return P.scores(_items(spark, sf_dir), MEASURES).select("intervention_id", "total", "missing")


def priority_view_scores(spark, sf_dir):
    return P.scores(_items(spark, sf_dir), MEASURES).select("intervention_id", "view_demand", "view_delivery", "view_value")


def priority_rank_ties(spark, sf_dir):
    return P.ranked(P.scores(_items(spark, sf_dir), MEASURES)).select("intervention_id", "total", "rank", "tied")


def priority_sensitivity(spark, sf_dir):
    items = _items(spark, sf_dir)
    return P.rank_changes(P.ranked(P.scores(items, MEASURES)), P.ranked(P.scores(items, MEASURES, {"size": 4.0})))


SENSITIVITY = f"""with {ITEMS_SQL}, {_scores_sql('b')}, {_scores_sql('o', (3.0, 4.0, 2.0))}
    select intervention_id, b.total as base_total, b.rank as base_rank, o.total as case_total, o.rank as case_rank, o.rank - b.rank as rank_delta, round(o.total - b.total, 8) as score_delta
    from b join o using (intervention_id)"""


def priority_schedule(spark, sf_dir):
    ranked = P.ranked(P.scores(_items(spark, sf_dir), MEASURES))
    key = F.col("intervention_id")
    rows = ranked.select(
        "programme_id", key, "rank", F.when(key % 13 != 0, F.col("price")).alias("upper_cost"),
        F.when(key % 5 == 0, F.array(key - 5)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"),
        F.when(key % 7 == 0, F.array(key + 7)).otherwise(F.array().cast("array<bigint>")).alias("excludes"),
    )
    return P.schedule(rows, (20000.0, 30000.0, 50000.0))


def asof_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verification = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "purchase", "verified").otherwise("unverified")
    updates = e.select("user_id", (F.col("event_id") % 5).alias("dimension"), F.round("value").cast("long").alias("state"), verification.alias("verification"), F.to_date("ts").alias("observed_on"), F.col("ts").alias("recorded_on"), F.col("event_id").alias("update_id"))
    return M.effective_states(updates, ["user_id", "dimension"])


ASOF = """with u as (select user_id, event_id % 5 as dimension, cast(round(value) as bigint) as state, cast(ts as date) as observed_on, ts, event_id,
    case event_type when 'error' then 'contradicted' when 'purchase' then 'verified' else 'unverified' end as v from events)
    select user_id, dimension, arg_max(state, row(observed_on, ts, event_id)) filter (where v = 'verified') as effective_state, max(event_id) filter (where v = 'verified') as last_verified_id,
        count(*) filter (where v = 'unverified') as n_unverified, count(*) filter (where v = 'contradicted') as n_contradicted from u group by user_id, dimension"""


def indicator_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obs = e.select(
        F.col("user_id").alias("indicator_id"), F.col("event_id").alias("observation_id"), "value", F.when(F.col("event_id") % 20 == 0, "baseline").otherwise("monitoring").alias("kind"),
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "contradicted").when(F.col("event_type") == "purchase", "verified").otherwise("unverified").alias("verification"),
        F.to_date("ts").alias("period_end"), F.date_add(F.to_date("ts"), (F.col("event_id") % 6).cast("int")).alias("recorded_on"), F.date_add(F.to_date("ts"), 3).alias("due_on"),
    )
    ind = e.select("user_id").distinct().select(
        F.col("user_id").alias("indicator_id"), (F.col("user_id") % 50 + 20).cast("double").alias("target_value"), F.date_add(F.lit("2024-01-20").cast("date"), (F.col("user_id") % 30).cast("int")).alias("target_date"),
        F.when(F.col("user_id") % 2 == 0, "at-least").otherwise("at-most").alias("direction"), (F.col("user_id") % 4).alias("frequency_days"),
    )
    return M.indicator_status(ind, obs, F.lit("2024-02-01").cast("date")).withColumn("next_due_on", F.col("next_due_on").cast("string"))


INDICATOR = """with o as (select user_id as id, event_id, value, event_id % 20 <> 0 as own, case when event_type = 'error' and user_id % 3 = 0 then 'contradicted' when event_type = 'purchase' then 'verified' else 'unverified' end as v,
        cast(ts as date) as period_end, cast(ts as date) + cast(event_id % 6 as integer) as recorded_on, cast(ts as date) + 3 as due_on from events),
    g as (select id, arg_max(event_id, row(period_end, recorded_on, event_id)) filter (where own and v = 'verified') as latest_id, arg_max(value, row(period_end, recorded_on, event_id)) filter (where own and v = 'verified') as latest,
        arg_max(due_on, row(due_on, recorded_on, event_id)) as last_due, count(*) filter (where own and v = 'contradicted') as n_contradicted, count(*) filter (where own and v = 'unverified') as n_unverified,
        count(*) filter (where recorded_on > due_on) as n_late from o group by id),
    r as (select *, id % 50 + 20 as target, date '2024-01-20' + cast(id % 30 as integer) as target_date, last_due + cast(id % 4 as integer) as next_due_on from g)
    select id as indicator_id, case when n_contradicted > 0 then 'contradictory-data' when n_unverified > 0 and latest_id is null then 'unverified-data' when date '2024-02-01' > next_due_on then 'missing-data'
        when latest_id is null then case when date '2024-02-01' < target_date then 'not-due' else 'missing-data' end
        when (id % 2 = 0 and latest >= target) or (id % 2 <> 0 and latest <= target) then 'met' else 'not-met' end as target_status,
        latest_id as latest_observation_id, cast(next_due_on as varchar) as next_due_on, n_late, n_unverified, n_contradicted from r"""

LANGS = ("en", "fr", "de", "es")


def evidence_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(
        F.col("source").alias("family"), (F.col("doc_id") % 11 != 0).alias("available"), (F.col("doc_id") % 2 == 0).alias("has_artifact"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("observed_to"),
        (F.col("doc_id") % 4).alias("quality"), F.array("lang").alias("units"), F.array(F.when(F.col("doc_id") % 5 == 0, "routing").otherwise("display")).alias("uses"),
    )
    need = table(spark, sf_dir, "documents").select("source").distinct().union(spark.createDataFrame([("src-none",)], "source string"))
    need = need.select(F.col("source").alias("family"), F.lit(400).alias("max_age_days"), F.lit(3).cast("long").alias("min_quality"), F.array(*[F.lit(x) for x in (*LANGS, "it")]).alias("required_units"), F.lit("routing").alias("required_use"))
    return M.evidence_coverage(need, items, F.lit("2022-12-31").cast("date")).withColumn("freshest", F.col("freshest").cast("string"))


COVERAGE = """with i as (select source as family, doc_id % 11 <> 0 as available, doc_id % 2 = 0 as has_artifact, date '2020-01-01' + cast(doc_id % 700 as integer) as observed_to, doc_id % 4 as quality, lang, doc_id % 5 = 0 as routing
        from documents),
    g as (select family, count(*) as n, count(*) filter (where available) as n_available, count(*) filter (where has_artifact) as art, max(observed_to) filter (where available) as freshest, max(quality) filter (where available) as best_quality,
        bool_or(routing) filter (where available) as routable from i group by family),
    need as (select distinct source as family from documents union all select 'src-none'),
    units(u) as (values ('en'), ('fr'), ('de'), ('es'), ('it')),
    lack as (select n.family, string_agg(u, ',' order by u) as missing_units from need n cross join units where not exists (select 1 from i where i.family = n.family and i.available and i.lang = u) group by n.family)
    select n.family, coalesce(n_available, 0) as n_available, cast(freshest as varchar) as freshest, best_quality, coalesce(missing_units, '') as missing_units,
        concat_ws(',', case when coalesce(n_available, 0) = 0 then 'missing' end, case when n > 0 and art = 0 then 'non-reproducible' end, case when date '2022-12-31' - freshest > 400 then 'stale' end,
            case when best_quality < 3 then 'low-quality' end, case when n_available > 0 and missing_units is not null then 'spatially-incomplete' end, case when n_available > 0 and not routable then 'licence-restricted' end) as issues
    from need n left join g using (family) left join lack l on l.family = n.family"""


def conformance(spark, sf_dir):
    need = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("requirement_id"), (F.col("doc_id") % 2 == 0).alias("mandatory"))
    state = F.when(F.col("toxic") == 1, "not-applicable").when(F.col("quality") == 1, "met").otherwise("not-met")
    return M.conformance(need, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("requirement_id"), state.alias("state")))


CONFORMANCE = """select d.doc_id as requirement_id, d.doc_id % 2 = 0 as mandatory, coalesce(s, 'not-assessed') as state, d.doc_id % 2 = 0 and coalesce(s, 'not-assessed') not in ('met', 'not-applicable') as unresolved
    from documents d left join (select doc_id, case when toxic = 1 then 'not-applicable' when quality = 1 then 'met' else 'not-met' end as s from labels) using (doc_id)"""


def audit_compile(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    subjects = c.groupBy("conv_id").agg(F.when(F.max("turn") >= 3, "route").otherwise("zone").alias("kind")).withColumnRenamed("conv_id", "subject_id")
    need = spark.createDataFrame([("route", "user"), ("route", "assistant"), ("route", "system"), ("zone", "user"), ("zone", "assistant")], "kind string, requirement_id string")
    seen = c.groupBy("conv_id", "role").agg(F.when(F.max(F.length("text")) > 400, "fail").otherwise("pass").alias("outcome"))
    return M.compile_audit(subjects, need, seen.withColumnsRenamed({"conv_id": "subject_id", "role": "requirement_id"}))


AUDIT = """with s as (select conv_id, case when max(turn) >= 3 then 'route' else 'zone' end as kind from conversations group by conv_id),
    need(kind, role) as (values ('route', 'user'), ('route', 'assistant'), ('route', 'system'), ('zone', 'user'), ('zone', 'assistant')),
    o as (select conv_id, role, case when max(length(text)) > 400 then 'fail' else 'pass' end as outcome from conversations group by conv_id, role)
    select s.conv_id as subject_id, need.role as requirement_id, coalesce(outcome, 'unknown') as outcome, case coalesce(outcome, 'unknown') when 'unknown' then 'evidence-request' when 'fail' then 'deficiency' else 'none' end as disposition
    from s join need using (kind) left join o on o.conv_id = s.conv_id and o.role = need.role"""


def release_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 10 <> 1").select("o_orderkey", F.col("o_custkey").alias("geometry"), F.col("o_orderstatus").alias("attributes"))
    after = o.where("o_orderkey % 10 <> 2").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0)).alias("geometry"), F.when(F.col("o_orderkey") % 10 == 4, "X").otherwise(F.col("o_orderstatus")).alias("attributes"))
    return M.release_diff(before, after, "o_orderkey", "geometry", "attributes")


RELEASE = """select o_orderkey, case o_orderkey % 10 when 1 then 'added' when 2 then 'removed' when 3 then 'geometry-changed' when 4 then 'attributes-changed' else 'unchanged' end as change from orders"""

PLANS = {
    "line_conflicts": (line_conflicts, CONFLICTS),
    **{f"line_agg_{law}": _law(law) for law in L.LAWS},
    "priority_scores": (priority_scores, f"with {ITEMS_SQL}, {_scores_sql('b')} select intervention_id, total, missing from b"),
    "priority_view_scores": (priority_view_scores, f"with {ITEMS_SQL}, {_scores_sql('b')} select intervention_id, view_demand, view_delivery, view_value from b"),
    "priority_rank_ties": (priority_rank_ties, f"with {ITEMS_SQL}, {_scores_sql('b')} select intervention_id, total, rank, tied from b"),
    "priority_sensitivity": (priority_sensitivity, SENSITIVITY),
    "priority_schedule": (priority_schedule, None),
    "asof_status": (asof_status, ASOF),
    "indicator_status": (indicator_status, INDICATOR),
    "evidence_coverage": (evidence_coverage, COVERAGE),
    "conformance": (conformance, CONFORMANCE),
    "audit_compile": (audit_compile, AUDIT),
    "release_diff": (release_diff, RELEASE),
}
