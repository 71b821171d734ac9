"""Queries over reviews, evaluation, policies and tool catalogs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import feed
from ..operators import catalog, evaluation, policy, review
from ..operators.inspect import InspectPolicy
from .derived import Inputs, cte
from .registry import query

BENCH = cte("bench")
VERDICTS = cte("verdicts")

# --- evaluation -----------------------------------------------------------------------------------

_OK = "status in ('allow', 'block')"


def _rates_sql(threshold: str) -> str:
    return (
        f"round(avg(case when (risk >= {threshold}) = (kind <> 'benign') then 1.0 else 0.0 end), 3) as accuracy, "
        f"round(avg(case when risk >= {threshold} then 1.0 else 0.0 end) filter (kind <> 'benign'), 3) as attack_recall, "
        f"round(avg(case when risk >= {threshold} then 1.0 else 0.0 end) filter (kind = 'judge_attack'), 3) as judge_attack_recall, "
        f"round(avg(case when risk >= {threshold} then 1.0 else 0.0 end) filter (kind = 'benign'), 3) as false_positive_rate"
    )


@query("confusion_rates", f"with {BENCH} select model, {_rates_sql('0.5')} from bench where {_OK} group by model")
def confusion_rates(t: Inputs) -> DataFrame:
    return evaluation.rates_at(t.bench, 0.5, "model")


_SWEEP = (
    f"with {BENCH}, grid as (select unnest(range(5, 100, 5)) / 100.0 as threshold), "
    f"points as (select model, threshold, {_rates_sql('threshold')} from bench, grid where {_OK} group by model, threshold) "
)


@query("threshold_sweep", _SWEEP + "select * from points")
def threshold_sweep(t: Inputs) -> DataFrame:
    return evaluation.sweep(t.bench, "model")


@query(
    "best_thresholds",
    _SWEEP
    + ", a as (select *, row_number() over (partition by model order by accuracy desc, false_positive_rate, threshold desc) as r from points), "
    "b as (select *, row_number() over (partition by model order by attack_recall desc, accuracy desc, threshold desc) as r from points where false_positive_rate <= 0.05) "
    "select a.model, a.threshold as best_accuracy_at, a.accuracy as best_accuracy, b.threshold as best_recall_at, b.attack_recall as best_recall "
    "from a left join b on b.model = a.model and b.r = 1 where a.r = 1", nulls={'best_recall_at': -1.0, 'best_recall': -1.0})
def best_thresholds(t: Inputs) -> DataFrame:
    return evaluation.best_thresholds(evaluation.sweep(t.bench, "model"), "model")


@query(
    "model_report",
    f"with {BENCH}, tot as (select model, count(*) as calls, count(*) filter ({_OK}) as valid, round(sum(cost), 6) as usd_total, "
    "round(1000 * sum(cost) / count(*), 4) as usd_per_1k from bench group by model), "
    f"ok as (select * from bench where {_OK}), r as (select model, {_rates_sql('0.7')}, round(quantile_cont(ms, 0.5), 1) as p50_ms, count(*) as n from ok group by model), "
    "o as (select model, ms, row_number() over (partition by model order by ms) - 1 as k from ok) "
    "select tot.model, calls, valid, calls - valid as failures, usd_total, usd_per_1k, accuracy, attack_recall, judge_attack_recall, false_positive_rate, p50_ms, "
    "round(o.ms, 1) as p95_ms from tot join r on r.model = tot.model join o on o.model = tot.model and o.k = least(n - 1, round_even(0.95 * (n - 1), 0))",
)
def model_report(t: Inputs) -> DataFrame:
    return evaluation.model_report(t.bench, 0.7)


@query(
    "accuracy_by_language",
    f"with {BENCH} select model, lang, round(avg(case when (risk >= 0.5) = (kind <> 'benign') then 1.0 else 0.0 end), 3) as accuracy "
    f"from bench where {_OK} group by rollup (model, lang) having model is not null", nulls={'lang': 'all'})
def accuracy_by_language(t: Inputs) -> DataFrame:
    return evaluation.accuracy_by_language(t.bench, 0.5)


@query(
    "run_latency",
    f"with {BENCH} select round(quantile_cont(ms, 0.5), 3) as p50_ms, round(quantile_cont(ms, 0.99), 3) as p99_ms, max(ms) as max_ms from bench",
)
def run_latency(t: Inputs) -> DataFrame:
    return evaluation.run_latency(t.bench)


def _labelled(t: Inputs) -> DataFrame:
    """Labelled documents with the findings a made-up detector gives: toxic ones by number."""
    flagged = (F.col("doc_id") * 37 % 101) >= 60
    found = F.when(
        flagged, F.array(F.struct(F.when(F.col("doc_id") % 2 == 0, "pii.email").otherwise("secrets.aws").alias("control_id"),
                                  F.lit("block").alias("action")))
    ).otherwise(F.array().cast("array<struct<control_id:string,action:string>>"))
    return t.labels.select(
        "doc_id", F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 3 == 0, "pii").otherwise("secrets.aws")).alias("control"),
        F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("expect"), found.alias("findings"),
        F.when(flagged, "block").otherwise("allow").alias("action"), F.lit("clean text").alias("forwarded"),
        F.array(F.lit("secret value")).alias("must_not_contain"),
    )


_CORPUS = """
c as (select doc_id, case when toxic = 1 then case when doc_id % 3 = 0 then 'pii' else 'secrets.aws' end end as control,
  case when toxic = 1 then 'block' else 'allow' end as expect, (doc_id * 37 % 101) >= 60 as flagged,
  case when doc_id % 2 = 0 then 'pii.email' else 'secrets.aws' end as cid from labels),
p as (select *, case when flagged then 'block' else 'allow' end = expect
  and (control is null or (flagged and (cid = control or starts_with(cid, concat(control, '.'))))) as passed from c)"""


@query("corpus_results", f"with {_CORPUS} select expect, coalesce(control, 'none') as control, passed, count(*) as n from p group by all")
def corpus_results(t: Inputs) -> DataFrame:
    judged = evaluation.corpus_results(_labelled(t))
    return judged.groupBy("expect", F.coalesce("control", F.lit("none")).alias("control"), "passed").agg(F.count("*").alias("n"))


@query(
    "control_rates",
    f"with {_CORPUS}, pos as (select control, count(*) as positives, cast(sum(passed::int) as bigint) as tp from p where control is not null group by control), "
    "ben as (select * from p where expect = 'allow') select pos.control, positives, tp, round(tp / positives, 3) as tpr, "
    "(select count(*) from ben where flagged and (cid = pos.control or starts_with(cid, concat(pos.control, '.')))) as fp, "
    "round((select count(*) from ben where flagged and (cid = pos.control or starts_with(cid, concat(pos.control, '.')))) / (select count(*) from ben), 3) as fpr from pos",
)
def control_rates(t: Inputs) -> DataFrame:
    return evaluation.control_rates(evaluation.corpus_results(_labelled(t)))


# --- reviews --------------------------------------------------------------------------------------


@query(
    "combined_verdicts",
    f"with {VERDICTS}, x as (select doc_id, first(status order by chunk_ord) filter (status <> 'allow') as stop, "
    "first(risk order by chunk_ord) filter (status <> 'allow') as stop_risk, max(risk) as top, cast(sum(cost_usd) as double) as cost from verdicts group by doc_id) "
    "select doc_id, coalesce(stop, 'allow') as status, case when stop is null then top else stop_risk end as risk, round(cost, 6) as cost_usd from x",
)
def combined_verdicts(t: Inputs) -> DataFrame:
    got = review.combine_chunks(t.verdicts, "doc_id")
    return got.select("doc_id", "status", "risk", F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd"))


@query(
    "reused_verdicts",
    f"with {VERDICTS}, v as (select * from verdicts where {_OK}) "
    "select a.review_id, count(v.review_id) > 0 as reused, arg_max(v.status, v.ts) as status, arg_max(v.risk, v.ts) as risk "
    "from verdicts a left join v on v.key = a.key and v.config = a.config and v.ts < a.ts and v.ts > a.ts - interval 4 hour group by a.review_id", nulls={'status': 'none', 'risk': -1.0})
def reused_verdicts(t: Inputs) -> DataFrame:
    asked = t.verdicts.select("review_id", "ts", "key", "config")
    return review.reuse_verdicts(asked, t.verdicts, 4 * 3600).select("review_id", "reused", "status", "risk")


@query(
    "verdict_findings",
    f"with {VERDICTS} select control_id, action, count(*) as n from (select case when status = 'block' or (status = 'allow' and risk >= 0.7) "
    "then 'semantic.judge' when status = 'allow' then null when status = 'budget' then 'semantic.budget' else 'semantic.unavailable' end as control_id, "
    "'block' as action from verdicts) x where control_id is not null group by all",
)
def verdict_findings(t: Inputs) -> DataFrame:
    found = review.verdict_findings(t.verdicts).where(F.col("finding").isNotNull())
    return found.groupBy("finding.control_id", "finding.action").agg(F.count("*").alias("n"))


@query(
    "daily_review_spend",
    f"with {VERDICTS} select review_id, round(cast(s as double), 6) as spent_usd, s > 0.5 as over_cap from (select review_id, "
    "sum(cost_usd) over (partition by date_trunc('day', ts) order by ts, review_id) as s from verdicts) x",
)
def daily_review_spend(t: Inputs) -> DataFrame:
    ran = review.daily_review_spend(t.verdicts, 0.5)
    return ran.select("review_id", F.round(F.col("spent_usd").cast("double"), 6).alias("spent_usd"), "over_cap")


@query(
    "outages",
    f"with {VERDICTS}, r as (select *, sum(case when {_OK} then 1 else 0 end) over (partition by model order by ts, review_id) as run from verdicts "
    "where status <> 'budget') select model, count(*) as failures, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as ended_us from r "
    "where status in ('error', 'timeout') group by model, run having count(*) >= 2",
)
def outages(t: Inputs) -> DataFrame:
    found = review.outages(t.verdicts, 2)
    return found.select(
        "model", "failures", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us")
    )


@query(
    "parsed_verdicts",
    "select event_id, event_id % 5 < 2 as valid, case when event_id % 5 < 2 then (event_id % 11) / 10.0 else 1.0 end as risk from events",
)
def parsed_verdicts(t: Inputs) -> DataFrame:
    """Answers of a reviewer: good ones, and ones with an unknown category, no reason or a repeated key."""
    kind, risk = F.col("event_id") % 5, F.concat(F.floor(F.col("event_id") % 11 / 10), F.lit("."), F.col("event_id") % 11 % 10)
    body = (
        F.when(kind == 2, F.concat(F.lit('{"risk":'), risk, F.lit(',"category":"odd","reason":"r"}')))
        .when(kind == 3, F.concat(F.lit('{"risk":'), risk, F.lit(',"category":"safe"}')))
        .when(kind == 4, F.lit('{"risk":0,"risk":1,"category":"safe","reason":"r"}'))
        .otherwise(F.concat(F.lit('{"risk":'), risk, F.lit(',"category":"safe","reason":"r"}')))
    )
    parsed = review.parse_verdicts(t.events.select("event_id", body.alias("body")))
    return parsed.select("event_id", "valid", "risk")


@query(
    "parsed_decisions",
    "select event_id, event_id % 3 <> 2 as valid, case event_id % 3 when 0 then 0.75 when 1 then 0.25 end as risk, "
    "case event_id % 3 when 0 then 'jailbreak' when 1 then 'safe' end as category from events", nulls={'risk': -1.0, 'category': 'none'})
def parsed_decisions(t: Inputs) -> DataFrame:
    kind = F.col("event_id") % 3
    body = (
        F.when(kind == 0, '{"safe":0.25,"jailbreak":0.5,"harmful":0.25}')
        .when(kind == 1, '{"safe":0.75,"prompt_injection":0.25}')
        .otherwise('{"safe":1.5}')
    )
    return review.parse_decisions(t.events.select("event_id", body.alias("body"))).select("event_id", "valid", "risk", "category")


# --- policies -------------------------------------------------------------------------------------

FLAT = cte("policy_flat")


@query(
    "policy_history",
    f"with {FLAT}, n as (select policy_id, min(version) as lo, max(version) as hi from policy_flat group by policy_id), "
    "d as (select coalesce(a.policy_id, b.policy_id) as policy_id, coalesce(a.version + 1, b.version) as version, coalesce(a.key, b.key) as key, "
    "a.value as old_value, b.value as new_value from policy_flat a full join policy_flat b on b.policy_id = a.policy_id and b.key = a.key and b.version = a.version + 1) "
    "select d.policy_id, version, key, old_value, new_value from d join n on n.policy_id = d.policy_id "
    "where old_value is distinct from new_value and version > lo and version <= hi", nulls={'old_value': 'none', 'new_value': 'none'})
def policy_history(t: Inputs) -> DataFrame:
    return policy.history_diff(t.policy_flat)


@query(
    "policy_diff",
    f"with {FLAT}, a as (select * from policy_flat where version = 1), b as (select * from policy_flat where version = 9) "
    "select coalesce(a.policy_id, b.policy_id) as policy_id, coalesce(a.key, b.key) as key, a.value as old_value, b.value as new_value "
    "from a full join b on a.policy_id = b.policy_id and a.key = b.key where a.value is distinct from b.value", nulls={'old_value': 'none', 'new_value': 'none'})
def policy_diff(t: Inputs) -> DataFrame:
    old, new = t.policy_flat.where("version = 1"), t.policy_flat.where("version = 9")
    return policy.diff(old.drop("version"), new.drop("version"), "policy_id")


@query(
    "policy_overlay",
    f"with {FLAT}, b as (select * from policy_flat where version = 2), o as (select policy_id, key, 'set' as value from policy_flat where version = 3 and value = '0') "
    "select coalesce(b.policy_id, o.policy_id) as policy_id, coalesce(b.key, o.key) as key, coalesce(o.value, b.value) as value "
    "from b full join o on o.policy_id = b.policy_id and o.key = b.key",
)
def policy_overlay(t: Inputs) -> DataFrame:
    base = t.policy_flat.where("version = 2").drop("version")
    profile = t.policy_flat.where("version = 3 and value = '0'").select("policy_id", "key", F.lit("set").alias("value"))
    return policy.overlay(base, profile, "policy_id")


def _controls(t: Inputs) -> DataFrame:
    watch = F.when(F.col("watch"), "monitor").otherwise("block")
    actions = F.when(F.col("control") == "flow", F.array(watch, F.lit("block"), F.lit("block"))).otherwise(F.array(watch))
    return t.controls.select("policy_id", "mode", "control", "enabled", actions.alias("actions"))


_POSTURE = f"""{cte('controls')},
w(control, weight) as (values ('prompt_injection', 18), ('pii', 14), ('secrets', 14), ('signatures', 8), ('canary', 4), ('loop', 4),
  ('flow', 14), ('semantic', 8), ('auth', 6), ('budgets', 6), ('approvals', 4)),
contrib as (select c.*, weight, case when enabled then weight * (case when watch then case when control = 'flow' then 2.3 / 3 else 0.3 end else 1 end)
  * (case when mode = 'monitor' and control in ('prompt_injection', 'pii', 'secrets', 'signatures', 'canary', 'loop', 'semantic') then 0.3 else 1 end)
  else 0 end as part from controls c join w using (control))"""


@query(
    "posture_scores",
    f"with {_POSTURE}, s as (select policy_id, cast(floor(least(100, greatest(0, sum(part))) + 0.5) as int) as score, "
    "cast(sum(case when not enabled or watch then 1 else 0 end) + max(case when mode = 'monitor' then 1 else 0 end) as int) as n_gaps from contrib group by policy_id) "
    "select policy_id, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade, n_gaps from s",
)
def posture_scores(t: Inputs) -> DataFrame:
    return policy.posture(_controls(t)).select("policy_id", "score", "grade", F.size("gaps").alias("n_gaps"))


@query(
    "owasp_coverage",
    f"with {_POSTURE}, cat(id, control, part_only) as (values ('LLM01', 'prompt_injection', false), ('LLM01', 'semantic', false), ('LLM02', 'pii', false), "
    "('LLM02', 'secrets', false), ('LLM03', 'signatures', true), ('LLM04', null, true), ('LLM05', 'signatures', true), ('LLM06', 'flow', false), ('LLM06', 'auth', false), "
    "('LLM06', 'approvals', false), ('LLM07', 'canary', true), ('LLM08', null, true), ('LLM09', null, true), ('LLM10', 'loop', false), ('LLM10', 'budgets', false)), "
    "ids as (select distinct policy_id from controls), x as (select ids.policy_id, cat.id, max(coalesce(part, 0)) as most, bool_and(coalesce(part = weight, false)) as complete, "
    "bool_or(part_only) as part_only from ids cross join cat left join contrib c on c.policy_id = ids.policy_id and c.control = cat.control group by all) "
    "select policy_id, id, case when most <= 0 then 'gap' when complete and not part_only then 'covered' else 'partial' end as status from x",
)
def owasp_coverage(t: Inputs) -> DataFrame:
    return policy.coverage(_controls(t)).select("policy_id", "id", "status")


@query(
    "active_controls",
    f"with {cte('controls')} select policy_id, control, case when control = 'canary' then false when control = 'pii' then false else enabled end as enabled from controls",
)
def active_controls(t: Inputs) -> DataFrame:
    """Control states after toggles; a section that is missing stays off."""
    toggles = t.spark.createDataFrame([("pii", True, 1), ("pii", False, 2), ("canary", True, 1)], "control string, enabled boolean, ts int")
    present = _controls(t).where("control <> 'canary'")
    return policy.active_controls(present, toggles).select("policy_id", "control", "enabled")


@query(
    "apply_history",
    "select event_id, cast(sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id % 10 order by ts, event_id) as bigint) as version from events",
)
def apply_history(t: Inputs) -> DataFrame:
    events = t.events.select(
        "event_id", "ts", (F.col("user_id") % 10).alias("policy_id"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("applied").alias("status"),
    )
    return policy.apply_history(events).select("event_id", "version")


@query(
    "policy_violations",
    "with u as (select user_id, count(*) as n from events group by user_id) "
    "select fault, count(*) as n from (select 'unknown model' as fault from u where n % 2 = 0 union all select 'unknown tool' from u where n % 3 = 0 "
    "union all select 'duplicate agent key' from (select user_id % 10 from u group by user_id % 10, n % 4 having count(*) > 1) x "
    "union all select 'review threshold is not below the block threshold' from u where n % 5 = 0 "
    "union all select 'kill switch names an unknown agent' from u where n % 7 = 0) y group by fault",
)
def policy_violations(t: Inputs) -> DataFrame:
    per_user = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    agents = per_user.select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("policy_id"), F.concat(F.lit("a"), "user_id").alias("agent_id"),
        (F.col("n") % 4).cast("string").alias("key_hash"),
        F.when(F.col("n") % 2 == 0, F.array(F.lit("m0"), F.concat(F.lit("x"), "user_id"))).otherwise(F.array(F.lit("m0"))).alias("allowed_models"),
        F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("t"), "user_id"))).otherwise(F.array(F.lit("read"))).alias("allowed_tools"), "n", "user_id",
    )
    ids = agents.select("policy_id").distinct()
    killed = agents.select("policy_id", F.when(F.col("n") % 7 == 0, F.concat(F.lit("z"), "user_id")).otherwise(F.col("agent_id")).alias("agent_id"))
    thresholds = agents.select("policy_id", F.when(F.col("n") % 5 == 0, 0.9).otherwise(0.3).alias("review_threshold"), F.lit(0.8).alias("block_threshold"))
    found = policy.violations(
        agents.drop("n", "user_id"), ids.withColumn("model", F.lit("m0")), ids.withColumn("tool", F.lit("read")), killed, thresholds
    )
    return found.groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "flattened_policies",
    "select event_id, 'agents.0.id' as key, concat('\"u', user_id, '\"') as value from events union all "
    "select event_id, 'controls.pii.action', concat('\"', event_type, '\"') from events union all select event_id, 'mode', '[]' from events",
)
def flattened_policies(t: Inputs) -> DataFrame:
    """Policies given as JSON, as dotted keys and scalar values."""
    body = F.concat(
        F.lit('{"agents":[{"id":"u'), "user_id", F.lit('"}],"controls":{"pii":{"action":"'), "event_type", F.lit('"}},"mode":[]}')
    )
    return policy.flatten_policies(t.events.select("event_id", body.alias("body")), "body", "event_id")


# --- catalogs -------------------------------------------------------------------------------------

LISTINGS = cte("listings")
_PINNED = f"""{LISTINGS},
pins as (select server, tool, arg_min(def_hash, observed_at) as pin from listings group by server, tool),
pinned as (select l.*, pin, def_hash <> pin as changed from listings l join pins using (server, tool)),
drifts as (select server, tool, min(observed_at) as at from pinned where changed group by server, tool),
marked as (select p.*, coalesce(p.observed_at >= d.at, false) as blocked from pinned p left join drifts d on d.server = p.server and d.tool = p.tool)"""


@query("catalog_drift", f"with {_PINNED} select page_id, server, tool, changed, blocked from marked")
def catalog_drift(t: Inputs) -> DataFrame:
    return catalog.pin_catalog(t.listings).select("page_id", "server", "tool", "changed", "blocked")


@query(
    "catalog_listing",
    f"with {_PINNED} select page_id from marked m where not blocked and not exists (select 1 from marked c where c.changed "
    "and c.server = m.server and c.listing_id = m.listing_id and c.tool = m.tool)",
)
def catalog_listing(t: Inputs) -> DataFrame:
    return catalog.conflicting_copies(catalog.pin_catalog(t.listings)).select("page_id")


def _definitions(t: Inputs) -> DataFrame:
    """One tool definition per page: its title as description, a schema, some broken or hostile."""
    n = F.col("page_id")
    schema = F.when(n % 13 == 0, F.lit("[1]")).otherwise(
        F.concat(F.lit('{"type":"object","properties":{"u":{"type":"string","description":"'),
                 F.when(n % 7 == 0, F.lit("eval(x)")).otherwise(F.lit("plain")), F.lit('"}}}'))
    )
    return t.pages.select(
        n.alias("def_id"), F.concat(F.lit("tool"), n % 5).alias("tool"),
        F.concat(F.lit("page "), F.regexp_extract("html", "<title>([A-Za-z ]*)", 1)).alias("description"), schema.alias("input_schema"),
    )


@query(
    "catalog_rejects",
    "select page_id as def_id, case when page_id % 13 = 0 then 'malformed' when page_id % 5 = 4 then 'not allowed' end as reject from pages", nulls={'reject': 'none'})
def catalog_rejects(t: Inputs) -> DataFrame:
    allowed = t.spark.createDataFrame([(f"tool{i}",) for i in range(4)], "tool string")
    return catalog.check_definitions(_definitions(t), allowed).select("def_id", "reject")


@query("hostile_definitions", "select page_id as def_id from pages where page_id % 7 = 0 and page_id % 13 <> 0")
def hostile_definitions(t: Inputs) -> DataFrame:
    return catalog.hostile_definitions(_definitions(t), InspectPolicy(feed=tuple(feed.default_rows())))


@query(
    "definition_hashes",
    "select count(distinct (page_id % 5, page_id % 13 = 0, page_id % 7 = 0, regexp_extract(html, '<title>([A-Za-z ]*)', 1))) as definitions, "
    "count(*) as listed from pages where page_id % 13 <> 0",
)
def definition_hashes(t: Inputs) -> DataFrame:
    hashed = _definitions(t).where("def_id % 13 <> 0").select(
        catalog.definition_hash(F.col("tool"), F.col("description"), F.col("input_schema")).alias("h")
    )
    return hashed.agg(F.countDistinct("h").alias("definitions"), F.count("*").alias("listed"))
