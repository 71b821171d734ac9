"""Queries over request and decision logs: limits, spend, admission, metrics, chains, pages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import interpolated, running_total
from ..operators import audit, limits, metrics
from ..operators.decisions import explode_findings
from ..session import shared_folder
from ..sources import readers, sinks
from ..sources.readers import decision_log_lines
from ..types import severity
from .derived import Inputs, cte
from .registry import query

KEY = b"audit-demo-key"
USAGE = cte("usage")
LOG = cte("log")
HOURS = 4

# --- limits -------------------------------------------------------------------------------------


@query(
    "loop_findings",
    f"""with {USAGE}, r as (select *, row_number() over (partition by agent_id, session_id order by ts, event_id) as k from usage),
early as (select * from r where k <= 60),
rep as (select event_id, count(*) over (partition by agent_id, session_id, fingerprint order by ts
  range between interval '{HOURS * 3600 - 1}.999999 seconds' preceding and current row) as n from early)
select event_id, 'loop.session_limit' as control_id from r where k > 60
union all select event_id, 'loop.repeat' from rep where n > 1""",
)
def loop_findings(t: Inputs) -> DataFrame:
    return limits.loop_findings(t.usage, 1, HOURS * 3600.0, 60).select("event_id", "control_id")


@query(
    "rolling_usage",
    f"""with {USAGE} select event_id, agent_id, count(*) over w as requests_window, cast(sum(tokens) over w as bigint) as tokens_window
from usage window w as (partition by agent_id order by ts range between interval '3599.999999 seconds' preceding and current row)""",
)
def rolling_usage(t: Inputs) -> DataFrame:
    return limits.rolling_usage(t.usage, 3600.0).select("event_id", "agent_id", "requests_window", "tokens_window")


def _priced(t: Inputs) -> DataFrame:
    prices = {name: F.lit(value).cast("decimal(12,9)") for name, value in
              (("input", "3.00"), ("output", "15.00"), ("compute", "0.0004"))}
    return t.usage.withColumn(
        "cost", limits.cost(F.col("tokens"), F.col("tokens_out"), F.col("compute_s"), prices)
    )


_COST = ("(tokens * 3 + tokens_out * 15) / 1000000.0 + compute_s * 0.0004")


@query(
    "daily_spend",
    f"with {USAGE} select agent_id, cast(day(ts) as int) as day, round(sum({_COST}), 6) as usd_spent, "
    "round(sum(compute_s), 6) as compute_seconds from usage group by agent_id, day(ts)",
)
def daily_spend(t: Inputs) -> DataFrame:
    spent = limits.daily_spend(_priced(t))
    return spent.select(
        "agent_id", F.dayofmonth("day").alias("day"), F.round(F.col("usd_spent").cast("double"), 6).alias("usd_spent"),
        F.round("compute_seconds", 6).alias("compute_seconds"),
    )


_LIMITS = """lim as (select *, count(*) over w as rpm, cast(sum(tokens) over w as bigint) as tpm from usage
  window w as (partition by agent_id order by ts range between interval '3599.999999 seconds' preceding and current row)),
chk as (select event_id, 'budget.rpm' as control_id, rpm as v, 5 as lim from lim
  union all select event_id, 'budget.tokens_per_minute', tpm, 2500 from lim
  union all select event_id, 'budget.max_tokens', tokens, 1200 from lim)"""


@query(
    "limit_findings",
    f"with {USAGE}, {_LIMITS} select event_id, control_id, case when v > lim then 'block' else 'monitor' end as action "
    "from chk where v >= lim * 0.8",
)
def limit_findings(t: Inputs) -> DataFrame:
    rolled = limits.rolling_usage(t.usage, 3600.0)
    checks = [
        ("budget.rpm", F.col("requests_window"), F.lit(5), False),
        ("budget.tokens_per_minute", F.col("tokens_window"), F.lit(2500), False),
        ("budget.max_tokens", F.col("tokens"), F.lit(1200), False),
        ("budget.usd", F.lit(1.0), F.lit(None).cast("double"), False),
    ]
    found = rolled.withColumn("findings", limits.limit_findings(checks, F.lit(0.8)))
    return explode_findings(found, "event_id").select("event_id", "control_id", "action")


def _budgets(t: Inputs) -> DataFrame:
    """One budget row per agent that is a multiple of five, and the default."""
    own = t.agents.where(F.substring_index("agent_id", "agent", -1).try_cast("int") % 5 == 0)
    rows = own.selectExpr(
        "agent_id", "cast(0.5 as double) usd_per_day", "true usd_per_day_set", "cast(null as bigint) tokens_per_minute",
        "true tokens_per_minute_set", "cast(null as bigint) requests_per_minute", "false requests_per_minute_set",
        "cast(900 as bigint) max_tokens_per_request", "true max_tokens_per_request_set",
        "cast(null as double) compute_seconds_per_day", "false compute_seconds_per_day_set",
        "cast(null as double) warn_at", "false warn_at_set",
    )
    default = t.agents.limit(1).selectExpr(
        "'default' agent_id", "cast(2.0 as double) usd_per_day", "true usd_per_day_set",
        "cast(2000 as bigint) tokens_per_minute", "true tokens_per_minute_set",
        "cast(3 as bigint) requests_per_minute", "true requests_per_minute_set",
        "cast(1500 as bigint) max_tokens_per_request", "true max_tokens_per_request_set",
        "cast(60 as double) compute_seconds_per_day", "true compute_seconds_per_day_set",
        "cast(0.8 as double) warn_at", "true warn_at_set",
    )
    return rows.unionByName(default)


@query(
    "effective_budgets",
    f"with {cte('agents')} select agent_id, case when own then 0.5 else 2.0 end as usd_per_day, "
    "case when own then null else 2000 end as tokens_per_minute, 3 as requests_per_minute, "
    "case when own then 900 else 1500 end as max_tokens_per_request, 60.0 as compute_seconds_per_day, 0.8 as warn_at "
    "from (select agent_id, cast(replace(agent_id, 'agent', '') as int) % 5 = 0 as own from agents) a", nulls={'tokens_per_minute': -1})
def effective_budgets(t: Inputs) -> DataFrame:
    return limits.effective_budgets(t.agents, _budgets(t))


def _usage_events(t: Inputs) -> DataFrame:
    """Reserve events and, half a minute later, settlements; some reservations are released."""
    priced = _priced(t)
    rid = F.col("event_id").cast("string")
    reserve = priced.select(
        "event_id", "ts", "agent_id", F.lit("reserve").alias("kind"), rid.alias("reservation_id"), "tokens",
        (F.col("cost") * 20).cast(limits.MONEY).alias("cost"), F.lit(0.0).alias("compute_s"),
    )
    closing = priced.select(
        (F.col("event_id") + 1_000_000_000).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"),
        "agent_id", F.when(F.col("event_id") % 7 == 0, "release").otherwise("settle").alias("kind"),
        rid.alias("reservation_id"), F.floor(F.col("tokens") / 2).alias("tokens"),
        (F.col("cost") * 10).cast(limits.MONEY).alias("cost"), "compute_s",
    )
    return reserve.unionByName(closing)


@query("admission_fold")
def admission_fold(t: Inputs) -> DataFrame:
    """Sequential admission of every request under its agent's limits."""
    admitted = limits.admission(_usage_events(t), limits.effective_budgets(t.agents, _budgets(t)))
    return admitted.select(
        "event_id", "agent_id", "admitted", "requests_min", "tokens_min",
        F.round(F.col("usd_used").cast("double"), 6).alias("usd_used"), F.concat_ws(",", "blocked_by").alias("blocked_by"),
    )


@query(
    "usage_snapshot",
    f"""with {USAGE}, {cte('agents')}, ref as (select timestamp '2024-01-20 12:00:00' as now),
x as (select a.agent_id, round(coalesce(sum(case when u.ts >= timestamp '2024-01-20' then {_COST} end), 0), 6) as usd_spent,
  cast(count(case when u.ts > now - interval 1 hour then 1 end) as bigint) as requests_min,
  cast(coalesce(sum(case when u.ts > now - interval 1 hour then tokens end), 0) as bigint) as tokens_min,
  cast(replace(a.agent_id, 'agent', '') as int) % 5 = 0 as own
  from agents a cross join ref left join usage u on u.agent_id = a.agent_id and u.ts <= now group by a.agent_id)
select agent_id, usd_spent, requests_min, tokens_min, case when own then 0.5 else 2.0 end as usd_limit from x""",
)
def usage_snapshot(t: Inputs) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    held = _priced(t).where("event_id < 0")
    shown = limits.usage_snapshot(_priced(t), held, limits.effective_budgets(t.agents, _budgets(t)), now, 3600.0)
    return shown.select(
        "agent_id", F.round(F.col("usd_spent").cast("double"), 6).alias("usd_spent"), "requests_min", "tokens_min", "usd_limit"
    )


@query(
    "charged_costs",
    f"with {USAGE} select agent_id, round(sum(case when fingerprint = 'error' then 0.01 else {_COST} end), 6) as usd from usage group by agent_id",
)
def charged_costs(t: Inputs) -> DataFrame:
    status = F.when(F.col("fingerprint") == "error", "upstream_error").otherwise("ok")
    paid = limits.charged(F.col("cost"), F.lit("0.01").cast(limits.MONEY), status)
    return _priced(t).groupBy("agent_id").agg(F.round(F.sum(paid).cast("double"), 6).alias("usd"))


# --- metrics ------------------------------------------------------------------------------------


def decision_log(t: Inputs) -> DataFrame:
    """The derived log with the nested columns of a decision log."""
    timings = F.create_map(
        F.lit("total"), F.col("total_ms").cast("string"), F.lit("upstream"), F.col("upstream_ms").cast("string")
    )
    main = F.when(
        F.col("control_id").isNotNull(),
        F.struct(
            F.col("control_id"), F.concat(F.lit("found by "), "control_id").alias("detail"), F.col("action"),
            F.lit(1.0).alias("score"),
        ),
    )
    return t.log.withColumn("timings_ms", timings).withColumn("primary", main)


_REQ = "log where kind not in ('policy', 'approval', 'kill')"


@query(
    "counts_by_action",
    f"with {LOG}, a(action) as (values ('allow'), ('monitor'), ('redact'), ('require_approval'), ('block')), "
    f"c as (select case when action = 'odd' then 'other' else action end as action, count(*) as n from {_REQ} group by 1) "
    "select coalesce(a.action, c.action) as action, coalesce(n, 0) as n from a full join c on a.action = c.action",
)
def counts_by_action(t: Inputs) -> DataFrame:
    return metrics.counts_by_action(decision_log(t))


@query("counts_by_control", f"with {LOG} select control_id, count(*) as n from {_REQ} and control_id is not null group by 1")
def counts_by_control(t: Inputs) -> DataFrame:
    return metrics.counts_by_control(decision_log(t))


@query(
    "judge_rate",
    f"with {LOG} select count(*) as requests_total, avg(case when judge in ('skipped', 'disabled') then 0.0 else 1.0 end) as judge_rate from {_REQ}",
)
def judge_rate(t: Inputs) -> DataFrame:
    return metrics.judge_rate(decision_log(t))


def _latest_sql(q: float, rows: str = "true") -> str:
    return f"round(coalesce(quantile_cont(ms, {q}) filter ({rows}), 0), 3)"


_LATENCY = (
    f"with {LOG}, l as (select greatest(0, total_ms - upstream_ms) as ms, judge not in ('skipped', 'disabled') as judged from {_REQ} "
    "order by seq desc limit 500) select "
    + ", ".join(
        f"{_latest_sql(q, rows)} as {name}_{suffix}ms"
        for suffix, rows in (("", "true"), ("judge_", "judged"), ("no_judge_", "not judged"))
        for name, q in (("p50", 0.5), ("p99", 0.99))
    )
    + " from l"
)


@query("latency_percentiles", _LATENCY)
def latency_percentiles(t: Inputs) -> DataFrame:
    return metrics.latency(decision_log(t))


@query(
    "daily_latency",
    "with e as (select cast(day(ts) as int) as day, value as ms from events) select day, count(*) as n, "
    "round(quantile_cont(ms, 0.5), 6) as p50_ms, round(quantile_cont(ms, 0.99), 6) as p99_ms from e group by day",
)
def daily_latency(t: Inputs) -> DataFrame:
    """Exact percentiles of every event by day, from counted values."""
    timed = t.events.select(F.dayofmonth("ts").alias("day"), F.col("value").alias("ms"))
    got = interpolated(timed, ["day"], "ms", {"p50_ms": 0.5, "p99_ms": 0.99}, step=25.0)
    return got.select("day", "n", F.round("p50_ms", 6).alias("p50_ms"), F.round("p99_ms", 6).alias("p99_ms"))


@query("daily_latency_sketch")
def daily_latency_sketch(t: Inputs) -> DataFrame:
    return metrics.daily_latency(decision_log(t))


@query("metrics_long")
def metrics_long(t: Inputs) -> DataFrame:
    long = metrics.metrics_long(decision_log(t))
    return long.select("metric", F.to_json("labels").alias("labels"), F.round("value", 6).alias("value"))


# --- logs ---------------------------------------------------------------------------------------


@query("log_tail", f"with {LOG} select seq, agent_id, action from log where action = 'block' order by seq desc limit 50")
def log_tail(t: Inputs) -> DataFrame:
    return audit.tail(t.log, 50, action="block").select("seq", "agent_id", "action")


@query("log_page", f"with {LOG} select seq, agent_id, action from log where seq > 100 and agent_id = 'agent3' order by seq limit 25")
def log_page(t: Inputs) -> DataFrame:
    return audit.page(t.log, 25, after_seq=100, agent_id="agent3").select("seq", "agent_id", "action")


@query(
    "log_search",
    f"with {LOG} select seq, summary from log where action = 'block' and strpos(lower(summary), 'error') > 0 and strpos(lower(summary), '42') > 0",
)
def log_search(t: Inputs) -> DataFrame:
    return audit.search(t.log, "ERROR 42", ["summary"], action="block").select("seq", "summary")


@query(
    "report_totals",
    f"with {LOG} select 'records' as name, count(*) as n from log union all "
    "select 'requests', count(*) from log where kind not in ('policy', 'approval', 'kill', 'flow_state') union all "
    "select concat('action ', action), count(*) from log where kind not in ('policy', 'approval', 'kill', 'flow_state') group by action",
)
def report_totals(t: Inputs) -> DataFrame:
    parts = audit.report(decision_log(t))
    totals = parts["totals"].select(F.explode(F.create_map(F.lit("records"), "records", F.lit("requests"), "requests")).alias("name", "n"))
    actions = parts["by_action"].select(F.concat(F.lit("action "), "action").alias("name"), "n")
    return totals.unionByName(actions)


@query(
    "report_blocks",
    f"with {LOG} select seq, agent_id, control_id, concat('found by ', control_id) as why from log where action = 'block' order by seq desc limit 20",
)
def report_blocks(t: Inputs) -> DataFrame:
    return audit.report(decision_log(t))["blocks"]


@query("report_policy_changes", f"with {LOG} select seq, summary from log where kind = 'policy' order by seq desc limit 20")
def report_policy_changes(t: Inputs) -> DataFrame:
    return audit.report(decision_log(t))["policy_changes"]


@query(
    "merged_polls",
    f"with {LOG} select seq, action from log order by seq desc limit 500",
)
def merged_polls(t: Inputs) -> DataFrame:
    """Two overlapping polls merged: each record once, the newest 500."""
    polls = t.log.where("seq % 3 <> 0").unionByName(t.log.where("seq % 3 <> 1"))
    return audit.merge_polled(polls, 500).select("seq", "action")


def _body(t: Inputs) -> DataFrame:
    return t.events.select(
        (F.col("event_id") + 1).alias("seq"), F.to_json(F.struct("event_id", "event_type", "user_id", "value")).alias("body")
    )


@query("chain_verify", "select true as ok, count(*) as count, cast(null as bigint) as broken_at, 'ok' as reason from events", nulls={'broken_at': 0})
def chain_verify(t: Inputs) -> DataFrame:
    """Seal the log in shards, then verify every record and link."""
    sealed = audit.seal(_body(t), KEY).withColumn("position", F.col("seq"))
    return audit.verify_chain(sealed, KEY, 1024)


@query(
    "tamper_drill",
    "select false as ok, cast(776 as bigint) as count, cast(777 as bigint) as broken_at, 'HMAC mismatch' as reason from events limit 1",
)
def tamper_drill(t: Inputs) -> DataFrame:
    """One record edited in a copy of the sealed log; verification must find it."""
    sealed = audit.seal(_body(t), KEY).withColumn("position", F.col("seq"))
    return audit.verify_chain(audit.tamper(sealed, 777, "body", F.concat("body", F.lit(" "))), KEY, 1024)


@query(
    "deleted_record",
    "select false as ok, cast(500 as bigint) as count, cast(501 as bigint) as broken_at, 'sequence mismatch' as reason from events limit 1",
)
def deleted_record(t: Inputs) -> DataFrame:
    """One record taken out of the sealed log."""
    from ..sources.readers import with_positions

    sealed = audit.seal(_body(t), KEY).where("seq <> 501").withColumn("line", F.col("body"))
    return audit.verify_chain(with_positions(sealed, 10_000), KEY, 1024)


# --- from files to a verdict --------------------------------------------------------------------------


SHARD = 100


def _sealed(t: Inputs) -> DataFrame:
    return audit.seal(_body(t).withColumn("body", audit.line_body(F.col("body"), F.col("seq"))), KEY, SHARD)


def _sealed_lines(t: Inputs) -> DataFrame:
    """The sealed log as lines (seq, shard, line)."""
    return audit.sealed_lines(_sealed(t))


def _verdict(t: Inputs, lines: DataFrame, order: str = "seq", head: DataFrame | None = None) -> DataFrame:
    """Write lines to files, read them back by their places and verify the chain."""
    path = shared_folder(t.spark, "sealed-lines")
    sinks.write_lines(lines, path, order)
    return audit.verify_chain(readers.read_sealed_lines(t.spark, path), KEY, SHARD, head)


def _middle(t: Inputs) -> int:
    return t.events.count() // 2


@query("sealed_lines_roundtrip", "select true as ok, count(*) as count, cast(null as bigint) as broken_at, 'ok' as reason from events", nulls={"broken_at": 0})
def sealed_lines_roundtrip(t: Inputs) -> DataFrame:
    """The sealed log written as lines and verified from its files."""
    return _verdict(t, _sealed_lines(t))


@query("reordered_lines", "select false as ok, count(*) // 2 - 1 as count, count(*) // 2 as broken_at, 'sequence mismatch' as reason from events")
def reordered_lines(t: Inputs) -> DataFrame:
    """Two lines in the middle of the log change places; their records are whole."""
    at = _middle(t)
    place = F.when(F.col("seq") == at, at + 1).when(F.col("seq") == at + 1, at).otherwise(F.col("seq"))
    return _verdict(t, _sealed_lines(t).withColumn("place", place), "place")


@query("broken_line", "select false as ok, count(*) // 2 - 1 as count, count(*) // 2 as broken_at, 'unreadable audit' as reason from events")
def broken_line(t: Inputs) -> DataFrame:
    """A line in the middle of the log loses its end; the lines after it keep their places."""
    line = F.when(F.col("seq") == _middle(t), F.left("line", F.lit(40))).otherwise(F.col("line"))
    return _verdict(t, _sealed_lines(t).withColumn("line", line))


@query("swapped_shards", "select false as ok, 0 as count, 1 as broken_at, 'sequence mismatch' as reason from events limit 1")
def swapped_shards(t: Inputs) -> DataFrame:
    """The first two shards change places."""
    place = F.when(F.col("shard") == 0, F.col("seq") + SHARD).when(F.col("shard") == 1, F.col("seq") - SHARD).otherwise(F.col("seq"))
    return _verdict(t, _sealed_lines(t).withColumn("place", place), "place")


@query(
    "truncated_tail",
    "select false as ok, count(*) - 1 as count, count(*) as broken_at, 'head count mismatch (possible tail truncation)' as reason from events",
)
def truncated_tail(t: Inputs) -> DataFrame:
    """The last line is gone; a checkpoint of the head shows it."""
    # Sealed once for the head and the lines.
    path = shared_folder(t.spark, "sealed-log")
    _sealed(t).write.parquet(path)
    sealed = t.spark.read.parquet(path)
    head = sealed.agg(F.max_by("hash", "seq").alias("hash"), F.count("*").alias("count"))
    return _verdict(t, audit.sealed_lines(sealed).where(F.col("seq") < t.events.count()), head=head)


@query(
    "dropped_shard",
    "with shards as (select event_id // 100 as node, count(*) as n from events group by 1) "
    "select 0 as level, 1 as node, 'records of this node are missing' as reason "
    "union all select 1, 0, 'head count mismatch' "
    "union all select 2, 0, 'head count mismatch' from shards having count(*) > 100",
)
def dropped_shard(t: Inputs) -> DataFrame:
    """A shard is cut out of the log; the table of heads shows which."""
    sealed = audit.seal(_body(t), KEY, SHARD)
    heads = audit.seal_heads(sealed, KEY, SHARD)
    return audit.head_faults(sealed.where("shard <> 1"), heads, KEY, SHARD)


@query(
    "continued_seal",
    "select level, count(*) as nodes, true as same from ("
    "select 0 as level, event_id // 100 as node from events group by 2 union all "
    "select 1, event_id // 10000 from events group by 2 union all "
    "select 2, 0 from events having count(*) > 10000) x group by level",
)
def continued_seal(t: Inputs) -> DataFrame:
    """A log sealed in three batches has the heads of one sealed at once."""
    path, log, n = shared_folder(t.spark, "sealed-log"), _body(t), t.events.count()
    ends = [0, n // 3, n // 2 + 7, n]
    for batch, (after, upto) in enumerate(zip(ends, ends[1:])):
        sinks.append_sealed(log.where((F.col("seq") > after) & (F.col("seq") <= upto)), path, KEY, batch, SHARD)
    whole = audit.seal_heads(audit.seal(log, KEY, SHARD), KEY, SHARD)
    made = sinks.read_heads(t.spark, path, 2).alias("a").join(whole.alias("b"), ["level", "node"], "full")
    same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & F.col("a.count").eqNullSafe(F.col("b.count"))
    return made.groupBy("level").agg(F.count("*").alias("nodes"), F.bool_and(same).alias("same"))


@query(
    "sealed_heads",
    "select cast(level as int) as level, count(*) as nodes, cast(sum(n) as bigint) as records from ("
    "select 0 as level, event_id // 100 as node, count(*) as n from events group by 2 union all "
    "select 1, event_id // 10000, count(*) from events group by 2 union all "
    "select 2, 0, count(*) from events having count(*) > 10000) x "
    "where level < 2 or n > 10000 group by level",
)
def sealed_heads(t: Inputs) -> DataFrame:
    """Shard heads sealed level by level up to one root."""
    heads = audit.seal_heads(audit.seal(_body(t), KEY, 100), KEY, 100)
    return heads.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("count").alias("records"))


@query(
    "log_lines",
    "select case event_id % 50 when 0 then 'not JSON, or a repeated key' when 1 then 'not JSON, or a repeated key' "
    "when 2 then 'not an object' else 'read' end as reason, count(*) as n, cast(sum(case when event_id % 50 > 2 then event_id end) as bigint) as seqs "
    "from events group by 1", nulls={'seqs': 0})
def log_lines(t: Inputs) -> DataFrame:
    """JSON lines read as records; broken ones are set aside with a reason."""
    good = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("summary"), F.lit("block").alias("action")))
    line = (
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"seq":'), "event_id"))
        .when(F.col("event_id") % 50 == 1, F.lit('{"seq":1,"seq":2}'))
        .when(F.col("event_id") % 50 == 2, F.lit("[1]"))
        .otherwise(good)
    )
    read, broken = decision_log_lines(t.events.select(line.alias("value")))
    rows = read.select(F.lit("read").alias("reason"), "seq").unionByName(broken.select("reason", F.lit(None).cast("bigint").alias("seq")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(
    "canonical_lines",
    "select event_id % 2 = 0 as canonical, count(*) as n from events group by 1",
)
def canonical_lines(t: Inputs) -> DataFrame:
    """Lines that are byte for byte the canonical form of their value."""
    compact = F.concat(F.lit('{"a":'), "event_id", F.lit(',"b":"'), "event_type", F.lit('"}'))
    spaced = F.concat(F.lit('{"a": '), "event_id", F.lit(',"b":"'), "event_type", F.lit('"}'))
    lines = t.events.select(F.when(F.col("event_id") % 2 == 0, compact).otherwise(spaced).alias("line"))
    return audit.check_canonical(lines).groupBy("canonical").agg(F.count("*").alias("n"))


@query(
    "running_severity",
    f"with {LOG} select seq, cast(sum(case action when 'block' then 4 when 'redact' then 2 when 'monitor' then 1 when 'odd' then 4 else 0 end) "
    "over (partition by agent_id order by seq) as bigint) as total from log",
)
def running_severity(t: Inputs) -> DataFrame:
    """Running severity of each agent, summed in slices."""
    ran = running_total(
        t.log, ["agent_id"], [F.col("seq")], severity(F.col("action")), F.floor(F.col("seq") / 1000), "total"
    )
    return ran.select("seq", "total")
