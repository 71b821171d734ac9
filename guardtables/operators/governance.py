"""Identity, tool permissions, argument rules and approvals as joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import args_hash, explode_leaves, is_object, member
from ..functions.windows import latest_before
from ..types import finding, no_findings, when_finding
from .decisions import decide_requests, downgrade

# Order of the checks of a tool call; the first stage that finds something ends them.
STAGES = ["kill_switch", "unknown", "allowlist", "args", "rules", "approval"]
# Approval statuses and the moves between them.
STATUSES = ["pending", "approved", "denied", "consumed", "expired"]
MOVES = ["pending>approved", "pending>denied", "pending>expired", "approved>consumed", "approved>expired"]
MIN_KEY_CHARS = 8


def agents_by_key(agents: DataFrame) -> DataFrame:
    """Key hash and agent, where the hash belongs to one agent only; ambiguous keys identify nobody."""
    counted = agents.where(F.col("key_hash").isNotNull()).groupBy("key_hash").agg(
        F.count("*").alias("_n"), F.min("agent_id").alias("agent_id")
    )
    return counted.where(F.col("_n") == 1).drop("_n")


def authenticate(requests: DataFrame, agents: DataFrame, require_auth: bool = True) -> DataFrame:
    """Add agent_id and findings for missing, invalid and borrowed identities.

    ``requests`` has agent_key and agent_header.
    """
    usable = F.length("agent_key") >= MIN_KEY_CHARS
    keyed = requests.withColumn("key_hash", F.when(usable, F.sha2("agent_key", 256)))
    joined = keyed.join(agents_by_key(agents), "key_hash", "left").drop("key_hash")
    has_key = F.coalesce("agent_key", F.lit("")) != ""
    header = F.coalesce("agent_header", F.lit(""))
    item = (
        F.when(
            has_key & F.col("agent_id").isNull(),
            finding("auth.invalid", "block", detail="unknown API key", owasp="LLM06"),
        )
        .when(
            ~has_key & F.lit(require_auth),
            finding("auth.missing", "block", detail="agent key required", owasp="LLM06"),
        )
        .when(
            F.col("agent_id").isNotNull() & (header != "") & (header != F.col("agent_id")),
            finding("auth.impersonation", "block", detail="agent header does not match key owner", owasp="LLM06"),
        )
    )
    return joined.withColumn("findings", F.when(item.isNotNull(), F.array(item)).otherwise(no_findings()))


def check_models(requests: DataFrame, agents: DataFrame, models: DataFrame) -> DataFrame:
    """Add findings for models that are unknown or not on the agent's list (no list means all)."""
    joined = requests.join(models.select("model", F.lit(True).alias("_known")).distinct(), "model", "left").join(
        agents.select("agent_id", "allowed_models"), "agent_id", "left"
    )
    listed = F.col("allowed_models").isNull() | F.array_contains("allowed_models", F.col("model"))
    bad = F.col("_known").isNull() | ~listed
    item = finding(
        "model.not_allowed", "block", evidence=F.left("model", F.lit(60)),
        detail=F.concat(F.lit("model '"), F.left("model", F.lit(60)), F.lit("' is not allowed")), owasp="LLM10",
    )
    return joined.withColumn("findings", when_finding(bad, item)).drop("_known", "allowed_models")


def killed_agents(agents: DataFrame, *lists: DataFrame) -> DataFrame:
    """Known agents on any of the kill lists."""
    union = lists[0].select("agent_id")
    for more in lists[1:]:
        union = union.union(more.select("agent_id"))
    return union.distinct().join(agents.select("agent_id"), "agent_id", "left_semi")


def _rule_arrays(rules: DataFrame) -> DataFrame:
    """Argument rules of a tool as one array (a policy is a small document)."""
    return rules.groupBy("tool").agg(
        F.array_sort(F.collect_list(F.struct("arg", "kind", "pattern", "max_value"))).alias("_rules")
    )


def _text_of(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _argument_findings(args: str) -> Column:
    """Findings of allowed patterns and numeric caps; both fail when the argument is missing."""

    def broken(r: Column) -> Column:
        value = member(F.col(args), r["arg"])
        text = _text_of(value)
        matches = F.regexp_like(text, F.concat(F.lit("^(?:"), r["pattern"], F.lit(")\\z")))
        kind = F.schema_of_variant(value)
        number = F.try_variant_get(value, "$", "double")
        numeric = kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL") | kind.startswith("FLOAT")
        return F.when(r["kind"] == "pattern", ~F.coalesce(matches, F.lit(False))).when(
            r["kind"] == "max", ~F.coalesce(numeric & (number <= r["max_value"]), F.lit(False))
        ).otherwise(False)

    return F.transform(
        F.filter("_rules", broken),
        lambda r: finding(
            F.when(r["kind"] == "max", "tools.max_value").otherwise("tools.arg_pattern"), "block",
            detail=F.concat(
                F.lit("Argument "), r["arg"],
                F.when(r["kind"] == "max", " must be numeric and within its limit").otherwise(
                    " does not match its allowed pattern"
                ),
            ),
            owasp="LLM06",
        ),
    )


def denied_arguments(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls and arguments in which some string, at any depth, matches a denied pattern.

    A call whose arguments cannot be read counts as denied: argument '*' with no matches.
    """
    deny = rules.where(F.col("kind") == "deny").select("tool", "arg", "pattern")
    leaves = explode_leaves(calls.join(deny.select("tool").distinct(), "tool", "left_semi"),
                            "args_json", "strings", "call_id", "tool")
    top = F.regexp_extract("path", "^([^.\\[]*)", 1)
    hits = leaves.withColumn("arg", top).join(deny, ["tool", "arg"]).where(F.regexp_like("text", F.col("pattern")))
    unread = leaves.where("fault is not null").select("call_id", F.lit("*").alias("arg"), F.lit(0).cast("long").alias("matches"))
    return hits.groupBy("call_id", "arg").agg(F.count("*").alias("matches")).unionByName(unread)


def check_calls(
    calls: DataFrame, agents: DataFrame, tools: DataFrame, rules: DataFrame, killed: DataFrame,
    approved: DataFrame | None = None,
) -> DataFrame:
    """Add stage and findings of each call: the first failing stage ends the checks.

    Every dimension is joined by key, so plans stay equi joins; ``approved`` lists the calls
    an approval covers (from ``use_approvals``).
    """
    denied = denied_arguments(calls, rules).groupBy("call_id").agg(F.array_sort(F.collect_set("arg")).alias("_denied"))
    joined = (
        calls.join(agents.select("agent_id", "allowed_tools"), "agent_id", "left")
        .join(killed.select("agent_id", F.lit(True).alias("_killed")), "agent_id", "left")
        .join(tools.select("tool", "irreversible", F.lit(True).alias("_known")), "tool", "left")
        .join(_rule_arrays(rules), "tool", "left")
        .join(denied, "call_id", "left")
    )
    joined = (
        joined.join(approved.select("call_id", F.lit(True).alias("_approved")), "call_id", "left")
        if approved is not None
        else joined.withColumn("_approved", F.lit(None).cast("boolean"))
    )

    def tool_finding(name: str, detail: str, action: str = "block") -> Column:
        return F.array(finding(f"tools.{name}", action, detail=detail, owasp="LLM06"))

    on_list = F.coalesce(F.array_contains("allowed_tools", F.col("tool")), F.lit(False))
    deny_findings = F.transform(
        F.coalesce("_denied", F.array().cast("array<string>")),
        lambda a: finding(
            "tools.arg_pattern", "block", detail=F.concat(F.lit("Argument "), a, F.lit(" matches a denied pattern")),
            owasp="LLM06",
        ),
    )
    rule_findings = F.concat(F.coalesce(_argument_findings("args_json"), no_findings()), deny_findings)
    joined = joined.withColumn("_broken", rule_findings)
    stages = [
        (F.coalesce("_killed", F.lit(False)), tool_finding("kill_switch", "Agent is stopped by the kill switch")),
        (F.col("_known").isNull(), tool_finding("unknown", "Tool is not in the policy catalog")),
        (~on_list, tool_finding("allowlist", "Tool is not allowed for this agent")),
        (~is_object(F.col("args_json")),
         tool_finding("args", "Arguments must be a valid JSON object with unique keys and finite values")),
        (F.size("_broken") > 0, F.col("_broken")),
        (F.coalesce("irreversible", F.lit(False)) & ~F.coalesce("_approved", F.lit(False)),
         tool_finding("approval", "human approval required", "require_approval")),
    ]
    stage, found = F.lit(None).cast("string"), no_findings()
    for name, (condition, items) in reversed(list(zip(STAGES, stages))):
        stage = F.when(condition, F.lit(name)).otherwise(stage)
        found = F.when(condition, items).otherwise(found)
    return joined.select(*calls.columns, stage.alias("stage"), found.alias("findings"))


def pending_approvals(checked: DataFrame, ttl_seconds: float) -> DataFrame:
    """Approval requests for the calls that stopped at the approval stage."""
    created = F.unix_micros("ts") / 1_000_000
    return checked.where(F.col("stage") == "approval").select(
        F.sha2(F.concat_ws("|", F.lit("approval"), "call_id"), 256).alias("id"), "agent_id", "tool",
        args_hash(F.col("args_json")).alias("args_hash"), "policy_hash", F.lit("pending").alias("status"),
        created.alias("created_at"), (created + ttl_seconds).alias("expires_at"), "call_id",
    )


def latest_approvals(journal: DataFrame, position: str = "journal_pos") -> DataFrame:
    """Latest snapshot of every approval in an append-only journal."""
    row = F.struct(*[c for c in journal.columns if c != "id"])
    return journal.groupBy("id").agg(F.max_by(row, position).alias("_r")).select("id", "_r.*")


def approval_state(approvals: DataFrame, as_of: Column) -> DataFrame:
    """Status at a moment (epoch seconds): open approvals expire at their deadline, inclusive."""
    lapsed = F.col("status").isin("pending", "approved") & (as_of >= F.col("expires_at"))
    return approvals.withColumn("status", F.when(lapsed, "expired").otherwise(F.col("status")))


def illegal_moves(journal: DataFrame, position: str = "journal_pos") -> DataFrame:
    """Journal rows whose status may not follow the one before, or that decide too late.

    ``position`` is an increasing number without repeats.
    """
    rows = latest_before(
        journal, ["id"], F.col(position), F.floor(F.col(position) / 100_000), F.col("status"), "_status_before"
    )
    before = F.col("_status_before")
    move = F.concat_ws(">", before, "status")
    late = F.col("status").isin("approved", "denied") & (F.col("decided_at") >= F.col("expires_at"))
    bad = F.when(before.isNull(), F.col("status") != "pending").otherwise(~move.isin(MOVES) & (before != F.col("status")))
    found = rows.withColumn("move", move).withColumn("bad", bad | F.coalesce(late, F.lit(False))).where("bad")
    return found.drop("bad", "_status_before")


def list_approvals(approvals: DataFrame, status: str | None = None) -> DataFrame:
    """Approvals by status, newest first."""
    chosen = approvals if status is None else approvals.where(F.col("status") == status)
    return chosen.orderBy(F.desc("created_at"), "id")


def use_approvals(calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """Calls covered by an approval, each approval used once by its first matching call.

    A call matches on the approval id, agent, tool, arguments and policy, from the decision
    until just before the deadline. The first call is an aggregate, not a ranked window, so
    an approval id named by very many calls is combined before the shuffle.
    """
    # Only an object can have been approved.
    named = calls.where(F.col("approval_id").isNotNull() & is_object(F.col("args_json")))
    wanted = named.select(
        "call_id", "ts", F.col("approval_id").alias("id"), "agent_id", "tool", "policy_hash",
        args_hash(F.col("args_json")).alias("args_hash"),
    )
    granted = approvals.where(F.col("status") == "approved").select(
        "id", "agent_id", "tool", "args_hash", "policy_hash", "decided_at", "expires_at"
    )
    at = F.unix_micros("ts") / 1_000_000
    matched = wanted.join(granted, ["id", "agent_id", "tool", "args_hash", "policy_hash"]).where(
        (at >= F.col("decided_at")) & (at < F.col("expires_at"))
    )
    first = matched.groupBy("id").agg(F.min(F.struct("ts", "call_id")).alias("_first"))
    return first.select(F.col("id").alias("approval_id"), F.col("_first.call_id").alias("call_id"))


def undeclared_leaves(calls: DataFrame, tools: DataFrame, rules: DataFrame) -> DataFrame:
    """Argument texts the detectors should read; declared targets and patterned arguments are left alone.

    Arguments that cannot be read are one row with ``fault`` and no text.
    """
    targets = tools.select("tool", F.explode("target_args").alias("arg"))
    patterned = rules.where(F.col("kind") == "pattern").select("tool", "arg")
    declared = targets.union(patterned).distinct()
    leaves = explode_leaves(calls, "args_json", "strings", "call_id", "agent_id", "tool")
    return leaves.withColumn("arg", F.regexp_extract("path", "^([^.\\[]*)", 1)).join(
        declared, ["tool", "arg"], "left_anti"
    )


def govern(
    checked: DataFrame, flow: DataFrame, detected: DataFrame, monitor_only: bool = False
) -> DataFrame:
    """Decision per call over flow, tool and detector findings (flow explains first).

    ``flow`` and ``detected`` are long findings with call_id. An approved call satisfies flow
    findings that ask for approval; a block always wins and leaves no approval open.
    """
    columns = ["call_id", "control_id", "action", "score", "start", "end", "via", "evidence", "detail", "owasp"]
    own = checked.select("call_id", F.explode("findings").alias("f")).select("call_id", "f.*")

    def soften(long: DataFrame) -> DataFrame:
        item = F.struct(*[F.col(c) for c in columns[1:]])
        return long.select("call_id", F.explode(downgrade(F.array(item), F.lit(monitor_only))).alias("f")).select(
            "call_id", "f.*"
        )

    passed = checked.where(F.col("stage").isNull() & F.col("approval_id").isNotNull()).select(
        "call_id", F.lit(True).alias("_ok")
    )
    flow = flow.select(*columns).join(passed, "call_id", "left").where(
        ~(F.coalesce("_ok", F.lit(False)) & (F.col("action") == "require_approval"))
    ).drop("_ok")
    every = None
    for order, part in enumerate((flow, own.select(*columns), detected.select(*columns))):
        part = soften(part).withColumn("segment_ord", F.lit(order))
        every = part if every is None else every.unionByName(part)
    decided = decide_requests(checked.select("call_id", "agent_id", "tool"), every, "call_id", "segment_ord")
    return decided.withColumn("wants_approval", F.col("action") == "require_approval")
