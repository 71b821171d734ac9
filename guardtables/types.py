"""Schemas and fixed values shared by all operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Actions in order of severity.
ACTIONS = ["allow", "monitor", "redact", "require_approval", "block"]

FINDING = (
    "struct<control_id:string,action:string,score:double,start:int,end:int,"
    "via:string,evidence:string,detail:string,owasp:string>"
)
FINDINGS = f"array<{FINDING}>"
VIEW = "struct<name:string,text:string,mapped:boolean,case_only:boolean>"
VIEWS = f"array<{VIEW}>"
MATCH = "struct<entity:string,value:string,start:int,end:int>"
MATCHES = f"array<{MATCH}>"

# Columns of a tool-call log.
CALLS = (
    "call_id string, ts timestamp, agent_id string, session_id string, tool string, "
    "args_json string, approval_id string, policy_hash string"
)
# Fields of an approval journal record.
APPROVALS = (
    "id string, agent_id string, tool string, args_hash string, policy_hash string, status string, "
    "created_at double, expires_at double, decided_at double, who string, consumed_at double"
)
# Known fields of a decision-log record.
DECISIONS = (
    "seq bigint, ts double, request_id string, kind string, agent_id string, session_id string, "
    "direction string, action string, summary string, "
    "primary struct<control_id:string,detail:string,action:string,score:double>, "
    "policy_hash string, policy_version int, judge string, timings_ms map<string,string>, "
    "model string, tokens_in bigint, tokens_out bigint, cost_usd double, prev string, hash string"
)
# Statuses a review can end with.
VERDICT_STATUSES = ["allow", "block", "timeout", "circuit_open", "error", "budget", "disabled"]


def severity(action: Column) -> Column:
    """0 (allow) to 4 (block); an unknown action ranks as block."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action).cast("int") - 1
    return F.when(rank < 0, F.lit(len(ACTIONS) - 1)).otherwise(rank)


def action_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), rank)


def finding(
    control_id, action, score=1.0, start=None, end=None, via="original", evidence="", detail="", owasp=""
) -> Column:
    """One finding struct; every argument may be a literal or a column."""

    def col(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        col(control_id, "string").alias("control_id"),
        col(action, "string").alias("action"),
        col(score, "double").alias("score"),
        col(start, "int").alias("start"),
        col(end, "int").alias("end"),
        col(via, "string").alias("via"),
        col(evidence, "string").alias("evidence"),
        col(detail, "string").alias("detail"),
        col(owasp, "string").alias("owasp"),
    )


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def when_finding(condition: Column, item: Column) -> Column:
    """A one-element findings array when the condition holds, else an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(item)).otherwise(no_findings())
