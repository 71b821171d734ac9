"""Queries over tool calls, requests, conversations, approvals and value flow."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import args_hash, explode_leaves
from ..operators import flow, governance, requests
from ..operators.decisions import explode_findings
from ..operators.inspect import InspectPolicy, detect
from ..session import spread
from ..sources.readers import approval_journal_lines
from .derived import Inputs, cte
from .registry import query

KEY = b"call-demo-key"
CALLS = cte("calls")

# --- policy dimensions of the derived calls -------------------------------------------------------


def _agents(t: Inputs) -> DataFrame:
    """Agents with permissions by number: every third may only look up and read."""
    number = F.substring_index("agent_id", "agent", -1).cast("int")
    return t.agents.select(
        "agent_id",
        F.when(number % 3 == 0, F.array(F.lit("lookup"), F.lit("read")))
        .otherwise(F.array(*map(F.lit, ["lookup", "read", "mail", "transfer", "note"]))).alias("allowed_tools"),
        F.when(number % 4 == 0, F.array(F.lit("m1"))).alias("allowed_models"),
        F.sha2(F.concat(F.lit("key-"), F.when(number == 7, F.lit("agent8")).otherwise(F.col("agent_id"))), 256).alias("key_hash"),
    )


def _tools(t: Inputs) -> DataFrame:
    return t.spark.createDataFrame(
        [
            ("lookup", ["secret"], False, False, []),
            ("read", ["untrusted"], False, False, []),
            ("mail", [], True, False, ["to"]),
            ("transfer", [], True, True, ["iban"]),
            ("note", [], False, False, []),
        ],
        "tool string, labels array<string>, egress boolean, irreversible boolean, target_args array<string>",
    )


def _rules(t: Inputs) -> DataFrame:
    return t.spark.createDataFrame(
        [
            ("mail", "to", "pattern", "[\\w.+-]+@bank\\.example", None),
            ("transfer", "amount", "max", None, 1000.0),
            ("note", "body", "deny", "drop table [0-9]*1", None),
        ],
        "tool string, arg string, kind string, pattern string, max_value double",
    )


def _killed(t: Inputs) -> DataFrame:
    listed = t.agents.select("agent_id").where("agent_id = 'agent5'")
    running = t.spark.createDataFrame([("agent11",), ("nobody",)], "agent_id string")
    return governance.killed_agents(t.agents, listed, running)


def _approvals(t: Inputs) -> DataFrame:
    """One approval per user, for the arguments of the user's first transfer."""
    calls = t.calls.where("tool = 'transfer' and approval_id is not null")
    first = calls.groupBy("approval_id").agg(F.min(F.struct("ts", "agent_id", "tool", "args_json", "policy_hash")).alias("c"))
    at = F.unix_micros("c.ts") / 1_000_000
    return first.select(
        F.col("approval_id").alias("id"), "c.agent_id", "c.tool", args_hash(F.col("c.args_json")).alias("args_hash"),
        "c.policy_hash", F.lit("approved").alias("status"), (at - 60).alias("created_at"), (at - 1).alias("decided_at"),
        (at + 86400 * 10).alias("expires_at"),
    )


_NUMBER = "cast(replace(agent_id, 'agent', '') as int)"
_USED = f"""
tr as (select * from calls where tool = 'transfer'),
firsts as (select approval_id, min(ts) as at, arg_min(args_json, ts) as args, arg_min(agent_id, ts) as agent from tr group by approval_id),
used as (select t.approval_id, arg_min(t.call_id, t.ts) as call_id from tr t join firsts f on f.approval_id = t.approval_id
  and t.args_json = f.args and t.agent_id = f.agent
  and epoch_us(t.ts) / 1000000.0 >= epoch_us(f.at) / 1000000.0 - 1 and epoch_us(t.ts) / 1000000.0 < epoch_us(f.at) / 1000000.0 + 864000
  where t.args_json not in ('{{"a":1,"a":2}}') and t.args_json not like '[%' group by t.approval_id)"""
_STAGED = f"""{_USED},
staged as (select c.*, case when agent_id in ('agent5', 'agent11') then 'kill_switch'
  when tool = 'other' then 'unknown'
  when {_NUMBER} % 3 = 0 and tool not in ('lookup', 'read') then 'allowlist'
  when event_id % 37 = 0 or event_id % 41 = 0 then 'args'
  when tool = 'mail' and args_json not like '%@bank.example"%' then 'rules'
  when tool = 'transfer' and cast(regexp_extract(args_json, ':([0-9]+)', 1) as int) > 1000 then 'rules'
  when tool = 'note' and regexp_matches(args_json, 'drop table [0-9]*1') then 'rules'
  when tool = 'transfer' and call_id not in (select call_id from used) then 'approval' end as stage from calls c)"""


@query("tool_call_checks", f"with {CALLS}, {_STAGED} select call_id, tool, stage from staged", nulls={'stage': 'none'})
def tool_call_checks(t: Inputs) -> DataFrame:
    return _checked(t).select("call_id", "tool", "stage")


def _checked(t: Inputs) -> DataFrame:
    used = governance.use_approvals(t.calls, _approvals(t))
    return governance.check_calls(t.calls, _agents(t), _tools(t), _rules(t), _killed(t), used)


@query(
    "tool_call_findings",
    f"with {CALLS}, {_STAGED} select concat('tools.', case stage when 'rules' then case tool when 'transfer' then 'max_value' "
    "else 'arg_pattern' end else stage end) as control_id, case stage when 'approval' then 'require_approval' else 'block' end as action, "
    "count(*) as n from staged where stage is not null group by all",
)
def tool_call_findings(t: Inputs) -> DataFrame:
    return explode_findings(_checked(t), "call_id").groupBy("control_id", "action").agg(F.count("*").alias("n"))


@query("approval_single_use", f"with {CALLS}, {_USED} select approval_id, call_id from used")
def approval_single_use(t: Inputs) -> DataFrame:
    return governance.use_approvals(t.calls, _approvals(t))


@query(
    "pending_approvals",
    f"with {CALLS}, {_STAGED} select call_id, agent_id, tool, 'pending' as status, 120.0 as ttl from staged where stage = 'approval'",
)
def pending_approvals(t: Inputs) -> DataFrame:
    return governance.pending_approvals(_checked(t), 120.0).select(
        "call_id", "agent_id", "tool", "status", F.round(F.col("expires_at") - F.col("created_at"), 3).alias("ttl")
    )


@query(
    "denied_arguments",
    f"with {CALLS} select call_id, 'body' as arg, 1 as matches from calls where tool = 'note' "
    "and regexp_matches(args_json, 'drop table [0-9]*1') and event_id % 37 <> 0 and event_id % 41 <> 0 "
    "union all select call_id, '*', 0 from calls where tool = 'note' and event_id % 37 = 0",
)
def denied_arguments(t: Inputs) -> DataFrame:
    return governance.denied_arguments(t.calls, _rules(t))


@query(
    "argument_leaves",
    f"with {CALLS}, readable as (select * from calls where event_id % 37 <> 0 and event_id % 41 <> 0 and tool <> 'transfer') "
    "select call_id, case tool when 'mail' then 'body' when 'note' then 'body.lines[0]' else 'q' end as path, false as unread from readable "
    "union all select call_id, 'body.lines[1]', false from readable where tool = 'note' "
    "union all select call_id, null, true from calls where event_id % 37 = 0",
)
def argument_leaves(t: Inputs) -> DataFrame:
    """Argument texts the detectors read; declared targets are left out, numbers are no texts, repeated keys make a call unread."""
    leaves = governance.undeclared_leaves(t.calls, _tools(t), _rules(t))
    return leaves.select("call_id", "path", F.col("fault").isNotNull().alias("unread"))


@query(
    "event_properties",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
)
def event_properties(t: Inputs) -> DataFrame:
    """Scalar leaves of the JSON properties of every event."""
    leaves = explode_leaves(spread(t.events), "props", "scalars", "event_id")
    return leaves.where("path = 'k'").select("event_id", F.col("text").cast("bigint").alias("k"))


_JOURNAL = """
j as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as pos, event_id % 4 as kind from events),
s as (select *, case when pos = 1 then 'pending' when kind = 0 then 'approved' when kind = 1 then 'denied'
  when kind = 2 then 'consumed' else 'expired' end as status from j)"""


def _journal(t: Inputs) -> DataFrame:
    """Snapshots per user: the first is pending, later ones cycle through the statuses."""
    from pyspark.sql import Window as W

    kind = F.col("event_id") % 4
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    status = (
        F.when(F.col("pos") == 1, "pending").when(kind == 0, "approved").when(kind == 1, "denied")
        .when(kind == 2, "consumed").otherwise("expired")
    )
    return t.events.withColumn("pos", pos).select(
        F.concat(F.lit("ap"), "user_id").alias("id"), F.lit("a").alias("agent_id"), F.lit("t").alias("tool"),
        F.lit("h").alias("args_hash"), F.lit("p").alias("policy_hash"), status.alias("status"),
        F.col("event_id").cast("double").alias("created_at"), (F.col("event_id") + 100.0).alias("expires_at"),
        F.lit(None).cast("double").alias("decided_at"), "pos", F.col("event_id").alias("journal_pos"),
    )


@query(
    "latest_approvals",
    f"with {_JOURNAL} select concat('ap', user_id) as id, arg_max(case when status in ('pending', 'approved') and event_id + 100 <= 5000 "
    "then 'expired' else status end, event_id) as status, max(event_id) + 100.0 as expires_at from s group by user_id",
)
def latest_approvals(t: Inputs) -> DataFrame:
    latest = governance.latest_approvals(_journal(t))
    return governance.approval_state(latest, F.lit(5000.0)).select("id", "status", "expires_at")


@query(
    "illegal_moves",
    f"with {_JOURNAL}, m as (select *, lag(status) over (partition by user_id order by event_id) as before from s) "
    "select concat('ap', user_id) as id, event_id as journal_pos, concat(before, '>', status) as move from m "
    "where before is not null and before <> status and concat(before, '>', status) not in "
    "('pending>approved', 'pending>denied', 'pending>expired', 'approved>consumed', 'approved>expired')",
)
def illegal_moves(t: Inputs) -> DataFrame:
    return governance.illegal_moves(_journal(t)).select("id", "journal_pos", "move")


@query(
    "approval_journal",
    f"with {_JOURNAL} select case when event_id % 19 = 0 then 'a required field is missing' when event_id % 19 = 1 then 'unknown status' "
    "when event_id % 19 = 2 then 'not an object with unique keys' else status end as outcome, count(*) as n from s group by 1",
)
def approval_journal(t: Inputs) -> DataFrame:
    """Journal lines read as records; broken ones are set aside with a reason."""
    fields = ["id", "agent_id", "tool", "args_hash", "policy_hash", "status", "created_at", "expires_at"]
    rows = _journal(t).withColumn("n", F.col("journal_pos") % 19)
    line = (
        F.when(F.col("n") == 0, F.to_json(F.struct(*fields[1:])))
        .when(F.col("n") == 1, F.to_json(F.struct(*[F.lit("odd").alias(c) if c == "status" else F.col(c) for c in fields])))
        .when(F.col("n") == 2, F.lit('{"id":"x","id":"y"}'))
        .otherwise(F.to_json(F.struct(*fields)))
    )
    good, bad = approval_journal_lines(rows.select(line.alias("value"), "journal_pos"))
    outcomes = good.select(F.col("status").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query("approval_list", f"with {CALLS}, {_USED} select approval_id as id from firsts where args not like '[%' and args <> '{{\"a\":1,\"a\":2}}' union all select approval_id from firsts where args like '[%' or args = '{{\"a\":1,\"a\":2}}'")
def approval_list(t: Inputs) -> DataFrame:
    return governance.list_approvals(_approvals(t), "approved").select("id")


# --- identities -----------------------------------------------------------------------------------


def _keyed(t: Inputs) -> DataFrame:
    kind = F.col("event_id") % 6
    owner = F.col("agent_id")
    return t.calls.select(
        "event_id", "agent_id",
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("key-unknown")).otherwise(F.concat(F.lit("key-"), owner)).alias("agent_key"),
        F.when(kind == 2, F.lit("agent1")).otherwise(F.lit(None)).alias("agent_header"),
        F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"),
    )


@query(
    "authenticate",
    f"with {CALLS} select event_id, case when event_id % 6 = 0 then 'auth.missing' when event_id % 6 = 1 then 'auth.invalid' "
    "when agent_id in ('agent7', 'agent8') then 'auth.invalid' when event_id % 6 = 2 and agent_id <> 'agent1' then 'auth.impersonation' "
    "else 'ok' end as result from calls",
)
def authenticate(t: Inputs) -> DataFrame:
    """Keys matched by hash; a key two agents share identifies nobody."""
    checked = governance.authenticate(_keyed(t).drop("agent_id"), _agents(t))
    result = F.coalesce(F.get("findings", F.lit(0))["control_id"], F.lit("ok"))
    return checked.select("event_id", result.alias("result"))


@query(
    "model_allowlist",
    f"with {CALLS} select event_id, event_id % 4 > 2 or ({_NUMBER} % 4 = 0 and event_id % 4 <> 1) as denied from calls",
)
def model_allowlist(t: Inputs) -> DataFrame:
    models = t.spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    checked = governance.check_models(_keyed(t).select("event_id", "agent_id", "model"), _agents(t), models)
    return checked.select("event_id", (F.size("findings") > 0).alias("denied"))


@query(
    "labelled_results",
    f"with {CALLS} select call_id, case when tool = 'lookup' then case when event_id % 2 = 0 then 'secret' else 'secret,untrusted' end "
    "when tool in ('read', 'other') then 'untrusted' else case when event_id % 2 = 0 then '' else 'untrusted' end end as labels from calls",
)
def labelled_results(t: Inputs) -> DataFrame:
    results = t.calls.select("call_id", "tool", (F.col("event_id") % 2 == 0).alias("verified"))
    return requests.label_results(results, _tools(t)).select("call_id", F.concat_ws(",", "labels").alias("labels"))


@query(
    "provenance_tokens",
    f"with {CALLS} select call_id, case when event_id % 5 = 0 then null else tool end as verified_tool from calls", nulls={'verified_tool': 'none'})
def provenance_tokens(t: Inputs) -> DataFrame:
    """Tokens issued for each call; every fifth comes back with other content."""
    signed = t.calls.withColumn(
        "token", requests.sign_call(F.col("call_id"), F.col("tool"), F.col("session_id"), F.col("agent_id"), F.col("args_json"), KEY)
    )
    content = F.when(F.col("event_id") % 5 == 0, F.concat("args_json", F.lit(" "))).otherwise(F.col("args_json"))
    tool = requests.verified_tool(F.col("token"), KEY, F.col("agent_id"), F.col("session_id"), content)
    return signed.select("call_id", tool.alias("verified_tool"))


# --- value flow -----------------------------------------------------------------------------------


def _results(t: Inputs) -> DataFrame:
    """What lookups and reads returned: a customer number or an address."""
    content = F.when(
        F.col("tool") == "lookup",
        F.concat(F.lit("customer reference "), F.lpad(F.concat(F.lit("77"), F.col("user_id")), 9, "4"), F.lit(" found")),
    ).otherwise(F.concat(F.lit("please answer to u"), "user_id", F.lit("@else.example soon")))
    return t.calls.where("tool in ('lookup', 'read')").select(
        F.col("call_id").alias("src_id"), "ts", "agent_id", "tool",
        F.when(F.col("tool") == "lookup", F.array(F.lit("secret"))).otherwise(F.array(F.lit("untrusted"))).alias("labels"),
        content.alias("content"),
    )


def _outgoing(t: Inputs) -> DataFrame:
    """Later calls; every mail body quotes the customer reference of its user in groups."""
    quoted = F.concat(
        F.lit('{"to":"u'), "user_id", F.lit('@else.example","body":"ref '),
        F.regexp_replace(F.lpad(F.concat(F.lit("77"), F.col("user_id")), 9, "4"), "(.{3})", "$1 "), F.lit('"}'),
    )
    return t.calls.withColumn("args_json", F.when(F.col("tool") == "mail", quoted).otherwise(F.col("args_json")))


_FLOW = f"""
lk as (select agent_id, user_id, min(ts) as at from calls where tool = 'lookup' group by all),
rd as (select agent_id, user_id, min(ts) as at from calls where tool = 'read' group by all),
rda as (select agent_id, min(ts) as at from calls where tool = 'read' group by all),
mails as (select *, from calls where tool = 'mail')"""


@query(
    "flow_findings",
    f"with {CALLS}, {_FLOW} select call_id, 'flow.secret_egress' as control_id from mails m where exists "
    "(select 1 from lk where lk.agent_id = m.agent_id and lk.at < m.ts and ("
    + " or ".join(
        f"strpos(concat(m.user_id, lpad(concat('77', m.user_id), 9, '4')), substr(lpad(concat('77', lk.user_id), 9, '4'), {i}, 6)) > 0"
        for i in range(1, 5)
    )
    + ")) "
    "union all select call_id, 'flow.untrusted_target' from mails m where exists "
    "(select 1 from rd where rd.agent_id = m.agent_id and rd.user_id = m.user_id and rd.at < m.ts) "
    "union all select call_id, 'flow.untrusted_before_irreversible' from calls c where tool = 'transfer' and exists "
    "(select 1 from rda where rda.agent_id = c.agent_id and rda.at < c.ts)",
)
def flow_findings(t: Inputs) -> DataFrame:
    """Values of results that come back in later calls of the same agent."""
    found = flow.check_flow(_outgoing(t), _tools(t), _results(t), b"flow-demo-key", min_chars=16)
    return found.select("call_id", "control_id")


@query(
    "session_labels",
    f"with {CALLS}, r as (select agent_id, ts, case tool when 'lookup' then 'secret' else 'untrusted' end as label from calls where tool in ('lookup', 'read')), "
    "clears as (select agent_id, arg_min(ts, case when cast(day(ts) as int) >= 15 then ts end) as at from calls group by agent_id), "
    "f as (select r.agent_id, label, r.ts >= c.at as late, min(r.ts) as first_ts, any_value(c.at) as at from r join clears c on c.agent_id = r.agent_id group by all) "
    "select c.call_id, string_agg(distinct f.label, ',' order by f.label) as labels from calls c join f on f.agent_id = c.agent_id "
    "where f.first_ts < c.ts and (f.late or c.ts < f.at) group by c.call_id",
)
def session_labels(t: Inputs) -> DataFrame:
    """Labels each agent has met so far; a clear in the middle of the month forgets them."""
    clears = t.calls.where(F.dayofmonth("ts") >= 15).groupBy("agent_id").agg(F.min("ts").alias("ts"))
    labels = flow.session_labels(t.calls, flow.label_epochs(_results(t), clears))
    return labels.select("call_id", F.concat_ws(",", "labels").alias("labels"))


@query("fingerprint_table")
def fingerprint_table(t: Inputs) -> DataFrame:
    """Keyed digests of labelled results by kind and width."""
    prints = flow.fingerprints(_results(t), b"flow-demo-key", 16)
    return prints.groupBy("kind", "width").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("digests"))


@query("governed_calls")
def governed_calls(t: Inputs) -> DataFrame:
    """Decision per call over permissions, value flow and detectors on arguments."""
    calls = _outgoing(t)
    used = governance.use_approvals(calls, _approvals(t))
    checked = governance.check_calls(calls, _agents(t), _tools(t), _rules(t), _killed(t), used)
    leaks = flow.check_flow(calls, _tools(t), _results(t), b"flow-demo-key", min_chars=16)
    texts = governance.undeclared_leaves(calls, _tools(t), _rules(t))
    found = detect(texts.select("call_id", "text"), InspectPolicy())
    decided = governance.govern(checked, leaks, explode_findings(found, "call_id"))
    return decided.groupBy("tool", "action").agg(F.count("*").alias("n"))


# --- conversations and requests --------------------------------------------------------------------


@query(
    "conversation_joined_turns",
    "select conv_id, md5(string_agg(text, ' ' order by turn)) as joined_md5 from conversations where role = 'user' group by conv_id having count(*) > 1",
)
def conversation_joined_turns(t: Inputs) -> DataFrame:
    return requests.joined_digests(t.conversations, "conv_id")


@query(
    "joined_turn_scores",
    "select conv_id, 0.0 as score from conversations where role = 'user' group by conv_id having count(*) > 1",
)
def joined_turn_scores(t: Inputs) -> DataFrame:
    scored = requests.score_joined_turns(t.conversations, "conv_id")
    return scored.select("conv_id", F.round("injection.score", 6).alias("score"))


@query(
    "session_ids",
    "select conv_id, concat('s_', left(sha256(concat('agent', conv_id % 5, '|', coalesce(arg_min(text, turn) filter (role = 'user'), ''))), 16)) as session_id "
    "from conversations group by conv_id",
)
def session_ids(t: Inputs) -> DataFrame:
    agent = F.concat(F.lit("agent"), F.col("conv_id") % 5)
    return requests.session_ids(t.conversations, "conv_id", agent).select("conv_id", "session_id")


@query("input_size", "select conv_id, sum(len(text))::bigint as chars, sum(len(text)) > 4000 as too_large from conversations group by conv_id")
def input_size(t: Inputs) -> DataFrame:
    return requests.input_size(t.conversations, "conv_id", 4000)


@query(
    "turn_sources",
    "select conv_id, turn, case role when 'assistant' then 'model' when 'tool' then 'tool' else 'user' end as source from conversations",
)
def turn_sources(t: Inputs) -> DataFrame:
    return t.conversations.select("conv_id", "turn", requests.source_of(F.col("role")).alias("source"))


@query("repeated_turns", "select n, count(*) as fingerprints from (select role, text, count(*) as n from conversations group by role, text) x group by n")
def repeated_turns(t: Inputs) -> DataFrame:
    prints = t.conversations.groupBy(requests.fingerprint(F.col("role"), F.col("text")).alias("fp")).agg(F.count("*").alias("n"))
    return prints.groupBy("n").agg(F.count("*").alias("fingerprints"))


_BODIES = [
    ('{"model":"m","messages":[{"role":"user","content":"hello"}]}', ""),
    ('{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}],"temperature":0.5,"stop":["a"]}', ""),
    ('{"model":"","messages":[{"role":"user","content":"x"}]}', "model"),
    ('{"model":"m","messages":[]}', "messages"),
    ('{"model":"m","messages":[{"role":"robot","content":"x"}]}', "message role"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"n":2}', "n must be 1"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"extra":1}', "request fields"),
    ('{"model":"m","model":"m"}', "not a JSON object with unique keys and finite numbers"),
    ('{"model":"m","messages":[{"role":"user","content":"x","tool_calls":[]}]}', "message tool_calls"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"temperature":1e999}', "not a JSON object with unique keys and finite numbers"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"tool_choice":"maybe"}', "tool_choice"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"max_tokens":0}', "output limit"),
    ('{"model":"m","messages":[{"role":"user","content":"x"}],"response_format":{"type":"json_schema"}}', "response_format"),
]


@query(
    "request_shapes",
    f"select event_id, case event_id % {len(_BODIES)} "
    + " ".join(f"when {i} then '{reason}'" for i, (_, reason) in enumerate(_BODIES))
    + " end as reasons from events",
)
def request_shapes(t: Inputs) -> DataFrame:
    """Protocol checks of request bodies, one shape per event."""
    kind = F.col("event_id") % len(_BODIES)
    body = F.coalesce(*[F.when(kind == i, F.lit(text)) for i, (text, _) in enumerate(_BODIES)])
    checked = requests.check_requests(spread(t.events).select("event_id", body.alias("body")))
    return checked.select("event_id", F.concat_ws("; ", "reject_reasons").alias("reasons"))


@query(
    "request_metadata",
    "select event_id, path, is_key from events, (values ('tools[0].function.name', false), ('tools[0].function.description', false), "
    "('tools[0].function.parameters.properties.city', true), ('tools[0].function.parameters.properties.city.description', false), ('user', false)) x(path, is_key)",
)
def request_metadata(t: Inputs) -> DataFrame:
    """Texts and names of a request, besides message contents, that a model reads."""
    body = F.concat(
        F.lit('{"model":"m","messages":[{"role":"user","content":"x"}],"tools":[{"type":"function","function":{"name":"f'), "event_id",
        F.lit('","description":"about '), "event_type",
        F.lit('","parameters":{"type":"object","properties":{"city":{"type":"string","description":"where"}}}}}],"user":"u"}'),
    )
    found = requests.metadata_texts(spread(t.events).select("event_id", body.alias("body")), "event_id")
    return found.select("event_id", "path", "is_key")


@query(
    "deep_metadata",
    "select event_id, case when event_id % 91 + 10 <= 33 then concat('tools', repeat('[0]', (event_id % 91 + 10)::int)) end as path, "
    "case when event_id % 91 + 10 > 33 then 'nested more than 32 levels' end as fault from events",
)
def deep_metadata(t: Inputs) -> DataFrame:
    """Requests nested 10 to 100 levels: a text at the bottom is read, or the request has a reason to be refused."""
    levels = (F.col("event_id") % 91 + 10).cast("int")
    body = F.concat(
        F.lit('{"model":"m","tools":'), F.repeat(F.lit("["), levels), F.lit('"'), "event_type", F.lit('"'), F.repeat(F.lit("]"), levels), F.lit("}")
    )
    found = requests.metadata_texts(spread(t.events).select("event_id", body.alias("body")), "event_id")
    return found.select("event_id", "path", "fault")
