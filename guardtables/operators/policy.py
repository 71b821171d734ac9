"""Policies as flat tables: overlays, differences, posture, coverage, consistency."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import running_total

# Weight and OWASP tags of each control.
CONTROLS = [
    ("prompt_injection", 18, ["LLM01"]),
    ("pii", 14, ["LLM02"]),
    ("secrets", 14, ["LLM02"]),
    ("signatures", 8, ["LLM03", "LLM05"]),
    ("canary", 4, ["LLM07"]),
    ("loop", 4, ["LLM10"]),
    ("flow", 14, ["LLM06"]),
    ("semantic", 8, ["LLM01"]),
    ("auth", 6, ["LLM06"]),
    ("budgets", 6, ["LLM10"]),
    ("approvals", 4, ["LLM06"]),
]
# Controls a global monitor mode weakens, and how much monitoring is worth.
DETECTORS = ["prompt_injection", "pii", "secrets", "signatures", "canary", "loop", "semantic"]
MONITOR_FACTOR = 0.3
# Penalties and grades.
PENALTIES = {"fail_open": 2, "breaker_open": 3, "bad_chain": 10, "failing_tests": 5}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
# Categories, the controls behind them, and whether those can only cover a part.
OWASP = [
    ("LLM01", "Prompt Injection", ["prompt_injection", "semantic"], False),
    ("LLM02", "Sensitive Information Disclosure", ["pii", "secrets"], False),
    ("LLM03", "Supply Chain", ["signatures"], True),
    ("LLM04", "Data and Model Poisoning", [], True),
    ("LLM05", "Improper Output Handling", ["signatures"], True),
    ("LLM06", "Excessive Agency", ["flow", "auth", "approvals"], False),
    ("LLM07", "System Prompt Leakage", ["canary"], True),
    ("LLM08", "Vector and Embedding Weaknesses", [], True),
    ("LLM09", "Misinformation", [], True),
    ("LLM10", "Unbounded Consumption", ["loop", "budgets"], False),
]


def _dotted(value, prefix: str = "") -> list[tuple[str, str]]:
    if isinstance(value, (dict, list)) and value:
        items = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in items for x in _dotted(v, f"{prefix}.{k}" if prefix else str(k))]
    return [(prefix, json.dumps(value, sort_keys=True))]


def flatten_policies(policies: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """Rows (key, value) of policies given as JSON; keys are dotted paths, values JSON scalars."""

    def batch(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"key": k, "value": v} for k, v in _dotted(json.loads(b))])

    flat = F.pandas_udf(batch, "array<struct<key:string,value:string>>")
    return policies.select(*keep, F.explode(flat(F.col(body))).alias("kv")).select(*keep, "kv.key", "kv.value")


def overlay(base: DataFrame, profile: DataFrame, *keys: str) -> DataFrame:
    """Base rows overlaid by profile rows: the profile wins, a replaced list is replaced whole.

    Both are flat (key, value) rows. Base rows below a list or scalar that the profile sets
    are dropped: list items have a number in their path.
    """
    on = [*keys, "key"]
    owner = F.regexp_replace("key", "\\.[0-9]+(?:\\..*)?$", "")
    lists = profile.where(F.col("key") != owner).select(*keys, owner.alias("_list")).distinct()
    kept = base.withColumn("_list", owner).join(lists, [*keys, "_list"], "left_anti").drop("_list")
    merged = kept.select(*on, F.col("value").alias("_b"), F.lit(True).alias("_in_b")).join(
        profile.select(*on, F.col("value").alias("_p"), F.lit(True).alias("_in_p")), on, "full"
    )
    return merged.select(*on, F.when(F.col("_in_p"), F.col("_p")).otherwise(F.col("_b")).alias("value"))


def diff(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Flattened keys whose values differ; profile definitions are ignored."""
    on = [*keys, "key"]
    a, b = old.select(*on, F.col("value").alias("old_value")), new.select(*on, F.col("value").alias("new_value"))
    return a.join(b, on, "full").where(
        ~F.col("old_value").eqNullSafe(F.col("new_value")) & ~F.col("key").startswith("profiles")
    )


def history_diff(flat: DataFrame) -> DataFrame:
    """Changed keys of each version against the version before: (policy_id, version, key, old, new).

    Versions of a policy are numbered without gaps and joined to the next number, so a long
    history is not one window.
    """
    old = flat.select("policy_id", (F.col("version") + 1).alias("version"), "key", "value")
    last = flat.groupBy("policy_id").agg(F.max("version").alias("_last"), F.min("version").alias("_first"))
    changed = diff(old, flat, "policy_id", "version").join(last, "policy_id")
    return changed.where((F.col("version") <= F.col("_last")) & (F.col("version") > F.col("_first"))).drop("_last", "_first")


def apply_history(events: DataFrame) -> DataFrame:
    """Version number of each applied policy; rejected events keep the version in force."""
    applied = (F.col("status") == "applied").cast("int")
    return running_total(
        events, ["policy_id"], [F.col("ts"), F.col("event_id")], applied, F.date_trunc("hour", "ts"), "version"
    )


def active_controls(controls: DataFrame, toggles: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Every control of every policy with its state; a missing section is off and toggles win."""
    wanted = F.array(*[F.lit(n) for n in names or [c for c, _, _ in CONTROLS]])
    every = controls.select("policy_id").distinct().withColumn("control", F.explode(wanted))
    joined = every.join(controls, ["policy_id", "control"], "left")
    if toggles is None:
        return joined.withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    latest = toggles.groupBy("control").agg(F.max_by("enabled", "ts").alias("_toggle"))
    joined = joined.join(latest, "control", "left")
    # A toggle changes a section that is there; it cannot add one.
    state = F.when(F.col("enabled").isNull(), False).otherwise(F.coalesce("_toggle", "enabled"))
    return joined.withColumn("enabled", state).drop("_toggle")


def _weights(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(CONTROLS, "control string, weight int, owasp array<string>")


def contributions(controls: DataFrame) -> DataFrame:
    """What each control adds to the posture of its policy.

    ``controls``: policy_id, mode, control, enabled, actions (its rule actions; one for most
    controls, three for flow).
    """
    factor = F.aggregate(
        "actions", F.lit(0.0), lambda a, x: a + F.when(x == "monitor", MONITOR_FACTOR).otherwise(1.0)
    ) / F.greatest(F.size("actions"), F.lit(1))
    weakened = F.when((F.col("mode") == "monitor") & F.col("control").isin(DETECTORS), MONITOR_FACTOR).otherwise(1.0)
    return (
        controls.join(_weights(controls), "control")
        .withColumn("factor", factor)
        .withColumn(
            "contribution", F.when(F.col("enabled"), F.col("weight") * F.col("factor") * weakened).otherwise(0.0)
        )
    )


def grade(score: Column) -> Column:
    result = F.lit("F")
    for floor, letter in reversed(GRADES):
        result = F.when(score >= floor, letter).otherwise(result)
    return result


def posture(controls: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Score, grade and gaps per policy.

    ``health`` (optional, one row per policy): booleans fail_open, breaker_open, bad_chain
    and failing_tests.
    """
    added = contributions(controls)
    gap = F.when(
        ~F.col("enabled"), F.concat("control", F.lit(": disabled, missing, or no applicable configuration"))
    ).when(F.col("factor") < 1, F.concat("control", F.lit(": monitor-only rules reduce protection")))
    summed = added.groupBy("policy_id").agg(
        F.sum("contribution").alias("_sum"),
        F.array_sort(F.collect_set(gap)).alias("_gaps"),
        F.max("mode").alias("mode"),
    )
    if health is None:
        summed = summed.withColumns({name: F.lit(False) for name in PENALTIES})
    else:
        summed = summed.join(health, "policy_id", "left")
    flags = {name: F.coalesce(F.col(name), F.lit(False)) for name in PENALTIES}
    penalty = sum((F.when(flags[n], p).otherwise(0) for n, p in PENALTIES.items()), F.lit(0))
    score = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_sum") - penalty)) + 0.5).cast("int")
    notes = F.concat(
        F.col("_gaps"),
        F.when(F.col("mode") == "monitor", F.array(F.lit("global monitor mode"))).otherwise(F.array().cast("array<string>")),
        F.filter(
            F.array(*[F.when(flags[n], F.lit(f"{n}: -{p}")) for n, p in PENALTIES.items()]), lambda g: g.isNotNull()
        ),
    )
    return summed.select("policy_id", score.alias("score"), grade(score).alias("grade"), notes.alias("gaps"))


def coverage(controls: DataFrame) -> DataFrame:
    """Covered, partial or gap per policy and OWASP category."""
    categories = F.array(
        *[
            F.struct(
                F.lit(i).alias("id"), F.lit(title).alias("title"), F.lit(part).alias("partial_only"),
                F.lit(name).cast("string").alias("control"),
            )
            for i, title, names, part in OWASP
            for name in names or [None]
        ]
    )
    added = contributions(controls).select("policy_id", "control", "contribution", "weight")
    wanted = controls.select("policy_id").distinct().select("policy_id", F.inline(categories))
    rated = wanted.join(added, ["policy_id", "control"], "left").groupBy("policy_id", "id", "title").agg(
        F.max(F.coalesce("contribution", F.lit(0.0))).alias("_most"),
        F.bool_and(F.coalesce(F.col("contribution") == F.col("weight"), F.lit(False))).alias("_full"),
        F.first("partial_only").alias("_part"),
    )
    status = F.when(F.col("_most") <= 0, "gap").when(F.col("_full") & ~F.col("_part"), "covered").otherwise("partial")
    return rated.select("policy_id", "id", "title", status.alias("status"))


def violations(
    agents: DataFrame, models: DataFrame, tools: DataFrame, killed: DataFrame, thresholds: DataFrame
) -> DataFrame:
    """Consistency faults: repeated ids and keys, unknown references, thresholds out of order.

    Every table has policy_id.
    """
    def repeated(column: str, name: str) -> DataFrame:
        return (
            agents.where(F.col(column).isNotNull()).groupBy("policy_id", column).agg(F.count("*").alias("n"))
            .where(F.col("n") > 1).select("policy_id", F.lit(f"duplicate agent {name}").alias("fault"),
                                          F.col(column).alias("subject"))
        )

    def unknown(listed: DataFrame, known: DataFrame, column: str, fault: str) -> DataFrame:
        return listed.join(known.select("policy_id", column), ["policy_id", column], "left_anti").select(
            "policy_id", F.lit(fault).alias("fault"), F.col(column).alias("subject")
        )

    wanted_models = agents.select("policy_id", F.explode("allowed_models").alias("model"))
    wanted_tools = agents.select("policy_id", F.explode("allowed_tools").alias("tool"))
    parts = [
        repeated("agent_id", "id"), repeated("key_hash", "key"),
        unknown(wanted_models, models, "model", "unknown model"),
        unknown(wanted_tools, tools, "tool", "unknown tool"),
        unknown(killed.select("policy_id", "agent_id"), agents, "agent_id", "kill switch names an unknown agent"),
        thresholds.where(F.col("review_threshold") >= F.col("block_threshold")).select(
            "policy_id", F.lit("review threshold is not below the block threshold").alias("fault"),
            F.col("review_threshold").cast("string").alias("subject"),
        ),
    ]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result
