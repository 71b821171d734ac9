"""Counts, judge rate and latency percentiles of a decision log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import ACTIONS

# Records that are not requests, and how many requests the percentiles cover.
GOVERNANCE = ["policy", "approval", "kill"]
WINDOW = 500


def milliseconds(value: Column) -> Column:
    """A finite, nonnegative number; anything else counts as zero."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(number, F.lit(0.0)))


def overhead(timings: Column) -> Column:
    """Total minus upstream time; without a total, detection plus review."""
    total, upstream = F.try_element_at(timings, F.lit("total")), F.try_element_at(timings, F.lit("upstream"))
    detect, judge = F.try_element_at(timings, F.lit("detect")), F.try_element_at(timings, F.lit("judge"))
    return F.when(
        F.map_contains_key(timings, "total"),
        F.greatest(F.lit(0.0), milliseconds(total) - milliseconds(upstream)),
    ).otherwise(F.when(timings.isNull(), F.lit(0.0)).otherwise(milliseconds(detect) + milliseconds(judge)))


def was_judged(judge: Column) -> Column:
    return F.coalesce(~judge.isin("", "skipped", "disabled"), F.lit(False))


def requests_only(log: DataFrame) -> DataFrame:
    return log.where(~F.coalesce(F.col("kind").isin(GOVERNANCE), F.lit(False)))


def counts_by_action(log: DataFrame) -> DataFrame:
    """Requests per action; the known actions are always listed, unknown ones are 'other'."""
    action = F.coalesce("action", F.lit("allow"))
    known = F.when(action.isin(ACTIONS), action).otherwise("other")
    counted = requests_only(log).groupBy(known.alias("action")).agg(F.count("*").alias("n"))
    actions = log.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    return actions.join(counted, "action", "full").select("action", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_control(log: DataFrame) -> DataFrame:
    named = requests_only(log).where(F.col("primary.control_id").isNotNull())
    return named.groupBy(F.col("primary.control_id").alias("control_id")).agg(F.count("*").alias("n"))


def judge_rate(log: DataFrame) -> DataFrame:
    """Requests and the share of them that were reviewed."""
    judged = was_judged(F.col("judge")).cast("double")
    return requests_only(log).agg(
        F.count("*").alias("requests_total"), F.coalesce(F.avg(judged), F.lit(0.0)).alias("judge_rate")
    )


def latency(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """p50 and p99 of the latest requests: all, reviewed and not reviewed."""
    latest = (
        requests_only(log)
        .select("seq", overhead(F.col("timings_ms")).alias("ms"), was_judged(F.col("judge")).alias("judged"))
        .orderBy(F.desc("seq"))
        .limit(window)
    )

    def pct(q: float, rows: Column | None = None) -> Column:
        value = F.col("ms") if rows is None else F.when(rows, F.col("ms"))
        return F.round(F.coalesce(F.percentile(value, q), F.lit(0.0)), 3)

    judged = F.col("judged")
    return latest.agg(
        pct(0.5).alias("p50_ms"), pct(0.99).alias("p99_ms"),
        pct(0.5, judged).alias("p50_judge_ms"), pct(0.99, judged).alias("p99_judge_ms"),
        pct(0.5, ~judged).alias("p50_no_judge_ms"), pct(0.99, ~judged).alias("p99_no_judge_ms"),
    )


def daily_latency(log: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate p50 and p99 per day over all requests, from mergeable sketches."""
    timed = requests_only(log).select(
        F.to_date(F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).alias("day"),
        overhead(F.col("timings_ms")).alias("ms"),
    )
    return timed.groupBy("day").agg(
        F.count("*").alias("requests"),
        F.percentile_approx("ms", 0.5, accuracy).alias("p50_ms"),
        F.percentile_approx("ms", 0.99, accuracy).alias("p99_ms"),
    )


def metrics_long(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """All metrics as rows (metric, labels, value)."""

    def rows(df: DataFrame, metric: str, value: str, **labels: Column) -> DataFrame:
        pairs = [x for name, col in labels.items() for x in (F.lit(name), col)]
        tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return df.select(
            F.lit(metric).alias("metric"), tags.cast("map<string,string>").alias("labels"),
            F.col(value).cast("double").alias("value"),
        )

    timed = latency(log, window)
    parts = [
        rows(counts_by_action(log), "requests", "n", action=F.col("action")),
        rows(counts_by_control(log), "controls", "n", control=F.col("control_id")),
        rows(judge_rate(log), "requests_total", "requests_total"),
        rows(judge_rate(log), "judge_rate", "judge_rate"),
    ]
    for split, name in (("all", ""), ("yes", "judge_"), ("no", "no_judge_")):
        for q in ("p50", "p99"):
            parts.append(rows(timed, "overhead_ms", f"{q}_{name}ms", quantile=F.lit(q), judge=F.lit(split)))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result
