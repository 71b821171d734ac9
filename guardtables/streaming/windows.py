"""Event-time windows, joins and de-duplication over streams, and dimensions read per batch.

Late rows beyond the watermark are dropped by Spark and show
in the query progress as ``numRowsDroppedByWatermark``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import overhead, requests_only, was_judged


def windowed_metrics(log: DataFrame, length: str = "1 minute", late: str = "10 minutes", ts: str = "event_time") -> DataFrame:
    """Requests, reviewed requests and latency per tumbling window and action (also in batch)."""
    rows = requests_only(log)
    if log.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, length).alias("window"), F.coalesce("action", F.lit("allow")).alias("action")).agg(
        F.count("*").alias("requests"),
        F.count_if(was_judged(F.col("judge"))).alias("judged"),
        F.percentile_approx(overhead(F.col("timings_ms")), 0.5).alias("p50_ms"),
        F.percentile_approx(overhead(F.col("timings_ms")), 0.99).alias("p99_ms"),
    ).select("window.start", "action", "requests", "judged", "p50_ms", "p99_ms")


def unique_records(polled: DataFrame, late: str = "10 minutes", ts: str = "event_time") -> DataFrame:
    """Records of overlapping polls, each sequence number once."""
    return polled.withWatermark(ts, late).dropDuplicatesWithinWatermark(["seq"])


def reused_in_calls(
    prints: DataFrame, call_prints: DataFrame, remember: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Stream-stream join of value fingerprints with later calls of the same principal.

    Both sides: principal, width, digest and a time (src_ts, call_ts). State is kept for
    ``remember``; a batch over the stored fingerprints covers longer spans.
    """
    left = prints.withWatermark("src_ts", late)
    right = call_prints.withWatermark("call_ts", late).withColumnsRenamed(
        {"principal": "_p", "width": "_w", "digest": "_d"}
    )
    on = (
        (F.col("principal") == F.col("_p")) & (F.col("width") == F.col("_w")) & (F.col("digest") == F.col("_d"))
        & (F.col("call_ts") > F.col("src_ts"))
        & (F.col("call_ts") <= F.col("src_ts") + F.expr(f"INTERVAL {remember}"))
    )
    return left.join(right, on).drop("_p", "_w", "_d")


def with_live_dimension(
    stream: DataFrame,
    load: Callable[[], DataFrame],
    check: Callable[[DataFrame], bool],
    apply: Callable[[DataFrame, DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run a stream against a dimension that is read again for every batch.

    A version that cannot be read or fails its check leaves the last good one in force; the
    first version has to be good.
    """
    current: dict[str, DataFrame] = {}

    def batch(df: DataFrame, batch_id: int) -> None:
        try:
            candidate = load()
            good = check(candidate)
        except Exception:
            good = False
        if good:
            current["dim"] = candidate
        elif "dim" not in current:
            raise ValueError("the first version of the dimension is not valid")
        write(apply(df, current["dim"]), batch_id)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
