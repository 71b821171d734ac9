"""Readers that split good rows from rows with a reason, and policy tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import bind
from ..functions.jsonx import is_finite_json, is_object, parsed, without_digest, without_known_digest
from ..functions.text import encode_tags
from ..functions.windows import running_total
from ..operators.audit import check_canonical
from ..operators.governance import STATUSES
from ..operators.requests import check_requests, content_text
from ..operators.signatures import check_feed
from ..types import APPROVALS, CALLS, DECISIONS


def _split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def decision_log_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed records of JSON lines, and the lines that cannot be read with the reason.

    A line must be one object without repeated keys. The raw line and, as ``body``, the value
    without its hash are kept for verification.
    """
    value = parsed(F.col("line"))
    reason = F.when(value.isNull(), "not JSON, or a repeated key").when(
        ~F.schema_of_variant(value).startswith("OBJECT"), "not an object"
    )
    good, bad = _split(lines.select(F.col(line).alias("line")), reason)
    typed = good.withColumn("r", F.from_json("line", DECISIONS)).select(
        "r.*", "line", without_digest(F.col("line"), "hash").alias("body")
    )
    return typed, bad


def read_decision_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return decision_log_lines(spark.read.text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in order: line, position (from 1, over all files by name), complete (ends with a line break).

    Lines are counted per split of a file first; a line's position is what the splits before it hold and its place in its
    own. Only one row per split is sorted.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_row"),
    )
    splits = lines.groupBy("_file", "_block").agg(
        F.count("*").alias("_lines"), F.min("_row").alias("_first"), F.sum(F.octet_length("line") + 1).alias("_bytes"), F.max("_size").alias("_size")
    )
    in_order = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    of_file = W.partitionBy("_file")
    # A file whose last line has no line break is one byte shorter than its lines with one each.
    torn = (F.sum("_bytes").over(of_file) != F.col("_size")) & (F.col("_block") == F.max("_block").over(of_file))
    splits = splits.withColumns({"_before": F.coalesce(F.sum("_lines").over(in_order), F.lit(0)), "_torn": torn}).drop("_bytes", "_size")
    return lines.drop("_size").join(splits, ["_file", "_block"]).select(
        "line", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("position"),
        (~(F.col("_torn") & (F.col("_row") - F.col("_first") + 1 == F.col("_lines")))).alias("complete"),
    )


def read_sealed_lines(spark: SparkSession, path: str) -> DataFrame:
    """A sealed log as it lies in its files, ready for ``verify_chain``: every line has its position, also an unreadable one.

    Columns: position, complete, readable, canonical, seq, prev, hash, body (the line's canonical text without its
    digests), line. A seq must be an integer.
    """
    lines = check_canonical(numbered_lines(spark, path))
    value, seq = F.col("_value"), F.try_variant_get(F.col("_value"), "$.seq", "variant")
    read = bind(lines, "_value", F.when(F.ltrim("line").startswith("{") & is_finite_json(F.col("line")), parsed(F.col("line"))))
    read = bind(read, "_text", F.to_json(value))

    def text(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "string")

    read = bind(read, "_held", F.struct(text("prev").alias("prev"), text("hash").alias("hash")))
    body = without_known_digest(without_known_digest(F.col("_text"), "hash", F.col("_held.hash")), "prev", F.col("_held.prev"))
    return read.select(
        "position", "complete", value.isNotNull().alias("readable"), "canonical",
        F.when(F.schema_of_variant(seq) == "BIGINT", F.try_variant_get(seq, "$", "bigint")).alias("seq"), "_held.prev", "_held.hash",
        body.alias("body"), "line",
    )


def with_positions(log: DataFrame, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Add position: the rank of each record by sequence number, counted in slices of it."""
    return running_total(
        log, [], [F.col("seq"), F.col("line")], F.lit(1), F.floor(F.col("seq") / rows_per_slice), "position"
    )


CHAT = (
    "request_id string, ts timestamp, agent_key string, agent_header string, session_id string, model string, "
    "messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>,"
    "name:string,tool_call_id:string>>, body string"
)


def read_chat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chat requests as (valid requests, rejected requests with reasons)."""
    checked = check_requests(spark.read.schema(CHAT).json(path))
    return (
        checked.where(F.size("reject_reasons") == 0).drop("reject_reasons"),
        checked.where(F.size("reject_reasons") > 0),
    )


def turns_of(requests: DataFrame) -> DataFrame:
    """One row per message: request_id, turn, role, text, name, tool_call_id."""
    exploded = requests.select("request_id", F.posexplode("messages").alias("turn", "m"))
    text = F.coalesce(F.col("m.content"), content_text(F.coalesce("m.parts", F.array())), F.lit(""))
    return exploded.select("request_id", "turn", "m.role", text.alias("text"), "m.name", "m.tool_call_id")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALLS).json(path)


def approval_journal_lines(lines: DataFrame, line: str = "value", position: str = "journal_pos") -> tuple[DataFrame, DataFrame]:
    """Journal records and rejected lines; ``position`` orders snapshots of one approval."""
    record = lines.withColumn("r", F.from_json(line, APPROVALS))
    required = ["id", "agent_id", "tool", "args_hash", "policy_hash", "status", "created_at", "expires_at"]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"r.{name}").isNull()
    finite = F.col("r.created_at").between(-1e300, 1e300) & F.col("r.expires_at").between(-1e300, 1e300)
    reason = (
        F.when(~is_object(F.col(line)), "not an object with unique keys")
        .when(missing, "a required field is missing")
        .when(~F.col("r.status").isin(STATUSES), "unknown status")
        .when(~finite, "a time is not finite")
    )
    good, bad = _split(record, reason)
    return good.select("r.*", position), bad.select(line, position, "reason")


def corpus(rows: DataFrame) -> DataFrame:
    """Labelled texts with their hidden suffix written in tag characters."""
    hidden = encode_tags(F.coalesce("tags", F.lit("")))
    return rows.withColumn("text", F.concat("text", hidden))


def feed_version(feed: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The feed to use and a version row (status, count, hash, error).

    One failing row keeps the previous feed in force. The feed is small by contract, so its
    state is read once on the driver.
    """
    checked = check_feed(feed)
    facts = checked.agg(
        F.count("*").alias("count"), F.count_if(F.size("errors") > 0).alias("bad"),
        F.min(F.get("errors", F.lit(0))).alias("error"),
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.to_json(F.struct(*feed.columns))))), 256).alias("hash"),
    )
    state = facts.first()
    applied = state["count"] > 0 and state["bad"] == 0
    if not applied and previous is None:
        raise ValueError(f"invalid first feed: {state['error'] or 'empty'}")
    status = facts.select(
        F.lit("applied" if applied else "rejected").alias("status"), "count", "hash",
        F.when(F.col("count") == 0, "empty feed").otherwise(F.col("error")).alias("error"),
    )
    return (feed if applied else previous), status
