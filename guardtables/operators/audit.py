"""Decision logs: sealing, verification, drills, paging and report tables."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.crypto import hmac_sha256
from ..session import cut

GENESIS = "0" * 64
# Records that are not requests, and how many rows a report lists.
NOT_REQUESTS = ["policy", "approval", "kill", "flow_state"]
REPORT_ROWS = 20


def chain_digest(prev: Column, body: Column, key: bytes, shard: Column, seq: Column) -> Column:
    """What a record is signed with: its place (shard and number), the digest before it and its text."""
    place = F.concat_ws(":", shard.cast("string"), seq.cast("string"))
    return hmac_sha256(key, F.concat(place, F.lit(":"), prev, body))


# Records folded at once: a fold copies its state at each step, so a shard is folded in parts.
FOLD = 32


def _chain(records: Column, start: Column, key: bytes) -> Column:
    """Digests of the records of a shard (structs with seq, shard and b), each over the one before."""
    none = F.array().cast("array<string>")

    def link(acc: Column, r: Column) -> Column:
        before = F.coalesce(F.get(acc["made"], F.size(acc["made"]) - 1), acc["start"])
        made = F.concat(acc["made"], F.array(chain_digest(before, r["b"], key, r["shard"], r["seq"])))
        return F.struct(acc["start"].alias("start"), made.alias("made"))

    def part(parts: Column, at: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        begin = F.struct(F.coalesce(F.get(last, F.size(last) - 1), start).alias("start"), none.alias("made"))
        made = F.aggregate(F.slice(records, at, F.lit(FOLD)), begin, link, lambda acc: acc["made"])
        return F.concat(parts, F.array(made))

    at = F.sequence(F.lit(1), F.greatest(F.size(records), F.lit(1)), F.lit(FOLD))
    return F.aggregate(at, F.array().cast("array<array<string>>"), part, F.flatten)


def seal(
    log: DataFrame, key: bytes, shard_rows: int = 1024, body: str = "body", started: DataFrame | None = None,
) -> DataFrame:
    """Add shard, prev and hash to rows (seq from 1, ``body`` is the canonical text).

    A single chain can only be written one record after another. Each shard of consecutive rows is a chain of its own,
    folded inside one group of at most ``shard_rows`` rows; ``seal_heads`` then ties the shards together. ``started``
    (shard, start) is the digest that a shard begun earlier has reached. Rows without a seq have no place in a chain:
    their shard and digests are null.
    """
    keep = [c for c in log.columns if c not in ("shard", "prev", "hash")]
    rows = log.select(*keep, F.floor((F.col("seq") - 1) / shard_rows).alias("shard"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    record = F.struct(*keep, "shard")
    shards = rows.where("seq is not null").groupBy("shard").agg(F.array_sort(F.collect_list(record), by_seq).alias("rs"))
    if started is not None:
        shards = shards.join(started.select("shard", "start"), "shard", "left")
    start = F.coalesce("start", F.lit(GENESIS)) if started is not None else F.lit(GENESIS)
    signed = F.transform("rs", lambda r: F.struct(r["seq"].alias("seq"), r["shard"].alias("shard"), r[body].alias("b")))
    made = shards.select("rs", start.alias("start"), _chain(signed, start, key).alias("made"))
    links = F.transform(
        "rs", lambda r, i: F.struct(
            r.alias("r"), F.when(i == 0, F.col("start")).otherwise(F.get("made", i - 1)).alias("prev"), F.get("made", i).alias("hash")
        )
    )
    sealed = made.select(F.explode(links).alias("l")).select("l.r.*", "l.prev", "l.hash")
    none = F.lit(None).cast("string")
    return sealed.unionByName(rows.where("seq is null").withColumns({"prev": none, "hash": none}))


def seal_heads(sealed: DataFrame, key: bytes, shard_rows: int = 1024, previous: DataFrame | None = None) -> DataFrame:
    """Head of every shard, sealed again level by level until one root is left: level, node, hash, count.

    Level 0 holds the shard heads; each further level chains ``shard_rows`` heads of the one below, so the number of
    levels is the logarithm of the log. With ``previous``, the heads of a log that ``sealed`` continues, only nodes above
    new or longer shards are made again; the result equals that of the whole log.
    """
    new = sealed.where("shard is not null").groupBy(F.col("shard").alias("node")).agg(
        F.max_by("hash", "seq").alias("hash"), F.count("*").alias("count")
    )
    if previous is not None:
        had = previous.where("level = 0").select("node", F.col("count").alias("_had"))
        new = new.join(had, "node", "left").withColumn("count", F.col("count") + F.coalesce("_had", F.lit(0))).drop("_had")
    levels, number = [], 0
    changed = cut(new.select(F.lit(0).alias("level"), "node", "hash", "count"))
    while True:
        level = changed
        if previous is not None:
            old = previous.where(F.col("level") == number).select("level", "node", "hash", "count")
            level = cut(old.join(changed.select("node"), "node", "left_anti").select("level", "node", "hash", "count").union(changed))
        levels.append(level)
        if level.limit(2).count() <= 1:
            break
        number += 1
        above = F.floor(F.col("node") / shard_rows)
        below = level.join(changed.select(above.alias("_p")).distinct(), above == F.col("_p"), "left_semi")
        chained = seal(below.select((F.col("node") + 1).alias("seq"), F.col("hash").alias("body"), "count"), key, shard_rows)
        up = chained.groupBy("shard").agg(F.max_by("hash", "seq").alias("hash"), F.sum("count").alias("count"))
        changed = cut(up.select(F.lit(number).alias("level"), F.col("shard").alias("node"), "hash", "count"))
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    return result


def sealed_lines(sealed: DataFrame) -> DataFrame:
    """One JSON line for each sealed record (seq, line): its body with seq, prev and hash, keys in order, no white space.

    The body must be what ``line_body`` made of it before sealing.
    """
    ends = F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"prev":"'), "prev", F.lit('","hash":"'), "hash", F.lit('"}'))
    return sealed.select("seq", "shard", F.to_json(F.parse_json(ends)).alias("line"))


def line_body(body: Column, seq: Column) -> Column:
    """The canonical text of a JSON object with its seq: what a line holds besides its digests."""
    text = F.to_json(F.parse_json(body))
    joint = F.when(text == "{}", "{").otherwise(F.concat(F.left(text, F.length(text) - 1), F.lit(",")))
    return F.to_json(F.parse_json(F.concat(joint, F.lit('"seq":'), seq.cast("string"), F.lit("}"))))


@F.pandas_udf(BooleanType())
def _is_canonical(lines: pd.Series) -> pd.Series:
    def same(line: str | None) -> bool:
        try:
            value = json.loads(line)
            text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            return text == line
        except (TypeError, ValueError):
            return False

    return lines.map(same).astype(bool)


def check_canonical(lines: DataFrame, line: str = "line", out: str = "canonical") -> DataFrame:
    """Add whether a raw line is byte for byte the canonical form of its JSON value."""
    return lines.withColumn(out, _is_canonical(F.col(line)))


# Reasons in the order they are checked.
REASONS = ["incomplete audit line", "unreadable audit", "sequence mismatch", "previous hash mismatch", "HMAC mismatch",
           "noncanonical audit line (bytes changed)"]
# Records of a slice of a log that is one chain.
SLICE = 100_000


def checked_chain(log: DataFrame, key: bytes, shard_rows: int | None = None, body: str = "body") -> DataFrame:
    """The log with ``check_ord``: the first check that a record fails, NULL for none.

    ``position`` is the place in the file (from 1). Records meet the one before them inside a shard, or inside a slice
    of a log that is one chain, whose first record meets the last one of the slice before; so the check is parallel for
    any length of log. Optional columns: ``complete``, ``readable`` and ``canonical``.
    """
    size = shard_rows or SLICE
    place = F.floor((F.col("position") - 1) / size)
    sliced = log.withColumn("_slice", place)
    inside = W.partitionBy("_slice").orderBy("position")
    rows = sliced.withColumns({"_before": F.lag("hash").over(inside), "_first": F.row_number().over(inside) == 1})
    if shard_rows:
        expected = F.when(F.col("_first"), F.lit(GENESIS)).otherwise(F.col("_before"))
    else:
        ends = sliced.groupBy((F.col("_slice") + 1).alias("_slice")).agg(F.max_by("hash", "position").alias("_end"))
        rows = rows.join(ends, "_slice", "left")
        begin = F.when(F.col("position") == 1, F.lit(GENESIS)).otherwise(F.col("_end"))
        expected = F.when(F.col("_first"), begin).otherwise(F.col("_before"))
    shard = F.col("_slice") if shard_rows else F.lit(0)
    flag = {name: F.col(name) if name in log.columns else F.lit(True) for name in ("complete", "readable", "canonical")}
    # A NULL comparison is a failed one.
    passed = [
        flag["complete"],
        flag["readable"],
        F.col("seq") == F.col("position"),
        F.col("prev") == expected,
        F.col("hash") == chain_digest(F.col("prev"), F.col(body), key, shard, F.col("seq")),
        flag["canonical"],
    ]
    order = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(i)) for i, ok in enumerate(passed)]
    )
    return rows.withColumn("check_ord", order).drop("_slice", "_before", "_first", "_end")


def _reason(check_ord: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in REASONS]), check_ord)


def chain_faults(log: DataFrame, key: bytes, shard_rows: int | None = None, body: str = "body") -> DataFrame:
    """One row per broken record: position, check order and reason."""
    return checked_chain(log, key, shard_rows, body).where("check_ord is not null").select(
        "position", "check_ord", _reason(F.col("check_ord")).alias("reason")
    )


def head_faults(log: DataFrame, heads: DataFrame, key: bytes, shard_rows: int) -> DataFrame:
    """One row per node of the heads table that the log or the level below does not bear out: level, node, reason.

    ``heads`` is what ``seal_heads`` wrote; the table is made again from the log's own digests, level by level,
    and compared node by node, so a shard that was dropped, added, cut or swapped shows.
    """
    made = seal_heads(log, key, shard_rows)
    both = heads.alias("h").join(made.alias("m"), ["level", "node"], "full")
    reason = (
        F.when(F.col("h.hash").isNull(), "no head for this node")
        .when(F.col("m.hash").isNull(), "records of this node are missing")
        .when(F.col("h.count") != F.col("m.count"), "head count mismatch")
        .when(F.col("h.hash") != F.col("m.hash"), "head hash mismatch")
    )
    return both.select("level", "node", reason.alias("reason")).where("reason is not null")


def verify_chain(
    log: DataFrame, key: bytes, shard_rows: int | None = None, head: DataFrame | None = None,
    require_head: bool = False, body: str = "body",
) -> DataFrame:
    """One row: ok, count (valid records before the first break), broken_at, reason.

    ``head`` is a one-row checkpoint (count, hash) that shows a cut-off tail; ``head_faults`` checks the heads
    of all shards.
    """
    broken = F.col("check_ord").isNotNull()
    facts = checked_chain(log, key, shard_rows, body).agg(
        F.count("*").alias("n"), F.max_by("hash", "position").alias("last"),
        F.min(F.when(broken, F.struct("position", "check_ord"))).alias("fault"),
    )
    if head is not None:
        # Two rows at most become one.
        known = head.limit(1).select(F.col("count").alias("head_count"), F.col("hash").alias("head_hash"))
        both = facts.unionByName(known, allowMissingColumns=True)
        one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    else:
        one = facts.withColumns({"head_count": F.lit(None).cast("bigint"), "head_hash": F.lit(None).cast("string")})
    tail = (
        F.when(F.col("head_count").isNull(), F.when(F.lit(require_head), "missing audit head"))
        .when(F.col("head_count") != F.col("n"), "head count mismatch (possible tail truncation)")
        .when(F.col("head_hash") != F.coalesce("last", F.lit(GENESIS)), "head hash mismatch")
    )
    reason = F.coalesce(_reason(F.col("fault.check_ord")), tail)
    count = F.when(F.col("fault").isNotNull(), F.col("fault.position") - 1).otherwise(F.col("n"))
    return one.select(
        reason.isNull().alias("ok"), count.alias("count"),
        F.when(reason.isNotNull(), count + 1).alias("broken_at"), F.coalesce(reason, F.lit("ok")).alias("reason"),
    )


def tamper(log: DataFrame, seq: int, column: str, value: Column) -> DataFrame:
    """A copy of a sealed log with one field of one record rewritten and its old hash kept."""
    return log.withColumn(column, F.when(F.col("seq") == seq, value).otherwise(F.col(column)))


def tail(log: DataFrame, n: int, **equal) -> DataFrame:
    """The newest n records with equality filters, in ascending order."""
    return _filtered(log, equal).orderBy(F.desc("seq")).limit(n).orderBy("seq")


def page(log: DataFrame, limit: int, after_seq: int | None = None, **equal) -> DataFrame:
    """The oldest ``limit`` records after a cursor, or the newest ones without a cursor."""
    if limit < 1:
        raise ValueError("page size must be positive")
    if after_seq is None:
        return tail(log, limit, **equal)
    return _filtered(log, equal).where(F.col("seq") > after_seq).orderBy("seq").limit(limit)


def _filtered(log: DataFrame, equal: dict) -> DataFrame:
    for name, value in equal.items():
        log = log.where(F.col(name).eqNullSafe(F.lit(value)))
    return log


def report(log: DataFrame, not_requests: list[str] | None = None) -> dict[str, DataFrame]:
    """Report tables: totals, counts by action, the last blocks with the reason, policy changes."""
    skipped = NOT_REQUESTS if not_requests is None else not_requests
    is_request = ~F.coalesce(F.col("kind").isin(skipped), F.lit(False))
    why = F.when(F.coalesce(F.col("primary.detail"), F.lit("")) != "", F.col("primary.detail")).otherwise(
        F.coalesce("summary", F.lit(""))
    )
    return {
        "totals": log.agg(F.count("*").alias("records"), F.count_if(is_request).alias("requests")),
        "by_action": log.where(is_request)
        .groupBy(F.coalesce("action", F.lit("unknown")).alias("action"))
        .agg(F.count("*").alias("n")),
        "blocks": tail(log.where(F.col("action") == "block"), REPORT_ROWS).select(
            "seq", "agent_id", F.coalesce("primary.control_id", F.lit("unknown")).alias("control_id"),
            why.alias("why"),
        ),
        "policy_changes": tail(log.where(F.col("kind") == "policy"), REPORT_ROWS).select("seq", "summary"),
    }


def merge_polled(batches: DataFrame, keep: int) -> DataFrame:
    """Records of overlapping polls, each sequence number once, the newest ``keep``."""
    return batches.dropDuplicates(["seq"]).orderBy(F.desc("seq")).limit(keep)


def search(log: DataFrame, text: str = "", columns: list[str] | None = None, **equal) -> DataFrame:
    """Equality filters and free-text words that must all occur, in any of the columns."""
    columns = columns or ["summary", "agent_id", "kind", "action"]
    line = F.lower(F.concat_ws(" ", *columns))
    found = _filtered(log, equal)
    for word in text.lower().split():
        found = found.where(F.contains(line, F.lit(word)))
    return found
