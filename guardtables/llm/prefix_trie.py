"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of what may be shared.

A node is a distinct sequence of first turns. Each turn is reduced to 128 bits (role and text) and a prefix to a
polynomial of these, so a node is known by its depth and digest and no text travels after the first sort. A count-min
sketch of all prefix digests never counts too few: where its estimate is one, the prefix and all longer prefixes of that
conversation belong to it alone, and the rest of the conversation is emitted where it lies. Only possibly shared
prefixes (and the first single one of each conversation, which needs its parent) are grouped by a shuffle.

The sketch has eight cells for each prefix, but at most ``MOST_CELLS`` of them, as it is sent to every task. With more
prefixes than that estimates of one become rarer and more prefixes take the exact way; results do not depend on it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BASE, tidy
from .sequences import column, numbered, ordered, running

WORDS = r"[^\x20\x09-\x0D]+"
# Cells of a sketch row and of a block in which tasks report them; a cell counts up to 2.
MOST_CELLS, BLOCK = 1 << 26, 1 << 16
# Members of a piece of a list that is hashed.
PIECE = 10_000
KEY = ["depth", "p1", "p2"]
NODE = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def digests() -> tuple[Column, Column]:
    """128 bits of a turn."""
    return F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "text", "role")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation id with their digests and words; null roles and texts are empty."""
    rows = numbered(conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )).where("conv_id is not null")
    one, two = digests()
    return rows.select("*", one.alias("t1"), two.alias("t2"), F.regexp_count("text", F.lit(WORDS)).alias("words"))


def rebuilt(conversations: DataFrame, part_rows: int) -> DataFrame:
    """Ordered turns of the conversations as the contract rebuilds them, from a textless turn on: ``conv_id, t1, t2, words``.

    A conversation c takes the first h turns of c - c % 20, h = crc32(c) % 4, before its own turns after its first h.
    """
    rows = turn_rows(conversations)
    size = conversations.count()
    turns = running(
        ordered(rows, ["conv_id", "turn", "role", "text", "row_no"], ["conv_id", "t1", "t2", "words"], size, part_rows),
        "conv_id", ("t1", "t2"), BASE, ["conv_id", "t1", "t2", "words"],
    )
    turns = cut(turns.select("conv_id", "place", "t1", "t2", "words"))
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = turns.select("conv_id").distinct().select("conv_id", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    first = turns.where("conv_id % 20 = 0 and place < 3").withColumnRenamed("conv_id", "base")
    lent = ids.join(first, "base").where("place < h")
    shape = ["conv_id", "source", "place", "t1", "t2", "words"]
    parts = [
        ids.select("conv_id", F.lit(0).alias("source"), F.lit(0).cast("long").alias("place"),
                   *(F.lit(0).cast("long").alias(t) for t in ("t1", "t2")), F.lit(0).alias("words")),
        lent.withColumn("source", F.lit(1)).select(shape),
        turns.where(F.col("place") >= own).withColumn("source", F.lit(2)).select(shape),
    ]
    whole = cut(parts[0].union(parts[1]).union(parts[2]))
    return ordered(whole, ["conv_id", "source", "place"], ["conv_id", "t1", "t2", "words"], whole.count(), part_rows)


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each conversation and depth: the prefix digest (p1, p2), that of its parent (q1, q2), words, last."""
    found = running(turns, "conv_id", ("t1", "t2"), BASE, ["conv_id", "words", "part"])
    return cut(found.select(
        "conv_id", F.col("place").alias("depth"), F.col("a").alias("p1"), F.col("b").alias("p2"),
        F.col("a_before").alias("q1"), F.col("b_before").alias("q2"), F.col("words").cast("long").alias("words"), "last",
    ))


# --- count-min sketch ------------------------------------------------------------------------------------------------


def cells(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each prefix in the two rows of a sketch."""
    depth = column(batch, "depth").astype(np.uint64) * np.uint64(BASE)
    return tuple(((column(batch, p).view(np.uint64) ^ depth) % np.uint64(width)).astype(np.int64) for p in ("p1", "p2"))


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = {}
        for batch in batches:
            for row, at in enumerate(cells(batch, width)):
                places, counts = np.unique(at, return_counts=True)
                blocks = places // BLOCK
                edges = np.flatnonzero(np.diff(blocks, prepend=-1))
                for lo, hi in zip(edges, [*edges[1:], len(places)], strict=True):
                    key = (row, int(blocks[lo]))
                    kept = sketch.setdefault(key, np.zeros(BLOCK, np.uint8))
                    inside = places[lo:hi] % BLOCK
                    kept[inside] = np.minimum(kept[inside] + np.minimum(counts[lo:hi], 2), 2)
        for (row, block), kept in sketch.items():
            yield pa.RecordBatch.from_pydict({
                "line": pa.array([row], pa.int32()), "block": pa.array([block], pa.int64()),
                "cells": pa.array([packed(kept)], pa.binary()),
            })

    return run


def packed(kept: np.ndarray) -> bytes:
    """Counts 0 to 2 in two bit planes."""
    return np.packbits(kept >= 1).tobytes() + np.packbits(kept >= 2).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(2, -1)
    return planes[0] + planes[1]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the same cells, which follow each other, added up."""
    key, kept = None, None

    def closed():
        return pa.RecordBatch.from_pydict({
            "line": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int64()),
            "cells": pa.array([packed(kept)], pa.binary()),
        })

    for batch in batches:
        for row, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (row, block):
                if key is not None:
                    yield closed()
                key, kept = (row, block), np.zeros(BLOCK, np.uint8)
            kept = np.minimum(kept + unpacked(data), 2)
    if key is not None:
        yield closed()


def sketch(rows: DataFrame, width: int) -> dict[tuple[int, int], bytes]:
    """The blocks of the sketch that hold a count; two bits a cell, so at most ``width`` / 2 bytes in all."""
    blocks = rows.select("depth", "p1", "p2").mapInArrow(tidy(_counted(width)), "line int, block long, cells binary")
    merged = blocks.repartition("line", "block").sortWithinPartitions("line", "block").mapInArrow(tidy(_merged), blocks.schema)
    return {(r["line"], r["block"]): r["cells"] for r in merged.toLocalIterator()}


def screened(rows: DataFrame, most_cells: int) -> DataFrame:
    """Rows with ``shared``: false where the row before it in the conversation is known to be of this conversation alone."""
    width = BLOCK
    while width < min(8 * rows.count(), most_cells):
        width *= 2
    sent = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        whole = np.zeros((2, width), np.bool_)  # a count of two or more
        for (row, block), data in blocks.items():
            whole[row, block * BLOCK : (block + 1) * BLOCK] = np.unpackbits(np.frombuffer(data, np.uint8)[BLOCK // 8 :])
        single, group = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = cells(batch, width)
            alone = ~(whole[0][one] & whole[1][two])
            groups = column(batch, "conv_id")
            fresh = np.ones(len(groups), bool)
            fresh[1:] = groups[1:] != groups[:-1]
            fresh[0] = group is None or groups[0] != group
            run_no = np.cumsum(fresh)
            seen = np.cumsum(alone) - alone  # estimates of one before this row
            begins = np.concatenate([[0], np.flatnonzero(fresh)]) if not fresh[0] else np.flatnonzero(fresh)
            offset = run_no - (1 if fresh[0] else 0)
            tail = seen - seen[begins][offset] > 0
            if not fresh[0] and single:
                tail |= run_no == 0
            group = int(groups[-1])
            single = bool(tail[-1] or alone[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~tail)], [*batch.schema.names, "shared"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return cut(rows.mapInArrow(tidy(run), f"{schema}, shared boolean"))


# --- hashes of long lists ----------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ids, number = None, [], 0

    def closed():
        return pa.RecordBatch.from_pylist(
            [{**dict(zip(KEY, key, strict=True)), "part": part, "piece": number, "ids": ",".join(map(str, ids))}],
            pa.schema([(k, pa.int64()) for k in KEY] + [("part", pa.int32()), ("piece", pa.int64()), ("ids", pa.string())]),
        )

    for batch in batches:
        for *at, conv, part in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id", "part")), strict=True):
            if at != key or len(ids) == PIECE:
                if key is not None:
                    yield closed()
                key, ids, number = at, [], number + 1
            ids.append(conv)
    if key is not None:
        yield closed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    out = {name: [] for name in (*KEY, "ends_sha256")}

    def close():
        for name, value in zip(out, (*key, state.hexdigest()), strict=True):
            out[name].append(value)

    for batch in batches:
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if at != key:
                if key is not None:
                    close()
                key, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out["depth"]:
            yield pa.RecordBatch.from_pydict(out)
            out = {name: [] for name in out}
    if key is not None:
        close()
        yield pa.RecordBatch.from_pydict(out)


def end_hashes(ends: DataFrame, part_rows: int) -> DataFrame:
    """SHA-256 of the members' ids that end at a node, in order: pieces of the list are made in parallel, then hashed in turn."""
    rows = ordered(ends, [*KEY, "conv_id"], [*KEY, "conv_id"], ends.count(), part_rows)
    pieces = rows.mapInArrow(tidy(_pieces), "depth long, p1 long, p2 long, part int, piece long, ids string")
    in_turn = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part", "piece")
    return in_turn.mapInArrow(tidy(_hashed), "depth long, p1 long, p2 long, ends_sha256 string")


# --- the trie ----------------------------------------------------------------------------------------------------------


def with_parent(nodes: DataFrame, total: int) -> DataFrame:
    """Nodes with their parent's smallest member and size.

    Parents of more than a thousandth of all nodes, which are a thousand at most, are sent to the tasks; the rest meet
    their children by a shuffle.
    """
    parents = nodes.where("n_children > 0").select(
        F.col("depth").alias("pd"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"), "n_children",
    )
    rows = nodes.withColumn("pd", F.col("depth") - 1)
    on, hot = ["pd", "q1", "q2"], F.col("n_children") > total // 1000 + 1
    common = F.broadcast(parents.where(hot).drop("n_children"))
    near = rows.join(common, on)
    rest = rows.join(common.select(on), on, "left_anti").join(parents.where(~hot).drop("n_children"), on, "left")
    return near.unionByName(rest).drop("pd")


def prefix_trie(conversations: DataFrame, part_rows: int = 200_000, most_cells: int = MOST_CELLS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Turns of a conversation are in the order of turn (null first), then role and text; equal rows are turns of their
    own. Null roles and texts are empty; rows without a conv_id belong to no conversation. A table without conversations
    has no nodes. Other columns are not read. Conversations of any length and prefixes of any number of members are
    spread over partitions; only the list of ids that end at one node passes one task, as a stream, for its hash.
    """
    rows = screened(prefixes(rebuilt(conversations, part_rows)), most_cells)
    shared = rows.where("shared")
    nodes = cut(shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.min("words").alias("words"), F.count(F.when(F.col("last"), 1)).alias("n_ends"),
    ))
    total = nodes.count()
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    several = F.col("n_convs") > 1
    counted = nodes.join(below.agg(F.count("*").alias("below")), KEY, "left").withColumn(
        "n_children", F.when(several, F.coalesce("below", F.lit(0))).otherwise(1 - F.col("n_ends"))
    ).drop("below")
    # What a node adds to the nodes above it: a leaf, and the tokens that its other members need not repeat.
    known = cut(with_parent(cut(counted), total).withColumns({
        "leaf": F.when(several, F.col("n_children") == 0)
        .otherwise((F.col("depth") == 0) | F.coalesce(F.col("parent_convs") > 1, F.lit(False))).cast("long"),
        "own": (F.col("n_convs") - 1) * F.col("words"),
    }))
    # Each node counts for its smallest member, whose nodes are one stretch of its path: below the node they are a
    # running sum from the end of that stretch; other members of a node lie below it with all they count.
    stretch = ordered(known.withColumn("up", -F.col("depth")), ["conv_id", "up"], [*KEY, "conv_id", "own", "leaf"], total, part_rows)
    inside = running(stretch, "conv_id", ("own", "leaf"), 1, [*KEY]).select(*KEY, F.col("a").alias("own_sum"), F.col("b").alias("leaf_sum"))
    each = known.groupBy("conv_id").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")).where("own > 0 or leaf > 0")
    members = shared.select(*KEY, "conv_id").join(each, "conv_id")
    all_below = members.groupBy(*KEY).agg(F.sum("own").alias("own_all"), F.sum("leaf").alias("leaf_all"))
    mine = each.select("conv_id", F.col("own").alias("own_total"), F.col("leaf").alias("leaf_total"))
    nothing = F.lit(0).cast("long")

    def sums(part: str) -> Column:
        whole, rep, rest = (F.coalesce(F.col(f"{part}_{x}"), nothing) for x in ("all", "total", "sum"))
        return whole - rep + rest

    empty = F.sha2(F.lit("").cast("binary"), 256)
    own_id = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    grouped = (
        known.drop("own", "leaf").join(all_below, KEY, "left").join(inside, KEY, "left").join(mine, "conv_id", "left")
        .join(end_hashes(shared.where("last").select(*KEY, "conv_id"), part_rows), KEY, "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", F.when(several, sums("leaf")).otherwise(1).cast("long").alias("n_leaves"),
            sums("own").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        )
    )
    tails = rows.where("not shared").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        nothing.alias("saved_tokens"), F.when(F.col("last"), own_id).otherwise(empty).alias("ends_sha256"),
    )
    return grouped.select(NODE).union(tails.select(NODE))
