"""Rows of long groups in order: a group may be spread over many partitions and is never gathered in one task.

``ordered`` sorts rows by range and writes them once; a group that is longer than a partition is cut at the ends of
partitions. ``running`` gives each row its place in its group and running sums of two columns: every partition reports
one row of totals, the driver adds these up (one row per partition), and a second pass begins where the partitions
before it ended.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import powers, tidy

# Rows of one partition of an ordered table, about.
PART_ROWS = 200_000
WORD = (1 << 64) - 1


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own, ``row_no``: to be called on a table just read, where it never changes."""
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def ordered(rows: DataFrame, keys: list[str | Column], kept: list[str], size: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Columns ``kept`` of the rows in the order of ``keys``, with ``part``, the number of their partition.

    Keys should tell rows apart (see ``numbered``), so that many equal rows do not meet in one partition. The table is
    written to the checkpoint folder.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // part_rows))
    found = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return cut(found.select(*kept, F.spark_partition_id().alias("part")))


# --- running sums over groups that cross partitions ----------------------------------------------------------------


class Scan:
    """Place and running sums of rows in order; the state is the group of the last row.

    With ``base`` b the sum after n rows is v0 + v1 b + ... + v(n-1) b^(n-1) modulo 2^64, which for random v and odd b
    is a fingerprint of the sequence; with base 1 it is a plain sum.
    """

    def __init__(self, base: int, group: int | None = None, count: int = 0, sums: tuple[int, int] = (0, 0)):
        self.base, self.group, self.count, self.sums = base, group, count, sums

    def step(self, group: np.ndarray, values: tuple[np.ndarray, np.ndarray]):
        """Places, sums before and sums after each row; ``fresh`` marks the first row of a group."""
        n = len(group)
        fresh = np.ones(n, bool)
        fresh[1:] = group[1:] != group[:-1]
        goes_on = self.group is not None and group[0] == self.group
        run = np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        local = np.arange(n) - begins[run]
        factor = powers(self.base, n)[local] if self.base != 1 else np.ones(n, np.uint64)
        before, after = [], []
        for v, carried in zip(values, self.sums, strict=True):
            term = v * factor
            total = np.cumsum(term)
            inside = total - (total - term)[begins][run]
            if goes_on:
                first = run == 0
                shift = np.uint64(pow(self.base, self.count, 1 << 64))
                inside[first] = inside[first] * shift + np.uint64(carried)
                term[first] *= shift
            before.append(inside - term)
            after.append(inside)
        place = local + np.where(run == 0, self.count, 0) if goes_on else local
        if goes_on:
            fresh[0] = False
        self.group, self.count = int(group[-1]), int(place[-1]) + 1
        self.sums = (int(after[0][-1]), int(after[1][-1]))
        return place, before, after, fresh


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls."""
    return batch.column(name).to_numpy(zero_copy_only=False)


def _values(batch: pa.RecordBatch, values: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(column(batch, v).astype(np.int64).view(np.uint64) for v in values)


EDGES = (
    "part int, first_group long, first_count long, first_a long, first_b long, last_group long, last_count long, "
    "last_a long, last_b long, single boolean"
)


def _edges(group: str, values: tuple[str, str], base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, first, part = Scan(base), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = column(batch, group)
            if part is None:
                part, first_group = int(column(batch, "part")[0]), int(groups[0])
            place, _, after, fresh = scan.step(groups, _values(batch, values))
            if first is None:
                ends = np.flatnonzero(groups != first_group)
                if len(ends) and ends[0]:
                    at = ends[0] - 1
                    first = (int(place[at]) + 1, int(after[0][at]), int(after[1][at]))
                elif len(ends):
                    first = before
                before = (scan.count, *scan.sums)
        if part is None:
            return
        last = (scan.count, *scan.sums)
        numbers = [part, first_group, *(first or last), scan.group, *last]
        rows = {name.split()[0]: [x if -(1 << 63) <= x < 1 << 63 else x - (1 << 64)]
                for name, x in zip(EDGES.split(", "), numbers)}
        rows["single"] = [first is None]
        table = pa.RecordBatch.from_pydict(rows)
        yield table.set_column(0, "part", table.column(0).cast(pa.int32()))

    return run


def starts(rows: DataFrame, group: str, values: tuple[str, str], base: int) -> tuple[dict, dict]:
    """What the group that each partition begins with has had before it, and the group that follows each partition."""
    edges = rows.mapInArrow(tidy(_edges(group, values, base)), EDGES).orderBy("part").collect()
    begins, follows, carried = {}, {}, None
    for at, e in enumerate(edges):
        if at + 1 < len(edges):
            follows[e["part"]] = edges[at + 1]["first_group"]
        goes_on = carried is not None and carried[0] == e["first_group"]
        if goes_on:
            begins[e["part"]] = carried
        last = (e["last_group"], e["last_count"], e["last_a"] & WORD, e["last_b"] & WORD)
        if goes_on and e["single"]:
            shift = pow(base, carried[1], 1 << 64)
            last = (last[0], carried[1] + last[1], (carried[2] + shift * last[2]) & WORD, (carried[3] + shift * last[3]) & WORD)
        carried = last
    return begins, follows


RUNNING = "place long, a_before long, b_before long, a long, b long, last boolean"


def running(rows: DataFrame, group: str, values: tuple[str, str], base: int, kept: list[str]) -> DataFrame:
    """``kept`` columns of an ordered table with ``place`` in the group from 0, running sums and ``last`` of the group."""
    begins, follows = starts(rows, group, values, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, part = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if scan is None:
                part = int(column(batch, "part")[0])
                state = begins.get(part)
                scan = Scan(base, state[0], state[1], state[2:]) if state else Scan(base)
            groups = column(batch, group)
            place, before, after, fresh = scan.step(groups, _values(batch, values))
            last = np.zeros(len(groups), bool)
            last[:-1] = groups[1:] != groups[:-1]
            if held is not None:
                yield _closed(held, int(held[2][-1]) != int(groups[0]))
            numbers = [place.astype(np.int64), *(x.view(np.int64) for x in before), *(x.view(np.int64) for x in after)]
            held = ([batch.column(k) for k in kept] + [pa.array(x) for x in numbers], last, groups)
        if held is not None:
            yield _closed(held, follows.get(part) is None or follows[part] != int(held[2][-1]))

    def _closed(held, ends: bool) -> pa.RecordBatch:
        columns, last, _ = held
        last[-1] = ends
        names = [*kept, "place", "a_before", "b_before", "a", "b", "last"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(last)], names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(tidy(run), f"{fields}, {RUNNING}")
