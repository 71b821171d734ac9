"""Runs of characters that two sides share: hashes of all windows, and a Bloom filter probed before anything is shuffled."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Bits of a filter: ten for each hash up to this many, which bounds what goes to every task. A fuller filter passes more.
MOST_BITS = 1 << 28
BLOCK_BITS = 1 << 16


def window_hashes(text: str, width: int) -> np.ndarray:
    """A hash of every run of ``width`` characters, by its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    steps = np.full(len(codes), BASE, np.uint64)
    steps[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * np.multiply.accumulate(steps))])
    back = np.full(n, INVERSE, np.uint64)
    back[0] = 1
    value = (sums[width:] - sums[:n]) * np.multiply.accumulate(back)
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


class Bloom:
    """A Bloom filter over 64-bit hashes with three probes, kept as one byte array of bits."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        top = np.uint64(bits - 1)
        return [(h & top).astype(np.int64) for h in (hashes, hashes >> np.uint64(32), (hashes * np.uint64(BASE)) >> np.uint64(24))]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def bloom_of(hashes: DataFrame, column: str, expected: int) -> Bloom:
    """A filter of all hashes of a column: tasks set bits in blocks, blocks of the same bits are merged by shuffle."""
    bits = BLOCK_BITS
    while bits < min(10 * expected, MOST_BITS):
        bits *= 2
    size = BLOCK_BITS // 8

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(Bloom.places(values, bits)))
            for block in np.unique(at // BLOCK_BITS).tolist():
                inside = at[at // BLOCK_BITS == block] % BLOCK_BITS
                held = blocks.setdefault(block, np.zeros(size, np.uint8))
                np.bitwise_or.at(held, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        yield from map(_block, blocks.items())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if number != block:
                    if block is not None:
                        yield _block((block, held))
                    block, held = number, np.zeros(size, np.uint8)
                held |= np.frombuffer(data, np.uint8)
        if block is not None:
            yield _block((block, held))

    rows = hashes.select(column).mapInArrow(mine, "block int, data binary")
    in_order = rows.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, data binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in in_order.toLocalIterator():
        whole[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["data"], np.uint8)
    return Bloom(bits, whole.tobytes())


def _block(item: tuple[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([item[0]], pa.int32()), "data": pa.array([item[1].tobytes()])})


def runs_of(texts: DataFrame, key: str, forms: str, width: int, known: Bloom | None = None) -> DataFrame:
    """Runs of ``width`` characters of each row's texts: (key, form, pos, h, run), those that a filter may hold if one is given.

    ``form`` numbers the texts of a row; what a task holds is one batch of texts and its hits.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((known.bits, known.data.tobytes())) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(*sent.value) if sent is not None else None
        for batch in batches:
            keys = batch.column(0)
            for row, listed in enumerate(batch.column(1).to_pylist()):
                for form, text in enumerate(listed or []):
                    hashes = window_hashes(text, width)
                    at = np.flatnonzero(bloom.contains(hashes)) if bloom is not None else np.arange(len(hashes))
                    if not len(at):
                        continue
                    one = pa.array([row], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(one).take(pa.array(np.zeros(len(at), np.int32))), pa.array(np.full(len(at), form, np.int32)),
                            pa.array(at.astype(np.int32)), pa.array(hashes[at].view(np.int64)),
                            pa.array([text[i : i + width] for i in at.tolist()], pa.string()),
                        ],
                        [key, "form", "pos", "h", "run"],
                    )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(forms).alias("_forms")).mapInArrow(run, f"{key} {kind}, form int, pos int, h long, run string")
