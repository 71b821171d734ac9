"""What the operators share: texts as byte arrays, hashes of words and shingles, components of links."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
# Odd multiplier of the rolling hashes, its inverse modulo 2^64, and the constants of the finalizer.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Give memory that is no longer used back to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """The function for Arrow batches, which gives its memory back to the system at the end: workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds more than ``limit`` bytes of text, unless one text alone does."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        floor = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, floor + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each begins (one more entry at the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest one asked for is kept while it is short."""
    kept = _POWERS.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    steps = np.full(max(n, 1 << 20), base, np.uint64)
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    if len(made) <= 2 * SLICE_BYTES:
        _POWERS[base] = made
    return made[:n]


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(BASE_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of the bytes from each start up to each end."""
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(value + np.uint64(salt) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int, salt: int = 0) -> np.ndarray:
        """Hash of every run of ``size`` bytes, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        value = (self.sums[size:] - self.sums[:n]) * self.back[:n]
        return mixed(value + np.uint64((salt + size * 0xD6E8FEB86659FD93) % (1 << 64)))


# Bytes of a word: ASCII letters and digits, and all bytes of other characters.
WORD_BYTES = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and where each text's words begin.

    A word is a run of ASCII letters, digits and non-ASCII characters; null and empty texts have none.
    """
    data, at = raw(pc.utf8_lower(texts))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = WORD_BYTES[data]
    fresh = np.zeros(len(data), bool)  # a text begins here
    fresh[at[:-1][at[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh))
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:] | fresh[1:]
    ends = np.flatnonzero(inside & last) + 1
    return Rolling(data).of(starts, ends), np.searchsorted(starts, at)


# Multipliers for the places of a shingle.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and where each text's runs begin.

    A text of fewer words has one run of all of them; a text without words has none.
    """
    counts = np.diff(at)
    full = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(full)])
    owner = np.repeat(np.arange(len(counts)), full)
    first = at[:-1][owner] + (np.arange(begins[-1]) - begins[:-1][owner])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    length = np.minimum(counts, size)[owner]
    for place in range(size):
        total += np.where(place < length, padded[first + place] * PLACES[place], np.uint64(0))
    return mixed(total + length.astype(np.uint64)), begins


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed integers that Spark keeps."""
    return x.view(np.int64)


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """Smallest id reachable by links, for every id with a link: columns ``id`` and ``component_id``.

    Each round links every node to the smallest of its neighbours and itself (first the larger
    neighbours, then the smaller ones), so the number of rounds grows with the logarithm of a
    component's size. Rounds are cut at checkpoints; only their counts reach the driver. A
    node with very many neighbours is an aggregate with a map-side part and a join that adaptive
    execution can split, never a collected list. Joins are by sorted rows, as both sides lie by the same key
    already: small sides would be built in the driver for a broadcast, two a round.
    """
    edges = cut(
        links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    )
    digest = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = edges.agg(*digest).first()
    for _ in range(rounds):
        # Larger neighbours of a node go to the smallest of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Smaller neighbours of a node, and the node, go to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least.hint("merge"), "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        after = cut(small)
        found = after.agg(*digest).first()
        edges = after
        if found == before:
            break
        before = found
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.union(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
