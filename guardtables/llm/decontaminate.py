"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification."""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, mixed, shingles, slices, tidy, words

SHINGLE, SIMILARITY = 5, 0.8
# Fingerprints of 128 bits in 16 blocks; within RADIUS bits of each other two of them agree in some block
# up to one bit, as 16 blocks with two bits apart each would make 32.
BITS, BLOCKS, RADIUS = 128, 16, 31
# Items are sent to every task up to so many bytes of text in all; more items go in groups of that size.
ITEM_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def signs(hashes: np.ndarray) -> np.ndarray:
    """The 128 bits that each shingle votes with, as +1 and -1."""
    both = np.stack([mixed(hashes), mixed(hashes ^ np.uint64(BASE))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def packed(votes: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of votes: one byte for each block."""
    return np.packbits(votes > 0, axis=1)


LOW = np.uint64((1 << 20) - 1)
BIT_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Item:
    ids: list[int]
    n_words: int
    shingles: dict[int, float]  # of each distinct shingle its count times its weight
    total: float


class Items:
    """Benchmark items by length, with the blocks' index.

    A shingle weighs log(1 + items / items that hold it). Items of equal words are kept once with all
    their ids; items without words match nothing.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        texts = pa.array([t for _, t in rows], pa.string())
        hashes, at = words(texts)
        runs, begins = shingles(hashes, at, SHINGLE)
        same: dict[bytes, list[int]] = defaultdict(list)
        for i in range(len(rows)):
            if at[i + 1] > at[i]:
                same[hashes[at[i] : at[i + 1]].tobytes()].append(i)
        lists = [(runs[begins[g[0]] : begins[g[0] + 1]], g) for g in same.values()]
        held = Counter(s for run, _ in lists for s in set(run.tolist()))
        self.known = np.array(sorted(held), np.uint64)
        self.weights = np.array([np.log1p(len(lists) / held[int(s)]) for s in self.known])
        weight = dict(zip(self.known.tolist(), self.weights.tolist(), strict=True))
        self.low = np.zeros(1 << 20, bool)  # low bits of the known shingles
        self.low[self.known & LOW] = True
        # A shingle of no item weighs as much as one that a single item holds.
        self.other = float(np.log1p(max(1, len(lists))))
        self.items, prints = [], []
        for run, group in lists:
            counts = {s: c * weight[s] for s, c in Counter(run.tolist()).items()}
            ids = sorted(rows[i][0] for i in group)
            self.items.append(Item(ids, int(at[group[0] + 1] - at[group[0]]), counts, sum(counts.values())))
            votes = signs(run) * np.array([weight[s] for s in run.tolist()], np.float32)[:, None]
            prints.append(packed(votes.sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BLOCKS)
        # For each length one list of items for every block and value of the block: those within one bit of it.
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        near = BIT_COUNTS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        lengths: list[set[int]] = [set() for _ in self.known]
        spot = {s: i for i, s in enumerate(self.known.tolist())}
        for item in self.items:
            for shingle in item.shingles:
                lengths[spot[shingle]].add(item.n_words)
        for n in {item.n_words for item in self.items}:
            mine = np.array([i for i, item in enumerate(self.items) if item.n_words == n])
            lists = [mine[near[value, self.prints[mine, block]]] for block in range(BLOCKS) for value in range(256)]
            self.index[n] = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
        # Lengths of the items that hold a known shingle, end to end, and where each shingle's begin.
        self.lengths_at = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int64)
        self.lengths = np.array([n for x in lengths for n in sorted(x)], np.int64)

    def places(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles some item holds (their positions), and their place in the list of known ones."""
        maybe = np.flatnonzero(self.low[runs & LOW])
        spot = np.minimum(np.searchsorted(self.known, runs[maybe]), len(self.known) - 1)
        same = self.known[spot] == runs[maybe]
        return maybe[same], spot[same]

    def candidates(self, n_words: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of window and item of ``n_words`` words whose fingerprints are within the radius: none is left out."""
        at, lists = self.index[n_words]
        slot = (prints.astype(np.int64) + 256 * np.arange(BLOCKS)).ravel()
        take = at[slot + 1] - at[slot]
        found = lists[np.repeat(at[slot] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())]
        keys = np.unique(np.repeat(np.arange(len(slot)) // BLOCKS, take) * len(self.items) + found)
        pairs = np.stack([keys // len(self.items), keys % len(self.items)], axis=1)
        apart = BIT_COUNTS[prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]].sum(axis=1)
        pairs = pairs[apart <= RADIUS]
        return pairs[:, 0], pairs[:, 1]

    def similarity(self, run: np.ndarray, item: Item) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        counts = Counter(run.tolist())
        spot = np.searchsorted(self.known, np.array(list(counts), np.uint64))
        spot = np.minimum(spot, len(self.known) - 1)
        total = shared = 0.0
        for (s, c), i in zip(counts.items(), spot.tolist(), strict=True):
            w = c * (self.weights[i] if int(self.known[i]) == s else self.other)
            total += w
            shared += min(w, item.shingles.get(s, 0.0))
        return round(shared / (total + item.total - shared), 12)  # sums of equal weights may differ in the last bits

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Best window of a document for every item that reaches the similarity: id, similarity, first word, words."""
        best: dict[int, tuple[float, int]] = {}
        n = len(hashes)
        for size in {min(SHINGLE, n_words) for n_words in self.index}:
            runs, _ = shingles(hashes, np.array([0, n]), size)
            at, spot = self.places(runs)
            weight = np.full(len(runs), self.other)
            weight[at] = self.weights[spot]
            total = np.concatenate([[0], np.cumsum(weight)])
            take = self.lengths_at[spot + 1] - self.lengths_at[spot]
            first = np.repeat(self.lengths_at[spot] - np.concatenate([[0], np.cumsum(take)[:-1]]), take)
            lengths, places = self.lengths[first + np.arange(take.sum())], np.repeat(at, take)
            for n_words in np.unique(lengths).tolist():
                if min(SHINGLE, n_words) == size and n >= n_words * SIMILARITY:
                    own = np.zeros(len(runs))
                    own[places[lengths == n_words]] = weight[places[lengths == n_words]]
                    self._windows(n_words, min(n_words, n), size, runs, weight, total, own, best)
        return [
            (item_id, s, begin, min(self.items[i].n_words, n))
            for i, (s, begin) in sorted(best.items()) for item_id in self.items[i].ids
        ]

    def _windows(self, n_words, long, size, runs, weight, total, own, best) -> None:
        """Best windows of ``long`` words for the items of ``n_words`` words, into ``best``."""
        width = max(1, long - size + 1)
        # What a window shares with an item is at most its weight in shingles of such items, and the union is at
        # least its whole weight: windows below the similarity by that bound are not formed.
        shared = np.concatenate([[0], np.cumsum(own)])
        starts = np.flatnonzero(
            shared[width:] - shared[:-width] >= SIMILARITY * (total[width:] - total[:-width]) - 1e-6
        )
        for part in np.array_split(starts, len(starts) // 4096 + 1):
            if not len(part):
                continue
            first, last = int(part[0]), int(part[-1]) + width
            sums = np.zeros((last - first + 1, BITS))
            np.cumsum(signs(runs[first:last]) * weight[first:last, None], axis=0, out=sums[1:])
            prints = packed(np.round(sums[part - first + width] - sums[part - first], 6))
            for row, i in zip(*self.candidates(n_words, prints), strict=True):
                begin = int(part[row])
                found = self.similarity(runs[begin : begin + width], self.items[i])
                if found >= SIMILARITY - 1e-12 and found > best.get(int(i), (0.0, 0))[0]:
                    best[int(i)] = (found, begin)


def _matches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        sizes = {min(SHINGLE, n) for n in items.index}
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = words(part.column("text"))
                # Documents that share no shingle with any item are passed over at once.
                hit = np.zeros(len(part), bool)
                for size in sizes:
                    runs, begins = shingles(hashes, at, size)
                    found, _ = items.places(runs)
                    hit[np.searchsorted(begins, found, side="right") - 1] = True
                ids = part.column("doc_id").to_pylist()
                rows = [
                    (ids[i], *m) for i in np.flatnonzero(hit) for m in items.matches(hashes[at[i] : at[i + 1]])
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a passage like a benchmark item, with the best window for each item.

    Columns: ``doc_id``, ``item_id``, ``similarity`` (weighted Jaccard of five-word shingles, at
    least 0.8), ``first_word`` and ``n_words`` of the window. Windows are as long as the item (the whole
    document where that is a little shorter). Items of fewer than five words are one shingle and match
    their words exactly. Null and empty texts and items match nothing; items of equal words match
    together; rows with a repeated id are searched each by themselves. The work is one pass over
    the documents for each group of items that fits ``ITEM_BYTES``, without a shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null and item_id is not null").distinct()
    groups = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for group in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        made = Items([(r.item_id, r.text) for r in sorted(rows)])
        if made.items:
            part = texts.mapInArrow(tidy(_matches(docs.sparkSession.sparkContext.broadcast(made))), SCHEMA)
            found = part if found is None else found.union(part)
    return found if found is not None else texts.limit(0).selectExpr(
        "doc_id", "doc_id as item_id", "0D as similarity", "doc_id as first_word", "doc_id as n_words"
    )
