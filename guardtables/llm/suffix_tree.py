"""Language-model scores by a probabilistic suffix tree.

A text is read as its tokens, and a token as its bytes with a blank after it; one end symbol closes the text. The tree
predicts the next symbol from the longest suffix of what came before that it holds, so the probability of a text is one
of its sequence of tokens and needs no closed vocabulary.

* Contexts of up to ``DEPTH`` symbols are candidates when training has them at least ``LEAST`` times, so the tree grows
  with the corpus. Their counts are a table sharded by the last three symbols of a context: a context and all longer
  ones that end in it from there on are in one shard, which chooses and smooths them by itself. Only contexts of up to
  two symbols, 65,536 at most, are held by every task.
* A context stays when its next symbols diverge from those of its suffix by more than their description costs
  (likelihood ratio against half the logarithm of its count for each different next symbol); suffixes of contexts that
  stay do too.
* A distribution is mixed with that of its suffix, with as much weight as it has different symbols; the root's is mixed
  with the uniform one.
* A token's probability is that of its symbols, smoothed with how often training has the whole token: (count + k p) /
  (N + k). Of the weights ``PRIORS`` times N, k is the one under which training tokens, each left out of its own
  count, are most probable.
* Documents are dealt into groups; the different places of a group (a symbol with the context before it) travel to the
  shards once and come back with their probabilities, as its words do with their counts.
* ``Automaton`` and ``grow`` make the same tree in one process, for corpora whose contexts fit in memory.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import mixed, raw, slices, tidy

DEPTH, LEAST = 7, 2
# Bytes of the documents that are scored together, and bytes of all text for each shard of the tree.
GROUP_BYTES, SHARD_BYTES = 24 << 20, 8 << 20
# Different places that a task holds before it sends their counts off.
HELD = 4 << 20
# Bytes of text that are scored at once.
SCORED_BYTES = 1 << 20
BLANK, END = 32, 10
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PRIORS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols in a row, and where each begins: lower-cased words with a blank after each, then the end."""
    data, at = raw(pc.ascii_lower(texts))
    both = np.empty(len(data) + 2 * (len(at) - 1), np.uint8)
    stop = at[1:] + 2 * np.arange(1, len(at))  # after each text's end symbol
    inner = np.ones(len(both), bool)
    inner[stop - 1] = inner[stop - 2] = False
    both[inner] = data
    both[stop - 2] = BLANK
    space = SPACES[both]
    both[space] = BLANK
    both[stop - 1] = END
    space[stop - 1] = False
    before = np.ones(len(both), bool)  # a blank there already, or the text's beginning
    before[1:] = space[:-1]
    before[stop[:-1]] = True
    kept = ~space | ~before
    upto = np.concatenate([[0], np.cumsum(kept)])
    return both[kept], np.concatenate([[0], upto[stop]])


# --- the tree in memory -----------------------------------------------------------------------------------------------


def frequent(x: np.ndarray, least: float, depth: int) -> list[np.ndarray]:
    """Codes of the contexts of each length with at least ``least`` occurrences; none goes across an end.

    A longer context is counted only where the one without its last symbol is frequent.
    """
    used = np.flatnonzero(np.bincount(x, minlength=256))
    dense = np.zeros(256, np.int32)
    dense[used] = np.arange(len(used))
    x, width, end = dense.astype(np.uint8)[x], np.int32(max(1, len(used))), dense[END]
    found, codes = [], np.zeros(1, np.uint64)
    at, ids = np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.int32)
    for length in range(1, depth + 1):
        last = x[at]
        keys = ids * width + last
        if length > 1:  # an end may only come first
            inside = last != end
            keys, at = keys[inside], at[inside]
        counts = np.bincount(keys, minlength=width * len(codes))
        named = np.flatnonzero(counts >= least)
        codes = codes[named // width] << np.uint64(8) | used[named % width].astype(np.uint64)
        found.append(codes)
        new = np.full(len(counts), -1, np.int32)
        new[named] = np.arange(len(named))
        ids = new[keys]
        del keys, counts, new
        going = (ids >= 0) & (at < len(x) - 1)
        ids, at = ids[going], at[going] + np.int32(1)
    return found


class Automaton:
    """States for all candidate contexts, the root first; a step leads to the longest suffix that is a state.

    ``codes`` holds a context's length in its top byte and its symbols below, the last one lowest.
    """

    def __init__(self, codes: np.ndarray, used: np.ndarray):
        codes = np.unique(np.concatenate([codes, np.array([1 << 56 | END], np.uint64)]))
        self.lengths = np.concatenate([[0], (codes >> np.uint64(56)).astype(np.int64)])
        self.codes = np.concatenate([np.zeros(1, np.uint64), codes])  # sorted by length, then symbols
        # Bytes that training has not seen share the last symbol.
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        low = np.uint64((1 << 56) - 1)
        length = np.maximum(self.lengths, 1)
        shorter = (length - 1).astype(np.uint64) << np.uint64(56)
        bare = self.codes & low
        # Places of the context without its first symbol, and without its last one.
        mask = (np.uint64(1) << (np.uint64(8) * (length - 1).astype(np.uint64))) - np.uint64(1)
        self.suffix = np.searchsorted(self.codes, shorter | (bare & mask))
        prefix = np.searchsorted(self.codes, shorter | (bare >> np.uint64(8)))
        last = self.symbol[(bare & np.uint64(255)).astype(np.int64)]
        table = np.zeros((len(self.codes), self.width), np.int32)
        for depth in range(int(self.lengths.max()) + 1):
            mine = np.flatnonzero(self.lengths == depth)
            if depth:
                table[mine] = table[self.suffix[mine]]
            longer = np.flatnonzero(self.lengths == depth + 1)
            table[prefix[longer], last[longer]] = longer
        table[:, self.symbol[END]] = np.searchsorted(self.codes, np.uint64(1 << 56 | END))
        self.table = table.ravel()

    def read(self, x: np.ndarray, depth: int, values: np.ndarray | None) -> np.ndarray:
        """For each symbol its entry of ``values`` (state before it times width plus symbol), or that place itself.

        The row of symbols is cut into many strips that are read side by side. A strip begins ``depth``
        symbols early, which brings it to the state that reading from the beginning would give.
        """
        columns = max(256, -(-len(x) // 8192))
        rows = -(-len(x) // columns)
        padded = np.full(depth + rows * columns, self.symbol[END], np.int32)
        padded[depth : depth + len(x)] = self.symbol[x]
        strips = np.lib.stride_tricks.as_strided(padded, (rows, columns + depth), (4 * columns, 4))
        strips = np.ascontiguousarray(strips.T)
        out = np.empty((columns, rows), np.int64 if values is None else values.dtype)
        state = np.zeros(rows, np.int32)
        for t in range(depth + columns):
            place = state * np.int32(self.width) + strips[t]
            if t >= depth:
                out[t - depth] = place if values is None else values[place]
            state = self.table[place]
        return out.T.ravel()[: len(x)]


@dataclass
class Tree:
    """The trained model: the automaton, which contexts stayed, and log10 probabilities for every state and symbol."""

    automaton: Automaton
    depth: int
    kept: np.ndarray
    values: np.ndarray

    def tokens(self, x: np.ndarray) -> np.ndarray:
        """log10 probability of each token of a row of symbols."""
        values = self.automaton.read(x, self.depth, self.values).astype(np.float64)
        closed = (x == BLANK) | (x == END)
        return np.add.reduceat(values, np.concatenate([[0], np.flatnonzero(closed)[:-1] + 1])) if len(x) else values


def grow(automaton: Automaton, counts: np.ndarray, depth: int, least: float) -> Tree:
    """Choose the contexts that stay and smooth their distributions.

    ``counts`` has what followed each state where it was the longest suffix.
    """
    counts = counts.reshape(-1, automaton.width)
    lengths, suffix = automaton.lengths, automaton.suffix
    levels = [np.flatnonzero(lengths == n) for n in range(int(lengths.max()) + 1)]
    for mine in reversed(levels[1:]):  # a context is also seen wherever a longer one ends in it
        order = mine[np.argsort(suffix[mine], kind="stable")]
        first = np.flatnonzero(np.diff(suffix[order], prepend=-1))
        counts[suffix[order[first]]] += np.add.reduceat(counts[order], first, axis=0)
    seen = counts.sum(axis=1)
    different = np.count_nonzero(counts, axis=1)
    unseen = max(1, 256 - (automaton.width - 1))
    uniform = np.full(automaton.width, 1.0 / (automaton.width - 1 + unseen))
    uniform[-1] *= unseen
    chance = np.empty(counts.shape, np.float32)
    chance[0] = (counts[0] + uniform) / (seen[0] + 1.0)
    kept = np.zeros(len(lengths), bool)
    kept[0] = True

    def smooth(mine: np.ndarray, above: np.ndarray) -> np.ndarray:
        n = np.maximum(different[mine], 1)[:, None]
        return (counts[mine] + n * above) / (seen[mine][:, None] + n)

    # Divergence of each context from its suffix, with the suffix's own smoothed distribution.
    for level in levels[1:]:
        for mine in np.array_split(level, len(level) // 8192 + 1):
            above = chance[suffix[mine]]
            chance[mine] = smooth(mine, above)
            share = counts[mine] / np.maximum(seen[mine][:, None], 1)
            ratio = np.log(np.where(share > 0, share, 1.0) / np.where(share > 0, above, 1.0))
            cost = 0.5 * different[mine] * np.log(np.maximum(seen[mine], 2))
            kept[mine] = (seen[mine] >= least) & ((counts[mine] * ratio).sum(axis=1) > cost)
    for mine in reversed(levels[2:]):
        kept[suffix[mine[kept[mine]]]] = True
    # States that did not stay, and the smoothing through them, follow the longest suffix that did.
    for level in levels[1:]:
        for mine in np.array_split(level, len(level) // 8192 + 1):
            above = chance[suffix[mine]]
            chance[mine] = np.where(kept[mine][:, None], smooth(mine, above), above)
    np.log10(np.maximum(chance, np.float32(1e-37)), out=chance)
    chance[:, -1] -= np.float32(math.log10(unseen))  # one byte of those that share the last symbol
    return Tree(automaton, depth, kept, chance.ravel())


# --- the tree as a table ------------------------------------------------------------------------------------------


def grams(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The place of each symbol: what comes before it, the last one in the top byte, and the symbol in the lowest.

    A context does not go past the end before a text; bytes below that end are 0.
    """
    place = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))
    before = np.concatenate([np.full(1, END, np.uint8), x]).astype(np.uint64)
    key = x.astype(np.uint64)
    for j in range(1, min(depth, len(x)) + 1):
        key[j - 1 :] |= np.where(place[j - 1 :] >= j - 1, before[: len(x) - j + 1], np.uint64(0)) << np.uint64(8 * (8 - j))
    return key


def different(keys: np.ndarray) -> np.ndarray:
    """The different keys in order; sorting them is many times faster than numpy's table of hashes."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def united(parts: Iterator[np.ndarray]) -> np.ndarray:
    """The different keys of all parts in order; parts are merged as they come in."""
    held, size = [np.zeros(0, np.uint64)], 0
    for part in parts:
        held.append(different(part))
        size += len(held[-1])
        if size >= HELD:
            held, size = [different(np.concatenate(held))], 0
    return different(np.concatenate(held))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    both, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(both, kind="stable")  # parts are in order, so they are merged
    both, n = both[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(n, first)


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Values byte by byte, of rising ones their steps, compressed."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards of places, by the last three symbols of their contexts, and where their places are."""
    shard = (mixed(keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for n in np.flatnonzero(np.diff(ends)):
        yield int(n), order[ends[n] : ends[n + 1]]


def _summed(batches: Iterator[pa.RecordBatch], of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of what ``of`` makes of texts, a bounded number at once."""
    keys, counts, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text", SCORED_BYTES):
            one, n = np.unique(of(*symbols(part.column("text"))), return_counts=True)
            keys.append(one)
            counts.append(n)
            size += len(one)
            if size >= HELD:
                yield added(keys, counts)
                keys, counts, size = [], [], 0
    if size:
        yield added(keys, counts)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = grams(x, at, 2)
        return (keys >> np.uint64(40) | keys & np.uint64(255)).astype(np.int64)

    for codes, n in _summed(batches, of):
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n)], ["code", "n"])


def _grams(depth: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _summed(batches, lambda x, at: grams(x, at, depth)):
            for shard, mine in dealt(keys, shards):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()), pa.array([packed(keys[mine], True)], pa.binary()),
                        pa.array([packed(n[mine])], pa.binary()),
                    ],
                    ["shard", "keys", "counts"],
                )

    return run


def _asked(depth: int, shards: int):
    """Different places of each group of documents; groups follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                groups = batch.column("group").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    for part in slices(batch.slice(a, b - a), "text", SCORED_BYTES):
                        yield int(groups[a]), part

        for group, parts in groupby(rows(), key=lambda r: r[0]):
            keys = united(grams(*symbols(part.column("text")), depth) for _, part in parts)
            for shard, mine in dealt(keys, shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.int32()), pa.array([shard], pa.int32()), pa.array([packed(keys[mine], True)], pa.binary())],
                    ["group", "shard", "keys"],
                )

    return run


def _mixed_in(counts: np.ndarray, seen: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    n = np.maximum(kinds, 1)
    return (counts + n * above) / (seen + n)


class Head:
    """Contexts of up to two symbols: ``one`` and ``two`` have the counts of the next symbol, ``rows`` names those of two.

    ``chance1`` and ``chance2`` are probabilities mixed through all candidates until ``finish`` leaves out those that go.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, least: float):
        self.counts = np.bincount(codes & 255, n, 256)
        self.root = (self.counts + 1 / 256) / (self.counts.sum() + 1.0)
        self.one = np.bincount(codes >> 16 << 8 | codes & 255, n, 1 << 16).reshape(256, 256)
        whole = codes >> 16 != END  # before a text's first symbol there is only the end
        self.rows, spot = np.unique(codes[whole] >> 8, return_inverse=True)
        self.two = np.bincount(spot << 8 | codes[whole] & 255, n[whole], len(self.rows) << 8).reshape(-1, 256)
        self.chance1, self.kept1 = self._level(self.one, self.root[None], least)
        self.chance2, self.kept2 = self._level(self.two, self.chance1[self.rows >> 8], least)

    @staticmethod
    def _level(counts: np.ndarray, above: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        seen, kinds = counts.sum(axis=1), np.count_nonzero(counts, axis=1)
        share = counts / np.maximum(seen, 1)[:, None]
        ratio = np.log(np.where(share > 0, share, 1.0) / np.where(share > 0, above, 1.0))
        told = (counts * ratio).sum(axis=1) > 0.5 * kinds * np.log(np.maximum(seen, 2))
        enough = seen >= least
        return np.where(enough[:, None], _mixed_in(counts, seen[:, None], kinds[:, None], above), above), enough & told

    def finish(self, parents: np.ndarray) -> None:
        """Keep the suffixes of contexts that stay, ``parents`` of those of three symbols, and mix through these alone."""
        self.kept2 |= np.isin(self.rows, parents)
        self.kept1[self.rows[self.kept2] >> 8] = True

        def final(counts: np.ndarray, above: np.ndarray, kept: np.ndarray) -> np.ndarray:
            seen, kinds = counts.sum(axis=1), np.count_nonzero(counts, axis=1)
            return np.where(kept[:, None], _mixed_in(counts, seen[:, None], kinds[:, None], above), above)

        self.chance1 = final(self.one, self.root[None], self.kept1)
        self.chance2 = final(self.two, self.chance1[self.rows >> 8], self.kept2)

    def chance(self, keys: np.ndarray) -> np.ndarray:
        last, symbol = (keys >> np.uint64(56)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        found = self.chance1[last, symbol]
        if len(self.rows):
            two = (keys >> np.uint64(48)).astype(np.int64)
            spot = np.minimum(np.searchsorted(self.rows, two), len(self.rows) - 1)
            hit = (self.rows[spot] == two) & (last != END)
            found[hit] = self.chance2[spot[hit], symbol[hit]]
        return found


MODEL = "shard int, level int, contexts binary, seen binary, kinds binary, pairs binary, counts binary, parents array<int>"


def _chosen(sent, depth: int, least: float):
    """The contexts of one shard that stay: of each length their counts, and those of the symbols after them."""

    def run(table: pa.Table) -> pa.Table:
        head: Head = sent.value
        keys, counts = added(
            [unpacked(k, np.uint64, True) for k in table["keys"].to_pylist()],
            [unpacked(n, np.int64) for n in table["counts"].to_pylist()],
        )
        above = head.chance(keys)
        inside = (keys >> np.uint64(56) != END) & (keys >> np.uint64(48) & np.uint64(255) != END)
        levels = []
        for d in range(3, depth + 1):
            keys, counts, above = keys[inside], counts[inside], above[inside]
            if not len(keys):
                break
            prefix = keys >> np.uint64(8 * (8 - d))
            starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            seen = np.add.reduceat(counts, starts)
            many = np.repeat(seen >= least, np.diff(np.append(starts, len(keys))))
            keys, counts, above, prefix = keys[many], counts[many], above[many], prefix[many]
            if not len(keys):
                break
            contexts, owner = np.unique(prefix, return_inverse=True)
            seen = seen[seen >= least]
            pairs, first, of = np.unique(prefix << np.uint64(8) | keys & np.uint64(255), return_index=True, return_inverse=True)
            n, mine = np.bincount(of, counts), owner[first]
            kinds = np.bincount(mine)
            gain = np.bincount(mine, n * np.log(n / seen[mine] / above[first]))
            kept = gain > 0.5 * kinds * np.log(np.maximum(seen, 2))
            levels.append([contexts, seen, kinds, pairs, n.astype(np.int64), mine, kept])
            above = _mixed_in(n, seen[mine], kinds[mine], above[first])[of]
            inside = keys >> np.uint64(8 * (8 - d)) & np.uint64(255) != END
        for up, down in zip(levels[-2::-1], levels[:0:-1], strict=True):  # suffixes of contexts that stay do too
            up[-1][np.searchsorted(up[0], different(down[0][down[-1]] >> np.uint64(8)))] = True
        out = {c.split()[0]: [] for c in MODEL.split(", ")}
        for d, (contexts, seen, kinds, pairs, n, mine, kept) in enumerate(levels, 3):
            if not kept.any():
                break
            of = kept[mine]
            row = (
                table["shard"][0].as_py(), d, packed(contexts[kept], True), packed(seen[kept]), packed(kinds[kept]),
                packed(pairs[of], True), packed(n[of]),
                different(contexts[kept] >> np.uint64(8)).astype(np.int64).tolist() if d == 3 else [],
            )
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        binary, kinds_of = pa.binary(), {"shard": pa.int32(), "level": pa.int32(), "parents": pa.list_(pa.int32())}
        return pa.table({c: pa.array(v, kinds_of.get(c, binary)) for c, v in out.items()})

    return run


def _answers(sent):
    """log10 probabilities of the places that each group asks a shard for."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        head: Head = sent.value
        levels = []
        for row in sorted(model.to_pylist(), key=lambda r: r["level"]):
            whole = [unpacked(row[c], np.int64) for c in ("seen", "kinds", "counts")]
            levels.append((row["level"], unpacked(row["contexts"], np.uint64, True), unpacked(row["pairs"], np.uint64, True), *whole))
        found = []
        for data in asked["keys"].to_pylist():
            keys = unpacked(data, np.uint64, True)
            chance, at = head.chance(keys), np.arange(len(keys))
            for d, contexts, pairs, seen, kinds, counts in levels:
                context = keys[at] >> np.uint64(8 * (8 - d))
                spot = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                hit = contexts[spot] == context
                at, spot = at[hit], spot[hit]
                pair = context[hit] << np.uint64(8) | keys[at] & np.uint64(255)
                place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                n = np.where(pairs[place] == pair, counts[place], 0)
                chance[at] = _mixed_in(n, seen[spot], kinds[spot], chance[at])
            found.append(packed(np.log10(np.maximum(chance, 1e-37)).astype(np.float32)))
        return pa.table({"group": asked["group"], "shard": asked["shard"], "logs": pa.array(found, pa.binary())})

    return run


def train(texts: DataFrame, shards: int, depth: int = DEPTH, share: float = 0.0) -> tuple[DataFrame, Head, int]:
    """Train a tree on the column ``text`` of all given rows: its shards, its head and the number of tokens.

    Null texts are empty ones.
    """
    spark, texts = texts.sparkSession, texts.select(F.col("text").cast("string").alias("text"))
    # At most 2^24 rows: two symbols before each one.
    rows = texts.mapInArrow(tidy(_heads), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    codes, n = rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    least = max(LEAST, share * n.sum())
    head = Head(codes, n, least)
    sent = spark.sparkContext.broadcast(head)
    counted = texts.mapInArrow(tidy(_grams(depth, shards)), "shard int, keys binary, counts binary")
    model = cut(counted.groupBy("shard").applyInArrow(_chosen(sent, depth, least), MODEL))
    parents = model.where("level = 3").select(F.explode("parents").alias("p")).distinct().collect()  # 65,536 at most
    head.finish(np.array([r.p for r in parents], np.int64))
    return model, head, int(head.counts[[BLANK, END]].sum())


# --- counts of words ----------------------------------------------------------------------------------------------


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each group of documents with their training count; groups follow each other."""

    def rows(group: int, counts: Counter) -> Iterator[pa.RecordBatch]:
        words, many = list(counts.keys()), np.fromiter(counts.values(), np.int64, len(counts))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), group, np.int32)), pa.array(part, pa.binary()),
                    pa.array(many[at : at + 50_000]),
                ],
                ["group", "word", "n"],
            )

    current, counts = None, Counter()
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("group", "text", "held_out")]
        for group, text, held_out in zip(*columns, strict=True):
            if group != current:
                if current is not None:
                    yield from rows(current, counts)
                current, counts = group, Counter()
            words = (text or "").encode().lower().split()
            if held_out:
                for word in words:
                    counts.setdefault(word, 0)
            else:
                counts.update(words)
    if current is not None:
        yield from rows(current, counts)


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, first_words long,"
    " scores array<double>, left_out array<double>"
)


def smoothed(counts: np.ndarray, tree: np.ndarray, total: int) -> np.ndarray:
    """log10 probabilities of tokens for each of the weights, from their counts and what the tree says."""
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(counts, 0))
    tree = tree * math.log(10)
    out = np.empty((len(PRIORS), len(own)))
    for row, prior in zip(out, PRIORS, strict=True):
        weight = max(1.0, prior * total)
        np.logaddexp(own, math.log(weight) + tree, out=row)
        row -= math.log(max(0, total) + weight)
    out /= math.log(10)
    return out


def _score(depth: int, shards: int, tokens: int, ends: int):
    """Scores of one group of documents, with the counts of its words and the probabilities of its places."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        words, answers = known.filter(pc.is_null(known["shard"])), known.filter(pc.is_valid(known["shard"]))
        logs = dict(zip(answers["shard"].to_pylist(), answers["logs"].to_pylist(), strict=True))
        texts = (p.column("text") for b in docs.select(["text"]).to_batches() for p in slices(b, "text", SCORED_BYTES))
        places = united(grams(*symbols(t), depth) for t in texts)
        said_of = np.empty(len(places), np.float32)
        for shard, mine in dealt(places, shards):
            said_of[mine] = unpacked(logs[shard], np.float32)
        counts, firsts = {}, 0
        for batch in words.to_batches(max_chunksize=50_000):
            counts.update(zip(batch.column("word").to_pylist(), batch.column("total").to_pylist(), strict=True))
            firsts += int(batch.column("first").to_numpy().sum())
        out = []
        for batch in docs.select(["doc_id", "held_out", "text"]).to_batches():
            for part in slices(batch, "text", SCORED_BYTES):
                x, at = symbols(part.column("text"))
                own, spot = np.unique(grams(x, at, depth), return_inverse=True)
                closed = np.flatnonzero((x == BLANK) | (x == END))
                said = said_of[np.searchsorted(places, own)][spot].astype(np.float64)
                said = np.add.reduceat(said, np.concatenate([[0], closed[:-1] + 1]))
                held = np.empty(len(said), np.int64)
                begins = [0]
                for text in part.column("text").to_pylist():
                    found = (text or "").encode().lower().split()
                    upto = begins[-1] + len(found)
                    held[begins[-1] : upto] = np.fromiter(map(counts.__getitem__, found), np.int64, len(found))
                    held[upto] = ends
                    begins.append(upto + 1)
                at = np.array(begins[:-1])
                train_rows = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                own = np.repeat(train_rows, np.diff(begins))
                score = np.add.reduceat(smoothed(held, said, tokens), at, axis=1)
                left = np.add.reduceat(smoothed(held - own, said, tokens - 1) * own, at, axis=1)
                firsts_here = np.zeros(len(part), np.int64)
                firsts_here[:1], firsts = firsts, 0
                kinds = pa.list_(pa.float64())
                out.append(
                    pa.table(
                        {
                            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                            "n_tokens": pa.array(np.diff(begins)),
                            "n_known": pa.array(np.add.reduceat((held > 0).astype(np.int64), at)),
                            "logs": pa.array(np.add.reduceat(np.log10(held + 0.1), at)),
                            "first_words": pa.array(firsts_here),
                            "scores": pa.array(list(score.T), kinds), "left_out": pa.array(list(left.T), kinds),
                        }
                    )
                )
        return pa.concat_tables(out)

    return run


def scores(docs: DataFrame, held_out: Column, depth: int = DEPTH, share: float = 0.0) -> DataFrame:
    """Scores of whole texts under a tree trained on the rows that are not ``held_out``, and unigram scores beside them.

    Columns: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens that
    training has), ``train_tokens``, ``base_score`` (unigram with 0.1 added to each count) and ``score``, the
    model's log10 probability. A null text is an empty one, with the end as its only token. Rows that repeat
    are counted and scored each by themselves; other columns are not read. Documents are dealt into
    groups of a bounded size; a group's words meet the counts of the whole corpus, so a word travels once
    for each group that holds it, not for each time it occurs, and no vocabulary is collected. ``depth`` is from
    2 to 7; with a ``share``, contexts are candidates when they also make up that share of all training symbols.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    sums = rows.agg(
        F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), 1).otherwise(0))
    ).first()
    groups, ends = (sums[0] or 0) // GROUP_BYTES + 1, int(sums[1] or 0)
    shards = (sums[0] or 0) // SHARD_BYTES + 1
    model, head, tokens = train(rows.where("not held_out"), shards, depth, share)
    group = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("int")
    grouped = rows.withColumn("group", group).repartition("group")
    asked = grouped.sortWithinPartitions("group").mapInArrow(tidy(_asked(depth, shards)), "group int, shard int, keys binary")
    sent = docs.sparkSession.sparkContext.broadcast(head)
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answers(sent), "group int, shard int, logs binary")
    words = grouped.sortWithinPartitions("group").mapInArrow(tidy(_vocabulary), "group int, word binary, n long")
    # A word has one row for each group at most.
    counted = words.selectExpr(
        "group", "word", "sum(n) over (partition by word) as total", "min(group) over (partition by word) = group as lowest"
    ).selectExpr("group", "word", "total", "cast(lowest and total > 0 as long) as first")
    known = counted.unionByName(answers, allowMissingColumns=True)
    score = _score(depth, shards, tokens, ends)
    found = grouped.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(score, RESULT)
    found = cut(found)
    # One row: the different words of training, and how probable each weight makes training tokens.
    known = found.agg(
        F.sum("first_words"), *[F.sum(F.col("left_out")[i]) for i in range(len(PRIORS))]
    ).first()
    distinct = (known[0] or 0) + (ends > 0)
    best = max(range(len(PRIORS)), key=lambda i: known[i + 1] or 0.0)
    below = math.log10(tokens + 0.1 * (distinct + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(below)).alias("base_score"), F.col("scores")[best].alias("score"),
    )
