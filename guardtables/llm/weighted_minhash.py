"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle of five words weighs its count in the text times ``1 + ln(N / df)``, with the true number of documents
that hold it, however few. Texts are dealt into blocks; each block sends its different shingles to shards of the
hash space, a shard adds up how many documents of all blocks hold each, and the block gets its numbers back. So no
table of shingles is held anywhere: a task has one block or one shard, and their number grows with the corpus.

Copies of a text make what they share common, so that in a large group a few changed words would outweigh it. A copy
that is like the centre of its group by plain counts is therefore judged once more, with the logarithm of the
holders for shingles that the group itself made common; passages common elsewhere keep their weight.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, release
from .common import BASE, components, give_back, mixed, shingles, signed, slices, tidy, words

SHINGLE, SIMILARITY = 5, 0.8
# Share of all documents that every shingle counts as held by at least; 0 leaves the true frequencies.
FLOOR = 0.0
# Texts at the similarity agree in both samples of a band with probability 0.64: all 10 bands miss 4 pairs in 100,000.
BANDS, ROWS = 10, 2
DRAWS = 1 << 17
# Bytes of text of a block, and of those whose shingles make a shard (some eight bytes of hashes for seven of text).
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 12 << 20
# Text of a block handled at once.
PART_BYTES = 1 << 20


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def distinct(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: each text's distinct shingles in order, their counts, where a text's begin; its words, where they begin."""
    hashes, at = words(part.column("text"))
    runs, begins = shingles(hashes, at, SHINGLE)
    owner = np.repeat(np.arange(len(part)), np.diff(begins))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])])) if len(
        runs
    ) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(runs)]]))
    return runs[first], counts, np.searchsorted(owner[first], np.arange(len(part) + 1)), hashes, at


# --- document frequencies -----------------------------------------------------------------------------------------

HELD = "block long, held binary, shard int"


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, which compress better than value by value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _values(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _blocks(texts: DataFrame, total_bytes: int) -> DataFrame:
    """The texts dealt into blocks of like size; rows alike may lie in different ones."""
    n = -(-total_bytes // BLOCK_BYTES) + 1
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n)))


def _block_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a block in order, and how many of its documents hold each."""
    runs = [distinct(part)[0] for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", PART_BYTES)]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]), return_counts=True)


def _sent_out(shards: int):
    """A block's shingles by shard: the hash space is cut into ``shards`` stretches."""

    def run(block: pa.Table) -> pa.Table:
        keys, n = _block_counts(block.column("text").combine_chunks())
        width = (1 << 64) // shards
        ends = np.searchsorted(keys, np.array([s * width for s in range(1, shards)], np.uint64))
        parts = [(s, k, m) for s, (k, m) in enumerate(zip(np.split(keys, ends), np.split(n, ends), strict=True)) if len(k)]
        one = block.column("block")[0].as_py() if len(block) else 0
        give_back()
        return pa.table({
            "block": pa.array([one] * len(parts), pa.int64()), "shard": pa.array([s for s, *_ in parts], pa.int32()),
            "keys": pa.array([_planes(k) for _, k, _ in parts], pa.binary()),
            "n": pa.array([_planes(m.astype(np.uint32)) for *_, m in parts], pa.binary()),
        })

    return run


def _added_up(shard: pa.Table) -> pa.Table:
    """For each block of a shard how many documents of all blocks hold its shingles, in their order."""
    keys = [_values(k, np.uint64) for k in shard.column("keys").to_pylist()]
    n = np.concatenate([_values(m, np.uint32) for m in shard.column("n").to_pylist()])
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    held = np.bincount(place, n, len(found)).astype(np.uint32)[place]
    parts = np.split(held, np.cumsum([len(k) for k in keys])[:-1])
    del found, place
    give_back()
    return pa.table({
        "block": shard.column("block"), "held": pa.array([_planes(p) for p in parts], pa.binary()), "shard": shard.column("shard"),
    })


def frequencies(blocks: DataFrame, total_bytes: int) -> DataFrame:
    """How many documents hold each shingle of a block: ``block``, ``shard`` and ``held``, in the order of the hashes."""
    shards = -(-total_bytes // SHARD_BYTES) + 1
    sent = blocks.groupBy("block").applyInArrow(_sent_out(shards), "block long, shard int, keys binary, n binary")
    return sent.groupBy("shard").applyInArrow(_added_up, HELD)


# --- sampling -----------------------------------------------------------------------------------------------------


@dataclass
class Weights:
    """Weights of shingles in a corpus of ``total`` documents."""

    total: int
    floor: float = FLOOR

    def of(self, counts: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Weights of shingles that a text holds ``counts`` times and ``held`` documents hold."""
        total = max(1, self.total)
        return counts * (1.0 + np.log(total / np.maximum(held, max(1.0, self.floor * total))))

    def among_copies(self, counts: np.ndarray, held: np.ndarray, copies: float) -> np.ndarray:
        """Weights inside a group of ``copies``: where they are most of the ``held`` documents, these count as 1 + ln ``held``."""
        return self.of(counts, np.where(held <= 2 * copies, 1.0 + np.log(np.maximum(held, 1)), held))


class Sampler:
    """Improved consistent weighted sampling with draws from a fixed table.

    For sample k a shingle s draws (r, c, beta) with r, c from Gamma(2, 1) and beta uniform, by a
    hash of (s, k). With weight w: t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the
    shingle with the least a is the sample, together with t. Two texts give the same sample with a
    probability of their weighted Jaccard similarity. Draws of shingles that one text holds once, whose
    weight is the same, come from a table made once.
    """

    def __init__(self, usual: float):
        random = np.random.default_rng(20240607)
        self.r, c = random.gamma(2.0, 1.0, DRAWS), random.gamma(2.0, 1.0, DRAWS)
        self.c, self.beta = np.log(c), random.random(DRAWS)
        self.usual = usual
        self.value, self.level = self.draw(np.arange(DRAWS), np.full(DRAWS, np.log(usual)))

    def draw(self, at: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = np.floor(log_weight / self.r[at] + self.beta[at])
        return self.c[at] - self.r[at] * (level - self.beta[at] + 1), level

    def bands(self, runs: np.ndarray, weight: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Keys of all bands for each text that has a shingle; other texts have zeros."""
        out = np.zeros((len(begins) - 1, BANDS), np.uint64)
        filled = np.flatnonzero(np.diff(begins))
        if not len(filled):
            return out
        starts, sizes = begins[:-1][filled], np.diff(begins)[filled]
        odd = np.flatnonzero(weight != self.usual)
        log_odd = np.log(weight[odd])
        for k in range(BANDS * ROWS):
            at = (mixed(runs ^ np.uint64((k + 1) * BASE % (1 << 64))) >> np.uint64(64 - 17)).astype(np.int64)
            value, level = self.value[at], None
            if len(odd):
                value[odd], level = self.draw(at[odd], log_odd)
            least = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == np.repeat(least, sizes))
            _, one = np.unique(np.searchsorted(starts, hits, side="right"), return_index=True)
            chosen = hits[one]  # shingles of a text are in order, so ties go to the smallest
            levels = self.level[at[chosen]]
            if level is not None:
                spot = np.minimum(np.searchsorted(odd, chosen), len(odd) - 1)
                levels = np.where(odd[spot] == chosen, level[spot], levels)
            sample = mixed(runs[chosen] + levels.astype(np.int64).view(np.uint64) * np.uint64(BASE))
            out[filled, k // ROWS] = mixed(out[filled, k // ROWS] * np.uint64(31) + sample)
        return out


PACKED = "zstd"


def _signatures(weights: Weights):
    """Fingerprint, keys of all bands and packed document frequencies of each text of a block."""

    def run(block: pa.Table, counted: pa.Table) -> pa.Table:
        sampler = Sampler(float(weights.of(np.ones(1), np.ones(1))[0]))
        texts = pa.RecordBatch.from_arrays([c.combine_chunks() for c in block.columns], block.column_names)
        known, _ = _block_counts(texts.column("text"))
        order = np.argsort(counted.column("shard").to_numpy())
        listed = counted.column("held").to_pylist()
        df = np.concatenate([np.zeros(0, np.uint32), *(_values(listed[i], np.uint32) for i in order)])
        out = []
        for part in slices(texts, "text", PART_BYTES):
            runs, counts, begins, hashes, at = distinct(part)
            held = df[np.searchsorted(known, runs)]
            keys = sampler.bands(runs, weights.of(counts, held), begins)
            # The text's words in order, as a 128-bit fingerprint.
            place = mixed(np.arange(len(hashes), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64))
            prints = [
                np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + salt ^ place))])
                for salt in (np.uint64(0), np.uint64(BASE))
            ]
            prints = [signed(mixed(p[at[1:]] - p[at[:-1]])) for p in prints]
            packed = [pa.compress(_planes(held[a:b]), PACKED, asbytes=True) if b > a else b"" for a, b in zip(begins[:-1], begins[1:], strict=True)]
            out.append(pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("h"), pa.array(prints[0]), pa.array(prints[1]), pa.array(np.diff(at)),
                    pa.FixedSizeListArray.from_arrays(pa.array(signed(keys.ravel())), BANDS).cast(pa.list_(pa.int64())),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "h", "print_a", "print_b", "n_words", "bands", "held"],
            ))
        give_back()
        return pa.Table.from_batches(out)

    return run


SIGNATURES = "doc_id long, h long, print_a long, print_b long, n_words long, bands array<long>, held binary"


# --- verification -------------------------------------------------------------------------------------------------


def shared_weight(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight that two sorted sets of shingles share, and how much more each of the first one's weighs than in the second."""
    spot = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    other = np.where(b[spot] == a, wb[spot], 0.0) if len(b) else np.zeros(len(a))
    both = np.minimum(wa, other)
    return float(both.sum()), wa - both


MEASURED = "v long, u long, similarity double, shared double, total double, total_u double, alike double"
ADDED = "v long, u long, shingle long, gain double"


def _weighed(texts: pa.Array, held: list[bytes], weights: Weights) -> list[tuple[np.ndarray, ...]]:
    """Sorted shingles of each text, their weights, counts and frequencies, by the packed frequencies of each."""
    runs, counts, begins, *_ = distinct(pa.RecordBatch.from_arrays([texts], ["text"]))
    sizes = np.diff(begins).tolist()
    df = [_values(pa.decompress(h, 4 * n, PACKED, asbytes=True), np.uint32) for h, n in zip(held, sizes, strict=True) if n]
    df = np.concatenate([np.zeros(0, np.uint32), *df])
    columns = (runs, weights.of(counts, df), counts.astype(np.float64), df)
    return [tuple(c[a:b] for c in columns) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _pairs(batch: pa.RecordBatch, weights: Weights):
    """Both sides of each pair of a batch; a centre's text, which many rows share, is cut into shingles once."""
    for part in slices(batch, "text"):
        centres = part.column("text_u").dictionary_encode()
        at = centres.indices.to_numpy()
        _, first = np.unique(at, return_index=True)
        known = _weighed(centres.dictionary, part.column("held_u").take(pa.array(first)).to_pylist(), weights)
        mine = _weighed(part.column("text"), part.column("held").to_pylist(), weights)
        yield part, [(a, known[u]) for a, u in zip(mine, at.tolist(), strict=True)]


def _jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float, float, float]:
    """Weighted Jaccard similarity of two sorted sets, the weight they share and the weight of each."""
    shared, _ = shared_weight(a, wa, b, wb)
    one, two = float(wa.sum()), float(wb.sum())
    whole = one + two - shared
    return shared / whole if whole > 0 else 0.0, shared, one, two


def _compare(weights: Weights):
    """Exact similarities of pairs of texts, what they share, the weights of both and the similarity by plain counts.

    Pairs with ``copies`` are members of a group of so many and weigh their shingles accordingly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sides in _pairs(batch, weights):
                measured = []
                for ((a, wa, na, da), (b, wb, nb, db)), copies in zip(sides, part.column("copies").to_pylist(), strict=True):
                    if copies > 0:
                        wa, wb = weights.among_copies(na, da, copies), weights.among_copies(nb, db, copies)
                    measured.append((*_jaccard(a, wa, b, wb), _jaccard(a, na, b, nb)[0]))
                columns = [pa.array([m[i] for m in measured], pa.float64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("v"), part.column("u"), *columns],
                    ["v", "u", "similarity", "shared", "total", "total_u", "alike"],
                )

    return run


def _added(weights: Weights):
    """The shingles that ``v`` adds to ``u``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sides in _pairs(batch, weights):
                more, gains = [np.zeros(0, np.uint64)], [np.zeros(0)]
                for (a, wa, *_), (b, wb, *_) in sides:
                    _, gain = shared_weight(a, wa, b, wb)
                    more.append(a[gain > 0])
                    gains.append(gain[gain > 0])
                sizes = np.array([len(m) for m in more[1:]], np.int64)
                ids = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("v", "u")]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, ids), pa.array(signed(np.concatenate(more))), pa.array(np.concatenate(gains))],
                    ["v", "u", "shingle", "gain"],
                )

    return run


def near_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words, and links between representatives of different classes.

    The first frame has a row for each document: ``doc_id``, ``n_words`` and ``rep``, the smallest
    ``doc_id`` with the same words in the same order. The second has ``v``, ``u`` (representatives)
    and ``similarity`` for links that join all documents of a component.

    Inside a bucket each member is first compared with one centre c, the most central member. Two members
    x and y that are not in one component by then may still be linked, but for most pairs that is ruled out
    without a comparison. With I for the weight that a member shares with c and T for its whole weight, x
    and y share at most min(Ix, Iy), and beyond that only what both add to c. A link needs a shared weight of
    s / (1 + s) of Tx + Ty. So y is compared with x only where min(Ix, Iy) reaches that, or where both add
    the same shingle to c and the bound with the added weight reaches it. Near copies of one text, each with
    changes of its own, thus cost a comparison each, and no link between components is left out.

    Added weight counts only for shingles that members of another component add too; call its sum Ex. A link of
    x and y that the centre does not show needs an added weight E in common with E >= s Tx - Ix, and with
    g = s / (1 + s) T - I / 2 also E >= gx + gy. So x meets others only by a prefix of its added shingles, the
    least common ones first: the weight left after the prefix is below what x needs with any partner, and two
    members that share enough share a shingle in both prefixes.

    A member that is like its centre by plain counts, but not with these weights, is compared with it once more as
    one of a group. The group counts as many documents as hold a shingle of the centre among the members on average.
    """
    texts = _texts(docs)
    total, total_bytes = texts.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    weights, blocks = Weights(total), _blocks(texts, total_bytes)
    signed_texts = blocks.groupBy("block").cogroup(frequencies(blocks, total_bytes).groupBy("block"))
    signatures = cut(signed_texts.applyInArrow(_signatures(weights), SIGNATURES).where("doc_id is not null"))
    del blocks, signed_texts
    release(docs.sparkSession)
    classes = signatures.where("n_words > 0").groupBy("print_a", "print_b").agg(
        F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.count("*").alias("copies")
    )
    members = signatures.join(classes.drop("bands", "copies"), ["print_a", "print_b"], "left").select(
        "doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")
    )
    buckets = classes.select("rep", "copies", F.posexplode("bands").alias("band", "key"))
    # The centre of a bucket is the member that meets most others over all its buckets: of near copies the one that
    # was changed least.
    sized = buckets.join(
        buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"]
    )
    met = cut(sized.join(sized.groupBy("rep").agg(F.sum("n").alias("met")), "rep"))
    centres = met.groupBy("band", "key").agg(F.min_by("rep", F.struct(-F.col("met"), F.col("rep"))).alias("u"))
    placed = met.join(centres, ["band", "key"])
    stars = placed.where("rep <> u").select(F.col("rep").alias("v"), "u").distinct()
    # Texts travel instead of their shingles, which take twice their bytes; rows that repeat a document once.
    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    held = signatures.select("doc_id", "h", "held").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "h"])
    # Joined by the id alone, as pairs are, so that texts are shuffled once: the hash is no key of the join.
    placed_texts = texts.alias("t").join(
        held.alias("s"), (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.h").bitwiseXOR(F.col("s.h")) == 0)
    ).select("t.doc_id", "t.text", "t.h", "s.held").dropDuplicates(["doc_id", "h"])

    def with_texts(pairs: DataFrame) -> DataFrame:
        """Pairs with the texts of both and their frequencies."""
        one = placed_texts.select(F.col("doc_id").alias("v"), "text", "held")
        two = placed_texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"), F.col("held").alias("held_u"))
        both = pairs.select("v", "u", "copies").join(one, "v").join(two, "u")
        return both.select("v", "u", "copies", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "text_u")), "held", "held_u")

    linked, alone = F.col("similarity") >= similarity - 1e-12, F.lit(0.0).alias("copies")
    measured = cut(with_texts(stars.select("v", "u", alone)).mapInArrow(tidy(_compare(weights)), MEASURED))
    release(docs.sparkSession)
    links = measured.where(linked).select("v", "u", "similarity")
    # Components so far; only centres with members in different ones go on.
    joined = components(links, "v", "u")
    release(docs.sparkSession)
    around = measured.select("v", "u", "shared", "total").join(joined.withColumnRenamed("id", "v"), "v", "left").select(
        "u", "v", "shared", "total", F.coalesce("component_id", "v").alias("component")
    )
    half = similarity / (1 + similarity)
    gap = half * F.col("total") - F.col("shared") / 2
    several = around.groupBy("u").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min(gap).alias("least_gap")
    ).where("a <> b")
    members_of = cut(around.join(several.select("u", "least_gap"), "u"))
    needed = half * (F.col("x.total") + F.col("y.total")) - 1e-9
    inside = F.least("x.shared", "y.shared")
    apart = F.col("x.component") < F.col("y.component")

    def meeting(rows: DataFrame, keys: list[str], bound: Column) -> DataFrame:
        on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
        both = rows.alias("x").join(rows.alias("y"), [*on, apart, bound >= needed])
        return both.select(F.col("x.v").alias("v"), F.col("y.v").alias("u"))

    # Of a pair that the centre shows, neither is smaller than ``similarity`` times the other: each shares that much.
    within = members_of.where(F.col("shared") >= similarity * F.col("total") - 1e-9)
    added = with_texts(members_of.select("v", "u", alone)).mapInArrow(tidy(_added(weights)), ADDED).join(members_of, ["v", "u"])
    common = added.groupBy("u", "shingle").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("holders")
    ).where("a <> b")
    commonest = Window.partitionBy("u", "v").orderBy(F.desc("holders"), F.desc("shingle"))
    ranked = (
        added.join(common.select("u", "shingle", "holders"), ["u", "shingle"])
        .withColumn("left", F.sum("gain").over(commonest.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("added", F.sum("gain").over(Window.partitionBy("u", "v")))
    )
    least = F.greatest(similarity * F.col("total") - F.col("shared"), gap + F.col("least_gap")) - 1e-9
    prefix = ranked.where((F.col("added") >= least) & (F.col("left") >= least)).select(
        "u", "v", "shingle", "component", "shared", "total", "added"
    )
    beyond = F.least("x.added", "y.added")
    pairs = (
        meeting(within, ["u"], inside).union(meeting(prefix, ["u", "shingle"], inside + beyond)).distinct()
    )
    # Members like their centre by plain counts, once more among the copies of their group.
    sizes = met.select(F.col("rep").alias("v"), "copies").distinct()
    unlinked = measured.where((F.col("alike") >= similarity - 1e-12) & ~linked).select("v", "u").distinct()
    around_them = measured.join(unlinked.select("u").distinct(), "u", "left_semi").join(sizes, "v")
    groups = around_them.groupBy("u").agg(F.sum(F.col("copies") * F.col("shared") / F.col("total_u")).alias("held")).join(
        sizes.withColumnRenamed("v", "u"), "u"
    ).select("u", (F.col("held") + F.col("copies")).alias("copies")).where("copies > 2")  # a pair alone is no group
    again = pairs.select("v", "u", alone).union(unlinked.join(groups, "u").select("v", "u", "copies"))
    more = with_texts(again).mapInArrow(tidy(_compare(weights)), MEASURED).where(linked)
    return members, cut(links.union(more.select("v", "u", "similarity")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of each document among near-duplicates: ``doc_id``, ``class_id``, ``kept``.

    ``class_id`` is the smallest ``doc_id`` that links reach, itself included; ``kept`` says that
    it is the document's own. Texts link when the weighted Jaccard similarity of their five-word
    TF-IDF shingles is at least ``similarity``, or that of a text and the centre of its group of copies
    when shingles most of whose holders are in the group count as held by 1 + ln of the holders. Texts of fewer than five words are one shingle;
    null texts and texts without words link with nothing. Rows that repeat a ``doc_id`` are one
    document, which links by any of its texts; rows without a ``doc_id`` are left out.
    """
    members, links = near_links(docs, similarity)
    # A document with several texts is in several classes: they are linked through it.
    own = members.where("rep <> doc_id").select(F.col("doc_id").alias("v"), F.col("rep").alias("u"))
    joined = components(links.select("v", "u").union(own), "v", "u")
    ids = members.select("doc_id").distinct()
    found = ids.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    named = found.select("doc_id", F.coalesce("component_id", "doc_id").alias("class_id"))
    return named.withColumn("kept", F.col("doc_id") == F.col("class_id"))
