"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``LENGTH`` bytes is repeated when it starts anywhere else too. The suffixes that could take part are
dealt into buckets by content, and only one block of buckets is sorted at a time:

1. Every window of ``LENGTH`` bytes picks an anchor, the least hash of the ``GRAM``-byte strings inside. Equal
   windows have equal anchors at equal places, so they fall into the same bucket: the anchor's hash. Windows next to
   each other mostly share an anchor; together they are one segment of the text.
2. Segments of equal hash of all their bytes repeat each other as a whole, and need no sorting; only one of them is
   compared with the rest of its bucket. Buckets of one segment hold nothing repeated.
3. The other segments are shipped to their bucket. Their suffixes are sorted by their first bytes up to a position
   of a difference cover modulo ``PERIOD``, and longer ties are resolved by ranks of the cover's sample, which are
   computed before, with the lengths of common prefixes of neighbouring ranks.

Memory is bounded by the block that is sorted. A bucket of very many different segments is sorted in parts, and
windows that only different parts hold meet by their digests in a grouped aggregate.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import Rolling, mixed, raw, signed, slices, tidy

LENGTH, GRAM, PERIOD = 200, 40, 32
# Bytes of segments that are sorted at once, and different segments of a bucket that a task sorts.
BLOCK_BYTES, BUCKET_ROWS = 1 << 20, 2048
ANCHORS = "id long, print long, gram long, segment long, anchor int, low int, high int"


# --- anchors ------------------------------------------------------------------------------------------------------


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` entries, by its start, in two passes over blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of all texts in a row: text, hash of the anchor, hash of the bytes, anchor, first and last window.

    Places count from the text's first byte. Texts shorter than a window have none.
    """
    names = ["text", "gram", "segment", "anchor", "low", "high"]
    if len(data) < LENGTH:
        return {n: np.zeros(0, np.int64) for n in names}
    rolling = Rolling(data)
    grams = rolling.windows(GRAM)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    # The hash decides, then the place: of equal strings in a window the first one is its anchor.
    ranked = (mixed(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(ranked, LENGTH - GRAM + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 :])
    anchor = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(inside):
        return {n: np.zeros(0, np.int64) for n in names}
    first = np.flatnonzero(
        np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[inside[1:]] != owner[inside[:-1]])])
    )
    low, high = inside[first], inside[np.concatenate([first[1:] - 1, [len(inside) - 1]])]
    text, spot = owner[low], anchor[first]
    begin = at[text]
    return {
        "text": text, "gram": signed(grams[spot]), "segment": signed(rolling.of(low, high + LENGTH, salt=1)),
        "anchor": spot - begin, "low": low - begin, "high": high - begin,
    }


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = segments(*raw(part.column("text")))
            rows = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(rows), part.column("print").take(rows), pa.array(found["gram"]),
                    pa.array(found["segment"]), *(pa.array(found[n].astype(np.int32)) for n in ("anchor", "low", "high")),
                ],
                ["id", "print", "gram", "segment", "anchor", "low", "high"],
            )


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that their bucket needs."""
    for batch in batches:
        lists = batch.column("shipped")  # the other columns are there only for the shuffle to be shared
        bounds, parts = lists.offsets.to_numpy(), lists.flatten()
        rows = np.repeat(np.arange(len(batch)), np.diff(bounds))
        gram, anchor, low, high, many = (parts.field(i).to_numpy() for i in range(5))
        data, at = raw(batch.column("text"))
        bytes_of = [data[at[r] + a : at[r] + b + LENGTH].tobytes() for r, a, b in zip(rows, low, high, strict=True)]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(take), batch.column("print").take(take), pa.array(gram), pa.array(many),
                pa.array(low), pa.array(anchor - low), pa.array(bytes_of, pa.binary()),
            ],
            ["id", "print", "gram", "many", "low", "shift", "bytes"],
        )


# --- one block of buckets -----------------------------------------------------------------------------------------


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences are all residues: for any two places one shift below ``period`` takes both into it.

    Grown from {0, 1} by the residue that adds most new differences.
    """
    chosen, covered = [0, 1], {0, 1, period - 1}
    while len(covered) < period:
        best = max(range(period), key=lambda r: (len({(r - c) % period for c in chosen} | {(c - r) % period for c in chosen} | covered), -r))
        covered |= {(best - c) % period for c in chosen} | {(c - best) % period for c in chosen}
        chosen.append(best)
    return np.array(sorted(chosen))


COVER = difference_cover(PERIOD)
# For each residue the distance to the next one in the cover.
AHEAD = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def words_of(text: np.ndarray, places: np.ndarray, count: int) -> list[np.ndarray]:
    """``count`` big-endian numbers of 8 bytes from each place: they order as the bytes do."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8 * count)[places]
    numbers = np.ascontiguousarray(view).view(">u8").astype(np.uint64)
    return [numbers[:, i] for i in range(count)]


def ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the keys (the first weighs most), and where in it a row differs from the one before."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        fresh[1:] |= sorted_key[1:] != sorted_key[:-1]
    fresh[:1] = True
    return order, fresh


def repeated_windows(
    buckets: np.ndarray, shifts: np.ndarray, texts: list[bytes]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment which of its windows another segment of its bucket holds too, and one window of each class.

    ``shifts`` are the anchors' places in the segments. Segments are laid out so that anchors fall
    on multiples of ``PERIOD``: windows that can be equal are at one place of the cover.
    """
    sizes = np.array([len(t) for t in texts])
    lead = (-shifts) % PERIOD
    room = -(-(lead + sizes) // PERIOD) * PERIOD + PERIOD
    base = np.concatenate([[0], np.cumsum(room)])
    start, end = base[:-1] + lead, base[:-1] + lead + sizes
    text = np.zeros(base[-1] + PERIOD, np.uint8)
    inside = np.zeros(len(text) + 1, np.int8)
    inside[start], inside[end] = 1, -1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    text[inside] = np.frombuffer(b"".join(texts), np.uint8)
    limit = np.zeros(len(text), np.int64)
    limit[inside] = np.repeat(end, sizes)

    # Sample: places in the cover. Names order their first PERIOD bytes, ranks all LENGTH of them.
    covered = np.zeros(PERIOD, bool)
    covered[COVER] = True
    sample = np.flatnonzero(inside & np.resize(covered, len(text)))
    place_of = np.full(len(text) + LENGTH + 2 * PERIOD, -1, np.int64)
    place_of[sample] = np.arange(len(sample))
    ends = limit[sample]
    left = np.minimum(PERIOD, ends - sample)
    order, fresh = ranked([*words_of(text, sample, PERIOD // 8), left])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    steps = -(-LENGTH // PERIOD)
    later = [sample + PERIOD * c for c in range(steps)]
    columns = [np.where(p < ends, names[place_of[p]], 0) for p in later]
    order, _ = ranked(columns)
    # Length of the common prefix of each rank and the one before it.
    above, below = order[:-1], order[1:]
    same = np.ones(len(above), bool)
    common = np.zeros(len(above), np.int64)
    for c in range(steps):
        equal = same & (columns[c][above] == columns[c][below])
        stop = np.flatnonzero(same & ~equal & (columns[c][above] > 0) & (columns[c][below] > 0))
        if len(stop):
            a, b = later[c][above[stop]], later[c][below[stop]]
            view = np.lib.stride_tricks.sliding_window_view(text, PERIOD)
            differ = view[a] != view[b]
            alike = np.where(differ.any(axis=1), differ.argmax(axis=1), PERIOD)
            room_left = np.minimum(ends[above[stop]] - a, ends[below[stop]] - b)
            common[stop] += np.minimum(alike, room_left)
        common[equal] += PERIOD
        same = equal

    # Windows: their bucket and place, the bytes up to the next place in the cover, and the class of the rank there.
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    place = start[owner] + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    ahead = AHEAD[place % PERIOD]
    tail = place_of[place + ahead]
    group = np.empty(len(place), np.int64)
    position = np.empty(len(sample), np.int64)
    position[order] = np.arange(len(sample))
    for shift in np.unique(ahead):
        mine = ahead == shift
        classes = np.concatenate([[0], np.cumsum(common < LENGTH - shift)])
        group[mine] = classes[position[tail[mine]]]
    heads = words_of(text, place, 4)
    for i, head in enumerate(heads):
        bits = np.clip(ahead - 8 * i, 0, 8).astype(np.uint64) * np.uint64(8)
        heads[i] = np.where(bits > 0, head >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
    heads = heads[: -(-int(AHEAD.max()) // 8)]
    aligned = place - (start + shifts)[owner]
    order, fresh = ranked([buckets[owner], aligned, *heads, group])
    alone = fresh & np.concatenate([fresh[1:], [True]])
    repeated, chosen = np.empty(len(place), bool), np.empty(len(place), bool)
    repeated[order], chosen[order] = ~alone, fresh
    cuts = np.cumsum(counts)[:-1]
    return list(zip(np.split(repeated, cuts), np.split(chosen, cuts), strict=True))


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; rows come sorted by bucket, and whole buckets are sorted a block at a time."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        keys = rows.column("gram").to_numpy() ^ (rows.column("part").to_numpy() + 1)
        texts = rows.column("bytes").to_pylist()
        found = repeated_windows(
            np.unique(keys, return_inverse=True)[1], rows.column("shift").to_numpy().astype(np.int64), texts
        )
        take, low, high, digests = [], [], [], []
        begins, parts = rows.column("low").to_numpy(), rows.column("parts").to_numpy()
        for i, (flags, chosen) in enumerate(found):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            take += [i] * (len(edges) // 2)
            low += (begins[i] + edges[::2]).tolist()
            high += (begins[i] + edges[1::2] - 1).tolist()
            digests += [None] * (len(edges) // 2)
            if parts[i] > 1:  # other parts of the bucket may hold these windows too
                at = np.flatnonzero(chosen).tolist()
                take += [i] * len(at)
                low += [int(begins[i]) + w for w in at]
                high += [int(begins[i]) + w for w in at]
                digests += [hashlib.blake2b(texts[i][w : w + LENGTH], digest_size=16).digest() for w in at]
        ids = [rows.column(n).chunk(0).take(pa.array(take, pa.int64())) for n in ("id", "print")]
        return pa.RecordBatch.from_arrays(
            [*ids, pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(digests, pa.binary())],
            ["id", "print", "low", "high", "digest"],
        )

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        grams = rows.column("gram").to_numpy() ^ (rows.column("part").to_numpy() + 1)
        size = np.cumsum([len(b) for b in rows.column("bytes").to_pylist()])
        ends = np.flatnonzero(grams[1:] != grams[:-1]) + 1  # whole buckets end here; the last one may go on
        at = 0
        while len(ends) and at < ends[-1]:
            floor = size[at - 1] if at else 0
            fit = ends[(ends > at) & (size[ends - 1] - floor <= BLOCK_BYTES)]
            upto = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
            yield solved(rows.slice(at, upto - at))
            at = upto
        held = rows.slice(at)
    if held is not None and held.num_rows:
        yield solved(held)


# --- the operator -------------------------------------------------------------------------------------------------


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = raw(part.column("text"))
            change = np.zeros(len(data) + 1, np.int64)
            for name in ("whole", "found"):
                lists = part.column(name)
                rows = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                spans = lists.flatten()
                np.add.at(change, at[rows] + spans.field(0).to_numpy(), 1)
                np.add.at(change, at[rows] + spans.field(1).to_numpy() + LENGTH, -1)
            covered = np.cumsum(change[:-1]) > 0
            kept, removed, runs = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                mine = covered[a:b]
                kept.append(data[a:b][~mine].tobytes())
                removed.append(int(mine.sum()))
                runs.append(int((mine[1:] & ~mine[:-1]).sum() + mine[:1].sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), pa.array(np.diff(at)), pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()), pa.array(kept, pa.binary()),
                ],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each text without the bytes that a repeated string of 200 bytes covers.

    Columns: ``row`` (all columns of ``docs`` but the text), ``n_bytes``, ``n_removed``, ``n_spans`` (runs
    of removed bytes) and ``kept`` (binary: a run may begin or end inside a character). A string is
    repeated when it starts at any other place of the same or another text; all are judged on the
    input. Texts shorter than 200 bytes, empty and null ones lose nothing. Every row is a text of its
    own: rows that repeat a ``doc_id``, or have none, are compared like any others.
    """
    # A row is known by its id and a hash of its text; rows alike in both lose the same bytes.
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("print", F.xxhash64("text"))
    anchors = rows.select("id", "print", "text").mapInArrow(tidy(_anchors), ANCHORS)
    # Most anchors stand alone: only those of buckets with two segments or more go on.
    shared = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    held = cut(anchors.join(shared, "gram"))
    # Equal segments of a bucket, and how many different ones the bucket has. If two rows were chosen by equal
    # hashes, the segment has copies anyhow.
    mark = F.xxhash64("id", "print", "low")
    alike = held.groupBy("gram", "segment").agg(F.count("*").alias("copies"), F.min(mark).alias("chosen"))
    buckets = alike.groupBy("gram").agg(F.count("*").alias("many"))
    classes = alike.join(buckets, "gram")
    ships = (F.col("many") > 1) & (mark == F.col("chosen"))
    work = cut(
        held.join(classes, ["gram", "segment"]).groupBy("id", "print").agg(
            F.collect_list(F.when(F.col("copies") > 1, F.struct("low", "high"))).alias("whole"),
            F.collect_list(F.when(ships, F.struct("gram", "anchor", "low", "high", "many"))).alias("shipped"),
        )
    )
    # The same rows, dealt by the same keys, serve for shipping and for the result.
    placed = rows.join(work.where(F.size("shipped") > 0).select("id", "print", "shipped"), ["id", "print"])
    sent = placed.mapInArrow(tidy(_ship), "id long, print long, gram long, many long, low int, shift int, bytes binary")
    # A bucket of very many segments is sorted in parts. One window of each class of a part then meets those of the
    # bucket's other parts by its digest, in an aggregate with a map-side part.
    sent = sent.withColumn("parts", F.ceil(F.col("many") / BUCKET_ROWS)).withColumn(
        "part", F.pmod(F.xxhash64("id", "print", "low"), F.col("parts"))
    )
    dealt = sent.repartition("gram", "part").sortWithinPartitions("gram", "part")
    spans = dealt.mapInArrow(tidy(_sorted_blocks), "id long, print long, low int, high int, digest binary")
    if work.where(F.exists("shipped", lambda x: x["many"] > BUCKET_ROWS)).limit(1).count():
        spans = cut(spans)
        met = spans.where("digest is not null")
        again = met.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        spans = spans.where("digest is null").union(met.join(again, "digest").select(spans.columns))
    found = spans.groupBy("id", "print").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    none = F.array().cast("array<struct<low:int,high:int>>")
    joined = (
        rows.join(work.select("id", "print", "whole"), ["id", "print"], "left").join(found, ["id", "print"], "left")
        .select("row", "text", F.coalesce("whole", none).alias("whole"), F.coalesce("found", none).alias("found"))
    )
    schema = T.StructType([
        joined.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept", T.BinaryType()),
    ])
    return joined.mapInArrow(tidy(_remove), schema)
