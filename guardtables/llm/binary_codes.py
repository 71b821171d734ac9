"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

A unit vector o, padded with zeros to as many dimensions as the code has bits, is rotated at random; its code
holds the signs x of the result, scaled to length 1, and f = <x, o'> is stored with it. For another vector q,
<x, q'> / f is an unbiased estimate of <o, q> whose error stays below
``sqrt((1 - f^2) / f^2) * WIDTH / sqrt(bits - 1)`` but for a negligible share. Pairs whose estimate plus that
bound stays below the wanted cosine are passed over; all others are computed exactly from the vectors.

Pairs are formed among vectors that agree in one of several bands of the code's bits. The number of bits of a band
grows with the logarithm of the number of vectors, so that a bucket of unrelated vectors stays small, and the
number of bands follows from the wanted recall at exactly the wanted cosine.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import components, tidy

COSINE = 0.9
# Chance that a pair at exactly the wanted cosine meets in no band, and half-width of the bound in deviations.
MISS, WIDTH = 0.001, 4.5
# Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BUCKET_ROWS = 2048
# So many large buckets may be sent to every task.
HOT_BUCKETS = 20_000
PAIRS_AT_ONCE = 20_000


def bands_for(total: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors."""
    bits = min(max(math.ceil(math.log2(max(2, total))) - 4, 6), 24)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def rotation(bits: int, dims: int) -> np.ndarray:
    """The first ``dims`` columns of a random rotation in max(bits, dims) dimensions."""
    size = max(bits, dims)
    random = np.random.default_rng(1234 + dims)
    basis, _ = np.linalg.qr(random.standard_normal((size, dims)))
    return basis.astype(np.float64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of finite numbers with a length, as bytes of doubles divided by it."""
    for batch in batches:
        ids, rows = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if vec_id is None or not vector or any(x is None for x in vector):
                continue
            x = np.array(vector, np.float64)
            largest = np.abs(x).max()
            if np.isfinite(x).all() and largest > 0:
                x = x / largest  # the length of very large or very small numbers stays finite
                ids.append(vec_id)
                rows.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "unit"])


def _codes(bits: int, bands: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            units = batch.column("unit").to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for dims in np.unique(sizes):
                mine = np.flatnonzero(sizes == dims)
                x = np.frombuffer(b"".join(units[i] for i in mine), np.float64).reshape(len(mine), dims)
                if dims not in turns:
                    turns[dims] = rotation(bits * bands, dims)
                turned = x @ turns[dims].T
                signs = turned > 0
                factor = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
                # The vector as a query: 8 bits a number, and how far that is from the vector.
                scale = np.abs(x).max(axis=1) / 127
                small = np.round(x / scale[:, None]).astype(np.int8)
                off = np.linalg.norm(x - small * scale[:, None], axis=1)
                keys = signs[:, : bits * bands].reshape(len(mine), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
                reps = batch.column("rep").take(pa.array(mine))
                packed = np.packbits(signs, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        reps, pa.array(np.full(len(mine), dims, np.int32)),
                        pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(factor.astype(np.float32)),
                        pa.array([r.tobytes() for r in small], pa.binary()), pa.array(scale.astype(np.float32)),
                        pa.array(off.astype(np.float32)), pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    ["rep", "dims", "code", "factor", "query", "scale", "off", "keys"],
                )

    return run


CODES = "rep long, dims int, code binary, factor float, query binary, scale float, off float, keys array<long>"


def _pairs_inside(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs to compare in sorted groups, a bounded number at a time.

    ``side`` is 0 where all rows of a group are compared with each other; otherwise rows of side
    1 are compared with those of side 2.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [len(group)]])
    upto = np.repeat(ends, ends - starts)
    partners = upto - np.arange(len(group)) - 1
    total = np.cumsum(partners)
    at = 0
    while at < len(group):
        floor = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, floor + PAIRS_AT_ONCE, side="right")))
        many = partners[at:end]
        one = np.repeat(np.arange(at, end), many)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        kept = (side[one] == 0) | (side[one] != side[two])
        yield one[kept], two[kept]
        at = end


def _compare(bits: int, bands: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        names = ["band", "key", "dims", "block_a", "block_b"]

        def found(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in names])
            group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
            block = rows.column("block").to_numpy()
            side = np.where(keys[3] == keys[4], 0, np.where(block == keys[3], 1, 2))
            reps, band, dims = rows.column("rep").to_numpy(), keys[0], keys[2]
            out = []
            for size in np.unique(dims):
                mine = np.flatnonzero(dims == size)
                if size not in turns:
                    turns[size] = rotation(bits * bands, int(size)).astype(np.float32)
                part = rows.take(pa.array(mine))
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(mine), -1)
                signs = np.unpackbits(code, axis=1, count=turns[size].shape[0])
                wide = (signs.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(signs.shape[1]))
                query = np.frombuffer(b"".join(part.column("query").to_pylist()), np.int8).reshape(len(mine), size)
                turned = (query * part.column("scale").to_numpy()[:, None]).astype(np.float32) @ turns[size].T
                factor, off = part.column("factor").to_numpy(), part.column("off").to_numpy()
                bound = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * WIDTH / math.sqrt(signs.shape[1] - 1)
                bucket = signs[:, : bits * bands].reshape(len(mine), bands, bits)
                for a, b in _pairs_inside(group[mine], side[mine]):
                    estimate = np.einsum("ij,ij->i", wide[a], turned[b]) / factor[a]
                    # Pairs that the bound does not rule out are computed exactly later on.
                    open_pairs = np.flatnonzero(estimate + bound[a] + off[b] / factor[a] >= cosine)
                    a, b = a[open_pairs], b[open_pairs]
                    # A pair is reported in the first band in which it meets.
                    first = (bucket[a] == bucket[b]).all(axis=2).argmax(axis=1)
                    new = (first == band[mine][a]) & (reps[mine][a] != reps[mine][b])
                    out.append(np.stack([reps[mine][a[new]], reps[mine][b[new]]], axis=1))
            pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))] if len(pairs)
                else [pa.array([], pa.int64())] * 2,
                ["v", "u"],
            )

        # Rows come sorted by bucket; the last bucket of a batch may go on in the next one.
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = [rows.column(n)[rows.num_rows - 1] for n in names]
            keys = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in names])
            ended = np.flatnonzero((keys != np.array([x.as_py() for x in last])[:, None]).any(axis=0))
            upto = int(ended[-1]) + 1 if len(ended) else 0
            if upto:
                yield found(rows.slice(0, upto))
            held = rows.slice(upto)
        if held is not None and held.num_rows:
            yield found(held)

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column("unit").to_pylist(), batch.column("unit_u").to_pylist()
        exact = [
            float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) for a, b in zip(one, two, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("v"), batch.column("u"), pa.array(exact, pa.float64())], ["v", "u", "cosine"]
        )


def similar_pairs(units: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs of different vectors with an exact cosine of at least ``cosine``: ``v`` < ``u``, ``cosine``.

    ``units`` has ``rep`` (an id, once) and ``unit``. Buckets of many vectors are cut into blocks, and each pair of
    blocks is its own group of rows, so no task holds a whole hot bucket.
    """
    bits, bands = bands_for(units.count(), cosine)
    codes = cut(units.mapInArrow(tidy(_codes(bits, bands, cosine)), CODES))
    light = codes.select("dims", F.posexplode("keys").alias("band", "key"))
    counts = light.groupBy("band", "key", "dims").agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > BUCKET_ROWS))
    rows = codes.select(*[c for c in codes.columns if c != "keys"], F.posexplode("keys").alias("band", "key"))
    many = F.broadcast(hot) if hot.limit(HOT_BUCKETS + 1).count() <= HOT_BUCKETS else hot
    rows = rows.join(many, ["band", "key", "dims"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "dims", "code", "factor", "query", "scale", "off", "band", "key", "block",
        F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
    )
    keys = ["band", "key", "dims", "block_a", "block_b"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    pairs = dealt.mapInArrow(tidy(_compare(bits, bands, cosine)), "v long, u long")
    one = units.select(F.col("rep").alias("v"), "unit")
    two = units.select(F.col("rep").alias("u"), F.col("unit").alias("unit_u"))
    exact = pairs.join(one, "v").join(two, "u").mapInArrow(tidy(_cosines), "v long, u long, cosine double")
    return exact.where(F.col("cosine") >= cosine)


def vector_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links and components of vectors: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read. Two vectors of equal
    length link when their cosine in double precision is at least ``cosine``. Vectors that are null,
    empty, zero, or hold a null or non-finite number link with nothing. Equal vectors are one
    class with a count, so copies are not compared with each other. Rows that repeat a ``vec_id``
    give one row; they link as copies would, without counting themselves.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    units = rows.mapInArrow(tidy(_units), "vec_id long, unit binary").distinct()
    # Copies with the same direction are found by their exact bytes; others link by their cosine of 1.
    classes = cut(units.groupBy("unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    # The rep of a class is its first id; an id that stands for two classes would be ambiguous, so a hash decides.
    classes = classes.withColumn("rep", F.xxhash64("unit"))
    links = cut(similar_pairs(classes.select("rep", "unit"), cosine))
    sizes = classes.select("rep", "copies")
    both = links.select(F.col("v").alias("rep"), F.col("u").alias("other")).union(
        links.select(F.col("u").alias("rep"), F.col("v").alias("other"))
    )
    degree = (
        both.join(sizes.withColumnRenamed("rep", "other").withColumnRenamed("copies", "more"), "other")
        .groupBy("rep").agg(F.sum("more").alias("linked"))
    )
    joined = components(links, "v", "u")
    smallest = (
        classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("rep", "first", F.coalesce("component_id", "rep").alias("root"))
    )
    named = smallest.groupBy("root").agg(F.min("first").alias("component_id"))
    per_class = (
        smallest.join(named, "root").join(sizes, "rep").join(degree, "rep", "left")
        .select("rep", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    members = units.select("vec_id", F.xxhash64("unit").alias("rep")).join(per_class, "rep")
    by_id = members.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = rows.select("vec_id").distinct()
    found = ids.join(by_id, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
