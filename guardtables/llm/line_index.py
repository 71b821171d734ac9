"""Line de-duplication on sharded cuckoo filters backed by exact reference tables.

The index of a corpus is three tables in a folder that all executors share:

* ``references`` (shard, key, doc_id): one row for each key and document that holds it;
* ``counts`` (shard, key, n_docs, max_doc): the exact reference counts, for all keys;
* ``filters`` (shard, buckets, n_keys): one cuckoo filter per shard of the keys that ``min_docs``
  documents or more hold.

A filter says of most lines at once that they stay; a line that passes it is looked up in the exact
counts, so a false positive of the filter never changes a result. Documents are inserted and
deleted in batches. Each batch rewrites the counts of the shards that it touches from exact rows and
adds the fingerprints of keys that came over ``min_docs`` to the filters, or takes out those that fell
below it: after a deletion the index decides as if the documents had never been there.
"""
from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import tidy

SPACE = " \t\n\x0b\x0c\r"
# Slots of a bucket, and rounds of moving before a filter is built anew with more buckets.
SLOTS, ROUNDS = 4, 500
# Share of its slots that a filter is filled to before it is built anew.
FULL = 0.85
# Filters are sent to every task up to so many bytes in all; beyond that lines meet them by a join.
FILTER_BYTES = 16 << 20
KEYS_PER_SHARD = 50_000
SCHEMA = "doc_id long, n_lines long, keys array<binary>"


def key_of(line: str, min_chars: int) -> bytes | None:
    """The key of a line in 16 bytes, or None when it is too short to count.

    The line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case, as a 128-bit hash.
    """
    bare = line.strip(SPACE)
    return xxhash.xxh3_128_digest(bare.encode().lower()) if len(bare) >= min_chars else None


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [(t or "").split("\n") for t in batch.column("text").to_pylist()]
            keys = [[k for k in dict.fromkeys(key_of(x, min_chars) for x in d) if k] for d in lines]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(d) for d in lines], pa.int64()),
                    pa.array(keys, pa.list_(pa.binary())),
                ],
                ["doc_id", "n_lines", "keys"],
            )

    return run


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct keys of each document: ``doc_id``, ``n_lines``, ``keys``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_keys(min_chars)), SCHEMA)


# --- the filter ---------------------------------------------------------------------------------------------------


class CuckooFilter:
    """A cuckoo filter of 16-byte keys: 16-bit fingerprints, four slots to a bucket, 0 for free.

    The other bucket of a fingerprint is its bucket XOR a hash of the fingerprint, so an entry can
    be moved or deleted without its key. Keys are hashed already: bytes 0 to 7 give the bucket and
    bytes 8 to 9 the fingerprint.
    """

    def __init__(self, n_buckets: int = 1):
        self.table = np.zeros((n_buckets, SLOTS), np.uint16)

    @classmethod
    def for_keys(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with room for the keys, with all of them inserted."""
        size = 1 << max(0, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * FULL)))))
        while True:
            made = cls(size)
            if made.insert(keys):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and fingerprint of keys given as an array (n, 16) of bytes."""
        pairs = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
        prints = (pairs[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return pairs[:, 0], np.where(prints == 0, np.uint16(1), prints)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, prints = self.parts(keys)
        first = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return first, self.other(first, prints), prints

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        first, second, prints = self.places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def _settle(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put entries into free slots of their buckets; which of them found one."""
        done = np.zeros(len(bucket), bool)
        for slot in range(SLOTS):
            free = np.flatnonzero(~done & (self.table[bucket, slot] == 0))
            _, chosen = np.unique(bucket[free], return_index=True)  # one entry for a slot
            taken = free[chosen]
            self.table[bucket[taken], slot] = prints[taken]
            done[taken] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys; False when the filter is too full (it must then be built anew)."""
        first, second, prints = self.places(keys)
        done = self._settle(first, prints)
        bucket, prints = second[~done], prints[~done]
        random = np.random.default_rng(len(keys))
        for _ in range(ROUNDS):
            done = self._settle(bucket, prints)
            bucket, prints = bucket[~done], prints[~done]
            if not len(bucket):
                return True
            # One entry for a full bucket takes the place of another, which goes on to its other bucket.
            full, chosen = np.unique(bucket, return_index=True)
            slot = random.integers(0, SLOTS, len(full))
            thrown = self.table[full, slot]
            self.table[full, slot] = prints[chosen]
            bucket[chosen], prints[chosen] = self.other(full, thrown), thrown
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one entry for each key; the keys must have been inserted."""
        first, second, prints = self.places(keys)
        for a, b, p in zip(first.tolist(), second.tolist(), prints.tolist(), strict=True):
            bucket = a if (self.table[a] == p).any() else b
            self.table[bucket, int(np.argmax(self.table[bucket] == p))] = 0


def _as_rows(keys) -> np.ndarray:
    """Keys given as bytes objects, as an array (n, 16)."""
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


# --- the index ----------------------------------------------------------------------------------------------------


def shard_of(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class LineIndex:
    """The three tables of one corpus in a shared folder; each change writes a new version of them."""

    def __init__(
        self, spark: SparkSession, folder: str, min_chars: int = 40, min_docs: int = 5, shards: int | None = None
    ):
        self.spark, self.folder, self.version = spark, folder, 0
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.folder, f"{name}-{self.version}"))

    def _write(self, name: str, rows: DataFrame, version: int) -> DataFrame:
        path = posixpath.join(self.folder, f"{name}-{version}")
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _references(self, docs: DataFrame) -> DataFrame:
        keys = line_keys(docs, self.min_chars).where("doc_id is not null")
        return keys.select("doc_id", F.explode("keys").alias("key"))

    def _counts(self, references: DataFrame) -> DataFrame:
        """Counts of references without repeated rows. A key that a third of all documents hold is an
        aggregate with a map-side part."""
        return references.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents (``doc_id``, ``text``); those that are in already, with the same lines, add nothing."""
        new, after = self._references(docs).distinct(), self.version + 1
        if self.version == 0:
            if self.shards is None:
                new = self._write("added", new, after)
                self.shards = 8 + new.count() // KEYS_PER_SHARD
            self._write("references", new.select(shard_of("key", self.shards).alias("shard"), "key", "doc_id"), after)
            counts = self._counts(new)
            self._write("counts", counts.select(shard_of("key", self.shards).alias("shard"), "*"), after)
            self.version = after
            held = self.table("counts").where(F.col("n_docs") >= self.min_docs).select("shard", "key")
            self._write("filters", held.groupBy("shard").applyInArrow(_build, FILTER_SCHEMA), after)
            return self
        before = self.table("references")
        new = self._write("added", new.join(before, ["key", "doc_id"], "left_anti"), after)
        # Shards split when their keys have become twice as many as they should be.
        wanted = 8 + (self.table("counts").count() + new.select("key").distinct().count()) // KEYS_PER_SHARD
        split = wanted > 2 * self.shards
        self.shards = wanted if split else self.shards
        shard = shard_of("key", self.shards).alias("shard")
        self._write("references", before.select("key", "doc_id").union(new.select("key", "doc_id")).select(shard, "key", "doc_id"), after)
        grown = (
            self.table("counts").select("key", "n_docs", "max_doc").union(self._counts(new))
            .groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        )
        return self._after(self._write("counts", grown.select(shard, "*"), after), after, split)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out again, given by ``doc_id``; ids that are not in change nothing."""
        after, before = self.version + 1, self.table("references")
        gone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        kept = self._write("references", before.join(gone, "doc_id", "left_anti").select(before.columns), after)
        touched = before.join(gone, "doc_id", "left_semi").select("key").distinct()
        counts = self.table("counts")
        again = self._counts(kept.join(touched, "key", "left_semi"))
        fresh = counts.join(touched, "key", "left_anti").select(counts.columns).union(
            again.select(shard_of("key", self.shards).alias("shard"), "*")
        )
        return self._after(self._write("counts", fresh, after), after)

    def _after(self, counts: DataFrame, after: int, split: bool = False) -> LineIndex:
        """Bring the filters up to new counts: keys that crossed ``min_docs`` move in or out.

        A shard whose filter would be too full, or has none, is built anew from the exact counts; so are all shards
        when they were ``split``.
        """
        common = F.col("n_docs") >= self.min_docs
        now = counts.where(common).select("shard", "key")
        if split:
            updated = now.groupBy("shard").applyInArrow(_build, FILTER_SCHEMA)
        else:
            was = self.table("counts").where(common).select("shard", "key")
            filters = self.table("filters")
            room = filters.select("shard", (F.length("buckets") / 2 * FULL).alias("room"))
            full = now.groupBy("shard").agg(F.count("*").alias("n")).join(room, "shard", "left").where(
                F.col("n") > F.coalesce("room", F.lit(0))
            ).select("shard")
            moved = (
                now.join(was, ["shard", "key"], "left_anti").withColumn("added", F.lit(True))
                .union(was.join(now, ["shard", "key"], "left_anti").withColumn("added", F.lit(False)))
            )
            kept, going = (x.join(full, "shard", "left_anti") for x in (filters, moved))
            tried = self._write(
                "tried", kept.groupBy("shard").cogroup(going.groupBy("shard")).applyInArrow(_update, FILTER_SCHEMA), after
            )
            again = full.union(tried.where("n_keys < 0").select("shard")).distinct()
            built = now.join(again, "shard", "left_semi").groupBy("shard").applyInArrow(_build, FILTER_SCHEMA)
            updated = tried.where("n_keys >= 0").union(built)
        self._write("filters", updated, after)
        self.version = after
        return self

    def repeated(self, docs: DataFrame) -> DataFrame:
        """Keys that each document loses: ``doc_id``, ``keys``."""
        keys = line_keys(docs, self.min_chars).where("doc_id is not null")
        filters = self.table("filters")
        if (filters.agg(F.sum(F.length("buckets"))).first()[0] or 0) <= FILTER_BYTES:
            sent = self.spark.sparkContext.broadcast({r.shard: r.buckets for r in filters.collect()})
            shard = F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(self.shards)).cast("int"))
            keys = keys.withColumn("shards", shard).mapInArrow(tidy(_probe(sent)), "doc_id long, keys array<binary>")
        lines = keys.select("doc_id", F.explode("keys").alias("key"))
        exact = self.table("counts").where(F.col("n_docs") >= self.min_docs).select("key", "max_doc")
        lost = lines.join(exact, "key").where("doc_id <> max_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))

    def drop_repeated(self, docs: DataFrame) -> DataFrame:
        """Each text without its repeated lines: ``row`` (all columns but the text), ``n_lines``, ``n_dropped``, ``kept``.

        Lines with a key of at least ``min_chars`` code points that ``min_docs`` documents of the
        index hold stay only in the largest ``doc_id`` that holds the key. A null or empty text is
        one empty line. A null ``doc_id`` holds no key and loses no line; rows that repeat a
        ``doc_id`` are one document and lose the same keys.
        """
        rows = docs.select(
            F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        )
        joined = rows.join(self.repeated(rows), "doc_id", "left").select("row", "text", "lost")
        schema = T.StructType([joined.schema["row"], T.StructField("n_lines", T.LongType()),
                               T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
        return joined.mapInArrow(tidy(_rewrite(self.min_chars)), schema)


FILTER_SCHEMA = "shard int, buckets binary, n_keys long"


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    taken = int(np.count_nonzero(made.table))
    return pa.table(
        {"shard": pa.array([shard], pa.int32()), "buckets": [made.to_bytes()], "n_keys": pa.array([taken], pa.int64())}
    )


def _build(shard: tuple, rows: pa.Table) -> pa.Table:
    """The filter of one shard; shards are sized by distinct keys, so no key is hot here."""
    return _filter_row(shard[0].as_py(), CuckooFilter.for_keys(_as_rows(rows.column("key").to_pylist())))


def _update(shard: tuple, held: pa.Table, moved: pa.Table) -> pa.Table:
    """A shard's filter with the keys that moved; ``n_keys`` is -1 where it could not take them."""
    made = CuckooFilter.from_bytes(held.column("buckets")[0].as_py())
    added = moved.column("added").to_numpy().astype(bool) if moved.num_rows else np.zeros(0, bool)
    keys = _as_rows(moved.column("key").to_pylist()) if moved.num_rows else np.zeros((0, 16), np.uint8)
    made.delete(keys[~added])
    whole = made.insert(keys[added]) if added.any() else True
    row = _filter_row(shard[0].as_py(), made)
    return row if whole else row.set_column(2, "n_keys", pa.array([-1], pa.int64()))


def _probe(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: CuckooFilter.from_bytes(data) for shard, data in sent.value.items()}
        for batch in batches:
            lists = batch.column("keys")
            bounds = lists.offsets.to_numpy()
            flat = lists.flatten()
            shards = batch.column("shards").flatten().to_numpy(zero_copy_only=False)
            keys = _as_rows(flat.to_pylist()) if len(flat) else np.zeros((0, 16), np.uint8)
            found = np.zeros(len(keys), bool)
            for shard in np.unique(shards):
                if (held := filters.get(int(shard))) is not None:
                    mine = np.flatnonzero(shards == shard)
                    found[mine] = held.contains(keys[mine])
            upto = np.concatenate([[0], np.cumsum(found)])[bounds - bounds[0]]
            kept = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept], ["doc_id", "keys"])

    return run


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                total.append(len(lines))
                if lost:
                    lost = set(lost)
                    lines = [x for x in lines if key_of(x, min_chars) not in lost]
                dropped.append(total[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                ["row", "n_lines", "n_dropped", "kept"],
            )

    return run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables below the checkpoint folder that all executors share."""
    cut(spark.range(0))  # sets the folder where the session names none
    return posixpath.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
