"""Token-ID files: documents compressed one by one with a shared zstandard dictionary.

A folder holds one dictionary, numbered files of documents and a manifest. A file is

    magic (8 bytes), SHA-256 of the dictionary (32), bytes of an id, 2 or 4 (1)
    one zstandard frame for each document, whose content is its ids, little-endian, in a row
    index: byte offsets of the frames (n + 1), ids before each frame (n + 1), doc_ids (n), all 8 bytes; null flags (n)
    n (8 bytes), start of the index (8), magic (8)

so a reader fetches one short document by the index and one frame. Files hold ascending doc_ids, as do the files among
themselves. A task writes its files under names of their own and reports them only when they are complete; the manifest,
which Spark writes, lists the files that count, so files of lost or repeated tasks are never read.
"""
from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise
from struct import calcsize, pack, unpack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, tidy

MAGIC = b"TOKIDS01"
HEAD, TAIL = "<8s32sB", "<QQ8s"
# Bytes of text whose distinct words are encoded together.
SLICE_BYTES = 8 << 20
# The dictionary, the pieces it is trained on, and the bytes of each.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 64 << 10, 2_000, 4 << 10
# A file is closed when its frames pass so many bytes.
FILE_BYTES = 64 << 20


# --- ids of words ------------------------------------------------------------------------------------------------------

# A word of letters and ASCII signs (no apostrophe): each run of the one or the other kind is encoded by itself. Letters
# are those of ASCII, Latin-1, Latin Extended-A and Russian that stay one letter in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-žА-яЁё"
SIGNS = "!-&(-/:-@\\[-`{-~"
PLAIN = f"^[{LETTERS}{SIGNS}]+$"
SPECIAL = "<|"
# Runs encoded in one text.
JOINED = 1000


class Words:
    """Ids of whole texts from the distinct words of a slice of text, each encoded once by the tokenizers library.

    Exact for vocabularies that drop white space and whose rules do not look across it. The constructor checks the
    first on a probe; that the second holds is a property of the file's normalizer and splitter. Plain words consist of
    runs of letters and signs, which such a vocabulary encodes by themselves and in lower case. Runs are encoded many at a
    time: tokens that end a run are known, so runs are counted off to find them again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        ids = self._each([" a\t\n", "a", "a b", "b", " "])
        if ids[0] != ids[1] or ids[2] != ids[1] + ids[3] or ids[4]:
            raise ValueError("this vocabulary has tokens of white space")
        cased, runs = self._each(["Aé,b", "aé , b"])
        if cased != runs:
            raise ValueError("this vocabulary tells capitals apart, or joins letters and signs")
        self.closes = np.zeros(self.model.get_vocab_size(), bool)
        self.closes[[i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _separately(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end and how many each has."""
        found = self._each(texts)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs, which are encoded many at a time where that comes out."""
        flat, _ = self._separately([" ".join(runs[i : i + JOINED]) for i in range(0, len(runs), JOINED)])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(runs) or (len(ends) and ends[-1] != len(flat)):
            return self._separately(runs)
        return flat, np.diff(ends, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words end to end, plain ones first, and where each word's begin and how many it has."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, SPECIAL)))
        spaced = pc.utf8_lower(words.filter(plain))
        for before, after in ((LETTERS, SIGNS), (SIGNS, LETTERS)):
            spaced = pc.replace_substring_regex(spaced, f"([{before}])([{after}])", r"\1 \2")
        split = pc.ascii_split_whitespace(spaced)
        runs = split.flatten().dictionary_encode()
        flat, sizes = self._runs(runs.dictionary.to_pylist())
        order = runs.indices.to_numpy()
        flat, sizes = taken(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        others, many = self._separately(words.filter(pc.invert(plain)).to_pylist())
        mask = plain.to_numpy(zero_copy_only=False)
        begins, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begins[mask], counts[mask] = ends[:-1], np.diff(ends)
        begins[~mask], counts[~mask] = len(flat) + np.cumsum(many) - many, many
        return np.concatenate([flat, others]), begins, counts

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, and where each text's begin (one more entry at the end); null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        flat, begins, counts = self._words(words.dictionary)
        order = words.indices.to_numpy()
        sizes = counts[order]
        return taken(flat, begins[order], sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]


def taken(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of an array, given by where they begin and their sizes, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)]


_MODELS: dict[str, Words] = {}


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", limit):
            held.append(part)
            size += part.column("text").nbytes
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _MODELS.get(path) or _MODELS.setdefault(path, Words(path))
        end = serialized(np.array([end_id]), words.width)
        for part in gathered(batches, SLICE_BYTES):
            flat, bounds = words.ids(part.column("text"))
            whole, at = serialized(flat, words.width), (bounds * words.width).tolist()
            found = [whole[a:b] + end for a, b in pairwise(at)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return run


# --- the dictionary ------------------------------------------------------------------------------------------------------


def train(encoded: DataFrame, size: int = DICTIONARY_BYTES, samples: int = SAMPLES, piece: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the ids of ``samples`` different documents, those of the least hashes; of each a piece at a place by its hash.

    The sample only bears on how well documents are compressed. Too few documents for training give their ids themselves
    as the dictionary; no documents give none.
    """
    hashed = encoded.withColumn("h", F.xxhash64("ids"))
    # Hashes are even, so a share of their range holds about that share of the documents; four times what is wanted.
    share = min(1.0, 4 * samples / max(1, encoded.count()))
    room = F.greatest(F.octet_length("ids") - piece, F.lit(0))
    place = (F.pmod(F.xxhash64("ids", F.lit(1)), room + 1) / 4).cast("int") * 4 + 1
    near = hashed.where(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    chosen = near.select("h", F.substring("ids", place, F.lit(piece)).alias("ids")).dropDuplicates(["h"]).orderBy("h").limit(samples)
    pieces = [bytes(r["ids"]) for r in chosen.select("ids").collect()]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size]


# --- files ---------------------------------------------------------------------------------------------------------------


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class FileWriter:
    """One file of documents."""

    def __init__(self, folder: str, dictionary: bytes, width: int):
        files, base = opened(folder)
        self.name = f"ids-{uuid.uuid4().hex}.tok"
        self.out = files.open_output_stream(posixpath.join(base, self.name))
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.width, self.ids, self.nulls = width, [], []
        self.offsets, self.starts = [calcsize(HEAD)], [0]
        self.out.write(pack(HEAD, MAGIC, hashlib.sha256(dictionary).digest(), width))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.starts.append(self.starts[-1] + len(ids) // self.width)

    def close(self) -> None:
        for numbers in (self.offsets, self.starts):
            self.out.write(np.array(numbers, "<u8").tobytes())
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes())
        self.out.write(pack(TAIL, len(self.ids), self.offsets[-1], MAGIC))
        self.out.close()


class FileReader:
    """Documents of one file: all in a row, or one by its number or id."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        files, base = opened(folder)
        self.file = files.open_input_file(posixpath.join(base, name))
        size = self.file.size()
        count, at, magic = unpack(TAIL, self.file.read_at(calcsize(TAIL), size - calcsize(TAIL)))
        head, digest, self.width = unpack(HEAD, self.file.read_at(calcsize(HEAD), 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{name} is no file of token ids, or not complete")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        index = self.file.read_at(size - calcsize(TAIL) - at, at)
        numbers = np.frombuffer(index, "<u8", 2 * (count + 1))
        self.offsets, self.starts = numbers[: count + 1].astype(np.int64), numbers[count + 1 :].astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", count, 16 * (count + 1))
        self.nulls = np.frombuffer(index, np.uint8, count, 16 * (count + 1) + 8 * count).astype(bool)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.ids)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, number: int) -> np.ndarray:
        """Ids of one document; reads its frame only."""
        first, last = self.offsets[number : number + 2].tolist()
        return self._ids(self.file.read_at(last - first, first))

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document of an id."""
        known = np.flatnonzero((self.ids == doc_id) & ~self.nulls)
        return self.document(int(known[0])) if len(known) else None

    def documents(self, limit: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All documents with their numbers, read ``limit`` bytes at a time."""
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + limit, side="right")) - 1)
            base = int(self.offsets[at])
            data = self.file.read_at(int(self.offsets[upto]) - base, base)
            for number in range(at, upto):
                yield number, self._ids(data[int(self.offsets[number]) - base : int(self.offsets[number + 1]) - base])
            at = upto

    def close(self) -> None:
        self.file.close()


MANIFEST = "part int, number int, name string, n_docs long, n_tokens long, n_bytes long"


def _written(folder: str, dictionary: bytes, width: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, part = None, 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "name": [writer.name],
                "n_docs": [len(writer.ids)], "n_tokens": [writer.starts[-1]], "n_bytes": [writer.offsets[-1]],
            })

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                writer = writer or FileWriter(folder, dictionary, width)
                writer.add(doc_id.as_py(), ids.as_py())
                if writer.offsets[-1] > file_bytes:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES,
) -> None:
    """Encode whole texts, append ``end_id`` to each and write the files of a new folder that all executors share.

    Documents are in ascending order of doc_id, a null id first; those of one id in the order of a hash of their ids. A
    null or empty text has the end id alone. Rows of equal ids are all written. A table without documents gives a folder
    without files. Texts may be of any length that fits one row; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = posixpath.join(folder, "encoded")
    rows.mapInArrow(tidy(encoder(tokenizer, end_id)), "doc_id long, ids binary").write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.schema("doc_id long, ids binary").parquet(staged)
    dictionary = train(encoded)
    files, base = opened(folder)
    with files.open_output_stream(posixpath.join(base, "dictionary.zstd")) as out:
        out.write(dictionary)
    # Equal rows have a number of their own, so that many of them do not meet in one partition.
    order = ["doc_id", "h", "row_no"]
    numbered = encoded.withColumns({"h": F.xxhash64("ids"), "row_no": F.monotonically_increasing_id()})
    in_order = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    width = Words(tokenizer).width
    listed = in_order.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(
        tidy(_written(folder, dictionary, width, file_bytes)), MANIFEST
    )
    listed.write.parquet(posixpath.join(folder, "manifest"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count, with ``start``, the ids of all files before: one row for each file of ``FILE_BYTES``."""
    rows = spark.read.schema(MANIFEST).parquet(posixpath.join(folder, "manifest"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def dictionary_of(folder: str) -> bytes:
    files, base = opened(folder)
    with files.open_input_stream(posixpath.join(base, "dictionary.zstd")) as source:
        return source.read()


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = dictionary_of(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = FileReader(folder, name, dictionary)
                yield from _rows(reader, start)
                reader.close()

    return run


def _rows(reader: FileReader, start: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Documents of a file in batches of about ``limit`` ids."""
    numbers, held, size = [], [], 0

    def made() -> pa.RecordBatch:
        at = np.array(numbers, np.int64)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(reader.ids[at], pa.int64(), mask=reader.nulls[at]), pa.array(start + reader.starts[at]),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).view(np.int32))),
                pa.array([zlib.crc32(x) for x in held], pa.int64()),
            ],
            ["doc_id", "start", "ids", "ids_crc32"],
        )

    for number, ids in reader.documents():
        numbers.append(number)
        held.append(ids)
        size += len(ids)
        if size > limit:
            yield made()
            numbers, held, size = [], [], 0
    if held:
        yield made()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder: ``doc_id``, ``start`` (ids of all documents before), ``ids``, ``ids_crc32``."""
    files = manifest(spark, folder).select("name", "start").repartition(
        max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name"
    )
    return files.mapInArrow(tidy(_read(folder)), "doc_id long, start long, ids array<int>, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """Ids of the wanted documents alone: each file's index is read and the frames of those it holds.

    ``doc_ids`` (doc_id) is joined to the files' ranges by a list of ids that goes to every task; keep it to what one
    task can hold, or read the folder and join.
    """
    wanted = {r["doc_id"] for r in doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = dictionary_of(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                reader = FileReader(folder, name, dictionary)
                at = [i for i, d in enumerate(reader.ids.tolist()) if d in wanted and not reader.nulls[i]]
                if at:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.ids[at], pa.int64()),
                        "ids": pa.array([reader.document(i).astype(np.int32) for i in at], pa.list_(pa.int32())),
                    })
                reader.close()

    return manifest(spark, folder).select("name").repartition("name").mapInArrow(tidy(run), "doc_id long, ids array<int>")
