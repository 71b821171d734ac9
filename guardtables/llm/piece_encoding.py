"""SentencePiece encoding and decoding through a table of distinct chunks."""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

MARK = "▁"
# A chunk: whitespace markers, then what follows up to the next marker.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
# A worker's table starts anew beyond so many entries or characters.
TABLE_ENTRIES, TABLE_CHARS = 300_000, 8_000_000


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """The text's chunks without their first marker; the first marker of all is the one the model adds."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(" " + text)]


class ChunkTable:
    """Ids and decoded text of each distinct chunk, segmented once.

    Exact where no piece of the model holds a marker after another character: merges then never
    cross from one chunk into the next. The constructor checks that.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.model.get_piece_size()
        if any(MARK in p.lstrip(MARK) for p in map(self.model.id_to_piece, range(size))):
            raise ValueError("pieces of this model cross whitespace markers")
        self.marker = [self.model.piece_to_id(MARK)]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        # Ids of all chunks end to end, and where each chunk's begin.
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)

    def add(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.place]
        if len(self.place) + len(new) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            self.clear()
            new = list(parts)
        if not new:
            return
        found = [ids if p else self.marker for p, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)]
        self.chars += sum(map(len, new))
        at, sizes = len(self.place), np.fromiter(map(len, found), np.int64, len(found))
        first = self.starts[at]
        ends = first + np.cumsum(sizes)
        self.flat = grown(self.flat, int(ends[-1]))
        self.starts = grown(self.starts, at + len(new) + 1)
        self.flat[first : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1] - first))
        self.starts[at + 1 : at + len(new) + 1] = ends
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.texts += [" " + text for text in self.model.decode(found, num_threads=1)]


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """The array, at least ``size`` long."""
    return x if len(x) >= size else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


_TABLES: dict[str, ChunkTable] = {}


def encoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get(model) or _TABLES.setdefault(model, ChunkTable(model))
        for batch in batches:
            for part in slices(batch, "text"):
                yield encoded(table, part)
        table.clear()  # a worker may go on with other work

    return run


def encoded(table: ChunkTable, batch: pa.RecordBatch) -> pa.RecordBatch:
    documents = [chunks(t or "") for t in batch.column("text").to_pylist()]
    distinct = set().union(*documents)
    table.add(distinct)
    place, texts = table.place.__getitem__, table.texts.__getitem__
    counts = np.fromiter(map(len, documents), np.int64, len(documents))
    order = np.fromiter(map(place, chain.from_iterable(documents)), np.int64, int(counts.sum()))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    listed = order.tolist()
    decoded = ["".join(map(texts, listed[a:b]))[1:] for a, b in pairwise(bounds.tolist())]
    # Ids join back by position: the chunks' id lists are laid end to end in order of the text.
    starts = table.starts[order]
    sizes = table.starts[order + 1] - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    ids = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(table.flat[take], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
    )


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each whole text and the text they decode to: ``doc_id``, ``ids`` array<int>, ``decoded``.

    The result equals the library's own ``encode`` (no begin or end ids, no sampling) and
    ``decode``. A null or empty text has no ids and decodes to the empty text. Rows are independent,
    so repeated rows and ids give repeated results; other columns are not read. There is no shuffle:
    each Python worker keeps one bounded table of distinct chunks.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(encoder(model)), "doc_id long, ids array<int>, decoded string")
