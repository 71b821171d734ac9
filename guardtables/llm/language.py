"""Language identification with rank-order profiles of character n-grams."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

# Lengths of the n-grams are 1 to 3; a profile holds so many of the most frequent ones.
PROFILE = 300
NONE = "und"
SPACE = 32

_LOWER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point the code point of its lower case if it is a letter, else a space."""
    if not _LOWER:
        table = np.full(0x110000, SPACE, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LOWER.append(table)
    return _LOWER[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, one entry for each occurrence; empty without letters.

    Letters are lower-cased, everything between words is one space, and a text begins and ends with one.
    An n-gram may begin or end with the space but not hold it inside, so none goes across words.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    x = np.full(len(points) + 2, SPACE, np.int64)
    x[1:-1] = _letters()[points]
    gap = x == SPACE
    x = x[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    pair = (x[:-1] << 21) | x[1:]
    triple = (pair[:-1] << 21) | x[2:]
    return np.concatenate([x[x != SPACE], pair, triple[x[1:-1] != SPACE]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def top(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text in order; equal counts go by the n-gram."""
    codes, counts = counted(codes)
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):  # three numbers of 8 bytes for each character
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = np.array(part.column("text").to_pylist(), object)
            for lang in set(langs):
                mine = [grams(t) for t in texts[langs == lang] if t]
                codes, counts = counted(np.concatenate(mine)) if mine else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """The ``size`` most frequent n-grams of each language over all the given texts: ``lang``, ``gram``, ``place``.

    Rows with a null language teach nothing. Counts are added up in the tasks before the shuffle.
    """
    rows = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counts = rows.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).drop("n")


class Ranks:
    """The profiles as one table: for every n-gram of any profile its place in each, or ``size``."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), size, np.int64)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), at[lang]] = place

    def closest(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance (ties: the first by name) and the likeness.

        An n-gram counts the difference of its places in both profiles, or ``size`` where the
        language's profile lacks it. Likeness is 1 less the distance over the largest one possible.
        """
        codes = top(grams(text or ""), self.size)
        if not len(codes) or not self.langs:
            return NONE, 0.0
        spot = np.searchsorted(self.grams, codes)
        known = self.grams[np.minimum(spot, len(self.grams) - 1)] == codes
        places = self.places[np.where(known, spot, len(self.grams))]
        own = np.arange(len(codes))[:, None]
        apart = np.where(places == self.size, self.size, np.abs(places - own)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(codes))


def _closest(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            found = [ranks.closest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return run


def with_language(docs: DataFrame, training: DataFrame, size: int = PROFILE) -> DataFrame:
    """Language of each whole text by rank-order profiles: ``row`` (all columns but the text), ``text``, ``lang_pred``, ``score``.

    ``training`` has ``text`` and ``lang``; profiles come from all of it, and only they (at most
    ``size`` rows for each language) reach the driver. Only the text decides: a null text, or one
    without a letter, is ``und`` with score 0, and so is every text when no language was learned.
    Repeated rows are judged each by themselves.
    """
    rows = profiles(training, size).collect()
    ranks = Ranks([(r.lang, r.gram, r.place) for r in rows], size)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    texts = docs.select(
        F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([*texts.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(tidy(_closest(sent)), schema)


def identify(docs: DataFrame, training: DataFrame, size: int = PROFILE) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of each text; see ``with_language``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_language(texts, training, size).select("row.doc_id", "lang_pred", "score")
