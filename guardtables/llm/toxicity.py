"""Toxicity by compression distance: one zstandard dictionary per class, lengths of windows compared.

The ordinary dictionary is trained on windows of ordinary text. The toxic one is trained on windows of toxic text reduced
to what sets them apart: beginnings of words that toxic documents hold significantly oftener, as dictionaries of whole
windows hold mostly what both classes share. It is followed by the ordinary dictionary's content, so that a match there
costs the same in either and lengths differ only by what toxic text adds. A document's distance is the mean number of bytes
that the toxic dictionary saves in its windows.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

# Bytes of a window: whole words up to this size, so that no word is cut. Literals of windows this short are not
# Huffman-coded, so that a match of a few bytes shows.
WINDOW = 60
# The fit reads at most so many labelled documents of each class, those with the lowest hash of the id.
SAMPLE = 1500
DICTIONARY = 16 << 10
LEVEL = 8
# Bytes of a beginning of a word, the space before it included, and the documents it is found in at least.
SHORTEST, LONGEST, HOLDERS = 5, 12, 3
# Windows without a gain that every document is taken to have besides its own: a short text needs more than one hit.
PRIOR = 5
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
WINDOWS = re.compile(rb"\S(?:.{0,%d}(?!\S)|\S+)" % (WINDOW - 1), re.S)


def windows(text: str) -> list[bytes]:
    """The lower-cased text in windows of whole words; a longer word is a window of its own. A space comes first."""
    return [b" " + w for w in WINDOWS.findall(text.lower().encode())]


def _train(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; where the samples are too few for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def beginnings(word: bytes) -> Iterable[bytes]:
    """Beginnings of a word with the space before it; a whole word ends with one."""
    whole = b" " + word + b" "
    return (whole[:n] for n in range(SHORTEST, min(LONGEST, len(whole)) + 1))


def telling(own: list[str], other: list[str]) -> set[bytes]:
    """Beginnings of words that documents of one class hold significantly oftener.

    Significant is a log-likelihood ratio that chance would give about one of all beginnings. Of beginnings of each
    other the one of the largest ratio is kept, the longest one of equals.
    """
    def held(texts: list[str]) -> Counter:
        return Counter(x for t in texts for x in {b for w in set(WORD.findall(t.lower().encode())) for b in beginnings(w)})

    a, b, n, m = held(own), held(other), len(own), len(other)

    def part(seen: float, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0

    def ratio(x: bytes) -> float:
        share = (a[x] + b[x]) / (n + m)
        rest = part(n - a[x], n * (1 - share)) + part(m - b[x], m * (1 - share)) if share < 1 else 0.0
        return part(a[x], n * share) + part(b[x], m * share) + rest

    ratios = {x: ratio(x) for x, c in a.items() if c >= HOLDERS and c / n > b[x] / m}
    tried = math.log(max(3, len(a)))
    good = {x for x, r in ratios.items() if r >= 2 * tried - math.log(math.pi * tried)}

    def better(x: bytes) -> bool:
        return any(ratios.get(x[:k], 0.0) > ratios[x] + 1e-9 for k in range(SHORTEST, len(x)))

    best = {x for x in good if not better(x)}
    covered = {y[:k] for y in best for k in range(SHORTEST, len(y)) if ratios[y] >= ratios.get(y[:k], 0.0) - 1e-9}
    return best - covered


def reduced(text: str, kept: set[bytes]) -> list[bytes]:
    """The text's windows with the telling beginnings of their words alone; windows without one are left out."""
    found = []
    for window in windows(text):
        parts = [max((x for x in beginnings(w) if x in kept), key=len, default=b"") for w in WORD.findall(window)]
        if any(parts):
            found.append(b"".join(parts))
    return found


@dataclass
class Distance:
    """Both dictionaries and the calibration, sent to the tasks."""

    ordinary: bytes
    toxic: bytes
    threshold: float = 0.0
    steepness: float = 1.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )
        return made

    def gain(self, text: str | None, pair: list[zstandard.ZstdCompressor]) -> float:
        """Mean number of bytes that the toxic dictionary saves against the ordinary one in a window."""
        one, two = pair[0].compress, pair[1].compress
        saved = [max(0, len(one(w)) - len(two(w))) for w in windows(text or "")]
        return sum(saved) / (len(saved) + PRIOR)

    def score(self, gain: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.steepness * (gain - self.threshold), -50, 50))))


def fit(toxic: list[str], ordinary: list[str], share: float = 0.5) -> Distance:
    """Train the dictionaries and set the threshold where fewest documents fall on the wrong side.

    ``share`` is the share of toxic documents among all labelled ones, which weighs both kinds of error; of thresholds
    that are equally good the middle is taken. Without documents of one class every score is near 0 (no toxic ones) or
    near 1.
    """
    if not toxic or not ordinary:
        return Distance(b" ", b" ", 1.0 if not toxic else -1.0, 50.0)
    common = _train([w for t in ordinary for w in windows(t)], DICTIONARY)
    kept = telling(toxic, ordinary)
    apart = _train([w for t in toxic for w in reduced(t, kept)], DICTIONARY)
    model = Distance(common, apart + common)
    pair = model.compressors()
    gains = [np.array([model.gain(t, pair) for t in texts]) for texts in (ordinary, toxic)]
    seen = np.unique(np.concatenate([*gains, [0.0]]))
    cuts = np.concatenate([(seen[1:] + seen[:-1]) / 2, [seen[-1] + 0.1]])
    wrong = np.array([(1 - share) * (gains[0] > c).mean() + share * (gains[1] <= c).mean() for c in cuts])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    model.threshold = float(cuts[best[len(best) // 2]])
    model.steepness = 4.0 / max(model.threshold, 1e-3)
    return model


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[str], float]:
    """Texts of at most ``size`` toxic and ``size`` ordinary documents, and the share of toxic labels.

    Ids are picked from ``labels`` (``doc_id``, ``toxic``) first, so only the chosen texts travel.
    """
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").distinct()
    share = known.agg(F.avg("toxic")).first()[0]
    sides = []
    for label in (1, 0):
        picked = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = docs.where("text is not null").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
        texts = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
        sides.append([r.text for r in texts.orderBy("doc_id").collect()])
    return sides[0], sides[1], 0.5 if share is None else share


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        pair = model.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.score(model.gain(t, pair)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Toxicity of each whole text: ``doc_id``, ``score`` (0 to 1, 0.5 at the calibrated threshold).

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; other values, nulls and ids without a text teach
    nothing; a document with both labels teaches both). A text's score follows from the mean saving of the toxic
    dictionary in its windows. Null and empty texts have no window and score like a text without any saving. Repeated
    rows, rows of equal texts and rows without a doc_id are scored each by themselves, and alike; other columns are not
    read. A task holds one slice of texts, or one longer text, and its windows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(*sample(texts, labels, size)))
    return texts.mapInArrow(tidy(_scores(sent)), "doc_id long, score double")
