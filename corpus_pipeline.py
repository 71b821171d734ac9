"""A training corpus from raw documents, in five stages of the operators in ``guardtables.llm``."""
from __future__ import annotations

import functools
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardtables.llm import decontaminate, language, line_index, piece_encoding, weighted_minhash
from guardtables.llm.common import remainder
from guardtables.session import configure, cut, release, small_side, table

# Columns of ``documents``, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# The folder of each application's last stage: its checkpoints and tables, which only that stage's result reads.
_LAST: dict[str, str] = {}


def scratch(stage):
    """A stage whose checkpoints and tables lie in a folder of its own, deleted when a later stage starts from written rows."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        context, app = spark.sparkContext, spark.sparkContext.applicationId
        cut(spark.range(0))  # sets the checkpoint folder where the session names none
        before = context.getCheckpointDir()
        files, plan = docs.inputFiles(), docs._jdf.queryExecution().analyzed().toString()
        written = bool(files) and "ExistingRDD" not in plan and "LogicalRDD" not in plan
        last = _LAST.get(app)
        if last and written and not any(f.startswith(last) for f in files):
            _LAST.pop(app)
            _delete(spark, last)
            release(spark)
        folder = posixpath.join(before, f"stage-{uuid.uuid4().hex}")
        context.setCheckpointDir(folder)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            context.setCheckpointDir(posixpath.dirname(before))
            _LAST.setdefault(app, folder)

    return run_stage


@scratch
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; texts that are null or without a letter go."""
    found = language.with_language(docs.select(COLUMNS), docs.where(remainder("doc_id", 4) != 2))
    return found.where(F.col("lang_pred") != language.NONE).select("row.*", "text").select(COLUMNS)


@scratch
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the long lines that five or more of them hold, but for the last holder's."""
    index = line_index.LineIndex(spark, line_index.shared_folder(spark, "line-index")).insert(docs)
    kept = index.drop_repeated(docs.select(COLUMNS)).select("row.*", F.col("kept").alias("text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


@scratch
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Rows that repeat a doc_id are one document and stay or go together; rows without one stay.
    """
    others = weighted_minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.select(COLUMNS).join(small_side(others), "doc_id", "left_anti").select(COLUMNS)


@scratch
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage like a benchmark item; every row is judged by its own text, whatever its id."""
    rows = docs.select(COLUMNS).withColumn("row_no", F.monotonically_increasing_id())
    texts = rows.select(F.col("row_no").alias("doc_id"), "text")
    found = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_no")).distinct()
    return rows.join(small_side(found), "row_no", "left_anti").select(COLUMNS)


@scratch
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text and the text they decode to."""
    found = piece_encoding.encode(docs, piece_encoding.tokenizer_path())
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pieces", as_pieces),
]

# Out-of-place distances and piece ids have no SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's input."""
    docs, folder = table(configure(spark), sf_dir, "documents"), line_index.shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
