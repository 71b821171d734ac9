"""Writers of findings, decisions, sealed logs and exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import _filtered, line_body, seal, seal_heads, sealed_lines


def write_dated(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Parquet by day; rows of a day are spread over files, not sent to one task."""
    df.withColumn("date", F.to_date(ts)).write.mode(mode).partitionBy("date").parquet(path)


def decisions_writer(path: str, keys: list[str] | None = None):
    """A foreachBatch function that writes findings and decisions of a batch.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..operators.decisions import explode_findings

        ids = keys or ["request_id"]
        batch.drop("views").write.mode("overwrite").parquet(f"{path}/decisions/batch={batch_id}")
        explode_findings(batch, *ids).write.mode("overwrite").parquet(f"{path}/findings/batch={batch_id}")

    return write


def write_sealed(log: DataFrame, path: str, key: bytes, shard_rows: int = 1024) -> None:
    """A sealed copy of a log and the heads of its shards."""
    sealed = seal(log, key, shard_rows)
    sealed.write.mode("errorifexists").parquet(f"{path}/log")
    written = log.sparkSession.read.parquet(f"{path}/log")
    seal_heads(written, key, shard_rows).write.mode("errorifexists").parquet(f"{path}/heads")


def append_sealed(log: DataFrame, path: str, key: bytes, batch: int, shard_rows: int = 1024) -> None:
    """Continue a sealed log with the records after its last one (``seq`` goes on).

    The last shard goes on from its digest and only the heads above new or longer shards are made again. Batch N writes
    ``log/batch=N`` and ``heads/batch=N``, the heads of the whole log, so a batch that is repeated after a failure
    replaces its own folders. Batches count from 0.
    """
    spark = log.sparkSession
    previous, started, last = None, None, 0
    if batch:
        previous = read_heads(spark, path, batch - 1)
        leaves = previous.where("level = 0")
        last = leaves.agg(F.sum("count")).first()[0]
        started = leaves.where(F.col("count") < shard_rows).select(F.col("node").alias("shard"), F.col("hash").alias("start"))
    first = log.agg(F.min("seq")).first()[0]
    if first is not None and first != last + 1:
        raise ValueError(f"the log ends with record {last}; these begin with {first}")
    seal(log, key, shard_rows, started=started).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")
    written = spark.read.parquet(f"{path}/log/batch={batch}")
    heads = seal_heads(written, key, shard_rows, previous) if first is not None or previous is None else previous
    heads.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")


def read_heads(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The heads of a log after a batch of ``append_sealed``."""
    return spark.read.parquet(f"{path}/heads/batch={batch}")


def write_sealed_lines(log: DataFrame, path: str, key: bytes, shard_rows: int = 1024) -> None:
    """Sealed records as JSON lines in files whose names and lines are in the order of ``seq``; ``body`` is a JSON object."""
    ready = log.withColumn("body", line_body(F.col("body"), F.col("seq")))
    write_lines(sealed_lines(seal(ready.select("seq", "body"), key, shard_rows)), path)


def write_lines(lines: DataFrame, path: str, order: str = "seq") -> None:
    """Text files in order of a column."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("errorifexists").text(path)


def export_lines(log: DataFrame, **equal) -> DataFrame:
    """JSON lines of the records that pass the filters, ready for ``write.text``."""
    return _filtered(log, equal).select(F.to_json(F.struct(*log.columns)).alias("value"))
