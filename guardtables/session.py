"""Session settings, table loading and cut points."""
from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; sizes of shuffles and scans are left to the cluster and AQE.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers hold one batch at a time; texts may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Lower-casing of whole texts is several times faster without ICU.
    "spark.sql.icu.caseMappings.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("guardtables")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; timestamps without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoneless}) if zoneless else df


# Rows of a task of work that is heavy per row: a larger table has more tasks, not longer ones.
TASK_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core and per ``TASK_ROWS`` rows for work that is heavy per row.

    A small file is one split and would keep one core busy; a compressed split of short rows
    may hold millions of them. The rows are counted from the files' footers.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="guardtables-"))
    return df.checkpoint(eager=True)


RELEASE_SECONDS = 0.5


def release(spark: SparkSession) -> None:
    """Delete shuffles and broadcasts that nothing refers to any more, after a step whose result was cut.

    Python gives up its objects first, the JVM hears of that a moment later, so it is asked twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(RELEASE_SECONDS)
        spark._jvm.java.lang.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files below the checkpoint folder that all executors share."""
    cut(spark.range(0))  # sets the folder where the session names none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# Rows a side may have to be sent to every executor.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast when a count shows it is small; otherwise leave it to be shuffled.

    The side is written to the checkpoint folder first, so it is computed once.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept
