"""Streams give the same rows as the batch operators."""
import pytest
from pyspark.sql import functions as F

from guardtables.operators import limits
from guardtables.streaming import stateful, windows
from test_logs import event_rows, usage_frames


def run(spark, df, make, tmp_path, name, files=3):
    """Write rows in time order as a few files and read them as a stream."""
    folder = str(tmp_path / name)
    ordered = df.orderBy("ts", "event_id").collect()
    step = max(1, len(ordered) // files + 1)
    for i in range(0, len(ordered), step):
        spark.createDataFrame(ordered[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        make(stream).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / (name + "_cp"))).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def events(spark):
    schema = "event_id bigint, ts timestamp, agent_id string, session_id string, fingerprint string, tokens bigint"
    return spark.createDataFrame(event_rows(), schema)


def test_loop_guard(spark, events, tmp_path):
    got = run(spark, events, lambda s: stateful.loop_guard(s, 2, 120.0, 30), tmp_path, "loop_rows")
    batch = limits.loop_findings(events, 2, 120.0, 30).collect()
    assert {(r.event_id, r.control_id) for r in got} == {(r.event_id, r.control_id) for r in batch} and batch


def test_rolling_usage(spark, events, tmp_path):
    got = run(spark, events, lambda s: stateful.rolling_usage(s, 60.0), tmp_path, "rolling_rows")
    batch = limits.rolling_usage(events, 60.0).collect()
    assert {(r.event_id, r.requests_window, r.tokens_window) for r in got} == {
        (r.event_id, r.requests_window, r.tokens_window) for r in batch
    }


def test_admission(spark, tmp_path):
    _, events, budgets, _ = usage_frames(spark, n=120)
    got = run(spark, events, lambda s: stateful.admission(s, budgets), tmp_path, "admission_rows")
    batch = limits.admission(events, budgets).collect()
    assert {(r.event_id, r.admitted, r.usd_used) for r in got} == {(r.event_id, r.admitted, r.usd_used) for r in batch}


def test_first_use(spark, events, tmp_path):
    eligible = events.select("ts", "event_id", F.col("agent_id").alias("approval_id"), F.lpad(F.col("event_id").cast("string"), 5, "0").alias("call_id"))
    got = run(spark, eligible, stateful.first_use, tmp_path, "first_rows")
    batch = eligible.groupBy("approval_id").agg(F.min(F.struct("ts", "call_id"))["call_id"].alias("call_id")).collect()
    assert {(r.approval_id, r.call_id) for r in got} == {(r.approval_id, r.call_id) for r in batch}


def log(events):
    return events.select(
        "event_id", "ts", F.col("ts").alias("event_time"), F.col("event_id").alias("seq"), F.lit("chat").alias("kind"), F.lit("allow").alias("judge"),
        F.when(F.col("tokens") > 25, "block").otherwise("allow").alias("action"),
        F.create_map(F.lit("total"), F.col("tokens").cast("string")).alias("timings_ms"),
    )


def test_windowed_metrics(spark, events, tmp_path):
    rows = log(events)
    got = run(spark, rows, lambda s: windows.windowed_metrics(s, "10 minutes", "1 minute"), tmp_path, "metric_rows")
    batch = {tuple(r) for r in windows.windowed_metrics(rows, "10 minutes").collect()}
    # The last windows stay open until the watermark passes them.
    assert got and {tuple(r) for r in got} <= batch and len(got) >= len(batch) - 3


def test_unique_records(spark, events, tmp_path):
    rows = log(events).where("event_id < 50")
    doubled = rows.union(rows.withColumn("event_id", F.col("event_id") + 1000))
    got = run(spark, doubled, lambda s: windows.unique_records(s, "1000 hours"), tmp_path, "unique_rows", 2)
    assert sorted(r.seq for r in got) == list(range(50))


def test_value_stream_join(spark, events, tmp_path):
    both = events.select("event_id", "ts", F.lit("p").alias("principal"), F.lit(6).alias("width"), F.col("tokens").cast("string").alias("digest"))

    def make(s):
        prints = s.where("event_id < 100").select("principal", "width", "digest", F.col("ts").alias("src_ts"))
        late = s.where("event_id >= 100").select("principal", "width", "digest", F.col("ts").alias("call_ts"), "event_id")
        return windows.reused_in_calls(prints, late, "2000 hours", "2000 hours")

    got = run(spark, both, make, tmp_path, "join_rows", 2)
    known = {r[5] for r in event_rows() if r[0] < 100}
    assert {r.event_id for r in got} == {r[0] for r in event_rows() if r[0] >= 100 and r[5] in known}


def test_dimension_keeps_the_last_good_version(spark, events, tmp_path):
    folder = str(tmp_path / "dim_in")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).select("event_id", "agent_id").coalesce(1).write.mode("append").parquet(folder)
    versions = iter([[("hot", 1)], [], [("hot", 2)]])
    seen = []

    def load():
        return spark.createDataFrame(next(versions), "agent_id string, level int")

    def write(df, _):
        seen.append({r.level for r in df.collect()})

    stream = spark.readStream.schema("event_id bigint, agent_id string").option("maxFilesPerTrigger", 1).parquet(folder)
    query = windows.with_live_dimension(
        stream, load, lambda d: d.count() > 0, lambda df, dim: df.join(dim, "agent_id"), write, str(tmp_path / "dim_cp"), available_now=True
    )
    query.awaitTermination(120)
    assert seen == [{1}, {1}, {2}]
