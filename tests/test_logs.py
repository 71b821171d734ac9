"""Logs, limits and metrics against plain Python."""
import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from guardtables.functions.crypto import hmac_sha256
from guardtables.functions.jsonx import is_finite_json, without_digest, without_known_digest
from guardtables.functions.windows import interpolated, order_statistics, running_total, trailing
from guardtables.operators import audit, limits, metrics
from guardtables.sources.readers import decision_log_lines, numbered_lines, read_sealed_lines, with_positions
from guardtables.sources.sinks import append_sealed, export_lines, read_heads, write_sealed, write_sealed_lines

KEY = b"k" * 70
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event_rows(n=400, seed=3):
    """Events in arrival order with equal times and a hot agent."""
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, 20, 59, 60, 61, 4000]))
        agent = "hot" if rng.random() < 0.4 else f"a{rng.randrange(4)}"
        rows.append((i, at, agent, f"s{rng.randrange(2)}", f"f{rng.randrange(2)}", rng.randrange(1, 50)))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    schema = "event_id bigint, ts timestamp, agent_id string, session_id string, fingerprint string, tokens bigint"
    return spark.createDataFrame(event_rows(), schema).cache()


def test_hmac(spark):
    got = spark.createDataFrame([("żółć",), ("",)], "t string").select(hmac_sha256(KEY, F.col("t"))).collect()
    assert [r[0] for r in got] == [hmac.new(KEY, t.encode(), hashlib.sha256).hexdigest() for t in ("żółć", "")]


def test_trailing_counts_in_arrival_order(spark, events):
    rows, expected = event_rows(), {}
    for i, at, agent, *_, tokens in rows:
        seen = [r for r in rows[: i + 1] if r[2] == agent and r[1] > at - timedelta(seconds=60)]
        expected[i] = (len(seen), sum(r[5] for r in seen))
    got = trailing(events, ["agent_id"], "ts", "event_id", 60.0, {"n": F.lit(1), "t": F.col("tokens")}).collect()
    assert {r.event_id: (r.n, r.t) for r in got} == expected


def test_loop_guard_equals_a_sequential_guard(spark, events):
    counts, recent, expected = {}, {}, set()
    for i, at, agent, session, fp, _ in event_rows():
        key = (agent, session)
        if counts.get(key, 0) >= 30:
            expected.add((i, "loop.session_limit"))
            continue
        counts[key] = counts.get(key, 0) + 1
        recent[key] = [r for r in recent.get(key, []) if r[0] > at - timedelta(seconds=120)] + [(at, fp)]
        if sum(f == fp for _, f in recent[key]) > 2:
            expected.add((i, "loop.repeat"))
    got = limits.loop_findings(events, 2, 120.0, 30).collect()
    assert {(r.event_id, r.control_id) for r in got} == expected


def usage_frames(spark, seed=5, n=300):
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([1, 10, 30, 61, 9000]))
        agent, cost = f"a{rng.randrange(3)}", Decimal(rng.randrange(1, 400)) / 1000
        rows.append((3 * i, at, agent, "reserve", f"r{i}", rng.randrange(1, 120), cost, 0.0))
        how = rng.random()
        if how < 0.9:
            later = at + timedelta(seconds=rng.choice([2, 45, 7200]))
            rows.append((3 * i + 1, later, agent, "settle" if how < 0.7 else "release", f"r{i}", rng.randrange(1, 120), cost / 2, 1.5))
    rows.sort(key=lambda r: (r[1], r[0]))
    budgets = [("a0", 1.0, 200, 4, 110, None), ("a1", None, None, 3, None, 20.0), ("a2", 0.9, None, None, 100, None)]
    schema = "agent_id string, usd_per_day double, tokens_per_minute bigint, requests_per_minute bigint, max_tokens_per_request bigint, compute_seconds_per_day double"
    return rows, spark.createDataFrame(rows, limits.USAGE_EVENT), spark.createDataFrame(budgets, schema), {b[0]: b[1:] for b in budgets}


def sequential_admission(rows, budgets):
    """A direct simulation that never forgets anything."""
    result, admitted, closed = {}, {}, {}
    for event_id, at, agent, kind, rid, tokens, cost, compute in rows:
        if kind != "reserve":
            if rid in admitted and rid not in closed:
                closed[rid] = (at, kind, tokens, cost, compute)
            continue
        usd, tpm, rpm, most, seconds = budgets[agent]
        mine = {r: v for r, v in admitted.items() if v[1] == agent}
        minute = {r: v for r, v in mine.items() if v[0] > at - timedelta(seconds=60)}
        used_tokens = sum((0 if closed[r][1] == "release" else closed[r][2]) if r in closed else v[2] for r, v in minute.items())
        spent = sum((closed[r][3] for r in mine if r in closed and closed[r][1] == "settle" and closed[r][0].date() == at.date()), Decimal(0))
        held = sum((v[3] for r, v in mine.items() if r not in closed), Decimal(0))
        worked = sum(closed[r][4] for r in mine if r in closed and closed[r][1] == "settle" and closed[r][0].date() == at.date())
        bad = (
            (most is not None and tokens > most) or (rpm is not None and len(minute) + 1 > rpm)
            or (tpm is not None and used_tokens + tokens > tpm) or (usd is not None and spent + held + cost > Decimal(str(usd)))
            or (seconds is not None and worked >= seconds)
        )
        result[event_id] = not bad
        if not bad:
            admitted[rid] = (at, agent, tokens, cost)
    return result


def test_admission_equals_a_sequential_replay(spark):
    rows, events, budgets, plain = usage_frames(spark)
    got = {r.event_id: r.admitted for r in limits.admission(events, budgets).collect()}
    expected = sequential_admission(rows, plain)
    assert got == expected and 20 < sum(expected.values()) < len(expected) - 20


def test_running_total_over_slices(spark, events):
    got = running_total(events, ["agent_id"], [F.col("ts"), F.col("event_id")], F.col("tokens"), F.date_trunc("hour", "ts"), "total")
    sums, expected = {}, {}
    for i, _, agent, *_, tokens in event_rows():
        sums[agent] = sums.get(agent, 0) + tokens
        expected[i] = sums[agent]
    assert {r.event_id: r.total for r in got.collect()} == expected


def test_order_statistics(spark, events):
    values = sorted(r[5] for r in event_rows())
    got = order_statistics(events, [], "tokens", {"third": F.lit(2), "last": F.col("n") - 1}, step=7.0).first()
    assert (got.third, got.last, got.n) == (values[2], values[-1], len(values))
    half = interpolated(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double"), [], "v", {"p": 0.5}).first()
    assert half.p == 3.0


def test_cost_keeps_small_amounts(spark):
    prices = {n: F.lit(v).cast("decimal(12,9)") for n, v in (("input", "0.15"), ("output", "0.6"), ("compute", "0.0004"))}
    got = spark.range(1).select(limits.cost(F.lit(1), F.lit(3), F.lit(0.25), prices)).first()[0]
    assert got == Decimal("0.00000015") + Decimal("0.0000018") + Decimal("0.0001")


def test_limits(spark):
    checks = [("a", F.lit(8), F.lit(10), False), ("b", F.lit(11), F.lit(10), False), ("c", F.lit(0), F.lit(0), False),
              ("d", F.lit(10), F.lit(10), True), ("e", F.lit(1), F.lit(None).cast("int"), False), ("f", F.lit(1), F.lit(10), False)]
    got = spark.range(1).select(limits.limit_findings(checks, F.lit(0.8)).alias("f")).first().f
    assert [(f.control_id, f.action) for f in got] == [("a", "monitor"), ("b", "block"), ("c", "block"), ("d", "block")]


@pytest.fixture(scope="module")
def sealed(spark):
    log = spark.range(1, 51).select(F.col("id").alias("seq"), F.to_json(F.struct("id")).alias("body"), F.lit("x").alias("action"))
    return audit.seal(log, KEY, 20).withColumn("position", F.col("seq")).cache()


def test_seal_is_a_chain_per_shard(sealed):
    prev = audit.GENESIS
    for r in sealed.orderBy("seq").collect():
        prev = audit.GENESIS if (r.seq - 1) % 20 == 0 else prev
        assert r.prev == prev
        prev = hmac.new(KEY, (f"{r.shard}:{r.seq}:" + r.prev + r.body).encode(), hashlib.sha256).hexdigest()
        assert r.hash == prev


def check(log, key=KEY, **options):
    r = audit.verify_chain(log, key, 20, **options).first()
    return r.ok, r["count"], r.broken_at, r.reason


def test_tampering_is_found(spark, sealed):
    assert check(sealed) == (True, 50, None, "ok")
    assert check(audit.tamper(sealed, 7, "body", F.lit("{}"))) == (False, 6, 7, "HMAC mismatch")
    assert check(sealed, b"other") == (False, 0, 1, "HMAC mismatch")
    assert check(audit.tamper(sealed, 9, "prev", F.lit("0"))) == (False, 8, 9, "previous hash mismatch")
    gone = with_positions(sealed.drop("position").where("seq <> 30").withColumn("line", F.col("body")), 7)
    assert check(gone) == (False, 29, 30, "sequence mismatch")
    head = sealed.agg(F.max_by("hash", "seq").alias("hash"), F.count("*").alias("count"))
    assert check(sealed, head=head, require_head=True) == (True, 50, None, "ok")
    assert check(sealed.where("seq < 50"), head=head)[3].startswith("head count mismatch")
    assert check(sealed, head=head.where("false"), require_head=True)[3] == "missing audit head"
    assert check(sealed.withColumn("canonical", F.col("seq") != 4))[2:] == (4, "noncanonical audit line (bytes changed)")


def test_moved_and_missing_shards_are_found(spark, sealed):
    """Whole shards that are swapped or cut out and renumbered."""
    to = F.when(F.col("shard") == 0, F.col("seq") + 20).when(F.col("shard") == 1, F.col("seq") - 20).otherwise(F.col("seq"))
    swapped = sealed.withColumn("seq", to).withColumn("position", F.col("seq"))
    assert check(swapped) == (False, 0, 1, "HMAC mismatch")
    cut_out = sealed.where("shard <> 1").withColumn("seq", F.when(F.col("seq") > 40, F.col("seq") - 20).otherwise(F.col("seq")))
    assert check(cut_out.withColumn("position", F.col("seq"))) == (False, 20, 21, "HMAC mismatch")
    heads = audit.seal_heads(sealed, KEY, 20)
    assert audit.head_faults(sealed, heads, KEY, 20).count() == 0
    short = audit.head_faults(sealed.where("seq < 41"), heads, KEY, 20).collect()
    assert {(r.level, r.node, r.reason) for r in short} == {
        (0, 2, "records of this node are missing"), (1, 0, "head count mismatch")}


def test_heads_reach_one_root(sealed):
    rows = audit.seal_heads(sealed, KEY, 2).collect()
    top = max(r.level for r in rows)
    assert [r["count"] for r in rows if r.level == top] == [50]
    assert sum(r.level == 0 for r in rows) == 3


def test_sealed_files(spark, tmp_path, sealed):
    write_sealed(sealed.select("seq", "body"), str(tmp_path / "log"), KEY, 20)
    back = spark.read.parquet(str(tmp_path / "log/log")).withColumn("position", F.col("seq"))
    assert check(back)[0] and spark.read.parquet(str(tmp_path / "log/heads")).count() >= 4


def test_log_lines(spark):
    lines = ['{"seq":1,"action":"block","summary":"s"}', '{"seq":1,"seq":2}', "[1]", '{"seq":3', ""]
    good, bad = decision_log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.seq, r.action) for r in good.collect()] == [(1, "block")]
    assert sorted(r.reason for r in bad.collect()) == ["not JSON, or a repeated key"] * 3 + ["not an object"]


def test_canonical_bytes(spark):
    lines = ['{"a":1,"b":"ż"}', '{"b":1,"a":2}', '{"a": 1}', "x"]
    got = audit.check_canonical(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.canonical for r in got] == [True, False, False, False]


def test_pages_and_search(spark, sealed):
    assert [r.seq for r in audit.tail(sealed, 3).collect()] == [48, 49, 50]
    assert [r.seq for r in audit.page(sealed, 2, after_seq=10).collect()] == [11, 12]
    assert [r.seq for r in audit.page(sealed, 2, action="x").collect()] == [49, 50]
    assert audit.search(sealed, "ID 7", ["body"]).count() == len([i for i in range(1, 51) if "7" in str(i)])
    assert audit.merge_polled(sealed.union(sealed), 5).count() == 5
    assert json.loads(export_lines(sealed.where("seq = 1"), action="x").first()[0])["seq"] == 1


def test_percentiles_ignore_hostile_values(spark):
    rows = [(i, {"total": v}, "skipped", "chat", "allow") for i, v in enumerate(["10", "20", "30", None, "x", "NaN", "Infinity", "-5"])]
    rows += [(99, {"detect": "4", "judge": "6"}, "allow", "chat", "odd"), (100, {"total": "1"}, "allow", "policy", "allow")]
    log = spark.createDataFrame(rows, "seq int, timings_ms map<string,string>, judge string, kind string, action string")
    log = log.withColumn("primary", F.struct(F.lit(None).cast("string").alias("control_id")))
    got = metrics.latency(log).first()
    assert (got.p50_ms, got.p50_judge_ms, got.p50_no_judge_ms) == (0.0, 10.0, 0.0)
    assert got.p99_ms == pytest.approx(29.2)
    counts = {r.action: r.n for r in metrics.counts_by_action(log).collect()}
    assert counts == {"allow": 8, "monitor": 0, "redact": 0, "require_approval": 0, "block": 0, "other": 1}
    assert metrics.judge_rate(log).first().judge_rate == pytest.approx(1 / 9)


# --- from files to a verdict -----------------------------------------------------------------------------------


def line_files(spark, tmp_path, n=95):
    log = spark.range(1, n + 1).select(
        F.col("id").alias("seq"), F.to_json(F.struct(F.concat(F.lit('zażółć "hash":"x" '), "id").alias("text"), F.struct(
            F.lit("f" * 64).alias("hash"), F.col("id").alias("n")).alias("inner"))).alias("body"))
    path = str(tmp_path / "lines")
    write_sealed_lines(log.repartition(4), path, KEY, 20)
    return path, sorted((tmp_path / "lines").glob("part-*"))


def verdict(spark, path, head=None):
    r = audit.verify_chain(read_sealed_lines(spark, str(path)), KEY, 20, head).first()
    return r.ok, r["count"], r.broken_at, r.reason


def test_lines_keep_their_places(spark, tmp_path):
    path, files = line_files(spark, tmp_path)
    assert files and verdict(spark, path) == (True, 95, None, "ok")
    lines = "".join(f.read_text() for f in files).splitlines()
    assert [json.loads(x)["seq"] for x in lines] == list(range(1, 96))
    first = json.loads(lines[0])
    body = {k: v for k, v in first.items() if k not in ("hash", "prev")}
    signed = "0:1:" + audit.GENESIS + json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert first["hash"] == hmac.new(KEY, signed.encode(), hashlib.sha256).hexdigest() and first["inner"]["hash"] == "f" * 64

    def damaged(name, lines, end="\n"):
        target = tmp_path / name
        target.mkdir()
        (target / "a.txt").write_text("\n".join(lines[:40]) + "\n" if len(lines) > 40 else "")
        (target / "b.txt").write_text("\n".join(lines[40:] if len(lines) > 40 else lines) + end)
        return verdict(spark, target)

    assert damaged("same", lines) == (True, 95, None, "ok")
    assert damaged("reordered", [lines[1], lines[0], *lines[2:]]) == (False, 0, 1, "sequence mismatch")
    assert damaged("deleted", lines[:49] + lines[50:]) == (False, 49, 50, "sequence mismatch")
    assert damaged("cut", [*lines[:60], lines[60][:30], *lines[61:]]) == (False, 60, 61, "unreadable audit")
    assert damaged("twice", [*lines[:60], lines[60].replace('"seq"', '"n":1,"n":2,"seq"'), *lines[61:]])[2:] == (61, "unreadable audit")
    assert damaged("torn", [*lines[:-1], lines[-1][:-10]], "") == (False, 94, 95, "incomplete audit line")
    assert damaged("no_break", lines, "") == (False, 94, 95, "incomplete audit line")
    assert damaged("edited", [x.replace('"n":33', '"n":34') for x in lines])[2:] == (33, "HMAC mismatch")
    assert damaged("spaced", [*lines[:7], lines[7].replace('","', '", "', 1), *lines[8:]])[2:] == (8, "noncanonical audit line (bytes changed)")
    assert damaged("text_seq", [lines[0].replace('"seq":1,', '"seq":"1",'), *lines[1:]])[2:] == (1, "sequence mismatch")
    assert damaged("blank", [*lines[:3], "", *lines[3:]])[2:] == (4, "unreadable audit")


def test_split_files_are_numbered(spark, tmp_path):
    """Files cut into many splits, with empty and long lines."""
    rng = random.Random(1)
    lines = ["x" * rng.choice([0, 0, 1, 5, 300]) + str(i) * rng.choice([0, 1]) for i in range(3000)]
    for i in range(3):
        (tmp_path / f"part-{i}.txt").write_text("".join(x + "\n" for x in lines[i * 1000 : (i + 1) * 1000]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = numbered_lines(spark, str(tmp_path)).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in got] == lines and [r.position for r in got] == list(range(1, 3001)) and all(r.complete for r in got)


def test_one_long_chain_is_checked_in_slices(spark, sealed, monkeypatch):
    monkeypatch.setattr(audit, "SLICE", 7)
    log = audit.seal(sealed.select("seq", "body"), KEY, 1000).withColumn("position", F.col("seq"))

    def got(rows):
        r = audit.verify_chain(rows, KEY).first()
        return r.ok, r["count"], r.broken_at, r.reason

    assert got(log) == (True, 50, None, "ok")
    for at in (1, 7, 8, 30, 50):
        assert got(audit.tamper(log, at, "hash", F.lit("0" * 64)))[2:] == (at, "HMAC mismatch")
        assert got(audit.tamper(log, at, "prev", F.lit("1" * 64)))[2:] == (at, "previous hash mismatch")


def test_a_sealed_log_goes_on(spark, tmp_path, sealed):
    log = sealed.select("seq", "body")
    for batch, (after, upto) in enumerate([(0, 1), (1, 19), (19, 20), (20, 20), (20, 47), (47, 50)]):
        append_sealed(log.where((F.col("seq") > after) & (F.col("seq") <= upto)), str(tmp_path), KEY, batch, 4)
        append_sealed(log.where((F.col("seq") > after) & (F.col("seq") <= upto)), str(tmp_path), KEY, batch, 4)  # repeated
        whole = audit.seal_heads(audit.seal(log.where(F.col("seq") <= upto), KEY, 4), KEY, 4)
        made = read_heads(spark, str(tmp_path), batch)
        assert {tuple(r) for r in made.collect()} == {tuple(r) for r in whole.collect()}
    back = spark.read.parquet(str(tmp_path / "log")).withColumn("position", F.col("seq"))
    assert audit.verify_chain(back, KEY, 4).first()["ok"] and back.count() == 50
    with pytest.raises(ValueError, match="ends with record 50"):
        append_sealed(log, str(tmp_path), KEY, 6, 4)


def test_rows_without_a_number_are_not_sealed(spark):
    log = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (None, None)], "seq long, body string")
    got = audit.seal(log, KEY, 2).collect()
    assert len(got) == 5 and sum(r.hash is None for r in got) == 2 and all(r.hash is None for r in got if r.seq is None)


def test_known_digests_are_cut_out_as_read_ones(spark):
    one, two = "ab" * 32, "cd" * 32
    values = [
        {"hash": one}, {"a": 1, "hash": one}, {"hash": one, "z": [1]}, {"a": 1, "hash": one, "z": 2}, {"a": {"hash": one}, "hash": one},
        {"a": {"hash": two}, "hash": one}, {"a": f'"hash":"{one}"', "hash": one}, {"hash": "short"}, {"a": {"hash": one}}, {"hash": one, "z": {"hash": one}},
    ]
    texts = [(json.dumps(v, separators=(",", ":")),) for v in values] + [(None,)]
    value = F.try_variant_get(F.try_parse_json("t"), "$.hash", "string")
    got = spark.createDataFrame(texts, "t string").select(
        without_known_digest(F.col("t"), "hash", value).alias("a"), without_digest(F.col("t"), "hash").alias("b")
    ).collect()
    left = [json.dumps({k: v for k, v in x.items() if k != "hash" or v == "short"}, separators=(",", ":")) for x in values] + [None]
    assert [r.a for r in got] == left and [r.b for r in got] == left


def test_numbers_that_are_not_finite_are_found_beside_digests(spark):
    texts = ["1e999", "-1e999", "[1,2e400]", '{"a": 1E999}', "9" * 400, '{"h":"3e999"}', '{"h":"x,1e999"}', '{"a":1e3,"h":"3e999"}', "[1.5]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(is_finite_json(F.col("t"))).collect()
    assert [r[0] for r in got] == [False] * 5 + [True] * 4


def test_a_sealed_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a").write_text('{"seq":1}\n')
    plan = read_sealed_lines(spark, str(tmp_path / "lines"))._jdf.queryExecution().optimizedPlan().toString()
    # Once for its value; twice for each digest whose text stands in the line more than once.
    assert plan.count("parse_json") <= 5


def test_a_truncated_log_is_sealed_once(spark, monkeypatch):
    from guardtables.plans import load

    sealed, read = [], audit.verify_chain
    monkeypatch.setattr(audit, "verify_chain", lambda log, key, rows, head: sealed.append(head) or read(log, key, rows, head))
    got = load()[0]["truncated_tail"](spark, "/root/testdata/sf0.001").collect()
    assert got[0].reason.startswith("head count mismatch")
    # The head comes from the written records, not from a second chain of them.
    assert "sha2" not in sealed[0]._jdf.queryExecution().optimizedPlan().toString()
