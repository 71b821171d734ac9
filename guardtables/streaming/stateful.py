"""Keyed state over streams: repeat guard, rolling usage, admission, single-use approvals.

Each processor keeps one bounded JSON value per key. Rows of a key inside a micro-batch are
taken in time order; across batches they are taken as they arrive.
"""
from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.limits import ADMISSION, LIMITS, AgentLedger, play


class JsonFold(StatefulProcessor):
    """Folds the rows of a key into a JSON state and emits rows."""

    columns: list[str] = []
    order = ["ts", "event_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row) -> tuple | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self._state.get()[0]) if self._state.exists() else self.start()
        batch = pd.concat(list(rows)).sort_values(self.order)
        out = [r for r in (self.step(state, row) for row in batch.itertuples(index=False)) if r is not None]
        self._state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


LOOP = "event_id bigint, agent_id string, session_id string, control_id string"


class LoopGuard(JsonFold):
    """Session limit and repeats of a fingerprint in a sliding window."""

    columns = ["event_id", "agent_id", "session_id", "control_id"]

    def __init__(self, max_identical: int, window_seconds: float, max_requests: int) -> None:
        self.max_identical, self.window, self.max_requests = max_identical, int(window_seconds * 1e6), max_requests

    def start(self) -> dict:
        return {"count": 0, "recent": []}

    def step(self, state: dict, row) -> tuple | None:
        who = (row.event_id, row.agent_id, row.session_id)
        if state["count"] >= self.max_requests:
            return (*who, "loop.session_limit")
        now = _micros(row.ts)
        state["count"] += 1
        state["recent"] = [r for r in state["recent"] if r[0] > now - self.window]
        state["recent"].append([now, row.fingerprint])
        same = sum(fp == row.fingerprint for _, fp in state["recent"])
        return (*who, "loop.repeat") if same > self.max_identical else None


ROLLING = "event_id bigint, agent_id string, requests_window bigint, tokens_window bigint"


class Rolling(JsonFold):
    """Requests and tokens of an agent in the trailing window."""

    columns = ["event_id", "agent_id", "requests_window", "tokens_window"]

    def __init__(self, seconds: float) -> None:
        self.window = int(seconds * 1e6)

    def start(self) -> dict:
        return {"recent": []}

    def step(self, state: dict, row) -> tuple:
        now = _micros(row.ts)
        state["recent"] = [r for r in state["recent"] if r[0] > now - self.window]
        state["recent"].append([now, int(row.tokens)])
        return (row.event_id, row.agent_id, len(state["recent"]), sum(t for _, t in state["recent"]))


class Admission(JsonFold):
    """Sequential admission of one agent's requests."""

    columns = [part.split()[0] for part in ADMISSION.split(", ")]

    def step(self, state: dict, row) -> tuple | None:
        ledger = _ledger_from(state)
        result = play(ledger, row)
        state.clear()
        state.update(_ledger_to(ledger))
        return result


def _ledger_to(ledger: AgentLedger) -> dict:
    return {
        "day": ledger.day, "spent": str(ledger.spent), "compute": ledger.compute, "held": str(ledger.held),
        "open": {rid: [str(cost), tokens] for rid, (cost, tokens) in ledger.open.items()},
        "recent": [list(r) for r in ledger.recent], "tokens": ledger.tokens,
    }


def _ledger_from(state: dict) -> AgentLedger:
    ledger = AgentLedger()
    if state:
        ledger.day, ledger.compute, ledger.tokens = state["day"], state["compute"], state["tokens"]
        ledger.spent, ledger.held = Decimal(state["spent"]), Decimal(state["held"])
        ledger.open = {rid: (Decimal(cost), tokens) for rid, (cost, tokens) in state["open"].items()}
        ledger.recent = deque(state["recent"])
    return ledger


FIRST_USE = "approval_id string, call_id string, ts timestamp"


class FirstUse(JsonFold):
    """The first eligible call of an approval; later ones get nothing."""

    columns = ["approval_id", "call_id", "ts"]
    order = ["ts", "call_id"]

    def step(self, state: dict, row) -> tuple | None:
        if state.get("used"):
            return None
        state["used"] = True
        return (row.approval_id, row.call_id, row.ts)


def _fold(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


def loop_guard(
    stream: DataFrame, max_identical: int = 3, window_seconds: float = 120.0, max_requests: int = 60
) -> DataFrame:
    return _fold(stream, ["agent_id", "session_id"], LoopGuard(max_identical, window_seconds, max_requests), LOOP)


def rolling_usage(stream: DataFrame, seconds: float = 60.0) -> DataFrame:
    return _fold(stream, ["agent_id"], Rolling(seconds), ROLLING)


def admission(stream: DataFrame, budgets: DataFrame) -> DataFrame:
    """Admission over a stream of usage events; budgets are a small static table."""
    joined = stream.join(budgets.select("agent_id", *LIMITS), "agent_id", "left")
    return _fold(joined, ["agent_id"], Admission(), ADMISSION)


def first_use(eligible: DataFrame) -> DataFrame:
    """One call per approval over a stream of eligible calls (approval_id, call_id, ts)."""
    return _fold(eligible, ["approval_id"], FirstUse(), FIRST_USE)
