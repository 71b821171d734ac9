"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from guardtables.plans import load  # noqa: E402
from guardtables.session import local_session  # noqa: E402

HEADLINE = [
    "inspect_documents", "decision_rollup", "pii_numbers", "secret_assignments", "redact_documents", "signature_hits",
    "injection_scores", "chunk_documents", "flow_shared_runs", "loop_findings", "rolling_usage", "daily_spend",
    "admission_fold", "latency_percentiles", "daily_latency", "chain_verify", "tool_call_checks", "flow_findings",
    "reused_verdicts", "outages", "threshold_sweep", "catalog_drift", "policy_history", "posture_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    chosen = sys.argv[1:] or HEADLINE
    # Start the JVM's and Python's workers before the clock.
    queries["pii_email_spans"](spark, folder).limit(1).collect()
    spent = {}
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries", "value": round(sum(spent.values()), 3), "unit": "sec",
                "queries": spent, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
