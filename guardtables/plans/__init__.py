"""Registered queries."""
from __future__ import annotations

import importlib

MODULES = ["text_queries", "log_queries", "rule_queries", "policy_queries"]


def load() -> tuple[dict, dict]:
    """All registered queries and their expected-result SQL."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
