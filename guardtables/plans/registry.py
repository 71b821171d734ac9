"""Registered queries and the SQL that gives the expected result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, nulls: dict | None = None):
    """Register a function of the input tables under a name.

    ``nulls`` gives the value shown for NULL in some columns, on both sides.
    """

    def add(make: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = make(Inputs(spark, sf_dir))
            return result.fillna(nulls) if nulls else result

        QUERIES[name] = run
        if sql is not None:
            shown = ", ".join(f"coalesce({c}, {v!r}) as {c}" for c, v in (nulls or {}).items())
            ORACLES[name] = f"select * replace ({shown}) from ({sql}) q" if shown else sql
        return make

    return add
