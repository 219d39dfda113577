"""Every query of the core library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of quern.plans whose import registers queries.
PLANS = ("retrieval", "statistics", "relational", "answers", "curation", "lifecycle", "tasks", "planning", "streams", "stores", "rules")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) builder under its own name, with the equivalent SQL if there is one."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


for _plan in PLANS:
    import_module(f"quern.plans.{_plan}")
