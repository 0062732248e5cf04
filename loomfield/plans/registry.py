"""Every registered query with its SQL oracle. Modules add theirs with @query when they are imported."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with SQL that gives the same rows where SQL can."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


for _module in ("search", "rows", "ownership", "insights", "relational", "linkage", "people", "work", "more", "rest", "code", "streams", "statistics", "projects"):
    importlib.import_module(f"loomfield.plans.q_{_module}")
