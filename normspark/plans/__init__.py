"""Registered queries over the driver's tables: operators applied through column mappings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from normspark.plans import catalog, changes, documents, readers, reports, search, streams  # noqa: F401  (they register)
from normspark.plans.registry import QUERIES, SQL

FLAGSHIP = "e15_batch_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
