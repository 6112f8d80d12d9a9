"""Candidate queries for work: what is due, what was never tried, and a fair pick across sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_attempt(items: DataFrame, jobs: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Items with the columns of their newest job (largest ``order``), null without any."""
    newest = jobs.groupBy(key).agg(F.max(F.struct(*order, *cols)).alias("__j"))
    return items.join(newest, key, "left").select(*items.columns, *(F.col(f"__j.{c}").alias(c) for c in [*order, *cols]))


def fair_pick(rows: DataFrame, source: str, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows in all; every source is served once before any is served again."""
    rn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return rows.withColumn("turn", rn).where(F.col("turn") <= n).orderBy("turn", source).limit(n)


def keyset(rows: DataFrame, key: str, after, n: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(n)


def skip_reasons(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group and whether the group has more."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*group))
    return rows.withColumn("rn", rn).withColumn("truncated", size > n).where(F.col("rn") <= n)
