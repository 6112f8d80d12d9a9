"""Order within a group without one task a group: rows are cut into ranges of (group, order), each range is worked on
by itself, and what a range needs of those before it (a last key, a sum, a state) is passed on in a table of one row a range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.storage import stored

PART = "__part"


def ranged(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``__part``, the number of their range; ranges ascend in (group, order), and rows that are equal in both share one."""
    return stored(rows.repartitionByRange(group, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _with_piece(rows: DataFrame, pieces: DataFrame, group: str, value: str) -> DataFrame:
    """``rows`` with their piece's ``value``; a null group is a group."""
    p = pieces.select(F.col(group).alias("__g"), F.col(PART).alias("__p"), value)
    return rows.join(p, rows[group].eqNullSafe(F.col("__g")) & (rows[PART] == F.col("__p"))).drop("__g", "__p")


def previous(rows: DataFrame, group: str, order: Sequence[str], key: str, name: str = "previous") -> DataFrame:
    """``key`` of the row before in the group's order (ties by key); null on a group's first row."""
    parts = ranged(rows, group, order)
    ends = parts.groupBy(group, PART).agg(F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(key).alias("k"))).alias("__last"))
    # at most one row a range and group
    ends = ends.select(group, PART, F.lag("__last.k").over(Window.partitionBy(group).orderBy(PART)).alias("__before"))
    inside = Window.partitionBy(PART, group).orderBy(*order, key)
    out = parts.withColumn("__n", F.row_number().over(inside)).withColumn("__own", F.lag(key).over(inside))
    out = _with_piece(out, ends, group, "__before").withColumn(name, F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__own")))
    return out.drop(PART, "__n", "__own", "__before")


def running(rows: DataFrame, group: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over a group's rows up to and with this one; rows that are equal in ``order`` count together."""
    parts = ranged(rows.withColumn("__v", value), group, order)
    sums = parts.groupBy(group, PART).agg(F.sum("__v").alias("__s"))
    offset = F.sum("__s").over(Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("__here", F.sum("__v").over(Window.partitionBy(PART, group).orderBy(*order)))
    out = _with_piece(out, sums.select(group, PART, F.coalesce(offset, F.lit(0)).alias("__offset")), group, "__offset")
    return out.withColumn(name, F.col("__here") + F.col("__offset")).drop(PART, "__v", "__here", "__offset")


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``name``: a row's place in its group, from 0."""
    parts = ranged(rows, group, order)
    sizes = parts.groupBy(group, PART).agg(F.count("*").alias("__s"))
    offset = F.sum("__s").over(Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("__here", F.row_number().over(Window.partitionBy(PART, group).orderBy(*order)))
    out = _with_piece(out, sizes.select(group, PART, F.coalesce(offset, F.lit(0)).alias("__offset")), group, "__offset")
    # ties may fall otherwise when a task is run again, so the places are kept
    return stored(out.withColumn(name, F.col("__here") + F.col("__offset") - 1).drop(PART, "__here", "__offset"), "places")


# ------------------------------------------------------------------ greedy cuts


def next_starts(sizes: np.ndarray, max_rows: int, max_sum: int) -> np.ndarray:
    """For each row, where the batch that starts there is followed by the next; a row over the budget stands alone."""
    n = len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    end = np.searchsorted(total, total[:-1] + max_sum, side="right") - 1
    first = np.arange(n)
    return np.clip(end, first + 1, first + max_rows)


def _chunk_function(sizes: np.ndarray, own: int, max_rows: int, max_sum: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in which a chunk's first batch may start: how many batches start in the chunk, and where in the next chunk the one behind them starts.

    ``sizes`` holds the chunk's ``own`` rows and the first of the next chunk.
    """
    after = next_starts(sizes, max_rows, max_sum)
    count, leave = np.zeros(own + max_rows + 1, np.int64), np.maximum(np.arange(own + max_rows + 1) - own, 0)
    for i in range(own - 1, -1, -1):
        count[i], leave[i] = count[after[i]] + 1, leave[after[i]]
    return count[:max_rows], leave[:max_rows]


def _composed(counts: Sequence, leaves: Sequence, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    at, total = np.arange(max_rows), np.zeros(max_rows, np.int64)
    for c, e in zip(counts, leaves, strict=True):
        total, at = total + np.asarray(c)[at], np.asarray(e)[at]
    return total, at


def _entries(functions: DataFrame, max_rows: int, fan: int) -> DataFrame:
    """``g, chunk, entry, base``: where each chunk's first batch starts and how many batches start before it.

    Functions of ``fan`` chunks are composed into one until a group has at most ``fan``; then the states go down again.
    """
    kind = next(f.dataType.simpleString() for f in functions.schema if f.name == "g")

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        at, base = int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])
        out = []
        for c, e in zip(pdf["count"], pdf["leave"], strict=True):
            out.append((at, base))
            base, at = base + int(c[at]), int(e[at])
        return pd.DataFrame({"g": pdf["g"], "chunk": pdf["chunk"], "entry": [x[0] for x in out], "base": [x[1] for x in out]})

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total, at = _composed(pdf["count"], pdf["leave"], max_rows)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "chunk": pdf["above"].iloc[:1], "count": [total], "leave": [at]})

    states = f"g {kind}, chunk long, entry long, base long"
    last = functions.agg(F.max("chunk").alias("x")).first().x or 0
    if last < fan:
        start = functions.withColumn("entry", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
        return start.groupBy("g").applyInPandas(down, states)
    parts = functions.withColumn("above", F.floor(F.col("chunk") / fan))
    above = stored(parts.groupBy("g", "above").applyInPandas(up, f"g {kind}, chunk long, count array<long>, leave array<long>"), "chunks")
    got = _entries(above, max_rows, fan).select(F.col("g").alias("__g"), F.col("chunk").alias("__above"), "entry", "base")
    return parts.join(got, parts["g"].eqNullSafe(F.col("__g")) & (F.col("above") == F.col("__above"))).drop("__g", "__above").groupBy("g", "above").applyInPandas(down, states)


def greedy(rows: DataFrame, group: str, order: Sequence[str], size: str, max_rows: int, max_sum: int, chunk: int = 20_000, fan: int = 256) -> DataFrame:
    """``batch`` (from 0): consecutive rows of a group until the count or the sum of ``size`` is full; a larger row stands alone.

    Exact for groups of any length: a batch has at most ``max_rows`` rows, so a chunk's first batch starts on one of as
    many places. Each chunk gives a function from that place to its batches and the next chunk's place, functions are composed,
    and each chunk then cuts its own rows. A null or negative size counts as 0; a null group is a group.
    """
    if max_rows < 1:
        raise ValueError("a batch holds at least one row")
    chunk = max(chunk, max_rows)
    placed = positions(rows, group, order, "__k")
    placed = placed.withColumn("__chunk", F.floor(F.col("__k") / chunk)).withColumn("__size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    slim = placed.select(F.col(group).alias("g"), F.col("__chunk").alias("chunk"), F.col("__k").alias("k"), F.col("__size").alias("size"))
    ahead = slim.where((F.col("chunk") > 0) & (F.col("k") % chunk < max_rows)).withColumn("chunk", F.col("chunk") - 1)
    kind = rows.schema[group].dataType.simpleString()

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        own = int((pdf["k"] // chunk == pdf["chunk"]).sum())
        count, leave = _chunk_function(pdf["size"].to_numpy(), own, max_rows, max_sum)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "count": [count], "leave": [leave]})

    functions = stored(slim.unionByName(ahead).groupBy("g", "chunk").applyInPandas(function, f"g {kind}, chunk long, count array<long>, leave array<long>"), "chunks")
    entries = _entries(functions, max_rows, fan).select(F.col("g").alias("__g"), F.col("chunk").alias("__c"), "entry", "base")
    begun = slim.join(entries, slim["g"].eqNullSafe(F.col("__g")) & (F.col("chunk") == F.col("__c"))).drop("__g", "__c")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        after = next_starts(pdf["size"].to_numpy(), max_rows, max_sum)
        starts, at = np.zeros(len(pdf), np.int64), int(pdf["entry"].iloc[0])
        while at < len(pdf):
            starts[at] = 1
            at = int(after[at])
        return pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "batch": int(pdf["base"].iloc[0]) - 1 + np.cumsum(starts)})

    batches = begun.groupBy("g", "chunk").applyInPandas(cut, f"g {kind}, k long, batch long").select(F.col("g").alias("__g"), F.col("k").alias("__p"), "batch")
    out = placed.join(batches, placed[group].eqNullSafe(F.col("__g")) & (placed["__k"] == F.col("__p")))
    return out.select(*(placed[c] for c in rows.columns), "batch")
