"""Listings, statistics, inventories and dataset comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.operators.ranges import greedy, running


def catalog_stats(rows: DataFrame, by: str, with_text: Column, unavailable: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(with_text).alias("with_text"), F.count_if(unavailable).alias("unavailable"))


def pending(stats: DataFrame) -> DataFrame:
    left = F.col("total") - F.col("with_text") - F.col("unavailable")
    return stats.withColumn("pending", F.greatest(F.lit(0), F.coalesce(left, F.lit(0))))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page in order, with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def size_report(rows: DataFrame, backend: str, pointer: Column, size_band: Column, size: str) -> DataFrame:
    """Counts and sizes by (backend, pointer, band), by (backend, pointer) and in total."""
    base = rows.select(F.col(backend).alias("backend"), pointer.alias("pointer"), size_band.alias("band"), F.col(size).alias("size"))
    out = base.groupingSets([["backend", "pointer", "band"], ["backend", "pointer"], []], "backend", "pointer", "band").agg(
        F.grouping_id("backend", "pointer", "band").alias("level"), F.count("*").alias("n"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum("size").alias("bytes"), F.count_if(F.col("size") > 1000).alias("large"))
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(rows: DataFrame, status: str, text: str) -> DataFrame:
    """One row: count, status counts as a JSON object in key order, and a checksum over texts that needs no order."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"), F.sum(F.conv(F.left(F.md5(F.col(text)), F.lit(8)), 16, 10).cast("long")).alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(status).alias("k"), F.col("n").alias("v"))))
    return counts.agg(F.sum("n").alias("n"), F.sum("x").alias("text_sum"), F.to_json(F.map_from_entries(pairs)).alias("status_counts"))


def compare_copies(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row: rows only left, only right, differing; and the verdict."""
    body = F.struct(*cols)
    both = left.select(key, body.alias("a"), F.lit(1).alias("l")).join(right.select(key, body.alias("b"), F.lit(1).alias("r")), key, "full_outer")
    out = both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("different"))
    return out.withColumn("verdict", F.when(F.col("only_left") + F.col("only_right") + F.col("different") == 0, "equal").otherwise("different"))


LANES = 8


def row_text(rows: DataFrame) -> Column:
    """A row as one text that tells any two rows apart: names in order, each value with its length, null as ``-``."""
    def value(name: str) -> Column:
        text = rows[name].cast("string") if rows.schema[name].dataType.typeName() not in ("struct", "array", "map", "variant") else F.to_json(rows[name])
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat_ws(",", *(value(c) for c in sorted(rows.columns)))


def schema_digest(rows: DataFrame) -> str:
    """SHA-256 of names and types in the order of names."""
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(rows.schema.fields, key=lambda f: f.name)).encode()).hexdigest()


def dataset_fingerprint(rows: DataFrame, status: str, required: dict[str, Column] | None = None) -> DataFrame:
    """One row: ``n``, ``rows_digest``, ``status_counts`` and ``checks`` (JSON objects), ``schema_digest``.

    ``rows_digest`` is of the multiset of rows: the eight 32-bit words of each row's SHA-256 are summed by themselves, so no
    order and no sort is needed, repeats count, and partial sums are merged. ``required`` names records that must be there by a
    condition; ``checks`` holds the digest of the rows that meet it (the greatest, if several do) or an empty text.
    A null status counts as ``null``. An empty table has n = 0 and a digest too.
    """
    hashed = rows.withColumn("__h", F.sha2(row_text(rows), 256)).withColumn("__status", F.coalesce(rows[status].cast("string"), F.lit("null")))
    words = [F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(LANES)]
    checks = {name: F.max(F.when(c, F.col("__h"))) for name, c in sorted((required or {}).items())}
    counts = hashed.groupBy("__status").agg(F.count("*").alias("n"), *(F.sum(w).alias(f"w{i}") for i, w in enumerate(words)), *(c.alias(f"check_{k}") for k, c in checks.items()))
    total = [F.coalesce(F.sum(F.col(f"w{i}")), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(LANES)]
    found = [x for k in checks for x in (F.lit(k), F.coalesce(F.max(f"check_{k}"), F.lit("")))]
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__status").alias("k"), F.col("n").alias("v"))))  # one entry a status
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat_ws(",", *total), 256).alias("rows_digest"), F.to_json(F.map_from_entries(pairs)).alias("status_counts"),
        F.to_json(F.create_map(*found) if found else F.lit(None).cast("map<string,string>")).alias("checks"), F.lit(schema_digest(rows)).alias("schema_digest"),
    )


def compare_fingerprints(restored: DataFrame, expected: DataFrame) -> DataFrame:
    """``verdict`` (equal, different) and ``reasons`` of two fingerprints: row counts, schema, status counts, rows, and each required record that is missing in ``expected``, lost or changed."""
    a, b = (df.select(F.struct(*df.columns).alias(x)) for df, x in ((restored, "a"), (expected, "b")))
    both = a.crossJoin(F.broadcast(b))  # one row each
    differs = lambda name, what: F.when(~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")), what)
    ours, theirs = (F.coalesce(F.from_json(f"{x}.checks", "map<string,string>"), F.create_map().cast("map<string,string>")) for x in "ab")

    def record(k: Column) -> Column:
        mine, wanted = (F.coalesce(F.try_element_at(m, k), F.lit("")) for m in (ours, theirs))
        what = F.when(wanted == "", "no required record ").when(mine == "", "lost record ").when(mine != wanted, "changed record ")
        return F.concat(what, k)

    keys = F.array_sort(F.array_union(F.map_keys(ours), F.map_keys(theirs)))
    found = F.array(differs("n", "row counts"), differs("schema_digest", "schema"), differs("status_counts", "status counts"), differs("rows_digest", "rows"))
    return both.select(F.array_compact(F.concat(found, F.transform(keys, record))).alias("reasons")).select(F.when(F.size("reasons") == 0, "equal").otherwise("different").alias("verdict"), "reasons")


def bad_checksums(rows: DataFrame, key: str, body: str, checksum: str) -> DataFrame:
    """Keys whose payload is missing or does not have the recorded sha256."""
    reason = F.when(F.col(body).isNull(), "missing").when(F.sha2(F.col(body), 256) != F.col(checksum), "mismatch")
    return rows.select(key, reason.alias("reason")).where("reason is not null")


def cumulative_bins(rows: DataFrame, bucket: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Consecutive rows of a bucket in bins by the running sum of sizes before them."""
    return running(rows, bucket, order, F.col(size), "__upto").withColumn("bin", F.floor((F.col("__upto") - F.col(size)) / budget)).drop("__upto")


def greedy_batches(rows: DataFrame, bucket: str, key: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Consecutive rows of a bucket until the count or the byte budget is full; an oversized row stands alone."""
    return greedy(rows.select(bucket, key, size), bucket, [key], size, max_rows, max_bytes)


def coverage_status(laws: DataFrame, key: str, snapshots: DataFrame, nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """What is known of each law: ``laws`` (``key``, ``history`` as it was), ``snapshots`` (``key``), ``nodes`` (``key``, ``node_type``), ``changes`` (``key``, ``linked``: found in this text)."""
    seen = snapshots.select(key).distinct().withColumn("__s", F.lit(True))
    kinds = nodes.groupBy(key).agg(F.bool_or(F.col("node_type") == "document").alias("__whole"))
    known = changes.groupBy(key).agg(F.bool_or("linked").alias("__linked"))
    rows = laws.join(seen, key, "left").join(kinds, key, "left").join(known, key, "left")
    return rows.select(
        key, F.when(F.col("__s"), "available").otherwise("not_materialized").alias("official_source"),
        F.when(~F.coalesce("__s", F.lit(False)), "not_materialized").when(F.col("__whole"), "unstructured").otherwise("partial").alias("structured_text"),
        F.when(F.col("__linked").isNotNull(), "partial").otherwise(F.coalesce("history", F.lit("not_materialized"))).alias("history"),
        F.when(F.col("__linked"), "partial").otherwise("not_identified").alias("attribution"),
    )


def capacity_left(requested: Column, active: Column, cap: int) -> Column:
    return F.least(requested, F.greatest(F.lit(0), F.lit(cap) - active))
