"""Catalog merge and quality gates: upserts by external id, completeness, order, digests, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.operators.ranges import previous
from normspark.storage import stored


def upsert(stored: DataFrame, incoming: DataFrame, key: str, refresh: Sequence[str], owner: str | None = None) -> DataFrame:
    """Merge by key: ``refresh`` columns come from ``incoming`` where it has a value, all others stay.

    Adds ``change``: added, refreshed, unchanged, untouched (not listed) or conflict (the key belongs to
    another ``owner``; the stored row wins). Duplicate keys of ``incoming`` must have been routed before.
    """
    old, new = stored.alias("o"), incoming.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    was, now = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    clash = was & now & (F.col(f"o.{owner}") != F.col(f"n.{owner}")) if owner else F.lit(False)
    differs = F.lit(False)
    for c in refresh:
        differs = differs | (F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")))
    change = F.when(clash, "conflict").when(~was, "added").when(~now, "untouched").when(differs, "refreshed").otherwise("unchanged")
    cols = [
        (F.when(clash, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")) if c in refresh else F.coalesce(f"o.{c}", f"n.{c}") if c in incoming.columns else F.col(f"o.{c}")).alias(c)
        for c in stored.columns
    ]
    return both.select(*cols, change.alias("change"))


def delta_counts(merged: DataFrame, by: str) -> DataFrame:
    """Rows per kind of change and group, one row per group."""
    kinds = ("added", "refreshed", "unchanged", "untouched", "conflict")
    return merged.groupBy(by).agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))


def unique_identity(seeds: DataFrame, records: DataFrame, on: Sequence[str], record_id: str) -> DataFrame:
    """Seed rows with the id of the record that matches on all of ``on``, if it is the only one."""
    single = records.groupBy(*on).agg(F.count("*").alias("__n"), F.min(record_id).alias(record_id)).where("__n = 1").drop("__n")
    return seeds.join(single, list(on), "inner")


def page_completeness(rows: DataFrame, source: str, page: str, declared: str, size: int) -> DataFrame:
    """Per source: rows against the declared total, and whether totals agree and every page is full but the last."""
    pages = rows.groupBy(source, page).agg(F.count("*").alias("n"), F.min(declared).alias("lo"), F.max(declared).alias("hi"))
    expected = F.least(F.lit(size), F.greatest(F.col("hi") - F.col(page) * size, F.lit(0)))
    return pages.groupBy(source).agg(
        F.sum("n").alias("listed"), F.max("hi").alias("declared"), F.count("*").alias("pages"),
        F.count_if(F.col("n") != expected).alias("bad_pages"),
        ((F.min("lo") == F.max("hi")) & (F.count_if(F.col("n") != expected) == 0) & (F.sum("n") == F.max("hi"))).alias("complete"),
    )


def order_breaks(rows: DataFrame, source: str, position: Sequence[str], key: str) -> DataFrame:
    """Rows whose key is not above the key before, within a source."""
    return previous(rows, source, position, key).where(F.col("previous") >= F.col(key))


def duplicate_routes(rows: DataFrame, key: str) -> DataFrame:
    """Per key listed more than once: identical repeats or a conflict of metadata."""
    whole = F.xxhash64(*(c for c in rows.columns if c != key))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(whole).alias("a"), F.max(whole).alias("b")).where("n > 1")
    return counts.select(key, "n", F.when(F.col("a") == F.col("b"), "repeat").otherwise("conflict").alias("route"))


def minimum_volume(rows: DataFrame, kind: str, minimums: DataFrame) -> DataFrame:
    """``minimums`` (kind, minimum) with the rows found and whether they suffice."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("found"))
    out = minimums.join(counts, kind, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("enough", (F.col("found") >= F.col("minimum")) & (F.col("found") > 0))


def year_gate(rows: DataFrame, key: str, date: str, partition_year: str) -> DataFrame:
    """Per key: rows dated outside their partition's year, and the number of years the key is listed in."""
    return rows.groupBy(key).agg(F.count_if(F.year(date) != F.col(partition_year)).alias("misfiled"), F.count_distinct(partition_year).alias("years"))


def page_fingerprints(rows: DataFrame, source: str, page: str, key: str) -> DataFrame:
    """Per page: sha256 of its ids in order, their count, the first and the last. A page bounds the group's size."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), "\n")
    return rows.groupBy(source, page).agg(F.sha2(ids, 256).alias("sha256"), F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def identity_digest(rows: DataFrame, source: str, key: str, page_size: int, trailing: bool = False) -> DataFrame:
    """Digest of the digests of pages of ids, so that no group holds a whole source's ids."""
    paged = rows.withColumn("__page", F.floor(F.col(key) / page_size))
    pages = page_fingerprints(paged, source, "__page", key)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__page", "sha256"))), lambda x: x["sha256"]), "\n")
    joined = F.concat(joined, F.lit("\n")) if trailing else joined
    return pages.groupBy(source).agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.sha2(joined, 256).alias("digest"))


def resume_point(stored: DataFrame, fresh: DataFrame, source: str, page: str) -> DataFrame:
    """Per source: first page whose stored fingerprint is missing or no longer holds, and pages left to load."""
    mark = ["sha256", "n", "first_id", "last_id"]
    both = fresh.alias("f").join(stored.select(source, page, F.struct(*mark).alias("old")).alias("s"), [source, page], "left")
    stale = ~F.struct(*(F.col(f"f.{m}") for m in mark)).eqNullSafe(F.col("s.old"))
    return both.groupBy(source).agg(F.min(F.when(stale, F.col(page))).alias("first_stale_page"), F.count("*").alias("pages"), F.count_if(stale).alias("pending_pages"))


def above_watermark(rows: DataFrame, marks: DataFrame, source: str, key: str, page_size: int) -> DataFrame:
    """New rows per source above its stored maximum, the new maximum, and whether a full page of news hints at a backlog."""
    new = rows.join(marks, source, "left").where(F.col("max_seen").isNull() | (F.col(key) > F.col("max_seen")))
    return new.groupBy(source).agg(F.count("*").alias("new_rows"), F.max(key).alias("watermark"), (F.count("*") >= page_size).alias("backlog"))


def freshness(last: Column, limit: Column, as_of: Column) -> Column:
    return F.when(last.isNull(), "unknown").when(last < as_of - limit, "stale").otherwise("current")


def reconcile(listed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose listed and stored counts differ."""
    a, b = listed.groupBy(key).agg(F.count("*").alias("listed")), stored.groupBy(key).agg(F.count("*").alias("stored"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return out.where("listed <> stored")


def scope_counts(rows: DataFrame, scope: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(scope), F.lit("not_declared")).alias("scope")).agg(F.count("*").alias("n"))


def stalest(rows: DataFrame, last: str, tie: str, n: int) -> DataFrame:
    """Never seen first, then the oldest."""
    return rows.orderBy(F.asc_nulls_first(last), tie).limit(n)


def merge_coverage(old: Column, new: Column, remove: Sequence[str] = ()) -> Column:
    """Map with ``new`` keys replaced and ``remove`` keys gone."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k) & (~k.isin(*remove) if remove else F.lit(True)))
    return F.map_concat(kept, new)


def reject_reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fire, joined by commas; empty for a valid row."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))), ",")


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def sharded(rows: DataFrame, key: str, per_shard: int) -> DataFrame:
    """Global order of keys of any type: row numbers within ranges of keys, plus the sizes of the ranges before them."""
    ranges = stored(rows.select(key).repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    out = ranges.withColumn("__rank", rank).join(offsets, "__part").withColumn("row", F.col("__offset") + F.col("__rank"))
    return out.select(key, F.floor(F.col("row") / per_shard).alias("shard"), "row")
