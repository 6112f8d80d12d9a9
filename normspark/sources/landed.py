"""Landed JSON pages as a whole: a page that cannot be trusted is rejected as one, so that an incomplete catalog shows.

A page becomes a VARIANT first; its shape is checked before any record is read with a fixed schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.operators.catalog import reject_reasons


@dataclass(frozen=True)
class Shape:
    """Where a page keeps its records (the name of a list), and by JSON path its number, its totals and a record's id."""

    records: str
    number: str | None = None
    totals: tuple[str, ...] = ()
    id: str | None = None


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def items(v: Column) -> Column:
    """The elements of a VARIANT that is a list, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def pages(spark: SparkSession, path: str, shape: Shape, numbered: str | None = None, strict: bool = False) -> DataFrame:
    """One row a landed file: ``file``, ``page`` (its own number), ``value`` and ``reject`` (null for a page that can be read).

    Reasons: ``broken`` (not JSON, cut off), ``no_list``, ``record`` (one that is no object), ``repeated`` (an id twice),
    ``page`` (another number than the first group of ``numbered`` finds in the file's path); if ``strict`` also a missing number, and ``total`` (a count that is missing).
    Spark's readers pass over files of no bytes: such a page is missing, which the check of page numbers finds.
    """
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("__v"))
    v = F.col("__v")
    rows = rows.withColumn("__items", items(F.try_variant_get(v, f"$.{shape.records}", "variant")))
    ids = F.transform("__items", lambda x: F.try_variant_get(x, shape.id, "string")) if shape.id else None
    number = F.try_variant_get(v, shape.number, "bigint") if shape.number else F.lit(None).cast("bigint")
    whole = v.isNotNull()
    checks = {
        "broken": ~whole,
        "no_list": whole & F.col("__items").isNull(),
        "record": F.coalesce(F.exists("__items", lambda x: ~is_object(x)), F.lit(False)),
        "repeated": F.lit(False) if ids is None else F.coalesce(F.size(F.array_distinct(F.array_compact(ids))) < F.size(F.array_compact(ids)), F.lit(False)),
        "page": F.lit(False) if not shape.number else whole & ((F.lit(strict) & number.isNull()) | (F.lit(False) if numbered is None else ~number.eqNullSafe(F.expr("try_cast(__n AS bigint)")))),
        "total": F.lit(False) if not (strict and shape.totals) else whole & F.array_contains(F.array(*(F.try_variant_get(v, t, "bigint").isNull() for t in shape.totals)), True),
    }
    rows = rows.withColumn("__n", F.regexp_extract("file", numbered, 1) if numbered else F.lit(None).cast("string"))
    return rows.select("file", number.alias("page"), "value", F.nullif(reject_reasons(checks), F.lit("")).alias("reject"))


def records(landed: DataFrame, schema: str, name: str) -> DataFrame:
    """``page``, ``r`` (a record of ``schema``'s list ``name``) and ``page_reject``: the records of good pages, one row without a record for each rejected page."""
    got = F.when(F.col("reject").isNull(), F.from_json("value", schema))
    rows = landed.select("page", "reject", got.alias("__p"))
    read = rows.where("reject IS NULL").select("page", F.explode(F.col("__p")[name]).alias("r"), F.lit(None).cast("string").alias("page_reject"))
    kind = read.schema["r"].dataType
    bad = rows.where("reject IS NOT NULL").select("page", F.lit(None).cast(kind).alias("r"), F.concat(F.lit("page:"), "reject").alias("page_reject"))
    return read.unionByName(bad)


def quarantined(landed: DataFrame) -> DataFrame:
    """The rejected pages as they landed, with their reasons, for a quarantine folder."""
    return landed.where("reject IS NOT NULL").select("file", "page", "reject", "value")
