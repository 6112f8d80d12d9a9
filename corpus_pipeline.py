"""A corpus pipeline of five stages over ``documents``; every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normspark.llm import language_id, near_dup, packing, quality_rules, secret_scan
from normspark.llm.common import stored, table

STAGES = [
    ("language ID", language_id.stage),
    ("quality rules", quality_rules.stage),
    ("near duplicates", near_dup.stage),
    ("secret scan", secret_scan.stage),
    ("packing", packing.stage),
]

#: Learned rules, automata and signatures have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
