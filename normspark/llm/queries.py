"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_id, media_columns, near_dup, packing, personal_data, phrases, quality_rules, secret_scan, sentence_pieces, token_counts, url_filter, vector_codes
from .common import table


def _over(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": _over("documents", secret_scan.digest),
        "op2_quality_rules": quality_rules.digest,
        "op3_packing": _over("documents", packing.digest),
        "op4_sentence_pieces": _over("documents", sentence_pieces.digest),
        "op5_media_columns": _over("documents", media_columns.digest),
        "op6_near_dup": _over("documents", near_dup.digest),
        "op7_url_filter": _over("pages", url_filter.digest),
        "op8_personal_data": _over("documents", personal_data.digest),
        "op9_token_counts": _over("documents", token_counts.digest),
        "op10_language_id": _over("documents", language_id.digest),
        "op11_vector_codes": _over("embeddings", vector_codes.digest),
        "op12_phrases": _over("documents", phrases.digest),
        "op13_html_text": _over("pages", html_text.digest),
        "pipeline": lambda spark, sf_dir: importlib.import_module("corpus_pipeline").run(spark, sf_dir),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.oracle_sql(), "op11_vector_codes": vector_codes.oracle_sql(), "op12_phrases": phrases.oracle_sql(), "op13_html_text": html_text.oracle_sql()}
