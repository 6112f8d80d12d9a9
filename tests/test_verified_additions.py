"""Passages are compared by letters and digits, from 40 characters on, and with the law that their note names."""

import re
from pathlib import Path

import pytest

from normspark import plans
from normspark.operators import changes as D

SF = Path("/root/testdata/sf0.001")
LONG = "Incomprehensibilities, counterrevolutionaries & Straße-x"  # few words, over 40 letters


def flat(x):
    return re.sub("[^a-z0-9]", "", (x or "").casefold())


def brute(docs, items):
    return {(i, d) for i, p in items for d, t in docs if len(flat(p)) >= 40 and flat(p) in flat(t)}


def test_flat_passages(spark):
    docs = [(i, "y" * i + LONG.upper().replace(" ", "\n--") + " end") for i in range(45)] + [(90, None), (91, ""), (92, LONG[:45]), (93, "ﬁ" * 60)]
    items = [(1, LONG), (2, LONG[:30]), (3, None), (4, "fi" * 20), (5, "x" * 39), (6, "YY" + LONG)]
    got = [tuple(r) for r in D.flat_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert {(1, i) for i in range(45)} <= set(got) and (4, 93) in got


def test_note_names_the_law(spark):
    note = "(Incluído pela Lei nº 14.550, de 2023)"
    rows = [("l", "a", "paragraph", note, LONG), ("l", "b", "article", note, LONG), ("l", "c", "paragraph", "(Vide)", LONG), ("l", "d", "paragraph", note, LONG[:30]), ("l", "e", "paragraph", note.replace("2023", "2022"), LONG)]
    nodes = spark.createDataFrame(rows, "law string, node_id string, node_type string, source_note string, text string")
    laws = spark.createDataFrame([("14.550", 2023, f"§ 4º {LONG.upper()}."), ("14.550", 2022, "other")], "number string, year int, text string")
    assert [tuple(r) for r in D.verified_additions(nodes, laws).collect()] == [("l", "a", "14.550", 2023)]


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(str(SF / "documents.parquet")).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(str(SF / "benchmark.parquet")).select("item_id", "text").collect()]
    got = {tuple(r) for r in plans.queries()["d8_verified_additions_all"](spark, str(SF)).collect()}
    assert got == brute(docs, items) and {tuple(r) for r in plans.queries()["d8_word_passages"](spark, str(SF)).collect()} <= got
