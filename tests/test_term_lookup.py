"""Term and transposed-alias lookups find parts of words and whole phrases, as a scan of the catalog does."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from normspark import plans
from normspark.operators import search as E

SF = Path("/root/testdata/sf0.001")
LAWS = "slug string, title string, description string, aliases array<string>, law_type string, number string, year int, hot boolean, hydrated_at int"
ROWS = [
    ("env", "Lei do Meio", "Política ambiental do país", ["PNMA"], "Lei", "6.938", 1981, True, 2), ("ctb", "Código de Trânsito", "Institui o ctb", [], "Lei", "9.503", 1997, False, None),
    ("cp", "Código Penal", None, ["Código Criminal cp40"], "Decreto-Lei", "2.848", 1940, True, 1), ("none", "Outra", "", [], "Lei", "1", 2000, False, None),
]
QUERIES = ["ambient", "ctb", "cp", "x", "q", "digo tran", "meio ambiente", "zzzz", "ambient zzzz", "4", "", "rciminal", "cirminal", "lei pna"]


def brute(q, laws, stage):
    out = set()
    for r in q:
        needles = set(r.swapped) if stage == 2 else {r.p.terms, *(w for w in r.p.terms.split(" ") if len(w) >= 4)}
        for c in laws:
            fields = c.n_aliases if stage == 2 else [c.n_title, c.n_description, *c.n_aliases]
            if (stage == 3 or c.hot) and r.p.law_type in (None, c.law_type) and any(w and w in f for w in needles for f in fields):
                out.add((r.query_id, c.slug))
    return out


def test_equal_a_scan(spark):
    q = E.parsed(spark.createDataFrame([(str(i), x) for i, x in enumerate(QUERIES)], "query_id string, query string"))
    laws = E.prepared(spark.createDataFrame(ROWS, LAWS))
    for stage, fn in ((2, E.by_transposition), (3, E.by_terms)):
        got = [(r.query_id, r.slug) for r in fn(q, laws).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(q.collect(), laws.collect(), stage)
    found = {(r.query_id, r.slug) for r in E.by_terms(q, laws).collect()}
    assert {("0", "env"), ("1", "ctb"), ("2", "cp")} <= found


def test_search_reads_descriptions(spark):
    q = spark.createDataFrame([(1, "ambient"), (2, "ctb")], "query_id int, query string")
    got = {(r.query_id, r.slug, r.stage) for r in E.search(q, spark.createDataFrame(ROWS, LAWS), native=True).collect()}
    assert {(1, "env", 3), (2, "ctb", 3)} <= got


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_whole_table(spark):
    part = spark.read.parquet(str(SF / "part.parquet")).select("p_partkey", "p_name", "p_type", "p_brand").collect()
    got = [(r.query_id, r.slug) for r in plans.queries()["e7_term_lookup_all"](spark, str(SF)).collect()]
    want = set()
    for name in {r.p_name for r in part}:
        needles = {name, *(w for w in name.split(" ") if len(w) >= 4)}
        want |= {(name, str(r.p_partkey)) for r in part if any(w in f for w in needles for f in (r.p_name.lower(), r.p_type.lower(), r.p_brand.lower().replace("#", " ")))}
    assert len(got) == len(set(got)) and set(got) == want
    words = plans.queries()["e7_word_lookup"](spark, str(SF)).join(spark.read.parquet(str(SF / "part.parquet")).select(F.col("p_partkey").cast("string").alias("query_id"), "p_name"), "query_id")
    assert {(r.p_name, r.slug) for r in words.collect()} <= set(got)
