"""Idempotency, search, histories and reports on small inline tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from normspark.operators import catalog as C
from normspark.operators import changes as D
from normspark.operators import reports as R
from normspark.operators import search as E
from normspark.operators import selection as G

LAWS = "slug string, title string, description string, aliases array<string>, law_type string, number string, year int, hot boolean, hydrated_at int"


@pytest.fixture(scope="module")
def laws(spark):
    rows = [
        ("lgpd", "Lei Geral de Proteção de Dados Pessoais", "Dispõe sobre dados", ["LGPD"], "Lei", "13.709", 2018, True, 3), ("cp", "Código Penal", "", ["CP"], "Decreto-Lei", "2.848", 1940, True, 2),
        ("mpv1", "Medida Provisória 2.206-1", "", [], "Medida Provisória", "2.206-1", 2001, False, None), ("mpv2", "Medida Provisória 2.206-2", "", [], "Medida Provisória", "2.206-2", 2001, False, None),
        ("water", "Lei das Águas", "Recursos hídricos do país", [], "Lei", "9.433", 1997, False, None),
    ]
    return spark.createDataFrame(rows, LAWS)


def run(spark, laws, *queries, articles=None):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    out = {i: [] for i in range(len(queries))}
    for r in E.search(q, laws, articles).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r)
    return [out[i] for i in range(len(queries))]


def test_search(spark, laws):
    typo, one, both, none, water = run(spark, laws, "LGDP", "MPV 2.206-1/2001", "MPV 2.206/2001", "99.999/2001", "recursos hidricos")
    assert typo[0].slug == "lgpd" and typo[0].suggestion and typo[0].score == 840 and typo[0].stage == 2
    assert [r.slug for r in one] == ["mpv1"] and one[0].score == 1100
    assert sorted(r.slug for r in both) == ["mpv1", "mpv2"] and none == []
    assert water[0].slug == "water" and water[0].score == 780
    nodes = spark.createDataFrame([("cp", "art:121"), ("water", "art:121")], "slug string, node_id string")
    (found,) = run(spark, laws, "codigo penal art. 121", articles=nodes)
    assert found[0].slug == "cp" and found[0].score == 900 + 260


def test_search_native_needs_no_python(spark, laws):
    q = spark.createDataFrame([(1, "codigo penl")], "query_id int, query string")
    df = E.search(q, laws, native=True)
    assert "Python" not in df._jdf.queryExecution().toString() and df.first().slug == "cp"


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", "x", "s1"), (2, "b", "y", "s1")], "id int, title string, state string, owner string")
    new = spark.createDataFrame([(2, "B", "z", "s1"), (3, "c", "z", "s1"), (1, "zz", "q", "s2")], old.schema)
    once = C.upsert(old, new, "id", ["title"], "owner")
    rows = {r.id: tuple(r) for r in once.collect()}
    assert rows == {1: (1, "a", "x", "s1", "conflict"), 2: (2, "B", "y", "s1", "refreshed"), 3: (3, "c", "z", "s1", "added")}
    again = C.upsert(once.drop("change"), new, "id", ["title"], "owner")
    assert {r.change for r in again.where("id <> 1").collect()} == {"unchanged"}


def test_before_after(spark):
    rows = [("n", date(2000, 1, 1), 1, "one", "Text_Change"), ("n", date(2001, 1, 1), 2, "two", "Text_Change"), ("n", date(2001, 1, 1), 3, "three", "Text_Change"), ("n", date(2002, 1, 1), 4, "", "Repeal"), ("m", date(2000, 1, 1), 5, "new", "Insertion")]
    df = spark.createDataFrame(rows, "node string, day date, seq int, text string, kind string")
    got = {r.seq: (r.before_text, r.after_text) for r in D.before_after(df, ["node"], "day", "seq", "text", "kind").collect()}
    # of equal dates the first record is the predecessor
    assert got == {2: ("one", "two"), 3: ("one", "three"), 4: ("two", "(Revogado)"), 5: ("", "new")}


def test_fair_pick_and_batches(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), ("c", 1)], "source string, id int")
    assert sorted(r.source for r in G.fair_pick(rows, "source", [F.col("id")], 4).collect()) == ["a", "a", "b", "c"]
    sized = spark.createDataFrame([(0, i, s) for i, s in enumerate((50, 60, 200, 10, 10, 10))], "bucket int, id int, size int")
    got = [r.batch for r in R.greedy_batches(sized, "bucket", "id", "size", 2, 100).orderBy("id").collect()]
    assert got == [0, 1, 2, 3, 3, 4]


def test_contained_passages(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, f"x {words}  y"), (2, words.replace("iota", "other")), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(7, words), (8, "too short")], "item_id int, text string")
    assert [tuple(r) for r in D.contained_passages(docs, items).collect()] == [(7, 1)]


def test_order_of_sparse_and_written_keys(spark):
    import random

    from normspark.operators import catalog as C

    rnd = random.Random(3)
    for keys, kind in (([rnd.randrange(10**15) for _ in range(500)], "long"), ([f"law-{rnd.randrange(10**6):x}" for _ in range(500)] + ["law-x"] * 3, "string")):
        got = C.sharded(spark.createDataFrame([(k,) for k in keys], f"k {kind}"), "k", 100).orderBy("row").collect()
        assert [r.k for r in got] == sorted(keys) and [r.row for r in got] == list(range(len(keys))) and [r.shard for r in got] == [i // 100 for i in range(len(keys))]
