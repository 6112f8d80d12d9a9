"""Joins that grow with the tables: none sends a side to the driver, and none is repeated by row where few texts repeat."""

from pyspark.sql import functions as F

from normspark.operators import changes as D
from normspark.operators import dossiers as H
from normspark.operators import search as E
from tests.test_term_lookup import LAWS

PATHS = ("art:1", "art:1.par:1", "art:1.par:1.inciso:I")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def devices(spark, tmp_path):
    """Read from files, whose size is known; the devices are made of them by an explode, whose size is not."""
    paths = F.array(*map(F.lit, PATHS))
    spark.range(50).write.parquet(f"{tmp_path}/laws")
    laws = spark.read.parquet(f"{tmp_path}/laws")
    nodes = laws.select(F.col("id").alias("law"), F.explode(paths).alias("node_id"))
    lines = laws.select(F.col("id").alias("law"), F.get(paths, (F.col("id") % 3).cast("int")).alias("node_id"), (F.col("id") % 2 == 0).alias("ok"), F.col("id").alias("n"))
    return nodes, lines


def test_device_relations_broadcast_no_exploded_paths(spark, tmp_path):
    nodes, lines = devices(spark, tmp_path)
    got = D.device_relations(nodes, lines.select("law", "node_id", "n"), "law", "node_id")
    assert "BroadcastExchange" not in plan(got)
    assert got.count() == 17 * 3 + 17 * 2 + 16


def test_provenance_broadcasts_no_exploded_paths(spark, tmp_path):
    nodes, lines = devices(spark, tmp_path)
    got = D.provenance(nodes, lines, lines, "law", "node_id", "n", "ok", [F.col("n")])
    counting = plan(got).split("holder")
    assert len(counting) > 2 and not any("BroadcastHashJoin [law" in x for x in plan(got).splitlines() if "holder" in x)
    assert got.agg(F.sum("relations"), F.sum("inherited")).first()[:] == (50, 17 * 2 + 17)


def test_provenance_sends_no_changes_to_the_driver(spark, tmp_path):
    """The changes are read from small files, too, so that Spark takes them for small."""
    devices(spark, tmp_path)[1].write.parquet(f"{tmp_path}/lines")
    nodes, lines = devices(spark, f"{tmp_path}/more")[0], spark.read.parquet(f"{tmp_path}/lines")
    got = D.provenance(nodes, lines, lines, "law", "node_id", "n", "ok", [F.col("n")])
    assert "Broadcast" not in plan(got)
    assert got.where("change_id is not null").count() == 50 and got.count() == 150


def repeated(spark):
    """200 laws of two titles, 30 queries of three texts; an id of two texts on either side."""
    laws = [(f"s{i:03}", ("Lei do Meio", "Lei Penal")[i % 2], "Texto", [], "Lei", str(i), 1990, True, None) for i in range(200)] + [("s000", "Outra coisa", "", [], "Lei", "1", 1990, True, None)]
    asked = [(f"q{i:02}", ("meio", "penal texto", "zzzz")[i % 3]) for i in range(30)] + [("q02", "outra")]
    return E.parsed(spark.createDataFrame(asked, "query_id string, query string")), E.prepared(spark.createDataFrame(laws, LAWS))


def test_equal_texts_are_compared_once(spark, monkeypatch):
    q, laws = repeated(spark)
    seen, holding = [], E.holding
    monkeypatch.setattr(E, "holding", lambda needles, rows, fields: seen.append((needles.count(), rows.count())) or holding(needles, rows, fields))
    out = E.by_terms(q, laws)
    got = [(r.query_id, r.slug) for r in out.collect()]
    assert seen == [(7, 4)]  # meio; penal texto, penal, texto; zzzz; zzzz and outra of q02; two titles and the two of s000
    assert len(got) == len(set(got)) == 10 * 100 + 10 * 200 + 1 and ("q02", "s000") in got


def test_pairs_are_not_shuffled_after_they_arise(spark):
    q, laws = repeated(spark)
    for stage in (E.by_terms, E.by_word, E.by_prefix, E.by_transposition, E.by_transposed_word):
        top = plan(stage(q, laws)).split("Join")[0]
        assert "Aggregate" not in top and "Exchange" not in top, stage


def test_a_text_asked_often_is_answered_once(spark, monkeypatch):
    laws = [(f"s{i:03}", ("Lei do Meio", "Lei Penal")[i % 2], "Texto", [], "Lei", str(i), 1990, True, None) for i in range(60)]
    asked = [(f"q{i:02}", ("meio", "lei penal")[i % 2]) for i in range(30)]
    seen, scored = [], E.scored
    monkeypatch.setattr(E, "scored", lambda pairs, best: seen.append(pairs.count()) or scored(pairs, best))
    out = E.search(spark.createDataFrame(asked, "query_id string, query string"), spark.createDataFrame(laws, LAWS), limit=5, native=True)
    got = {(r.query_id, r["rank"], r.slug, r.score) for r in out.collect()}
    best = {k: [f"s{i:03}" for i in range(k, 60, 2)][:5] for k in (0, 1)}
    assert {(q, n, s) for q, n, s, _ in got} == {(f"q{i:02}", n + 1, s) for i in range(30) for n, s in enumerate(best[i % 2])}
    # of two texts, not of 30 queries; then only the laws that bear a name or hold the word themselves
    assert seen == [30 + 30, 30 + 30]


def test_candidates_of_one_key_are_spread(spark):
    """All references and candidates share a key: one task made all rows before."""
    refs = spark.range(40).select(F.col("id").alias("r"), F.when(F.col("id") < 30, "a").when(F.col("id") < 35, "b").alias("k"))
    pool = spark.range(500).select(F.when(F.col("id") < 490, "a").when(F.col("id") < 491, "b").otherwise(F.lit(None)).alias("k"), F.col("id").alias("c"))
    got = H.ambiguous(refs, pool, ["k"], "c")
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("r", "c").alias("d")).collect()
    assert sum(x.n for x in parts) == sum(x.d for x in parts) == 30 * 490 and len(parts) == 4
    assert got.where("k <> 'a' or c >= 490").count() == 0 and got.columns == ["k", "r", "c"]


def test_pairs_of_one_class_are_made_by_all_partitions(spark):
    """The sides are small, so that Spark would join them in one partition, however many pairs come of them."""
    met = spark.range(600).select(F.concat(F.lit("s"), "id").alias("slug"), (F.col("id") % 1).cast("string").alias("k"))
    asked = spark.range(50).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.col("id") % 1).cast("string").alias("k"))
    got = E.spread(met, asked)
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("query_id", "slug").alias("d")).collect()
    assert sum(x.n for x in parts) == sum(x.d for x in parts) == 600 * 50 and len(parts) == 4


def test_texts_of_laws_are_made_once_and_spread(spark, tmp_path):
    """A catalog of few bytes is one task's, and both the members and the classes (twice) made all its texts anew."""
    spark.createDataFrame([(f"s{i}", "Lei do Meio", "", [], "Lei", str(i), 1990, True, None) for i in range(40)], LAWS).coalesce(1).write.parquet(f"{tmp_path}/laws")
    laws = E.prepared(spark.read.parquet(f"{tmp_path}/laws"))
    assert laws.rdd.getNumPartitions() == 4
    members, classes = E.classed(laws, "slug", "n_title", "law_type")
    assert members.count() == 40 and classes.count() == 1
    for df in (members, classes):
        assert "translate" not in plan(df) and "regexp_replace" not in plan(df) and "Exchange" not in plan(df)


def test_pairs_arise_list_by_list_and_are_not_held(spark):
    """Pairs of one list follow each other, so that a file of them stays small, and no step holds all pairs of two lists."""
    met = spark.range(600).select(F.concat(F.lit("s"), "id").alias("slug"), (F.col("id") % 2).cast("string").alias("k"))
    asked = spark.range(80).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.col("id") % 2).cast("string").alias("k"))
    got = E.spread(met, asked)
    rows = [(r.query_id, r.slug) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 2 * 300 * 40
    assert 1 + sum(a[1] != b[1] for a, b in zip(rows, rows[1:], strict=False)) == 600
    steps = [x for x in plan(got).split("Initial Plan")[0].splitlines() if "Generate explode(transform" in x]
    assert len(steps) == 1 and "*(" not in steps[0]


def test_lists_are_bounded_and_lose_nothing(spark, monkeypatch):
    """Classes larger than a list on either side, one id that is null, a class that the other side lacks."""
    from normspark import storage

    monkeypatch.setattr(storage, "LIST", 16)
    queries = spark.range(101).select(F.when(F.col("id") > 0, F.col("id")).alias("query_id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("k"))
    laws = spark.range(1000).select(F.col("id").alias("slug"), F.when(F.col("id") < 900, "x").when(F.col("id") < 990, "y").otherwise("z").alias("k"))
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "x")], "k string, law_k string")
    for side, id in ((queries, "query_id"), (laws, "slug")):
        lists = storage.listed(side, "k", id, storage.parts_of(side, "k"))
        most = lists.groupBy("k").agg(F.max(F.size("ids")).alias("most"), F.sum(F.size("ids")).alias("all"))
        assert most.agg(F.max("most")).first()[0] <= 40 and most.agg(F.sum("all")).first()[0] == side.count()
    got = [tuple(r) for r in E.expanded(pairs, queries, laws).select("query_id", "slug").collect()]
    ids = lambda a, b: [i or None for i in range(a, b)]
    want = {(q, s) for q in ids(0, 90) for s in range(990)} | {(q, s) for q in ids(90, 101) for s in range(900, 990)}
    assert len(got) == len(want) and set(got) == want
