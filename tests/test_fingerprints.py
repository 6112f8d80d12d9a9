from pyspark.sql import functions as F

from normspark.operators import changes as D
from normspark.operators import reports as R

KIND = "k int, status string, text string, more array<string>"
ROWS = [(1, "a", "x", ["p", None]), (2, "b", None, []), (2, "b", None, []), (3, None, "", None)]


def test_digest_of_the_multiset(spark):
    """Order does not matter; repeats, nulls against empty texts, and where one value ends do."""
    def of(rows):
        return R.dataset_fingerprint(spark.createDataFrame(rows, KIND), "status").first()

    one = of(ROWS)
    assert of(ROWS[::-1]) == one and one.n == 4 and one.status_counts == '{"a":1,"b":2,"null":1}'
    others = [ROWS[:3], ROWS[:2] + ROWS[3:], [*ROWS[:3], (3, None, None, None)], [*ROWS[:3], (3, None, "", [])], [(1, "a", "xp", [None]), *ROWS[1:]], [*ROWS[:2], (1, "a", "x", ["p", None]), ROWS[3]], []]
    digests = [of(o).rows_digest for o in others]
    assert len({*digests, one.rows_digest}) == len(others) + 1
    empty = of([])
    assert (empty.n, empty.status_counts, empty.checks) == (0, "{}", None)


def test_reasons(spark):
    left = spark.createDataFrame(ROWS, KIND)
    need = {"one": F.col("k") == 1, "nine": F.col("k") == 9}
    print_of = lambda df: R.dataset_fingerprint(df, "status", need)
    got = R.compare_fingerprints(print_of(left.where("k > 1").withColumnRenamed("text", "words")), print_of(left)).first()
    assert got.verdict == "different" and got.reasons == ["row counts", "schema", "status counts", "rows", "no required record nine", "lost record one"]
    only = {"one": F.col("k") == 1}
    same = R.compare_fingerprints(R.dataset_fingerprint(left.repartition(3), "status", only), R.dataset_fingerprint(left, "status", only)).first()
    assert (same.verdict, same.reasons) == ("equal", [])
    changed = left.withColumn("text", F.when(F.col("k") == 1, "y").otherwise(F.col("text")))
    assert R.compare_fingerprints(R.dataset_fingerprint(changed, "status", only), R.dataset_fingerprint(left, "status", only)).first().reasons == ["rows", "changed record one"]


def test_provenance(spark):
    nodes = spark.createDataFrame([("l", "art:1"), ("l", "art:1.par:2"), ("l", "art:10"), ("l", "art:3"), ("m", "art:1"), ("m", None)], "law string, node string")
    changes = spark.createDataFrame([("l", "art:1", 1, None, "2020"), ("l", "art:1", 2, True, "2010"), ("l", "art:10", 3, False, None), ("l", "art:10", 4, False, "1999"), ("m", "art:9", 5, True, "2000")], "law string, node string, id int, ok boolean, day string")
    relations = spark.createDataFrame([("l", "art:1", "r1"), ("l", "art:1", "r1"), ("l", "art:3", "r2"), ("l", None, "r3"), ("m", "art:1.par:2", "r4")], "law string, node string, rel string")
    got = D.provenance(nodes, changes, relations, "law", "node", "id", "ok", [F.desc_nulls_last("day")]).collect()
    assert {(r.law, r.node): (r.change_id, r.relations, r.inherited, r.status) for r in got} == {
        ("l", "art:1"): (2, 2, 0, "verified"), ("l", "art:1.par:2"): (None, 0, 2, "not_identified"), ("l", "art:10"): (4, 0, 0, "partial"), ("l", "art:3"): (None, 1, 0, "partial"),
        ("m", "art:1"): (None, 0, 0, "not_identified"), ("m", None): (None, 0, 0, "not_identified")}
    rows = D.device_relations(nodes, relations, "law", "node").collect()
    assert sorted((r.node, r.holder, r.distance, r.rel) for r in rows) == [("art:1", "art:1", 0, "r1")] * 2 + [("art:1.par:2", "art:1", 1, "r1")] * 2 + [("art:3", "art:3", 0, "r2")]
