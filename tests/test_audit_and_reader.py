"""The corpus audit, the reader's groups, histories, names and archives in small cases: nulls, ties, repeats, nothing at all."""

from datetime import datetime

from pyspark.sql import functions as F

from normspark.operators import changes as D
from normspark.operators import documents as B
from normspark.operators import dossiers as H
from normspark.operators import search as E
from normspark.sources import catalogs as C

NODES = "version long, node_id string, node_type string, text string"


def test_corpus_audit(spark):
    laws = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None), ("e", 5), ("f", 6)], "law string, current_version long")
    versions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (6, "n")], "version long, checksum string")
    shots = [
        ("a", "x", 2, ["Art. 9º Another reading of the same bytes."]), ("a", "x", 1, ["Art. 1º One.", "Art. 2º Two.", "Art. 2º Two."]), ("b", "w", 1, ["Art. 1º Of an older version."]), ("f", "n", None, []),
        ("c", "z", 3, ["Nothing numbered."]),
    ]
    rows = [(law, checksum, t and datetime(2020, 1, t), lines, 0, 0) for law, checksum, t, lines in shots]
    snapshots = spark.createDataFrame(rows, "law string, checksum string, retrieved_at timestamp, lines array<string>, struck int, pdfs int")
    nodes = spark.createDataFrame([(1, "art:1", "article", "One."), (1, "art:3", "article", "Three."), (2, "art:1", "article", "x")], NODES)
    out = B.corpus_audit(laws, versions, snapshots, nodes)
    got = {r.law: r for r in out.collect()}
    assert sorted(got) == ["a", "b", "c", "e", "f"]
    a = got["a"]
    assert (a.missing, a.unexpected, a.repeated, a.source_checksum, a.assessment) == (["art:2"], ["art:3"], ["art:2"], "x", "gaps_detected") and a.audited_at.day == 1
    assert {k: r.status for k, r in got.items()} == {"a": "audited", "b": "skipped_without_snapshot", "c": "audited", "e": "skipped_without_snapshot", "f": "audited"}
    assert not any(r.completeness_certified for r in got.values()) and got["b"].assessment is None
    assert tuple(B.audit_totals(out).first()) == (5, 3, 2, 0)
    assert tuple(B.audit_totals(B.corpus_audit(laws.limit(0), versions, snapshots, nodes)).first()) == (0, 0, 0, 0)


def test_reader_groups(spark):
    rows = [
        (1, "tit:1", "title", "Título", "before", 0), (1, "art:1", "article", "Art. 1º", "First.", 1), (1, "art:1.par:1", "paragraph", "§ 1º", "Produção deefeitos", 2), (1, "art:1.item:I", "item", "I", "one", 3),
        (1, "art:10", "article", "Art. 10", None, 12), (1, "art:10.x", "subitem", "a", "sub", 13), (1, "art:2", "article", "Art. 2.", "Second.", 14), (2, "document", "document", "", "text alone", 1),
    ]
    out = B.reader_groups(spark.createDataFrame(rows, "d int, node_id string, node_type string, label string, text string, order_index int"), "d").orderBy("order_index").collect()
    assert [(r.d, r.article, r.number, r.title, r.text) for r in out] == [(1, "art:1", "1", "Art. 1º", "First."), (1, "art:10", "10", "Art. 10.", None), (1, "art:2", "2", "Art. 2.", "Second.")]
    assert [(c.node_id, c.kind, c.label) for c in out[0].clauses] == [("art:1.par:1", "", "§ 1º "), ("art:1.item:I", "item", "I — ")]
    assert [tuple(c) for c in out[1].clauses] == [("art:10.x", "subitem", "a — ", "sub")] and out[2].clauses == []


def test_history(spark):
    laws = spark.createDataFrame([("a", "complete"), ("b", ""), ("c", None), ("d", "partial")], "law string, history string")
    jobs = [("a", 1, "history", "queued", 5), ("a", 2, "history", "running", 5), ("a", 3, "history", "failed", 9), ("d", 4, "text", "running", 9)]
    jobs = spark.createDataFrame(jobs, "law string, job_id int, job_type string, status string, created_at int")
    assert dict(map(tuple, D.history_status(laws, jobs).collect())) == {"a": "running", "b": "not_requested", "c": "not_requested", "d": "partial"}
    changes = spark.createDataFrame([("a", 1, datetime(2020, 1, 2), True), ("a", 2, None, None)], "law string, id int, day timestamp, comparable boolean")
    events = spark.createDataFrame([("a", 3, None, "compared"), ("a", 4, datetime(2021, 1, 2), None), ("b", 5, None, "discovered")], "law string, id int, day timestamp, event_status string")
    got = sorted(tuple(r) for r in D.history(laws, jobs, changes, events).collect())
    assert got == [("a", "running", "change", "diff", 1, "2020-01-02"), ("a", "running", "change", "relation", 2, "0000-01-01"), ("a", "running", "event", "relation", 4, "2021-01-02"), ("b", "not_requested", "event", "relation", 5, "0000-01-01")]


def test_event_ids(spark):
    import uuid

    got = spark.createDataFrame([("l", "1", "art:1"), ("l", "1", None)], "a string, b string, c string").select(D.event_id("p", F.col("a"), F.col("b"), F.col("c")).alias("i")).collect()
    assert {r.i for r in got} == {str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("p:l:1:art:1", "p:l:1:")}


def test_ambiguous_candidates(spark):
    refs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "r int, k string")
    pool = spark.createDataFrame([("x", 10), ("x", 11), ("y", 12), (None, 13), (None, 14)], "k string, c int")
    assert sorted((r.r, r.c) for r in H.ambiguous(refs, pool, ["k"], "c").collect()) == [(1, 10), (1, 11), (2, 10), (2, 11)]


def test_alias_weights(spark):
    rows = [("a", "Lei Geral", ["LGPD", "Lei geral", "marco civil", "MCI2", ""], "Lei", "13.709", 2018), ("b", "Ato", None, "Ato", "2.206-1", None)]
    got = {(r.slug, r.name): r.weight for r in E.alias_weights(spark.createDataFrame(rows, "slug string, title string, aliases array<string>, law_type string, number string, year int")).collect()}
    assert got == {
        ("a", "lei geral"): 100, ("a", "lgpd"): 95, ("a", "marco civil"): 90, ("a", "mci2"): 95, ("a", "13 709 2018"): 100, ("a", "lei 13 709 2018"): 60, ("a", "13709 2018"): 60, ("a", "13709"): 60,
        ("b", "ato"): 100, ("b", "2206 1"): 60,
    }


def test_version_ids(spark):
    held = spark.createDataFrame([("l", "x", None, b"1"), ("l", "y", 7, b"2"), ("m", "x", None, b"3")], "law_slug string, checksum string, version_id long, raw_body binary")
    new = spark.createDataFrame([("l", "x", 9), ("l", "x", 8), ("l", "x", None), ("l", "y", 9)], "law_slug string, checksum string, version_id long")
    out = C.with_version_ids(held, new)
    assert out.columns == held.columns and sorted((r.law_slug, r.checksum, r.version_id or 0) for r in out.collect()) == [("l", "x", 8), ("l", "y", 7), ("m", "x", 0)]
