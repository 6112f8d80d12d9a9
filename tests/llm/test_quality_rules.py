import re

import numpy as np

from normspark.llm import quality_rules as Q
from tests.llm.conftest import DOCS, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_equal_brute_force():
    block = prose(4, 12)
    for t in [None, "", "a", "## | ##", block + " " + block, f"{block}\n{block}\n\n{block}", "x " * 40, "é b\x1cc d \x0b e", "\n".join(["same line"] * 5), "a b c d e f g h " * 3 + "z " + "a b c d e f g h"]:
        assert Q.statistics(t)[:5] == brute(t), t


def test_learns_planted_thresholds():
    rnd = np.random.default_rng(1)
    n = 900
    x = {k: rnd.random(n) for k in Q.RATIOS}
    bad = (x["symbol_ratio"] > 0.8) | ((x["upper_ratio"] > 0.7) & (x["end_ratio"] < 0.4))
    rules = Q.learn_list(x, bad)
    fit = np.logical_or.reduce([Q._fits(r, x, n) for r in rules])
    assert 1 <= len(rules) <= 12 and (fit & bad).sum() > 0.8 * bad.sum() and (fit & ~bad).sum() <= 0.02 * n
    assert Q.learn_list({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_query_and_stage(spark, tmp_path):
    good = [(i, prose(i, 80) + ".", "en", "s", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"#{j * i} |$ <{j}>" for j in range(30)), "en", "s", 0) for i in range(30)]
    spark.createDataFrame(good + junk + [(300, None, None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 100), 0) for r in good + junk if r[0] % 2 == 0] + [(None, 0, 0), (0, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in Q.digest(spark, str(tmp_path)).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(1, 30))
    assert got[300].base_failed and not got[300].kept and got[300].n_words == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = Q.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_edges(spark, docs, empty, clashing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judged(docs, labels, ["doc_id"]).count() == docs.count()
    assert Q.judged(clashing, labels, clashing.columns).select("__keep.*").columns == clashing.columns
    assert Q.judged(empty, labels, ["doc_id"]).count() == 0
