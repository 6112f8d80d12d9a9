from collections import Counter, defaultdict

import numpy as np

from normspark.llm import near_dup as N
from tests.llm.conftest import DOCS, prose


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + N.WORDS]) for i in range(max(len(w) - N.WORDS + 1, min(len(w), 1))))


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def edited(text, places):
    w = text.split()
    for p in places:
        w[p % len(w)] = f"new{p}"
    return " ".join(w)


def brute_groups(texts):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if texts[i].split() and texts[j].split() and jaccard(texts[i], texts[j]) >= N.SIMILARITY:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_cells_give_weighted_jaccard():
    texts = [prose(1, 60), edited(prose(1, 60), [3]), prose(2, 9) + " " + prose(2, 9), "a b", "a b", "", None, "one two three four five six one two three four five six"]
    shingle, of, count = N.shingles(texts)
    cell = N.cells(shingle, of)
    sets = [np.sort(cell[of == i]) for i in range(len(texts))]
    for i in range(len(texts)):
        assert len(sets[i]) == sum(shingles(texts[i]).values()) and count[i] == len((texts[i] or "").split())
        for j in range(i):
            assert abs(N.similarity(sets[i], sets[j]) - jaccard(texts[i], texts[j])) < 1e-12
    assert N.word_key(" a  b\n") == N.word_key("a b") != N.word_key("ab") and len(N.word_key("a")) == 16 and N.word_key(" ") is N.word_key(None) is None


def test_darts_collide_as_often_as_texts_are_similar():
    # the last three repeat shingles, so they have weights above one
    texts = [prose(7, 400), edited(prose(7, 400), range(5, 400, 40)), edited(prose(7, 400), range(5, 400, 9)), "a", "a b c d e f g " * 40, "a b c d e f g " * 25, "a b c d e f g " * 25 + prose(8, 90)]
    shingle, of, count = N.shingles(texts)
    element, owner, weight = N.elements(shingle, of)
    assert weight.max() >= 39
    sig = N.darts(element, owner, weight, len(texts), 2000)
    assert (sig != 0).all()
    for i, j in ((0, 1), (0, 2), (1, 2), (4, 5), (5, 6), (4, 6), (0, 6)):
        assert abs((sig[i] == sig[j]).mean() - jaccard(texts[i], texts[j])) < 0.05


def test_groups_equal_brute_force(spark):
    texts = {}
    for g in range(6):
        base = prose(1000 + g, 80 + 30 * g)
        for k in range(7):
            texts[10 * g + k] = edited(base, range(k, 80, 40 - 5 * (k % 3))) if k else base
    texts |= {200: texts[0] + "  ", 201: texts[0], 202: "", 203: "a b", 204: "a  b", 205: "c"}
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in N.digest(df).collect()}
    want = brute_groups(texts)
    assert {i: r.class_id for i, r in got.items()} == want
    assert got[200].copy_class == got[201].copy_class == 0 and got[204].copy_class == 203
    kept = [r.doc_id for r in N.stage(spark, df, "").collect()]
    assert sorted(kept) == sorted(i for i, c in want.items() if i == c)


def test_hot_group_of_copies_and_a_chain(spark):
    base = prose(5, 120)
    chain = [base]
    for i in range(12):
        chain.append(edited(chain[-1], [9 * i]))
    rows = [(i, base, "en", "s", 0) for i in range(300)] + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(chain)]
    got = {r.doc_id: r.class_id for r in N.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) == {0} and len(got) == 313


def test_rows_that_share_a_doc_id_are_judged_by_text(spark):
    a, b, c = prose(21, 90), prose(22, 90), prose(23, 90)
    rows = [(1, a), (1, b), (2, edited(a, [4])), (3, c), (3, c), (3, c + " "), (4, b), (5, ""), (5, None), (5, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((r.class_id, r.doc_id) for r in N.digest(df).collect() if r.doc_id not in (None, 5))
    assert got == [(1, 1), (1, 1), (1, 2), (1, 4), (3, 3), (3, 3), (3, 3)]
    kept = sorted(((r.doc_id or 0), (r.text or "").strip()) for r in N.stage(spark, df, "").collect())
    assert kept == sorted([(0, a), (1, a), (1, b), (3, c), (5, ""), (5, "")])


def test_texts_of_common_passages_alone(spark):
    lines = [prose(500 + i, 25) for i in range(24)]
    texts = {}
    for i in range(120):
        k = i % 12
        texts[i] = "\n".join([lines[(k + j) % 24] for j in range(10)] + ([prose(900 + i, 4)] if i % 3 else []))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    assert {r.doc_id: r.class_id for r in N.digest(df).collect()} == brute_groups(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (100, 300), (500, 7)]
    got = dict(N.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100, 500: 0}


def test_edges(spark, docs, empty, clashing, corpus):
    rows = N.digest(docs).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert len(rows) == len(corpus) and by[105] == {1} and by[100] == {100} and by[101] == {101} and by[0] == {0}
    assert N.digest(empty).count() == 0 and N.digest(clashing).count() == len(corpus)
    kept = N.stage(spark, clashing, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == clashing.columns and ids.count(0) == 1 and 105 not in ids and {100, 101, 102} <= set(ids)
