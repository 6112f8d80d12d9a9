import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from normspark.llm import phrases as P
from tests.llm.conftest import DOCS


def brute(rows, least, top=P.TOP, absorbed=P.ABSORBED):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, n_of in f.items():
        cand = {g: a for g, a in n_of.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in cand.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    sub = g[i : i + n]
                    if 100 * a >= absorbed * cand[sub]:
                        gone.add(sub)
        scored = []
        for g, a in cand.items():
            if g not in gone:
                score, k = min((P.SCORE * a // (n_of[g[:k]] + n_of[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), n_of[g[:k]], n_of[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "ß", "日本", "W1", "w1-x", " ", "a\u001cb", "New", "york", "city"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rnd.randrange(60)))
        rows.append((i, text + " New York city" * rnd.randrange(3), rnd.choice(["en", "de", None, "und"]), "s", 0))
    rows += [(900, None, "en", None, 0), (901, "", None, None, 0), (902, " .,;\t", "xx", None, 0), (903, "b b b b b b b b b", "en", None, 0)]
    return rows + [rows[1], rows[1]] + [(1000 + i, "x y z. x y", "en", "hot", 0) for i in range(60)]


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = result(P.phrases(spark.createDataFrame(rows, DOCS).repartition(5), least=4))
    assert got == brute(rows, 4) and len(got) > 20 and {g[0] for g in got} == {"en", "de", "und"}


def test_production_threshold_and_top(spark):
    rows = corpus(2, 400)
    docs = spark.createDataFrame(rows, DOCS)
    assert result(P.digest(docs)) == brute(rows, 30)
    assert result(P.phrases(docs, least=5, top=7)) == brute(rows, 5, top=7)


def test_other_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = corpus(3, 60)
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("q").alias(c) for c in ("phrase", "n", "a", "key", "part", "w", "rank")))
    assert result(P.phrases(docs, least=4)) == brute(rows, 4)
    assert P.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_few_counters_and_a_full_bitmap_lose_nothing(spark):
    """Summaries at their least size (64 hash partitions, capacity as the mass demands) and a bitmap where nearly every bit is set."""
    rows = corpus(4, 200)
    docs = spark.createDataFrame(rows, DOCS)
    got = P.counts(docs, least=6, counters=1, bits=16)
    want = Counter()
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            want[(r[2] or "und", "")] += len(w)
            for n in range(1, 5):
                want.update((r[2] or "und", " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    assert {(r.lang, r.phrase): r.n for r in got.collect()} == {k: v for k, v in want.items() if v >= 6 or (k[1] == "" and k[0] in ("en", "de", "und", "xx"))}


def test_summary_keeps_what_is_frequent():
    """Merged in any order at capacity mass // least + 1, the cut stays below ``least``."""
    rnd = np.random.default_rng(5)
    for _ in range(30):
        batches = [rnd.zipf(1.3, 400).astype(np.uint64) % np.uint64(5000) for _ in range(20)]
        least = int(rnd.integers(2, 40))
        capacity = sum(map(len, batches)) // least + 1
        keys, counts, cut = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in batches:
            k, c = P.counted(b)
            keys, counts, less = P.cut_down(*P.counted(np.concatenate((keys, k)), np.concatenate((counts, c))), capacity)
            cut += less
            assert len(keys) <= capacity
        assert cut < least
        true = Counter(np.concatenate(batches).tolist())
        left = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert all(left[k] <= n <= left[k] + cut for k, n in true.items() if n >= least)


def test_equal_hashes_of_unequal_words_are_told_apart():
    keys = np.array([5, 5, 9, 5, 9], np.uint64)
    head, n = P._groups(keys, [np.array([1, 2, 3, 1, 3]), np.array([0, 0, 0, 0, 0])])
    assert sorted(zip(head.tolist(), n.tolist(), strict=True)) == [(0, 2), (1, 1), (2, 2)]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 50)
    rnd = random.Random(6)
    text = "".join(rnd.choice(["ab", "c d", "e, f", "g. ", " ", "hij" * 30]) for _ in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    got, parts = [], 0
    for block, _ in P.blocks(iter([batch])):
        ids, words = block.words()
        parts += 1
        byte = {}
        for w, p in zip(ids, block.piece, strict=True):
            byte.setdefault(p, []).append(words[int(w)].as_py())
        got += byte.values()
    assert parts > 5 and got == [w for w in (piece.split() for piece in re.split("[.,]", text)) if w]
