import random
import tracemalloc
import zlib

from normspark.llm import language_id as L
from tests.llm.conftest import DOCS, prose


def phrases(text, sample):
    """Greedy longest matches of a folded text in a folded sample."""
    text, n, i = L.fold(text), 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(k - 1, 1)
        n += 1
    return n


def check(samples, texts):
    parser = L.CrossParser(samples)
    counts, letters = parser.phrases(texts)
    for t, row, has in zip(texts, counts, letters, strict=True):
        assert has == any(c.isalpha() for c in t)
        assert row.tolist() == [phrases(t, L.fold(s)) for _, s in samples], t[:80]


def test_counts_equal_brute_force():
    samples = (("aa", prose(1, 200)), ("bb", "der die das und nicht mit ein eine " * 5 + prose(2, 20)), ("cc", "the cat sat on the mat"))
    check(samples, [prose(3, 120), "das und nicht", "zzz qqq", "x", "", "12 34", "Das, DAS!  und?nicht ß", prose(1, 200), "the中cat", "中", "the cat中中", " mat ", prose(5, 3000)])


def test_a_text_is_one_phrase_of_itself():
    for text in ("ΟΔΟΣ ΛΟΓΟΣ", "İSTANBUL İzmir", "STRAẞE ǅ Ǆ", "ὈΔΥΣΣΕΎΣ ᾼ"):
        counts, _ = L.CrossParser((("a", text), ("b", "zz"))).phrases([text, text + " ;"])
        assert counts[:, 0].tolist() == [1, 1], text


def test_counts_over_many_blocks(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    rnd = random.Random(4)
    samples = (("aa", "abaab" * 9), ("bb", "aaa bb"), ("cc", "c"))
    texts = ["".join(rnd.choice("aab c") for _ in range(rnd.randrange(400))) for _ in range(60)] + ["a" * 5000, "ab" * 2001, "aab" * 777, "abaab" * 500]
    check(samples, texts)


def test_large_alphabet_takes_little_memory():
    rnd = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(rnd.choice(letters) for _ in range(25_000))
    tracemalloc.start()
    parser = L.CrossParser((("en", prose(1, 4000)), ("zz", text)))
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 20e6
    assert parser.predict([text[100:300], prose(3, 40)])[0] == ["zz", "en"]
    check((("en", prose(1, 50)), ("zz", text)), [text[5:90] + "the" + text[2000:2100]])


def test_held_out_accuracy(spark):
    words = {"xx": "alfa brag colt dun erf".split(), "yy": "zuim quop wexi vyro jazz".split()}
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang, "s", 0) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    got = {r.doc_id: r for r in L.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, *_ in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)


def test_predictions_ignore_labels_of_held_out_rows(spark):
    rows = [(i, prose(i, 60), "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "wrong", "s", 0) for i in range(60)]
    assert {r.lang_pred for r in L.digest(spark.createDataFrame(rows, DOCS)).collect()} == {"en"}


def test_edges(spark, docs, empty, clashing):
    rows = L.digest(docs).collect()
    assert len(rows) == docs.count() == L.digest(clashing).count() and L.digest(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[None].held_out is False and by[104].lang_pred == "de"
    kept = L.stage(spark, clashing, "")
    out = kept.collect()
    assert kept.columns == clashing.columns and {r.doc_id for r in out} == set(by) - {100, 101, 102}
    assert all(r.lang == by[r.doc_id].lang_pred for r in out)
    assert {r.lang for r in L.stage(spark, docs, "", languages=("de",)).collect()} == {"de"}
