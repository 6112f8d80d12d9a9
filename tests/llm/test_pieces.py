import pytest
import sentencepiece

from normspark.llm import sentence_pieces as E
from normspark.llm import token_counts as T
from normspark.llm.pieces import default_model, marked, vocabulary

TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "unbelievable internationalisation", "naïve café", "日本語", "😀 ok\n\ttab", "x" * 70, "1234567 89.5%", "the quick brown fox", "é"]


def brute(text):
    """Best segmentation of the whole marked text at once, under the stated tie rules."""
    v, s = vocabulary(default_model()), marked(text)
    best = [(0.0, 0, 0)] + [None] * len(s)
    for i in range(len(s)):
        single = s[i] in v.score
        for j in range(i + 1, min(len(s), i + v.longest) + 1):
            if s[i:j] in v.score:
                total = best[i][0] + v.score[s[i:j]]
                if best[j] is None or total > best[j][0]:
                    best[j] = (total, i, v.id[s[i:j]])
        if not single:
            total = best[i][0] + v.unknown
            if best[i + 1] is None or total > best[i + 1][0]:
                best[i + 1] = (total, i, None)
    ids, j = [], len(s)
    while j:
        _, i, p = best[j]
        ids += [p] if p is not None else [v.byte[b] for b in reversed(s[i:j].encode())]
        j = i
    return ids[::-1], best[-1][0]


@pytest.mark.parametrize("text", TEXTS)
def test_both_equal_brute_force(text):
    import numpy as np

    ids, score = brute(text)
    raw = E.encoder(default_model()).encode([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert E.encoder(default_model()).decode(raw) == text
    n, total, _ = T.counter(default_model()).count(text)
    assert n == len(ids) and total == pytest.approx(score)


def _as_unigram():
    """The model file with its algorithm field set to unigram (1 instead of 2), found by its wire form."""
    raw = open(default_model(), "rb").read()
    at = 0
    while at < len(raw):
        field, at = raw[at] >> 3, at + 1
        size = shift = 0
        while True:
            size |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                break
        if field == 2:
            spec = raw[at : at + size]
            i = spec.find(b"\x18\x02")
            return raw[: at + i] + b"\x18\x01" + raw[at + i + 2 :]
        at += size
    raise ValueError("no trainer section")


def test_agrees_with_the_librarys_lattice_on_known_characters():
    """The best of its n-best list; its plain call keeps single-precision sums next to scores of -1e9."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=_as_unigram())
    for text in ["Hello world", "unbelievable internationalisation", "the quick brown fox jumps", "a b c d", "antidisestablishmentarianism"]:
        assert T.counter(default_model()).count(text)[0] == len(sp.nbest_encode_as_ids(text, 4)[0]), text


def test_queries(docs, empty, clashing):
    rows, counts = {}, {}
    for r in E.digest(docs).collect():
        rows.setdefault(r.doc_id, r)
        assert r.round_trip
    for r in T.digest(docs).collect():
        counts.setdefault(r.doc_id, r)
    assert {k: r.n_pieces for k, r in rows.items()} == {k: r.n_tokens for k, r in counts.items()}
    assert rows[100].n_pieces == rows[101].n_pieces == 0
    for m in (E, T):
        assert m.digest(empty).count() == 0 and m.digest(clashing).count() == docs.count()


def test_encode_then_decode_columns(docs):
    ids = E.encoded(docs, ["doc_id", "text"]).select("__keep.*", "ids")
    back = E.decoded(ids, ["text"]).select("__keep.text", "text")
    assert all((a or "") == b for a, b in back.toDF("a", "b").collect())


def test_long_words_equal_brute_force(monkeypatch):
    import random
    import time

    import numpy as np

    monkeypatch.setattr(E, "BLOCK", 97)
    rnd, enc = random.Random(7), E.Encoder(default_model())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    words = ["".join(rnd.choices(letters, k=n)) for n in (E.LONG - 1, E.LONG, E.LONG + 1, 3000)] + ["a" * 970, "é中😀́" * 200, "the" * 333, "=" * 1200 + "x"]
    for w in words:
        raw = enc.encode([w])[0]
        assert np.frombuffer(raw, "<u4").tolist() == brute(w)[0], w[:40]
        assert enc._long(marked(w)) == enc._group([marked(w)])[0] == raw
    # a word of 300,000 letters took over two minutes when it advanced by itself
    monkeypatch.setattr(E, "BLOCK", 65_536)
    word, began = "".join(rnd.choices(letters, k=300_000)), time.time()
    raw = enc.encode([word])[0]
    assert time.time() - began < 30 and enc.decode(raw) == word
