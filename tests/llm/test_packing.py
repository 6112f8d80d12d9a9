import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from normspark.llm import packing as P

ODD = ["<|endoftext|> a<|endoftext|>b, İstanbul ÀÉ. don't we'll I'M ẞ ﬁ., 12.5% ...?! a.b,c d'", "", "   ", "\t\n\r x", "A. b? Straße; ΣΑΣ. ǅ, ①", "é. ö! ́a, á̂:"]


def test_ids_equal_the_tokenizer(corpus):
    texts = ODD + [r[1] or "" for r in corpus]
    plain = Tokenizer.from_file(P.default_tokenizer())
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ids = P.WordIds(P.default_tokenizer())
    assert ids.encode(texts) == want == ids.encode(texts)


def test_every_letter_before_every_mark():
    """All letters beyond ASCII, some of which normalise to a letter and a sign, alone and behind another letter."""
    ids = P.WordIds(P.default_tokenizer())
    letters = [c for i in range(0x80, 0x20000) if (c := chr(i)).isalpha()]
    few = [c for c in letters if not (ids.normal.normalize_str(c)).isalpha()]
    assert len(few) >= 50 and "\u0130" in few and "\u0958" in few
    words = [f"{before}{c}{mark}" for c in few for mark in ".,;:!?" for before in ("", "ab", "é")] + [c + m for i, c in enumerate(letters) for m in ".,;:!?"[i % 6]]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    want = [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.encode(texts) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_hold_every_length_once(histogram):
    packs = P.pack(histogram, 64)
    held = Counter()
    for pattern, n in packs:
        assert n > 0 and sum(length * k for length, k in pattern) <= 64
        for length, k in pattern:
            held[length] += n * k
    assert held == Counter(histogram)
    # no two packs are less than half full
    assert sum(n for p, n in packs if sum(length * k for length, k in p) <= 32) <= 1


def test_sequences(spark, corpus, docs):
    rows = P.digest(docs).collect()
    plain = Tokenizer.from_file(P.default_tokenizer())
    want = Counter()
    for i, text, *_ in corpus:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), P.CAPACITY):
            part = ids[a : a + P.CAPACITY]
            want[(i, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert sorted(by) == list(range(len(by)))


def test_edges(empty, clashing, docs):
    assert P.digest(empty).count() == 0
    assert P.digest(clashing).count() == P.digest(docs).count()
