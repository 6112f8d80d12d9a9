import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from normspark.llm import personal_data as P
from tests.llm.conftest import DOCS

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS}


TEXTS = [
    "a@b.c_d@e.f x@y @z.com q@@r.s a.b+c@d-e.co.uk. end@x.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 12.34.56", "4111 1111 1111 1111 and 4736962573099581 or 4736-9625-7309-9582 0000000000000",
    "+1 (017) 555-7713 +49.30.1234567 + 12345678 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7", None, "", "1" * 3000, "9" * 12 + ".1.1.1", "1." * 2000, "a" * 30000 + "@b.de", "😀 jo@ex.org 10.0.0.1",
]


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)], DOCS)
    rows = P.digest(df).collect()
    for r in rows:
        want = brute(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in P.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k in P.KINDS for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789ab.@+-_ ()%\n", max_size=60))
def test_any_text(text):
    assert P.base_spans(text) == brute(text)


def test_weak_labels_find_the_reliable_labeler():
    import numpy as np

    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.4
    noisy = lambda p: np.where(rnd.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1))
    votes = np.stack([noisy(0.95), noisy(0.8), noisy(0.7)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, prior, theta = P.expectation_maximisation(patterns, counts)
    assert abs(prior - 0.4) < 0.06 and theta[0, 1, 2] > theta[1, 1, 2] > theta[2, 1, 2]
    assert post[(patterns == 1).all(axis=1)][0] > 0.9 > 0.1 > post[(patterns == -1).all(axis=1)][0]


def planted(n=400):
    """Texts with base spans, with looser personal data (what the method must add) and with look-alikes (what it must not)."""
    rnd = random.Random(11)
    num = lambda k, first="23456789": rnd.choice(first) + "".join(rnd.choice("0123456789") for _ in range(k - 1))
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(n):
        good, bad = [], []
        strict = rnd.choice([f"mail {word()}@{word()}.com", f"{word()}@mail.{word()}.org", f"call +1 {num(3)} {num(3)} {num(4)}", f"host 10.{rnd.randrange(250)}.3.{rnd.randrange(250)}", f"+49 30 {num(7)}", f"from {rnd.randrange(1, 250)}.2.{rnd.randrange(250)}.9"])
        kind = rnd.randrange(8)
        if kind == 0:
            good.append(f"{word()} (at) {word()} (dot) com")
        elif kind == 1:
            good.append(f"tel {num(3)}-{num(3)}-{num(4)}")
        elif kind == 2:
            good.append("server 2001:db8:0:0:1:0:0:" + num(2))
        elif kind == 3:
            good.append(f"phone ({num(3)}) {num(3)}-{num(4)}")
        elif kind == 4:
            bad.append(f"order no {num(3)}-{num(3)}-{num(4)}")
        elif kind == 5:
            bad.append(f"at {num(2, '012')}:{num(2, '345')}:{num(2, '345')} sharp")
        elif kind == 6:
            bad.append(f"serial {num(16, '68')}")
        text, where = f"{word()} {strict} {word()} ", set()
        for part in good + bad:
            if part in good:
                cue = re.match(r"tel |server |phone ", part)
                where.add((len(text) + (cue.end() if cue else 0), len(text) + len(part)))
            text += part + " "
        rows.append((i, text + word(), where))
    return rows


def test_spans_are_added_with_support_only(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    added = {}
    for r in P.digest(docs).collect():
        base = {(a, b) for spans in brute(rows[r.doc_id][1]).values() for a, b in spans}
        added[r.doc_id] = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s} - base
    want = {i: where for i, _, where in rows}
    right = sum(len(added[i] & want[i]) for i in want)
    assert sum(map(len, want.values())) > 150
    assert right >= 0.95 * sum(map(len, want.values())) and right >= 0.98 * sum(map(len, added.values()))


def test_nothing_is_added_without_a_vote_for_it(spark):
    docs = [(i, f"mail jo{i}@ex.com or call +1 212 555 01{i:02d} from host 10.1.2.{i}", "en", "s", 0) for i in range(60)]
    docs += [(200, "plain prose without any such thing, version 1.2.3 of 2020-01-02", "en", "s", 0), (201, "so 234-567-8901 it is", "en", "s", 0)]
    got = {r.doc_id: r for r in P.digest(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[200].spans == got[201].spans == "" and all(len(got[i].spans.split(",")) == 3 for i in range(60))


def test_edges(docs, empty, clashing, corpus):
    assert P.digest(docs).count() == len(corpus) == P.digest(clashing).count()
    assert P.digest(empty).count() == 0
