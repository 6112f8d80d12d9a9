import re

from normspark.llm import url_filter as U
from tests.llm import markov as M

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://b.net/x?y", "http://b.net", "https://www.example.com/de/3", "http://example.com/den", "ftp://x.org/fr/1#t", "http://x.org/fr", "http://borg/fr/1",
    "no scheme", "", None, "://host.net/", "http://notexample.net/en/", "http://sub.a.org/fr/?q=://", "http://xn--net/", "HTTP://A.ORG/FR/", "http://net/", "http://é.net/\n",
]


def brute(url):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = U.digest(df).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, best = brute(URLS[r.page_id])
        assert (r.host, r.path) == (host, path), URLS[r.page_id]
        assert r.rule == (best and best[0]) and r.verdict in ("allow", "block")
        if best:
            assert r.verdict == best[1]


def test_models_separate_held_out_urls(spark):
    import random

    rnd = random.Random(2)
    word = lambda w: "".join(rnd.choice(w) for _ in range(3))
    good = [f"http://{word(['lib', 'wiki', 'news'])}.org/fr/{word(['art', 'sci'])}" for _ in range(300)]
    bad = [f"http://{word(['xxx', 'casino', 'bet'])}.net/{word(['win', 'slot'])}" for _ in range(300)]
    new = [f"http://{word(['lib', 'wiki', 'news'])}.com/{word(['art', 'sci'])}" for _ in range(40)] + [f"http://{word(['xxx', 'casino', 'bet'])}.com/{word(['win', 'slot'])}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r.page_id: r for r in U.digest(df).collect()}
    assert sum(got[600 + i].verdict == "allow" for i in range(40)) >= 36
    assert sum(got[640 + i].verdict == "block" for i in range(40)) >= 36


def test_probabilities_sum_to_one():
    import numpy as np

    context, gram, of, sizes = M._grams(["abcabcabd", "aab", None, ""])
    n = np.ones(gram.size, np.int64)
    g, i = np.unique(gram.ravel(), return_index=True)
    model = M.Markov(context.ravel()[i], g, n[: len(g)] * 2)
    at = 5  # the same context with every possible next byte
    c = np.repeat(context[:, at : at + 1], 256, axis=1)
    every = M.mix64(c ^ M.mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000)))
    assert abs(np.exp(model.log_likelihood(c, every)).sum() - 1) < 1e-9 and sizes.tolist() == [9, 3, 0, 0]


def test_edges(spark):
    schema = "page_id long, url string, html string, score double, host string, rule string"
    rows = [(1, "http://a.net/x", None, 1.0, "h", "r"), (1, "http://a.net/x", None, 1.0, "h", "r"), (None, None, None, None, None, None), (2, "http://b.com/" + "z" * 200_000, "", 0.0, "", "")]
    got = U.digest(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.verdict in ("allow", "block") for r in got)
    assert U.digest(spark.createDataFrame([], schema)).count() == 0
