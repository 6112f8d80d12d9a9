"""Scores come from every gram, however many there are, and equal the array model's."""

import numpy as np
from pyspark.sql import functions as F

from normspark.llm import url_filter as U
from tests.llm import markov as M


def brute(urls, examples):
    def model(accepted):
        context, gram, _, _ = M._grams([u for u, a in examples if a == accepted])
        g, i, n = np.unique(gram.ravel(), return_index=True, return_counts=True)
        return M.Markov(context.ravel()[i], g, n)

    yes, no = model(True), model(False)
    context, gram, of, sizes = M._grams(urls)
    return np.bincount(of, yes.log_likelihood(context, gram) - no.log_likelihood(context, gram), len(sizes)) / np.maximum(sizes, 1)


def test_scores_use_every_gram(spark):
    rnd = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    text = lambda n: "".join(rnd.choice(letters, n))
    # more than 200,000 different grams in either model
    urls = [f"http://x.net/{text(45)}" for _ in range(2500)] + [f"http://x.org/fr/{text(45)}" for _ in range(2500)] + [f"http://x.com/é{text(30)}" for _ in range(50)]
    urls += [urls[0]] * 3 + ["", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    held = {r.page_id for r in df.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    examples = [(u, ".org/" in u) for i, u in enumerate(urls) if u and ".com" not in u and i not in held]
    for accepted in (True, False):
        assert len(np.unique(M._grams([u for u, a in examples if a == accepted])[1])) > 200_000
    got = {r.page_id: r.score for r in U.digest(df).collect()}
    want = brute(urls, examples)
    assert len(got) == len(urls)
    assert max(abs(got[i] - want[i]) for i in range(len(urls))) < 1e-9


def test_hot_rows_and_no_examples(spark):
    df = spark.createDataFrame([(i, "http://x.com/a") for i in range(5)], "page_id long, url string")
    assert [(r.score, r.verdict) for r in U.digest(df).collect()] == [(0.0, "allow")] * 5


def test_no_grams_or_urls_are_sent_to_the_driver(spark, monkeypatch, tmp_path):
    """They are read from small files, so that Spark takes them for few."""
    plans, stored = [], U.stored
    monkeypatch.setattr(U, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    urls = [f"http://x.net/{i}" for i in range(40)] + [f"http://x.org/fr/{i}" for i in range(40)] + ["http://x.com/1", "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages")
    out = U.digest(spark.read.parquet(f"{tmp_path}/pages"))
    assert out.count() == len(urls)
    assert sum("Join" in x for x in plans) == 1 and not any("Broadcast" in x for x in plans)
