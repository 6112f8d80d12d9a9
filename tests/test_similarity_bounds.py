"""The bounds that keep rows from Python: no pair that the ratio lets through is lost, and clearly different ones are."""

import difflib
import random

from pyspark.sql import functions as F

from normspark.operators import search as E

WORDS = "lei marco civil consumidor consumo defesa dados pessoais proteção transito penal codigo tributario aaaaaaa bbbb ab ba a 2018 13709 1988 zz".split()


def bent(rng, text):
    """The text with a few letters lost, doubled or exchanged."""
    out = list(text)
    for _ in range(rng.randrange(4)):
        if out:
            i = rng.randrange(len(out))
            out[i:i + 1] = rng.choice([[], [out[i]] * 2, [rng.choice("abcxyz é9")]])
    return "".join(out)


def test_no_match_is_lost(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        names = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 7))) for _ in range(rng.randrange(0, 4))]
        text = " ".join(rng.choices(WORDS, k=rng.randrange(0, 9)))
        asked = bent(rng, rng.choice([*names, text, " ".join(rng.choices(WORDS, k=rng.randrange(0, 5)))]))
        rows.append((i, asked, names, text))
    df = spark.createDataFrame(rows, "i int, q string, names array<string>, d string")
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "names", "d"), " "), lambda w: w != ""))
    may = E.could_match(F.col("q"), E.letters(F.col("q")), F.transform("names", E.letters), words)
    got = df.select("i", E.best_ratio("q", "names", "d").alias("best"), may.alias("may")).collect()
    assert not [r.i for r in got if r.best > 0 and not r.may]
    hits, dropped = sum(r.best > 0 for r in got), sum(not r.may for r in got)
    assert hits > 1000 and dropped > 300


def test_bound_is_no_less_than_the_ratio(spark):
    rng = random.Random(6)
    texts = ["", "é", "ééééé", "aaaaaaaaaa", "abc" * 100, *(bent(rng, " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))) for _ in range(300))]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string").where("length(a) + length(b) > 0")
    got = df.select("a", "b", E.most_alike(E.letters(F.col("a")), E.letters(F.col("b"))).alias("bound")).collect()
    assert all(r.bound >= difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in got)
    assert [r.bound for r in got if r.a == r.b and r.a] == [1.0 for r in got if r.a == r.b and r.a]
