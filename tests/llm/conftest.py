import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (rnd.choice("abcdefghij") * rnd.randrange(3)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, blank and very long texts, ties and repeated rows."""
    rows = [(i, prose(i, 30 + 7 * i), "en", f"s{i % 3}", 0) for i in range(12)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "de", "s1", 4), (103, "x", "en", None, 1), (104, "ß" * 3000, "de", "s1", 3000), (None, prose(3, 51), "en", "s0", 0)]
    rows += [rows[0], rows[0], (105, rows[1][1], "en", "s0", 0), (106, prose(99, 9000), "en", "s0", 0), (107, "日本語 テキスト 😀 é   |", "ja", "s0", 12)]
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(docs):
    """The same rows with more columns, named like inner ones."""
    from pyspark.sql import functions as F

    extra = ["__keep", "__text", "score", "words", "rank", "spans", "blob", "n_words", "kept", "host", "media", "ids", "found", "group", "rep", "key"]
    return docs.select("*", *(F.lit(1).alias(c) for c in extra))
