"""Batch search: a table of queries against a catalog, stage by stage as joins on precomputed keys.

``queries``: ``query_id``, ``query``. ``catalog``: ``slug``, ``title``, ``description``, ``aliases`` (array), ``law_type``,
``number``, ``year``, ``hot`` and ``hydrated_at``. A stage runs only for the queries that no earlier stage found
anything for. Nothing scans the catalog per query: every stage is an equi join on exploded keys.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from normspark.functions.scalars import adjacent_transpositions, digits_only, normalize_query, parse_query
from normspark.storage import crossed, listed, parts_of, stored


def parsed(queries: DataFrame) -> DataFrame:
    # exploding a single element keeps the parsed struct from being computed anew by each of its many readers
    out = queries.select("query_id", "query", F.explode(F.array(parse_query(F.col("query")))).alias("p")).withColumn("normal", normalize_query(F.col("query")))
    one = F.size(F.split("p.terms", " ")) == 1
    return out.select("*", F.when(one, adjacent_transpositions(F.col("p.terms"))).otherwise(F.array().cast("array<string>")).alias("swapped"), letters(F.col("p.terms")).alias("letters"))


def prepared(catalog: DataFrame) -> DataFrame:
    """The catalog with its normalised forms and number parts."""
    base = F.regexp_extract("number", r"^(.*?)(?:-(\d+))?$", 1)
    names = F.concat(F.array("title"), "aliases", F.array(F.concat("law_type", F.lit(" "), "number", F.lit("/"), F.col("year").cast("string")), F.concat("number", F.lit("/"), F.col("year").cast("string")), F.col("number")))
    out = parted(catalog, "slug", "title").select(
        "*", digits_only(base).alias("number_base"), F.nullif(F.regexp_extract("number", r"-(\d+)$", 1), F.lit("")).alias("sequence"),
        F.array_distinct(F.transform(names, normalize_query)).alias("names"), normalize_query(F.col("title")).alias("n_title"),
        normalize_query(F.coalesce("description", F.lit(""))).alias("n_description"), F.transform("aliases", normalize_query).alias("n_aliases"),
    )
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "names", "n_description"), " "), lambda w: w != ""))
    return out.select("*", F.transform("names", letters).alias("name_letters"), words.alias("name_words"))


def _typed(q: DataFrame) -> Column:
    return F.col("p.law_type").isNull() | (F.col("p.law_type") == F.col("law_type"))


def _words(*cols: str) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.split(c, " ") for c in cols), F.split(F.array_join("n_aliases", " "), " "))))


def by_number(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Stage 1: equal number, and sequence and year where the query has them."""
    hit = q.where("p.number is not null").join(laws.select("slug", "number_base", "sequence", "year", "law_type"), F.col("p.number") == F.col("number_base"))
    return hit.where((F.col("p.number_sequence").isNull() | (F.col("p.number_sequence") == F.col("sequence"))) & (F.col("p.year").isNull() | (F.col("p.year") == F.col("year"))) & _typed(q)).select("query_id", "slug", F.lit(1).alias("stage"))


def _spots(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding(needles: DataFrame, laws: DataFrame, fields: Column) -> DataFrame:
    """``w, slug``: the distinct ``needles`` (``w``) and the laws with a field (array of texts) that contains them.

    Each needle meets only the laws with its rarest 3-gram (or itself, if it is shorter); they are then read.
    """
    texts = laws.select("slug", F.filter(fields, lambda x: x != "").alias("texts"))
    grams = texts.select("slug", F.explode(F.array_distinct(F.flatten(F.transform("texts", lambda x: F.concat(_spots(x, 1), _spots(x, 2), _spots(x, 3)))))).alias("g"))
    w = F.col("w")
    parts = needles.where("w <> ''").select("w").distinct().select("w", F.explode(F.when(F.length(w) < 3, F.array(w)).otherwise(F.array_distinct(_spots(w, 3)))).alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    # a gram that no law has makes its needle's count 0
    rarest = parts.hint("merge").join(often, "g", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("w", "m.g")
    return rarest.hint("merge").join(grams, "g").join(texts.hint("merge"), "slug").where(F.exists("texts", lambda x: F.contains(x, w))).select("w", "slug")


def classed(rows: DataFrame, id: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(``id, k``; ``k`` and ``cols``): rows with the same ``cols`` are one class, so that they are compared once.

    An ``id`` comes once and has one class; one whose rows differ has a class of its own, with all of them. Nothing is collected by class.
    A small file may hold many rows, so merge hints here and below keep either side from being sent to the driver. The rows, members
    and classes are stored: each is read several times, and the texts of ``rows`` are dear to make.
    """
    same = F.unhex(F.md5(F.to_json(F.struct(*cols))))
    rows = stored(rows.select(id, *cols, same.alias("__k")), "rows")
    own = F.unhex(F.md5(F.concat(F.lit("one "), F.coalesce(F.col(id).cast("string"), F.lit("")))))
    members = stored(rows.groupBy(id).agg(F.when(F.min("__k") == F.max("__k"), F.min("__k")).otherwise(own).alias("k")), "members")
    kept = rows.alias("r").hint("merge").join(members.alias("m"), F.col(f"r.{id}").eqNullSafe(F.col(f"m.{id}")))
    return members, stored(kept.select("k", *(f"r.{c}" for c in cols)).distinct(), "classes")


def expanded(pairs: DataFrame, queries: DataFrame, laws: DataFrame) -> DataFrame:
    """``query_id, slug`` of distinct ``pairs`` of classes (``k``, ``law_k``): each pair once by the members, so no rows are compared or shuffled after they arise."""
    lists = listed(queries, "k", "query_id", parts_of(queries, "k")).select("k", "ids")
    return crossed(pairs.hint("merge").join(lists, "k").select("law_k", "ids"), laws.select("slug", F.col("k").alias("law_k")), "law_k", "query_id", "slug")


def spread(met: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, slug``: the queries of each class with the laws that it met (``slug, k``, distinct), a class in parts."""
    lists = listed(queries, "k", "query_id", parts_of(queries, "k")).select("k", "ids")
    return crossed(lists, stored(met, "met"), "k", "query_id", "slug")


def _asked(q: DataFrame, words: Column) -> tuple[DataFrame, DataFrame]:
    """Classes of queries by type and distinct words: (``query_id, k``; ``k, asked, w``)."""
    rows = q.select("query_id", F.col("p.law_type").alias("asked"), F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))).alias("words")).where(F.size("words") > 0)
    members, classes = classed(rows, "query_id", "asked", "words")
    return members, classes.select("k", "asked", F.explode("words").alias("w"))


def _classes(laws: DataFrame, texts: Column) -> tuple[DataFrame, DataFrame]:
    """Classes of laws by type and texts: (``slug, k``; ``slug`` (the class), ``law_type, texts``)."""
    members, classes = classed(laws.where("slug is not null").withColumn("texts", texts), "slug", "law_type", "texts")
    return members, classes.withColumnRenamed("k", "slug")


def _fits() -> Column:
    return F.col("asked").isNull() | (F.col("asked") == F.col("law_type"))


def _held(q: DataFrame, laws: DataFrame, words: Column, texts: Column, stage: int) -> DataFrame:
    """Queries with one of their ``words`` within one of the ``texts`` of laws of their type."""
    queries, asked = _asked(q, words)
    members, classes = _classes(laws, texts)
    hits = holding(asked, classes, F.col("texts")).join(classes.select("slug", "law_type").distinct().hint("merge"), "slug")
    pairs = asked.hint("merge").join(hits, "w").where(_fits()).select("k", F.col("slug").alias("law_k")).distinct()
    return expanded(pairs, queries, members).withColumn("stage", F.lit(stage))


def _keyed(q: DataFrame, laws: DataFrame, words: Column, keys: Column, stage: int) -> DataFrame:
    """Queries with one of their ``words`` among the ``keys`` of laws of their type."""
    queries, asked = _asked(q, words)
    members, classes = _classes(laws, F.array_sort(F.array_distinct(keys)))
    hits = classes.select(F.col("slug").alias("law_k"), "law_type", F.explode("texts").alias("w"))
    return expanded(asked.hint("merge").join(hits, "w").where(_fits()).select("k", "law_k").distinct(), queries, members).withColumn("stage", F.lit(stage))


def _tokens() -> Column:
    """The phrase and its words of four letters or more."""
    return F.concat(F.array("p.terms"), F.filter(F.split("p.terms", " "), lambda x: F.length(x) >= 4))


def _prefix() -> Column:
    first = F.get(F.split("p.terms", " "), F.lit(0))
    return F.when(F.length(first) <= 4, F.left(first, F.lit(2))).otherwise(F.left(first, F.lit(3)))


def by_transposition(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Stage 2: a word with two letters exchanged occurs in a hot law's alias."""
    return _held(q, laws.where("hot"), F.col("swapped"), F.col("n_aliases"), 2)


def by_terms(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Stage 3: the phrase or a word of four letters or more occurs in the title, description or an alias."""
    return _held(q, laws, _tokens(), F.concat(F.array("n_title", "n_description"), "n_aliases"), 3)


def by_transposed_word(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Of stage 2, what is a whole word of an alias."""
    return _keyed(q, laws.where("hot"), F.col("swapped"), F.split(F.array_join("n_aliases", " "), " "), 2)


def by_word(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Of stage 3, a word of four letters or more that is a whole word of the title, description or an alias."""
    return _keyed(q, laws, F.filter(F.split("p.terms", " "), lambda x: F.length(x) >= 4), _words("n_title", "n_description"), 3)


def by_prefix(q: DataFrame, laws: DataFrame) -> DataFrame:
    """Stage 4: the first two or three letters of the first word occur in the title or an alias (as 2- and 3-grams)."""
    queries, asked = _asked(q.where("p.terms <> ''"), F.array(_prefix()))
    members, classes = _classes(laws, F.array(F.concat_ws(" ", "n_title", F.array_join("n_aliases", " "))))
    whole = F.get("texts", F.lit(0))
    hits = classes.select(F.col("slug").alias("law_k"), "law_type", F.explode(F.array_distinct(F.concat(_spots(whole, 2), _spots(whole, 3)))).alias("w"))
    return expanded(asked.hint("merge").join(hits, "w").where(_fits()).select("k", "law_k").distinct(), queries, members).withColumn("stage", F.lit(4))


def fallback(q: DataFrame, laws: DataFrame, n: int = 2000) -> DataFrame:
    """Stage 5: the hot laws hydrated last, for queries that are not a bare number."""
    hot = laws.where("hot").orderBy(F.desc_nulls_last("hydrated_at"), "title", "slug").limit(n).select("slug", "law_type")
    # at most n rows of two short strings
    return q.where("p.number is null or p.terms <> ''").join(F.broadcast(hot), _typed(q)).select("query_id", "slug", F.lit(5).alias("stage"))


def first_stage(candidates: DataFrame) -> DataFrame:
    """Candidates of each query's earliest stage."""
    least = F.min("stage").over(Window.partitionBy("query_id"))
    return candidates.withColumn("least", least).where("stage = least").select("query_id", "slug", "stage")


# Classes of characters, four bits each: the first 16 in one number, the others in a second one.
_CLASSES = (*"abcdefghijklmnopqrstuvwxyz", " ", "01", "23", "45", "67", "89")


def letters(text: Column) -> Column:
    """How often each class of characters occurs, up to four times as that many set bits; ``rest``: all further characters; ``n``: the length."""
    n = F.length(text)
    counts = [n - F.length(F.translate(text, c, "")) for c in _CLASSES]
    bits = [F.shiftleft(F.get(F.array(*(F.lit(x).cast("long") for x in (0, 1, 3, 7, 15))), F.least(c, F.lit(4))), 4 * (i % 16)) for i, c in enumerate(counts)]
    low, high = (reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 16]) for i in (0, 16))
    return F.struct(low.alias("low"), high.alias("high"), (n - sum((F.least(c, F.lit(4)) for c in counts), F.lit(0))).alias("rest"), n.alias("n"))


def most_alike(a: Column, b: Column) -> Column:
    """No ratio of two texts with these ``letters`` is greater: it counts characters in common blocks, and no more can be common than both have."""
    both = F.bit_count(a["low"].bitwiseAND(b["low"])) + F.bit_count(a["high"].bitwiseAND(b["high"])) + F.least(a["rest"], b["rest"])
    return 2.0 * both / (a["n"] + b["n"])


def _maybe_alike(t: Column, w: Column) -> Column:
    """False where the ratio of two words is surely below 0.72: by their lengths, then by the characters that the other one has, too."""
    n, m = F.length(t), F.length(w)
    both = F.least(n - F.length(F.call_function("translate", t, w, F.lit(""))), m - F.length(F.call_function("translate", w, t, F.lit(""))))
    return (2.0 * F.least(n, m) / (n + m) >= 0.72) & (2.0 * both / (n + m) >= 0.72)


def could_match(terms: Column, asked: Column, name_letters: Column, name_words: Column) -> Column:
    """False where ``best_ratio`` is surely 0: no name can reach 0.56, and some word of ``terms`` is close to no word of the names and the description."""
    near = F.exists(name_letters, lambda x: (x["n"] > 0) & (most_alike(asked, x) >= 0.56))
    close = F.forall(F.filter(F.split(terms, " "), lambda t: t != ""), lambda t: F.exists(name_words, lambda w: _maybe_alike(t, w)))
    return F.coalesce((terms != "") & (near | close), F.lit(False))


@lru_cache(maxsize=200_000)
def _alike(token: str, word: str) -> bool:
    """Two words with a ratio of at least 0.72; the cheap upper bounds are tried first."""
    m = difflib.SequenceMatcher(None, token, word)
    return m.real_quick_ratio() >= 0.72 and m.quick_ratio() >= 0.72 and m.ratio() >= 0.72


def _close(tokens: list[str], words: list[str]) -> bool:
    return all(any(_alike(t, w) for w in words) for t in tokens)


@pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of normalised texts, at least 0.7 when each word of ``a`` has one of 0.72 in ``b``."""

    def one(q: str, c: str) -> float:
        if not q or not c:
            return 0.0
        r = difflib.SequenceMatcher(None, q, c).ratio()
        return max(r, 0.7) if r < 0.7 and _close(q.split(), c.split()) else r

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@pandas_udf(T.DoubleType())
def best_ratio(a: pd.Series, names: pd.Series, description: pd.Series) -> pd.Series:
    """The best ratio over the names, 0 if below 0.56; 0.72 at least when every word of the query is close to one of the description."""

    def one(q: str, all_names: list, text: str) -> float:
        if not q:
            return 0.0
        best, tokens = 0.0, q.split()
        for c in all_names:
            if c:
                m = difflib.SequenceMatcher(None, q, c)
                floor = max(best, 0.56)
                if m.real_quick_ratio() >= floor and m.quick_ratio() >= floor:
                    r = m.ratio()
                    best = max(best, r if r >= 0.56 else 0.0)
                if best < 0.7 and _close(tokens, c.split()):
                    best = 0.7
        return 0.72 if best < 0.72 and text and _close(tokens, text.split()) else best

    return pd.Series([one(x, list(n), d or "") for x, n, d in zip(a, names, description, strict=True)])


def edit_ratio(a: Column, b: Column) -> Column:
    """The native alternative: 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def scored(pairs: DataFrame, best: Column) -> DataFrame:
    """``score`` and ``exact`` of joined query and catalog rows. A description hit hides a title hit."""
    terms, has = F.col("p.terms"), F.col("p.terms") != ""
    same_number = F.coalesce((F.col("p.number") == F.col("number_base")) & (F.col("p.number_sequence").isNull() | (F.col("p.number_sequence") == F.col("sequence"))), F.lit(False))
    number = F.when(same_number, F.when(F.col("p.year").isNull(), 950).when(F.col("p.year") == F.col("year"), 1100).otherwise(0)).otherwise(0)
    named = F.array_contains("names", F.col("normal"))
    term_named = has & F.array_contains("names", terms)
    swapped = F.arrays_overlap("names", "swapped")
    by_terms = (
        F.when(~has, 0).when(term_named, 900).when(F.contains(F.col("n_description"), terms), 780).when(F.contains(F.col("n_title"), terms), 820)
        .when(F.exists("n_aliases", lambda a: F.contains(a, terms)), 760).when(best >= 0.56, F.floor(best * 700)).otherwise(0)
    )
    score = F.greatest(number, F.when(named, 900).otherwise(0), F.when(swapped, 840).otherwise(0), by_terms)
    return pairs.withColumn("score", score.cast("int")).withColumn("exact", (number > 0) | named | term_named)


def boosted(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Scores with the article's share: ``articles`` are distinct (slug, node_id)."""
    return with_share(holding_article(rows, articles)).drop("__has")


def holding_article(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """``__has``: the law has the article asked for."""
    out = rows.withColumn("__node", F.concat(F.lit("art:"), F.col("p.article")))
    out = out.join(articles.select("slug", F.col("node_id").alias("__node"), F.lit(True).alias("__has")), ["slug", "__node"], "left")
    return out.withColumn("__has", F.coalesce("__has", F.lit(False))).drop("__node")


def shared(score: Column) -> Column:
    """``score`` with the article's share; it never falls where ``score`` rises."""
    has, terms = F.col("__has"), F.col("p.terms") != ""
    return (
        F.when(F.col("p.article").isNull(), score).when(has & terms, F.when(score > 0, score + 260).otherwise(0))
        .when(has, F.greatest(score, F.lit(600))).when(score > 0, score + 30).otherwise(0)
    )


def with_share(rows: DataFrame) -> DataFrame:
    exact = F.col("exact") | (F.col("p.article").isNotNull() & F.col("__has") & (F.col("p.terms") == ""))
    return rows.withColumn("score", shared(F.col("score"))).withColumn("exact", exact)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query; exact hits hide the others unless an article is asked for. Ties end with the slug."""
    any_exact = F.max("exact").over(Window.partitionBy("query_id"))
    rows = rows.where("score > 0").withColumn("__any", any_exact).where(F.col("p.article").isNotNull() | ~F.col("__any") | F.col("exact"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), F.desc("hot"), "slug"))
    return rows.withColumn("rank", rn).where(F.col("rank") <= limit).withColumn("suggestion", ~F.col("exact"))


def parted(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in as many parts as a shuffle has: short rows in a small file are else one task's, however long each takes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def search(queries: DataFrame, catalog: DataFrame, articles: DataFrame | None = None, limit: int = 10, native: bool = False) -> DataFrame:
    """``query_id, rank, slug, score, stage, suggestion``. ``native`` scores by edit distance without Python."""
    stages = (by_number, by_transposition, by_terms, by_prefix, fallback)
    laws = stored(prepared(catalog).withColumn("__law", F.monotonically_increasing_id()), "laws")
    return answers(queries, laws, stages, articles, limit, native)


def answers(queries: DataFrame, laws: DataFrame, stages: Iterable[Callable[[DataFrame, DataFrame], DataFrame]], articles: DataFrame | None, limit: int, native: bool) -> DataFrame:
    """``search`` over ``prepared`` laws that are read several times: stored ones, whose rows ``__law`` tells apart.

    Queries of the same text are answered once; a query that comes twice is one.
    """
    members, texts = classed(queries.where("query_id is not null"), "query_id", "query")
    q = stored(parsed(parted(texts.withColumnRenamed("k", "query_id"), "query_id")).withColumn("__q", F.monotonically_increasing_id()), "queries")
    found, left = None, q
    for stage in stages:
        # a stage runs for the queries that none before it has found anything for
        hits = stored(stage(left, laws), "hits")
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    rows = candidates(found, q, laws, articles, limit)
    # the few that are left get their texts back
    rows = rows.join(laws.drop("hot").hint("merge"), ["slug", "__law"]).join(q.drop("query_id", "p"), "__q")
    terms = F.when(F.col("base") < 700, F.col("p.terms")).otherwise("")
    if native:
        best = F.array_max(F.transform("names", lambda n: edit_ratio(terms, n)))
    else:
        # rows that cannot reach 0.56 send nothing to Python; exploding one element keeps the bound from being computed anew by each reader
        may = could_match(terms, F.col("letters"), F.col("name_letters"), F.col("name_words"))
        sent = F.when(may, F.struct(terms.alias("terms"), F.col("names").alias("names"), F.col("n_description").alias("description"))).otherwise(
            F.struct(F.lit("").alias("terms"), F.array().cast("array<string>").alias("names"), F.lit("").alias("description")))
        rows = rows.withColumn("__sent", F.explode(F.array(sent)))
        best = best_ratio(F.col("__sent.terms"), F.col("__sent.names"), F.col("__sent.description"))
    rows = scored(rows.withColumn("__best", best), F.col("__best"))
    if articles is not None:
        rows = with_share(rows)
    # only rows whose score reaches the page need the ratio that breaks ties
    rows = rows.where("score > 0").withColumn("__r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("__r") <= limit)
    asked = F.when(F.col("p.terms") != "", F.col("p.terms")).otherwise(F.col("normal"))
    rows = rows.withColumn("similarity", edit_ratio(asked, F.col("n_title")) if native else ratio(asked, F.col("n_title")))
    out = ranked(rows, limit).select(F.col("query_id").alias("k"), "rank", "slug", "score", "stage", "suggestion")
    return members.hint("merge").join(out, "k").select("query_id", "rank", "slug", "score", "stage", "suggestion")


def candidates(found: DataFrame, q: DataFrame, laws: DataFrame, articles: DataFrame | None, limit: int) -> DataFrame:
    """The pairs of ``found`` that may be among the best ``limit`` of their query, without the law's texts: ``base`` is the score without any ratio.

    Exact hits hide the others. A ratio gives 700 at most, so what cannot reach the ``limit``-th best certain score even with that is left out.
    """
    pairs = found.join(laws.hint("merge"), "slug").join(q, "query_id")
    rows = scored(pairs, F.lit(0.0)).select("query_id", "__q", "slug", "__law", "stage", "hot", "exact", F.col("score").alias("base"), F.struct("p.article", "p.terms", "p.number", "p.number_sequence", "p.year").alias("p"))
    if articles is not None:
        asked = q.select(F.concat(F.lit("art:"), F.col("p.article")).alias("node_id")).where("node_id is not null").distinct()
        rows = holding_article(rows, articles.join(asked, "node_id", "left_semi"))
    rows = stored(rows, "pairs")
    share = shared if articles is not None else lambda score: score
    hides = stored(rows.groupBy("query_id").agg(F.max("exact").alias("__any")), "hides")
    rows = rows.join(hides, "query_id").where(F.col("p.article").isNotNull() | ~F.col("__any") | F.col("exact")).drop("__any")
    certain = rows.groupBy("query_id", share(F.col("base")).alias("score")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = certain.withColumn("__n", so_far).where(F.col("__n") >= limit).groupBy("query_id").agg(F.max("score").alias("__least"))
    most = share(F.greatest("base", F.when(F.col("p.terms") != "", 700).otherwise(0)))
    return rows.join(stored(least, "least"), "query_id", "left").where(most >= F.coalesce("__least", F.lit(0))).drop("exact", "__least")


#: The weights of a law's names by their kind.
WEIGHTS = {"official_title": 100, "number_year": 100, "acronym": 95, "popular_name": 90, "generated": 60}


def alias_weights(catalog: DataFrame) -> DataFrame:
    """Each law's names with their weights, normalised; the heaviest of equal ones, empty ones left out.

    An alias of capitals and digits alone is an acronym, any other one a popular name; generated are the number and
    year after the type, and both and the number alone without dots.
    """
    of = lambda name, weight: F.struct(normalize_query(name).alias("name"), weight.alias("weight"))
    kind = {k: F.lit(w) for k, w in WEIGHTS.items()}
    year, plain = F.col("year").cast("string"), F.translate("number", ".", "")
    number_year = F.concat("number", F.lit("/"), year)
    generated = (F.concat("law_type", F.lit(" "), number_year), F.concat(plain, F.lit("/"), year), plain)
    fixed = F.array(of(F.col("title"), kind["official_title"]), of(number_year, kind["number_year"]), *(of(g, kind["generated"]) for g in generated))
    given = F.transform("aliases", lambda a: of(a, F.when(a.rlike(r"^\p{Lu}[\p{Lu}\d]+$"), kind["acronym"]).otherwise(kind["popular_name"])))
    names = catalog.select("slug", F.inline(F.concat(fixed, F.coalesce(given, F.array().cast("array<struct<name:string,weight:int>>")))))
    return names.where("name <> ''").groupBy("slug", "name").agg(F.max("weight").alias("weight"))
