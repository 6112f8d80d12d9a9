"""Search over ``part`` as a catalog, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.functions import scalars as S
from normspark.operators import search as E
from normspark.operators import search_index as X
from normspark.plans.registry import SQL, Tables, query
from normspark.storage import shared_dir


def _catalog(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").cast("string").alias("slug"), F.initcap("p_name").alias("title"), F.col("p_type").alias("description"), F.array(F.col("p_brand")).alias("aliases"), F.lit("Lei").alias("law_type"),
        F.when(F.col("p_partkey") % 10 == 0, F.concat(S.dotted((F.col("p_partkey") + 1000).cast("string")), F.lit("-1"))).otherwise(S.dotted((F.col("p_partkey") + 1000).cast("string"))).alias("number"),
        (F.lit(1950) + F.col("p_size")).cast("int").alias("year"), (F.col("p_size") > 40).alias("hot"), F.col("p_retailprice").alias("hydrated_at"),
    )


def _queries(t: Tables) -> DataFrame:
    """Five kinds of query made from every hundredth part: number and year, number, title, a title word with two letters exchanged, an article."""
    p = t.part.where("p_partkey % 100 = 0").select("p_partkey", "p_name", "p_brand", "p_size")
    word = F.get(F.split("p_name", " "), F.lit(0))
    number = S.dotted((F.col("p_partkey") + 1000).cast("string"))
    kinds = F.array(
        F.concat(F.lit("Lei nº "), number, F.lit("/"), (F.col("p_size") + 1950).cast("string")), F.concat(F.lit("lei "), F.col("p_partkey").cast("string"), F.lit("000")), F.upper("p_name"),
        F.concat(F.left(word, F.lit(1)), F.substring(word, 3, 1), F.substring(word, 2, 1), F.substr(word, F.lit(4))), F.concat(F.lit("art. 2 "), "p_name"),
    )
    return p.select("p_partkey", F.posexplode(kinds).alias("k", "query")).select(F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("k").cast("string")).alias("query_id"), "query")


def _folded(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(replace(lower({x}), 'º', 'o'), 'ª', 'a')), '\\b(?:numero|no|n)\\b|\\bn[.]\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_folded("replace(text, 'ß', 'ss')")}) AS digest FROM documents")
def e1_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(S.normalize_query(F.col("text")), 256).alias("digest"))


@query()
def e1_normalize_all(t: Tables) -> DataFrame:
    """The same without SQL: the tests compare with brute force, marks and scripts of any kind included."""
    return t.documents.select("doc_id", F.sha2(S.normalize_query(F.col("text")), 256).alias("digest"))


@query("""
SELECT p_partkey, CASE WHEN y OR length(n) >= 4 THEN n END AS number, CASE WHEN (y OR length(n) >= 4) AND p_size % 2 = 0 THEN '4' END AS sequence,
  CASE WHEN y THEN CASE WHEN p_size < 50 THEN 2000 + p_size WHEN p_size < 100 THEN 1900 + p_size ELSE p_size END END AS year, 'Lei' AS law_type,
  CASE WHEN y THEN '' ELSE replace(format('{:,}', p_partkey), ',', ' ') || CASE WHEN p_size % 2 = 0 THEN ' 4 ' ELSE ' ' END || p_size END AS terms
FROM (SELECT *, p_partkey::VARCHAR AS n, p_size BETWEEN 10 AND 9999 AS y FROM part)""")
def e2_parse_query(t: Tables) -> DataFrame:
    return _parsed_parts(t.part)


@query()
def e2_parse_query_all(t: Tables) -> DataFrame:
    return _parsed_parts(t.part)


def _parsed_parts(rows: DataFrame) -> DataFrame:
    rows = E.parted(rows)
    text = F.concat(F.lit("Lei nº "), S.dotted(F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, "-4").otherwise(""), F.lit("/"), F.col("p_size").cast("string"))
    p = S.parse_query(text)
    return rows.select("p_partkey", p["number"].alias("number"), p["number_sequence"].alias("sequence"), p["year"].alias("year"), p["law_type"].alias("law_type"), p["terms"].alias("terms"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Lei Complementar' WHEN 1 THEN 'Medida Provisória' WHEN 2 THEN 'Lei' WHEN 3 THEN 'Decreto-Lei' END AS law_type FROM part")
def e3_query_type(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "lc 123").when(k == 1, "MPV 2.206").when(k == 2, "a lei do dia").when(k == 3, "decreto-lei nº 7").otherwise("portaria")
    return t.part.select("p_partkey", S.query_type(text).alias("law_type"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), i AS (SELECT w, unnest(range(1, length(w))) AS i FROM w WHERE regexp_matches(w, '^[a-z]{4,20}$'))
SELECT DISTINCT w, left(w, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2) AS variant FROM i WHERE substr(w, i, 1) <> substr(w, i + 1, 1)""")
def e4_transpositions(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.where(F.col("w").rlike("^[a-z]{4,20}$")).select("w", F.explode(S.adjacent_transpositions(F.col("w"))).alias("variant"))


@query("""
SELECT q.p_partkey || '-0' AS query_id, c.p_partkey::VARCHAR AS slug FROM part q JOIN part c ON q.p_partkey = c.p_partkey WHERE q.p_partkey % 100 = 0
UNION ALL SELECT q.p_partkey || '-1', c.p_partkey::VARCHAR FROM part q JOIN part c ON q.p_partkey * 1000 = c.p_partkey + 1000 WHERE q.p_partkey % 100 = 0 AND q.p_partkey >= 1""")
def e5_number_lookup(t: Tables) -> DataFrame:
    return E.by_number(E.parsed(_queries(t)), E.prepared(_catalog(t))).select("query_id", "slug")


@query("""
SELECT q.p_partkey::VARCHAR AS query_id, c.p_partkey::VARCHAR AS slug FROM part q JOIN part c ON lower(replace(q.p_brand, '#', '')) = lower(replace(c.p_brand, '#', '')) WHERE q.p_partkey % 100 = 0 AND c.p_size > 40""")
def e6_transposed_alias(t: Tables) -> DataFrame:
    plain = F.translate(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), "0123456789", "abcdefghij")
    catalog = _catalog(t).withColumn("aliases", F.array(F.translate(F.lower(F.regexp_replace(F.get("aliases", F.lit(0)), "[^A-Za-z0-9]", "")), "0123456789", "abcdefghij")))
    swap = F.concat(F.substring(plain, 2, 1), F.left(plain, F.lit(1)), F.substr(plain, F.lit(3)))
    queries = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), swap.alias("query"))
    return E.by_transposed_word(E.parsed(queries), E.prepared(catalog)).select("query_id", "slug")


@query("""
WITH q AS (SELECT DISTINCT left(w, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) AS x FROM (SELECT string_split(p_name, ' ')[1] AS w FROM part)),
v AS (SELECT x, left(x, i - 1) || substr(x, i + 1, 1) || substr(x, i, 1) || substr(x, i + 2) AS v FROM (SELECT x, unnest(range(1, length(x))) AS i FROM q WHERE regexp_matches(x, '^[a-z]{4,20}$')) WHERE substr(x, i, 1) <> substr(x, i + 1, 1))
SELECT DISTINCT v.x AS query_id, c.p_partkey::VARCHAR AS slug FROM v JOIN part c ON c.p_size > 40 AND contains(c.p_name, v.v)""")
def e6_transposed_alias_all(t: Tables) -> DataFrame:
    """A title's first word with two letters exchanged, anywhere in the names of hot parts as aliases."""
    first = F.get(F.split("p_name", " "), F.lit(0))
    swap = F.concat(F.left(first, F.lit(1)), F.substring(first, 3, 1), F.substring(first, 2, 1), F.substr(first, F.lit(4)))
    queries = t.part.select(swap.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    return E.by_transposition(E.parsed(queries), E.prepared(_catalog(t).withColumn("aliases", F.array("title")))).select("query_id", "slug")


_HELD = """
w AS (SELECT id, x AS w FROM q UNION SELECT id, w FROM (SELECT id, unnest(string_split(x, ' ')) AS w FROM q) WHERE length(w) >= 4),
c AS (SELECT p_partkey::VARCHAR AS slug, p_name AS a, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS d FROM part)
SELECT DISTINCT id AS query_id, slug FROM w JOIN c ON contains(a, w) OR contains(b, w)"""


@query("WITH q AS (SELECT p_partkey::VARCHAR AS id, p_name AS x FROM part WHERE p_partkey % 100 = 0)," + _HELD)
def e7_term_lookup(t: Tables) -> DataFrame:
    """Phrases and parts of words in titles and descriptions."""
    queries = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"))
    return E.by_terms(E.parsed(queries), E.prepared(_catalog(t).withColumn("aliases", F.array().cast("array<string>")))).select("query_id", "slug")


@query("""
WITH q AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 100 = 0), c AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
SELECT DISTINCT q.p_partkey::VARCHAR AS query_id, c.p_partkey::VARCHAR AS slug FROM q JOIN c USING (w) WHERE length(w) >= 4 AND regexp_matches(w, '^[a-z]+$')""")
def e7_word_lookup(t: Tables) -> DataFrame:
    queries = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"))
    return E.by_word(E.parsed(queries), E.prepared(_catalog(t).withColumn("aliases", F.array().cast("array<string>")))).select("query_id", "slug")


@query("WITH q AS (SELECT DISTINCT p_name AS id, p_name AS x FROM part)," + _HELD + " OR contains(d, w)")
def e7_term_lookup_all(t: Tables) -> DataFrame:
    """Every name as a query, against titles, descriptions and aliases."""
    queries = t.part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return E.by_terms(E.parsed(queries), E.prepared(_catalog(t))).select("query_id", "slug")


@query("""
WITH q AS (SELECT p_partkey, CASE WHEN length(string_split(p_name, ' ')[1]) <= 4 THEN left(p_name, 2) ELSE left(p_name, 3) END AS g FROM part WHERE p_partkey % 100 = 0)
SELECT q.p_partkey::VARCHAR AS query_id, c.p_partkey::VARCHAR AS slug FROM q JOIN part c ON contains(c.p_name, q.g)""")
def e8_prefix_lookup(t: Tables) -> DataFrame:
    queries = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"))
    return E.by_prefix(E.parsed(queries), E.prepared(_catalog(t).withColumn("aliases", F.array().cast("array<string>")))).select("query_id", "slug")


def _index(t: Tables, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index in three versions: half of the catalog with other titles, then all of it as it is, then without laws that are no part."""
    root = shared_dir(t.spark, "search_index")
    early = catalog.where("cast(slug as long) % 2 = 0").withColumn("title", F.concat("title", F.lit(" Widget Bolt"))).withColumn("description", F.lit("LARGE SMALL"))
    strays = catalog.withColumn("slug", F.concat(F.lit("x"), "slug")).where("hot")
    X.extend(root, early.unionByName(strays))
    X.extend(root, catalog)
    X.extend(root, catalog.limit(0), strays)
    return X.laws(t.spark, root), X.postings(t.spark, root)


@query(SQL["e6_transposed_alias_all"])
def e6_stored_aliases(t: Tables) -> DataFrame:
    """As ``e6_transposed_alias_all``, from a stored index that was extended."""
    first = F.get(F.split("p_name", " "), F.lit(0))
    swap = F.concat(F.left(first, F.lit(1)), F.substring(first, 3, 1), F.substring(first, 2, 1), F.substr(first, F.lit(4)))
    queries = t.part.select(swap.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    return X.by_transposition(E.parsed(queries), *_index(t, _catalog(t).withColumn("aliases", F.array("title")))).select("query_id", "slug")


@query(SQL["e7_term_lookup_all"])
def e7_stored_terms(t: Tables) -> DataFrame:
    """As ``e7_term_lookup_all``, from a stored index that was extended."""
    queries = t.part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return X.by_terms(E.parsed(queries), *_index(t, _catalog(t))).select("query_id", "slug")


@query(SQL["e8_prefix_lookup"])
def e8_stored_prefixes(t: Tables) -> DataFrame:
    """As ``e8_prefix_lookup``, from a stored index that was extended."""
    queries = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"))
    return X.by_prefix(E.parsed(queries), *_index(t, _catalog(t).withColumn("aliases", F.array().cast("array<string>")))).select("query_id", "slug")


@query("""
WITH hot AS (SELECT p_partkey FROM part WHERE p_size > 40 ORDER BY p_retailprice DESC NULLS LAST, p_name, p_partkey::VARCHAR LIMIT 200)
SELECT q.p_partkey::VARCHAR AS query_id, hot.p_partkey::VARCHAR AS slug FROM part q, hot WHERE q.p_partkey % 100 = 0""")
def e9_fallback(t: Tables) -> DataFrame:
    """The hot parts of the highest price for queries that are no bare number; bare numbers get none."""
    p = t.part.where("p_partkey % 100 = 0")
    words = p.select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"))
    numbers = p.select(F.concat(F.lit("n"), "p_partkey").alias("query_id"), (F.col("p_partkey") + 1000).cast("string").alias("query"))
    return E.fallback(E.parsed(words.unionByName(numbers)), E.prepared(_catalog(t)), 200).select("query_id", "slug")


@query("""
WITH c AS (SELECT l_orderkey AS query_id, l_suppkey::VARCHAR AS slug, l_linenumber AS stage FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 2 = 0)
SELECT query_id, slug, stage FROM (SELECT *, min(stage) OVER (PARTITION BY query_id) AS m FROM c) WHERE stage = m""")
def e10_first_stage(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_linenumber > 1 or l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").cast("string").alias("slug"), F.col("l_linenumber").alias("stage"))
    return E.first_stage(rows)


@query("SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS r FROM part")
def e11_edit_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(E.edit_ratio(F.col("p_name"), F.col("p_type")), 6).alias("r"))


@query()
def e11_similarity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(E.ratio(S.normalize_query(F.col("p_name")), S.normalize_query(F.col("p_type"))), 6).alias("r"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 950 ELSE 1100 END AS score FROM part WHERE p_partkey + 1000 >= 1000""")
def e12_scores(t: Tables) -> DataFrame:
    """Each part searched by its own number and year; every tenth without the year."""
    catalog = _catalog(t)
    bare = F.regexp_extract("number", r"^([0-9.]+)", 1)
    queries = catalog.select(F.col("slug").alias("query_id"), F.when(F.col("slug").cast("long") % 10 == 0, F.concat(F.lit("lei "), bare)).otherwise(F.concat(F.lit("lei "), bare, F.lit("/"), F.col("year").cast("string"))).alias("query"))
    q, laws = E.parsed(queries), E.prepared(catalog)
    pairs = E.by_number(q, laws).where("query_id = slug").join(q, "query_id").join(laws, "slug")
    return E.scored(pairs, F.lit(0.0)).select(F.col("slug").cast("long").alias("p_partkey"), "score")


@query("""
SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 950 WHEN 1 THEN 1100 WHEN 3 THEN 900 WHEN 4 THEN 780 WHEN 5 THEN 820 WHEN 6 THEN 760 WHEN 7 THEN CASE WHEN length(string_split(p_name, ' ')[1]) >= 4 THEN 840 ELSE 0 END WHEN 8 THEN 525 ELSE 0 END AS score, p_partkey % 11 IN (0, 1, 3) AS exact FROM part""")
def e12_score_branches(t: Tables) -> DataFrame:
    """Each part against its own query of one of eleven kinds: number, number and year, another year, title, description, part of the title,
    part of an alias, an alias of four letters or more with two exchanged (shorter ones don't count), ratios of 0.75 and 0.55, nothing asked.
    """
    k, word = F.col("p_partkey") % 11, F.get(F.split("p_name", " "), F.lit(0))
    number, year = S.dotted((F.col("p_partkey") + 1000).cast("string")), (F.lit(1950) + F.col("p_size"))
    asked = (
        F.when(k == 0, F.concat(F.lit("lei "), number)).when(k == 1, F.concat(F.lit("lei "), number, F.lit("/"), year.cast("string"))).when(k == 2, F.concat(F.lit("lei "), number, F.lit("/"), (year + 1).cast("string")))
        .when(k == 3, F.upper("p_name")).when(k == 4, F.col("p_type")).when(k == 5, word).when(k == 6, "apelid")
        .when(k == 7, F.concat(F.left(word, F.lit(1)), F.substring(word, 3, 1), F.substring(word, 2, 1), F.substr(word, F.lit(4)))).when(k < 10, "zzzz yyyy").otherwise("")
    )
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("slug"), F.initcap("p_name").alias("title"), F.when(k == 4, F.concat(F.lit("texto "), "p_type")).alias("description"), F.array(F.when(k == 7, word).otherwise("Apelido")).alias("aliases"),
        F.lit("Lei").alias("law_type"), number.alias("number"), year.alias("year"), F.lit(True).alias("hot"), F.lit(0).alias("hydrated_at"), asked.alias("query"), F.when(k == 8, 0.75).otherwise(0.55).alias("best"))
    q = E.parsed(rows.select(F.col("slug").alias("query_id"), "query"))
    pairs = E.prepared(rows.drop("query")).join(q, F.col("query_id") == F.col("slug"))
    return E.scored(pairs, F.col("best")).select(F.col("slug").cast("long").alias("p_partkey"), "score", "exact")


@query("""
WITH h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 5),
r AS (SELECT o_orderkey, l_orderkey IS NOT NULL AS has, o_orderkey % 2 = 1 AS asks, o_orderkey // 2 % 2 = 1 AS terms, CASE WHEN o_orderkey // 4 % 2 = 1 THEN 400 + o_orderkey // 8 % 2 * 300 ELSE 0 END AS s FROM orders LEFT JOIN h ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN NOT asks THEN s WHEN has AND terms THEN CASE WHEN s > 0 THEN s + 260 ELSE 0 END WHEN has THEN greatest(s, 600) WHEN s > 0 THEN s + 30 ELSE 0 END AS score, asks AND has AND NOT terms AS exact FROM r""")
def e13_boost_branches(t: Tables) -> DataFrame:
    """With and without an article asked for, words and a score."""
    bit = lambda n: F.shiftright("o_orderkey", n) % 2 == 1
    p = F.struct(F.when(bit(0), "5").alias("article"), F.when(bit(1), "words").otherwise("").alias("terms")).alias("p")
    score = F.when(bit(2), 400 + F.shiftright("o_orderkey", 3) % 2 * 300).otherwise(0)
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("slug"), p, score.alias("score"), F.lit(False).alias("exact"))
    articles = t.lineitem.select(F.col("l_orderkey").cast("string").alias("slug"), F.concat(F.lit("art:"), F.col("l_linenumber").cast("string")).alias("node_id")).distinct()
    return E.boosted(rows, articles).select(F.col("slug").cast("long").alias("o_orderkey"), F.col("score").cast("long").alias("score"), "exact")


@query("""
SELECT query_id, slug, rank, suggestion FROM (SELECT l_orderkey AS query_id, l_linenumber::VARCHAR AS slug, l_returnflag <> 'R' AS suggestion,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 100 DESC, l_suppkey::DOUBLE DESC, l_linestatus = 'O' DESC, l_linenumber::VARCHAR)::INTEGER AS rank
  FROM (SELECT *, bool_or(l_returnflag = 'R' AND l_partkey % 100 > 0) OVER (PARTITION BY l_orderkey) AS any_exact FROM lineitem) WHERE l_partkey % 100 > 0 AND (l_orderkey % 2 = 0 OR NOT any_exact OR l_returnflag = 'R')) WHERE rank <= 3""")
def e14_ranking_articles(t: Tables) -> DataFrame:
    """Even orders ask for an article, where exact hits hide no others."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("string").alias("slug"), (F.col("l_partkey") % 100).alias("score"), F.col("l_suppkey").cast("double").alias("similarity"), (F.col("l_linestatus") == "O").alias("hot"),
        (F.col("l_returnflag") == "R").alias("exact"), F.struct(F.when(F.col("l_orderkey") % 2 == 0, "5").alias("article")).alias("p"),
    )
    return E.ranked(rows, 3).select("query_id", "slug", "rank", "suggestion")


@query("""
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 430 ELSE 0 END WHEN o_orderkey % 2 = 0 THEN 660 ELSE 0 END AS score
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 5) ON o_orderkey = l_orderkey""")
def e13_article_boost(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("slug"), F.struct(F.lit("5").alias("article"), F.lit("words").alias("terms")).alias("p"), F.when(F.col("o_orderkey") % 2 == 0, 400).otherwise(0).alias("score"), F.lit(False).alias("exact"))
    articles = t.lineitem.select(F.col("l_orderkey").cast("string").alias("slug"), F.concat(F.lit("art:"), F.col("l_linenumber").cast("string")).alias("node_id")).distinct()
    return E.boosted(rows, articles).select(F.col("slug").cast("long").alias("o_orderkey"), "score")


@query("""
SELECT query_id, slug, rank FROM (SELECT l_orderkey AS query_id, l_linenumber::VARCHAR AS slug, l_partkey % 100 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 100 DESC, l_suppkey::DOUBLE DESC, l_linestatus = 'O' DESC, l_linenumber::VARCHAR)::INTEGER AS rank
  FROM (SELECT *, bool_or(l_returnflag = 'R' AND l_partkey % 100 > 0) OVER (PARTITION BY l_orderkey) AS any_exact FROM lineitem) WHERE l_partkey % 100 > 0 AND (NOT any_exact OR l_returnflag = 'R')) WHERE rank <= 3""")
def e14_ranking(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("string").alias("slug"), (F.col("l_partkey") % 100).alias("score"), F.col("l_suppkey").cast("double").alias("similarity"), (F.col("l_linestatus") == "O").alias("hot"),
        (F.col("l_returnflag") == "R").alias("exact"), F.struct(F.lit(None).cast("string").alias("article")).alias("p"),
    )
    return E.ranked(rows, 3).select("query_id", "slug", "rank")


@query()
def e15_batch_search(t: Tables) -> DataFrame:
    articles = t.lineitem.select(F.col("l_orderkey").cast("string").alias("slug"), F.concat(F.lit("art:"), F.col("l_linenumber").cast("string")).alias("node_id")).distinct()
    return E.search(_queries(t), _catalog(t), articles, 10)


@query()
def e15_batch_search_native(t: Tables) -> DataFrame:
    return E.search(_queries(t), _catalog(t), None, 10, native=True)


@query("""
WITH p AS (SELECT *, p_partkey::VARCHAR AS slug, CASE WHEN p_partkey % 10 = 0 THEN ' 1' ELSE '' END AS seq, ' ' || (1950 + p_size) AS y FROM part),
n AS (SELECT slug, lower(p_name) AS name, 100 AS weight FROM p UNION ALL SELECT slug, lower(p_type), CASE WHEN regexp_matches(p_type, '^[A-Z][A-Z0-9]+$') THEN 95 ELSE 90 END FROM p UNION ALL SELECT slug, lower(p_type) || ' popular', 90 FROM p
UNION ALL SELECT slug, x || replace(format('{:,}', p_partkey + 1000), ',', ' ') || seq || y, w FROM p, (VALUES ('', 100), ('lei ', 60)) v(x, w)
UNION ALL SELECT slug, (p_partkey + 1000) || seq || y, 60 FROM p UNION ALL SELECT slug, (p_partkey + 1000) || seq, 60 FROM p)
SELECT slug, trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) AS name, max(weight) AS weight FROM n GROUP BY ALL""")
def e16_alias_weights(t: Tables) -> DataFrame:
    return E.alias_weights(_catalog(t).withColumn("aliases", F.array(F.col("description"), F.concat("description", F.lit(" popular")))))


# ------------------------------------------------------------------ scalar functions


@query("""
SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits, replace(format('{:,}', o_orderkey * 1000), ',', '.') AS dots FROM orders""")
def j1_j2_digits(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.digits_only(F.col("o_orderpriority")).alias("digits"), S.dotted((F.col("o_orderkey") * 1000).cast("string")).alias("dots"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 's/n' ELSE replace(format('{:,}', p_partkey), ',', '.') END AS number FROM part")
def j3_official_number(t: Tables) -> DataFrame:
    return j3_official_number_all(t)


@query()
def j3_official_number_all(t: Tables) -> DataFrame:
    number = F.col("p_partkey").cast("string")
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Lei nº "), S.dotted(number), F.lit(" de 2018"))).otherwise("Lei sem número")
    return t.part.select("p_partkey", S.official_number(title, F.when(F.col("p_size") % 3 == 1, number).otherwise("")).alias("number"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 50 THEN 2000 + p_size ELSE 1900 + p_size END AS year FROM part")
def j4_full_year(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.full_year(F.when(F.col("p_size") >= 10, F.col("p_size").cast("string"))).alias("year"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def j5_any_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("31/02/99")
    return t.orders.select("o_orderkey", F.date_format(S.any_date(raw), "yyyy-MM-dd").alias("day"))


@query("""
SELECT n, CASE WHEN n NOT BETWEEN 1 AND 3999 THEN n::VARCHAR ELSE ['','M','MM','MMM'][n // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] END AS roman
FROM (SELECT DISTINCT o_orderkey AS n FROM orders)""")
def j6_roman(t: Tables) -> DataFrame:
    return j6_roman_all(t)


@query()
def j6_roman_all(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("n")).distinct().select("n", S.roman(F.col("n")).alias("roman"))


@query("SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def j7_flat(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(S.flat(F.col("text"), strip_marks=False), 256).alias("digest"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_matches(url, '^[a-z]+://([^/?#]+\\.)?example\\.org([/?#]|$)') AS allowed, regexp_replace(url, '^http://', 'https://') AS https FROM pages")
def j8_url_parts(t: Tables) -> DataFrame:
    host = S.url_part(F.col("url"), "HOST")
    return t.pages.select("page_id", host.alias("host"), S.url_part(F.col("url"), "PATH").alias("path"), S.allowed_host(host, ["example.org"]).alias("allowed"), S.https(F.col("url")).alias("https"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM pages")
def j9_j11_stripped(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(S.strip_tags(F.col("html"))).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE l_returnflag || ',' || l_linestatus END || CASE WHEN l_returnflag <> 'X' AND l_linestatus <> 'X' THEN ',X' ELSE '' END AS parts FROM lineitem")
def j10_distinct_concat(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(S.distinct_concat(F.array("l_returnflag"), F.array(F.col("l_linestatus"), F.lit("X")), F.array("l_returnflag")), ",").alias("parts"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS band, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS minute FROM events")
def j13_j14_bands(t: Tables) -> DataFrame:
    stamp = S.utc_timestamp(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("never"))
    return t.events.select("event_id", S.band(F.col("value"), [(10, "low"), (50, "middle")], "high").alias("band"), F.date_format(stamp, "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT p_partkey, p_name || ' Produção de efeitos' AS text, p_partkey::VARCHAR AS number FROM part")
def j15_j16_display(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.effects_spacing(F.concat("p_name", F.lit("Produção de efeitos"))).alias("text"), S.comparable_number(F.concat(F.lit("000"), F.col("p_partkey").cast("string"))).alias("number"))
