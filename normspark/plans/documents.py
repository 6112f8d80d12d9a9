"""Parser queries. Texts of ``documents`` are dealt out as legal drafting by the position of a line, so that the
parser meets articles, paragraphs, items, subitems and continuations in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.functions import scalars as S
from normspark.operators import documents as B
from normspark.operators.changes import latest
from normspark.operators.search import parted
from normspark.plans.registry import Tables, query
from normspark.sql import register


def _drafted(t: Tables) -> DataFrame:
    """``doc_id`` and ``lines``: each line of a document with a marker that follows from its position."""
    lines = _split_lines(F.col("text"))

    def mark(x: Column, i: Column) -> Column:
        n = (F.floor(i / 6) + 1).cast("string")
        return (
            F.when(i % 6 == 0, F.concat(F.lit("Art. "), n, F.lit("º "), x)).when(i % 6 == 1, F.concat(F.lit("I - "), x)).when(i % 6 == 2, F.concat(F.lit("a) "), x))
            .when(i % 6 == 3, F.concat(F.lit("§ 1º "), x)).when(i % 6 == 4, F.concat(F.lit("II - "), x)).otherwise(F.concat(F.lit("seguem "), x))
        )

    return t.documents.select("doc_id", F.transform(lines, mark).alias("lines"))


def _split_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t\r]+", " "))), lambda x: x != "")


_LINES = """
l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r]+', ' ', 'g'), ' ')), lambda s: s <> '') AS x FROM documents))"""

_MARKED = _LINES + """,
m AS (SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN 'article' WHEN 1 THEN 'item' WHEN 2 THEN 'subitem' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'item' ELSE 'continuation' END AS kind,
  'art:' || (pos // 6 + 1) AS art FROM l),
ids AS (SELECT doc_id, pos, kind, CASE pos % 6 WHEN 0 THEN art WHEN 1 THEN art || '.inciso:I' WHEN 2 THEN art || '.inciso:I.alinea:a' WHEN 3 THEN art || '.par:1'
  WHEN 4 THEN art || '.par:1.inciso:II' ELSE art || '.par:1' END AS node_id, CASE pos % 6 WHEN 0 THEN NULL WHEN 1 THEN art WHEN 2 THEN art || '.inciso:I' WHEN 3 THEN art WHEN 4 THEN art || '.par:1' END AS parent_id FROM m)"""


def _events(t: Tables) -> DataFrame:
    rows = _drafted(t).select("doc_id", F.posexplode("lines").alias("pos", "raw")).withColumn("text", B.without_notes(F.col("raw"))).withColumn("note", B.notes(F.col("raw")))
    rows = B.after_last_heading(rows, "doc_id", "pos", F.lit(False)).withColumn("kind", B.kind_of(F.col("text")))
    return B.carried(rows.withColumn("component", F.coalesce("component", F.lit("body"))), "doc_id")


@query("""
SELECT page_id, coalesce(nullif(lower(regexp_extract(left(html, 4096), '(?i)<meta[^>]+charset\\s*=\\s*[''\"]?([a-z0-9._-]+)', 1)), ''), 'iso-8859-1') AS charset FROM pages""")
def b1_raw_format(t: Tables) -> DataFrame:
    return t.pages.select("page_id", B.declared_charset(F.encode("html", "UTF-8")).alias("charset"))


@query()
def b3_paragraphs(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.encode("html", "UTF-8").alias("html"))
    return B.paragraphs(pages, "page_id", "html").select("page_id", F.size("lines").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"), "struck", "pdfs")


@query(f"""WITH {_LINES},
x AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 4 THEN '{B.STRUCK[0]} ' || raw || ' {B.STRUCK[1]}' ELSE raw END AS line FROM l),
g AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) FILTER (pos % 5 = 4) AS struck, count(*) FILTER (pos % 7 = 6) AS pdfs FROM x GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n, sha256(coalesce(t, '')) AS digest, coalesce(struck, 0)::INTEGER AS struck, coalesce(pdfs, 0)::INTEGER AS pdfs FROM documents LEFT JOIN g USING (doc_id)""")
def b3_rendered_paragraphs(t: Tables) -> DataFrame:
    """Documents rendered as pages of ``<p>`` and ``<li>`` with struck lines and links, in UTF-8 by ``<meta>`` or UTF-16 by mark, and read back."""
    def line(x: Column, i: Column) -> Column:
        x = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        x = F.concat(F.when(i % 5 == 4, F.concat(F.lit("<del>"), x, F.lit("</del>"))).otherwise(x), F.when(i % 7 == 6, '<a href="/anexo.PDF?v=1"></a>').otherwise(""))
        return F.when(i % 2 == 0, F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise(F.concat(F.lit("<li>  "), x, F.lit("</li>\n")))

    html = F.concat(F.lit("<html><head><META http-equiv=x charset='UTF-8'><style>p {}</style></head>"), F.array_join(F.transform(_split_lines(F.col("text")), line), ""), F.lit("<script>no</script></html>"))
    body = F.when(F.col("doc_id") % 3 == 0, F.encode(html, "UTF-16")).otherwise(F.encode(html, "UTF-8"))
    got = B.paragraphs(t.documents.select("doc_id", body.alias("body")), "doc_id", "body")
    return got.select("doc_id", F.size("lines").cast("long").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"), "struck", "pdfs")


@query(f"""WITH {_LINES}
SELECT doc_id, pos, CASE WHEN doc_id % 2 = 0 THEN '(Incluído pela Lei nº ' || doc_id || ', de 2018)' ELSE '' END AS note, raw AS text FROM l""")
def b5_notes(t: Tables) -> DataFrame:
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" (Incluído pela Lei nº "), F.col("doc_id").cast("string"), F.lit(", de 2018)"))).otherwise("")
    rows = t.documents.select("doc_id", F.posexplode(_split_lines(F.col("text"))).alias("pos", "raw"), note.alias("n")).withColumn("whole", F.concat("raw", "n"))
    return rows.select("doc_id", "pos", B.notes(F.col("whole")).alias("note"), B.without_notes(F.col("whole")).alias("text"))


@query(f"WITH {_MARKED} SELECT doc_id, pos, kind FROM m")
def b6_paragraph_kinds(t: Tables) -> DataFrame:
    rows = _drafted(t).select("doc_id", F.posexplode("lines").alias("pos", "raw"))
    return rows.select("doc_id", "pos", B.kind_of(F.col("raw")).alias("kind"))


@query(f"WITH {_MARKED} SELECT doc_id, pos, kind, node_id, parent_id FROM ids")
def b7_hierarchical_ids(t: Tables) -> DataFrame:
    return _events(t).select("doc_id", "pos", "kind", "node_id", "parent_id")


@query(f"""WITH {_LINES}, h AS (SELECT *, max(CASE WHEN length(raw) % 7 = 0 THEN pos END) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, pos, CASE WHEN pos = last THEN NULL WHEN pos > last THEN 'adct' ELSE 'body' END AS component FROM h""")
def b8_components(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(_split_lines(F.col("text"))).alias("pos", "raw"))
    return B.after_last_heading(rows, "doc_id", "pos", F.length("raw") % 7 == 0).select("doc_id", "pos", "component")


def _by_order(t: Tables, line: Column) -> DataFrame:
    """``l_orderkey`` and the lines that its items give, in order.

    The parser keeps these partitions. Their number is set: like lines pack well, so that Spark would choose few by their bytes.
    """
    items = parted(t.lineitem, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))).alias("s"))
    return items.select("l_orderkey", F.transform("s", lambda s: s["x"]).alias("lines"))


@query("""
WITH o AS (SELECT l_orderkey, 'vale ' || l_returnflag AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM lineitem),
f AS (SELECT *, first_value(text) OVER (PARTITION BY l_orderkey ORDER BY k) AS ft FROM o),
kept AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS i FROM f WHERE k = 1 OR text <> ft)
SELECT l_orderkey, CASE WHEN k = 1 THEN 'art:1' ELSE 'art:1.source-variant:' || i END AS node_id, CASE WHEN k = 1 THEN 'article' ELSE 'variant' END AS node_type, text FROM kept""")
def b9_variants(t: Tables) -> DataFrame:
    """The same article once for each item of an order: equal texts merge, others become variants."""
    docs = _by_order(t, F.concat(F.lit("Art. 1º vale "), "l_returnflag"))
    return B.legal_nodes(docs, "l_orderkey").select("l_orderkey", "node_id", "node_type", "text")


@query("""
WITH RECURSIVE o AS (SELECT l_orderkey, 'segue ' || l_returnflag || l_partkey % 10 AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey % 10) AS k FROM lineitem),
f AS (SELECT l_orderkey, k, 'base ' || text AS acc FROM o WHERE k = 1 UNION ALL
  SELECT o.l_orderkey, o.k, CASE WHEN contains(f.acc, o.text) THEN f.acc ELSE f.acc || ' ' || o.text END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1)
SELECT l_orderkey, 'art:1' AS node_id, arg_max(acc, k) AS text FROM f GROUP BY 1""")
def b10_continuations(t: Tables) -> DataFrame:
    """An article and a line of continuation for each item: those that it does not hold yet are appended."""
    docs = _by_order(t, F.concat(F.lit("segue "), "l_returnflag", (F.col("l_partkey") % 10).cast("string")))
    docs = docs.select("l_orderkey", F.concat(F.array(F.lit("Art. 1º base")), "lines").alias("lines"))
    return B.legal_nodes(docs, "l_orderkey").select("l_orderkey", "node_id", "text")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey || '-a' ELSE p_partkey::VARCHAR END AS number, CASE WHEN p_size % 2 = 0 THEN 'Art. ' || p_partkey || 'º-A' ELSE 'Art. ' || p_partkey || 'º' END AS label FROM part""")
def b11_article_numbers(t: Tables) -> DataFrame:
    raw = F.concat(S.dotted(F.col("p_partkey").cast("string")), F.lit("º"), F.when(F.col("p_size") % 2 == 0, "-A").otherwise(""))
    return t.part.select("p_partkey", S.canonical_article(raw).alias("number"), S.article_label(raw).alias("label"))


@query(f"""WITH {_LINES} SELECT doc_id, 'document' AS node_id, sha256(string_agg(raw, chr(10) ORDER BY pos)) AS digest FROM l WHERE doc_id % 3 <> 0 GROUP BY doc_id""")
def b12_whole_documents(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", _split_lines(F.col("text")).alias("lines"))
    nodes = docs.where("doc_id % 3 = 0").select("doc_id")
    return B.whole_documents(docs, nodes, "doc_id").select("doc_id", "node_id", F.sha2("text", 256).alias("digest"))


@query("""
WITH v AS (SELECT source, sha256(text) AS checksum, min(doc_id) AS id FROM documents GROUP BY ALL)
SELECT source, checksum, row_number() OVER (PARTITION BY source ORDER BY id DESC) = 1 AS is_current FROM v""")
def b13_versions(t: Tables) -> DataFrame:
    rows = t.documents.groupBy("source", F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("id"))
    old = rows.where("id % 2 = 0")
    merged = old.unionByName(B.new_versions(old, rows, ["source", "checksum"]))
    return B.with_current(merged, "source", [F.col("id")]).select("source", "checksum", "is_current")


@query("SELECT p_partkey, p_type FROM part WHERE p_type = 'SMALL' OR starts_with(p_type, 'SMALL.')")
def b14_provision_subset(t: Tables) -> DataFrame:
    return B.subset(t.part.select("p_partkey", "p_type"), "p_type", "SMALL")


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_partkey::VARCHAR END AS number, CASE WHEN p_size % 3 <> 0 THEN 1990 + p_size % 30 END AS year FROM part")
def b16_amending_law(t: Tables) -> DataFrame:
    year = (1990 + F.col("p_size") % 30).cast("string")
    note = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("(Redação dada pela Lei nº "), F.col("p_partkey").cast("string"), F.lit(", de "), year, F.lit(")"))).otherwise("(Vide nota)")
    return t.part.select("p_partkey", S.note_law_number(note).alias("number"), S.note_law_year(note).alias("year"))


_NODES = f"""WITH {_MARKED},
c AS (SELECT *, CASE WHEN kind IN ('article', 'paragraph') THEN regexp_replace(raw, '^[.\\-–—]?\\s*', '') ELSE raw END AS own FROM ids JOIN l USING (doc_id, pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS order_index FROM c WHERE kind <> 'continuation' AND (own <> '' OR kind = 'article'))
SELECT doc_id, node_id, parent_id AS parent_node_id, kind AS node_type, CASE pos % 6 WHEN 0 THEN 'Art. ' || (pos // 6 + 1) || 'º' WHEN 1 THEN 'I' WHEN 2 THEN 'a' WHEN 3 THEN '§ 1º' ELSE 'II' END AS label,
  CASE WHEN kind = 'paragraph' AND follow IS NOT NULL AND NOT contains(own, follow) THEN own || ' ' || follow ELSE own END AS text, '' AS source_note, order_index::INTEGER AS order_index
FROM k LEFT JOIN (SELECT doc_id, pos - 2 AS pos, 'seguem ' || raw AS follow FROM l WHERE pos % 6 = 5) USING (doc_id, pos)"""


@query(_NODES)
def b_legal_nodes(t: Tables) -> DataFrame:
    return B.legal_nodes(_drafted(t), "doc_id")


@query(_NODES)
def k_legal_nodes(t: Tables) -> DataFrame:
    """The same from SQL: the table function on documents as partitions."""
    register(t.spark)
    _drafted(t).createOrReplaceTempView("drafted_documents")
    return t.spark.sql("SELECT * FROM legal_nodes(TABLE(drafted_documents) PARTITION BY (doc_id), 'doc_id', 'lines')")


@query("""
WITH n AS (SELECT doc_id, (len(x) + 5) // 6 AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r]+', ' ', 'g'), ' ')), lambda s: s <> '') AS x FROM documents))
SELECT doc_id, k AS source_articles, k AS parsed_articles, 0 AS missing, 'review_required' AS assessment FROM n""")
def b17_audit(t: Tables) -> DataFrame:
    docs = _drafted(t)
    nodes = B.legal_nodes(docs, "doc_id")
    out = B.audit(docs.select("doc_id", "lines", F.lit(0).alias("struck"), F.lit(0).alias("pdfs")), nodes, "doc_id")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", none(F.col("source_articles")).alias("source_articles"), none(F.col("parsed_articles")).alias("parsed_articles"), F.coalesce(F.size("missing"), F.lit(0)).alias("missing"), "assessment")


@query(f"""
WITH n AS MATERIALIZED ({_NODES}), g AS (SELECT *, max(CASE WHEN node_type = 'article' THEN order_index END) OVER (PARTITION BY doc_id ORDER BY order_index) AS a FROM n)
SELECT doc_id, a AS order_index, max(CASE WHEN node_type = 'article' THEN node_id END) AS article, max(CASE WHEN node_type = 'article' THEN label END) AS title, sha256(max(CASE WHEN node_type = 'article' THEN text END)) AS head,
  count(*) - 1 AS n, sha256(coalesce(string_agg(node_id || '|' || CASE WHEN node_type IN ('item', 'subitem') THEN node_type ELSE '' END || '|' || label || CASE WHEN node_type = 'paragraph' THEN ' ' ELSE ' — ' END || text, chr(10) ORDER BY order_index) FILTER (node_type <> 'article'), '')) AS clauses
FROM g WHERE a IS NOT NULL GROUP BY doc_id, a""")
def b15_reader_groups(t: Tables) -> DataFrame:
    out = B.reader_groups(B.legal_nodes(_drafted(t), "doc_id"), "doc_id")
    text = F.array_join(F.transform("clauses", lambda c: F.concat(c["node_id"], F.lit("|"), c["kind"], F.lit("|"), c["label"], c["text"])), "\n")
    return out.select("doc_id", "order_index", "article", "title", F.sha2("text", 256).alias("head"), F.size("clauses").cast("long").alias("n"), F.sha2(text, 256).alias("clauses"))


def _audited(t: Tables) -> DataFrame:
    """Every document as a law; some without a version, some without a snapshot, some whose first article is lost or stands twice in the source."""
    docs = _drafted(t)
    laws = t.documents.select(F.col("doc_id").alias("law"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") + 7).alias("current_version"), F.sha2("text", 256).alias("checksum"))
    versions = laws.select(F.col("current_version").alias("version"), "checksum").where("version is not null")
    lines = F.when(F.col("doc_id") % 6 == 0, F.concat("lines", F.slice("lines", 1, 1))).otherwise(F.col("lines"))
    snapshots = docs.where("doc_id % 4 <> 1").join(t.documents.select("doc_id", F.sha2("text", 256).alias("checksum")), "doc_id").select(
        F.col("doc_id").alias("law"), "checksum", F.timestamp_seconds("doc_id").alias("retrieved_at"), lines.alias("lines"), F.lit(0).alias("struck"), F.lit(0).alias("pdfs"))
    nodes = B.legal_nodes(docs, "doc_id").where("doc_id % 5 <> 0 or node_id <> 'art:1'").withColumn("version", F.col("doc_id") + 7).drop("doc_id")
    return B.corpus_audit(laws, versions, snapshots, nodes)


_AUDITED = """
WITH n AS (SELECT doc_id, (len(x) + 5) // 6 AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r]+', ' ', 'g'), ' ')), lambda s: s <> '') AS x FROM documents)),
a AS (SELECT doc_id AS law, CASE WHEN doc_id % 4 = 1 THEN 'skipped_without_snapshot' ELSE 'audited' END AS status, CASE WHEN doc_id % 4 <> 1 THEN coalesce(k, 0) END AS k, doc_id FROM documents LEFT JOIN n USING (doc_id) WHERE doc_id % 11 <> 0)"""


@query(_AUDITED + """
SELECT law, status, k + CASE WHEN doc_id % 6 = 0 AND k > 0 THEN 1 ELSE 0 END AS source_articles, k - CASE WHEN doc_id % 5 = 0 AND k > 0 THEN 1 ELSE 0 END AS parsed_articles,
  CASE WHEN k IS NOT NULL THEN CASE WHEN doc_id % 5 = 0 AND k > 0 THEN 'art:1' ELSE '' END END AS missing, CASE WHEN k IS NOT NULL THEN CASE WHEN doc_id % 6 = 0 AND k > 0 THEN 'art:1' ELSE '' END END AS repeated,
  CASE WHEN k IS NOT NULL THEN CASE WHEN doc_id % 5 = 0 AND k > 0 THEN 'gaps_detected' ELSE 'review_required' END END AS assessment FROM a""")
def b18_corpus_audit(t: Tables) -> DataFrame:
    out = _audited(t)
    whole = lambda c, none: F.when(F.col("status") == "audited", F.coalesce(c, F.lit(none)))
    return out.select(
        "law", "status", whole(F.col("source_articles"), 0).cast("long").alias("source_articles"), whole(F.col("parsed_articles"), 0).cast("long").alias("parsed_articles"),
        whole(F.array_join("missing", ","), "").alias("missing"), whole(F.array_join("repeated", ","), "").alias("repeated"), "assessment")


@query(_AUDITED + " SELECT count(*) AS examined, count(k) AS audited, count(*) - count(k) AS skipped_without_snapshot, 0 AS completeness_certified FROM a")
def b18_audit_totals(t: Tables) -> DataFrame:
    return B.audit_totals(_audited(t))


@query(f"WITH {_LINES}, n AS (SELECT doc_id, sum(length(raw)) AS n FROM l GROUP BY 1) SELECT doc_id, coalesce(n, 0) >= 80 AS legible FROM documents LEFT JOIN n USING (doc_id)")
def b19_legible(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", B.text_lines(F.regexp_replace("text", "[ \t\r]+", " "), 80).isNotNull().alias("legible"))


@query("SELECT doc_id, length(text) >= 80 AND contains(text, '19') AND contains(regexp_replace(text, '[^0-9]', '', 'g'), '7') AND contains(lower(strip_accents(text)), 'the') AS ok FROM documents")
def b20_identity(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", B.identity_ok(F.col("text"), F.lit(19), F.lit("7"), F.lit("THE act")).alias("ok"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'A' DESC, l_returnflag = 'R' DESC, strftime(l_shipdate, '%Y-%m-%d') DESC, l_linestatus = 'O' DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def b21_best_representation(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "current").when(F.col("l_returnflag") == "R", "original").otherwise("other")
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", kind.alias("version"), F.lit("texto").alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published"), F.when(F.col("l_linestatus") == "O", "OfficialLegalValue").otherwise("other").alias("value"))
    order = B.representation_order("version", "name", "published", "value")
    return latest(rows, ["l_partkey"], [*order, F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")
