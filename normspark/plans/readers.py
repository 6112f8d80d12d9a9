"""Reader queries: payloads in the landed formats are written from the driver's tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import schemas
from normspark.functions import scalars as S
from normspark.plans.registry import Tables, query
from normspark.sources import catalogs as A
from normspark.sources import histories as H
from normspark.sources import landed as L
from normspark.sources import proceedings as P
from normspark.storage import shared_dir, stored

#: Records of one landed page, which is one file.
PAGE = 500


def _xml(rows: DataFrame, key: str, record: Column, name: str) -> str:
    """A folder of XML files: each ``PAGE`` keys make one list."""
    path = shared_dir(rows.sparkSession, name)
    pages = rows.select(F.floor(F.col(key) / PAGE).cast("int").alias("file"), record.alias("r")).groupBy("file").agg(F.collect_list("r").alias("rs"))
    whole = F.concat(F.lit("<Lista><documentos>"), F.array_join("rs", ""), F.lit("</documentos></Lista>"))
    pages.select("file", whole.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


def _pages(rows: DataFrame, key: str, record: Column, whole, name: str) -> str:
    """A folder of JSON files: each ``PAGE`` keys make one, ``whole`` of the page's number and its records."""
    path = shared_dir(rows.sparkSession, name)
    pages = rows.select(F.floor(F.col(key) / PAGE).cast("int").alias("file"), record.alias("r")).groupBy("file").agg(F.collect_list("r").alias("rs"))
    pages.select("file", F.to_json(whole(F.col("file"), F.col("rs"))).alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


def _s(x: str) -> Column:
    return F.col(x).cast("string")


_DOTS = "replace(format('{:,}', p_partkey), ',', '.')"
_DAY = "'01/0' || (1 + p_size % 9) || '/' || (1950 + p_size)"


def _day() -> Column:
    return F.concat(F.lit("01/0"), (1 + F.col("p_size") % 9).cast("string"), F.lit("/"), (1950 + F.col("p_size")).cast("string"))


_ISO = "make_date(1950 + p_size, 1 + p_size % 9, 1)::VARCHAR"


@query(f"""
SELECT p_partkey::VARCHAR AS remote_id, {_DOTS} AS number, CASE WHEN p_size % 11 <> 0 THEN 1950 + p_size END AS year, {_ISO} AS signed, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'Lei nº ' || {_DOTS} END AS title, p_name AS description,
  nullif(concat_ws(',', CASE WHEN p_size % 11 = 0 THEN 'year' END, CASE WHEN p_size % 7 = 0 THEN 'title' END), '') AS reject FROM part""")
def a1_senate_list(t: Tables) -> DataFrame:
    p = t.part
    number = S.dotted(_s("p_partkey"))
    line = F.concat(
        F.lit('<documento id="'), _s("p_partkey"), F.lit('"><numero>'), _s("p_partkey"), F.lit("</numero><normaNome>"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("Lei nº "), number)),
        F.lit("</normaNome><ementa>"), F.col("p_name"), F.lit("</ementa><dataassinatura>"), _day(), F.lit("</dataassinatura><anoassinatura>"), F.when(F.col("p_size") % 11 == 0, "?").otherwise((1950 + F.col("p_size")).cast("string")), F.lit("</anoassinatura></documento>"),
    )
    # each record lands twice; identical repeats collapse
    got = A.senate(t.spark, _xml(p.unionByName(p), "p_partkey", line, "senate"), "Lei")
    return got.select("remote_id", "number", "year", _s("signed_at").alias("signed"), "title", "description", "reject")


@query(f"""
SELECT p_partkey::VARCHAR AS remote_id, {_DOTS} AS number, CASE WHEN p_size % 11 <> 0 THEN 1950 + p_size END AS year, 'Decreto nº ' || {_DOTS} || ', de ' || p_size AS title,
  CASE WHEN p_size % 3 = 0 THEN 'https://www.al.sp.gov.br/repositorio/legislacao/' || p_partkey END AS text_url, CASE WHEN p_size % 11 = 0 THEN 'date' END AS reject FROM part""")
def a2_alesp_pages(t: Tables) -> DataFrame:
    host = F.when(F.col("p_size") % 3 == 0, "https://www.al.sp.gov.br").when(F.col("p_size") % 3 == 1, "http://www.al.sp.gov.br").otherwise("https://www.al.sp.gov.br.example.org")
    record = F.struct(
        _s("p_partkey").alias("idNorma"), F.lit("Decreto").alias("tipo"), _s("p_partkey").alias("nuNorma"), F.when(F.col("p_size") % 11 == 0, "sem data").otherwise(_day()).alias("data"),
        F.concat(F.lit("Decreto nº "), S.dotted(_s("p_partkey")), F.lit(", de "), _s("p_size")).alias("nomeNorma"), F.col("p_name").alias("dsEmenta"), F.concat(host, F.lit("/repositorio/legislacao/"), _s("p_partkey")).alias("urlIntegraListaPesquisa"),
    )
    path = _pages(t.part, "p_partkey", record, lambda n, rs: F.struct(n.alias("number"), rs.alias("content")), "alesp")
    return A.alesp(t.spark, path).select("remote_id", "number", "year", "title", "text_url", "reject")


@query("""
SELECT p_partkey::VARCHAR AS remote_id, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Lei' WHEN 2 THEN 'Decreto' ELSE 'Lei' END AS law_type, CASE WHEN p_size % 5 = 0 THEN 's/n' ELSE p_size::VARCHAR END AS number, 1950 + p_size AS year, p_name AS title,
  CASE WHEN p_size % 6 = 0 THEN 'X' ELSE 'M' END AS scope, nullif(concat_ws(',', CASE WHEN p_size % 4 = 0 THEN 'type' END, CASE WHEN p_size % 6 = 0 THEN 'scope' END), '') AS reject FROM part""")
def a3_sapl_pages(t: Tables) -> DataFrame:
    types = t.spark.createDataFrame([("1", "Lei"), ("2", "Decreto"), ("3", "Lei")], "id string, law_type string")
    record = F.struct(
        _s("p_partkey").alias("id"), (F.col("p_size") % 4).cast("string").alias("tipo"), F.when(F.col("p_size") % 5 == 0, "").otherwise(_s("p_size")).alias("numero"), (1950 + F.col("p_size")).cast("string").alias("ano"),
        F.when(F.col("p_size") % 6 == 0, "x").otherwise("m").alias("esfera_federacao"), F.col("p_name").alias("__str__"), F.col("p_type").alias("ementa"),
    )
    path = _pages(t.part, "p_partkey", record, lambda n, rs: F.struct(F.struct(n.alias("page")).alias("pagination"), rs.alias("results")), "sapl")
    return A.sapl(t.spark, path, types, "M").select("remote_id", "law_type", "number", "year", "title", "scope", "reject")


#: Records of a page in the queries on bad pages.
SMALL = 50
#: What is wrong with a page, by its number modulo 7.
_BAD = "CASE f % 7 WHEN 1 THEN 'broken' WHEN 2 THEN 'no_list' WHEN 3 THEN 'page' WHEN 4 THEN 'record' WHEN 5 THEN 'repeated' WHEN 6 THEN 'total' END"
_NUMBERED = r"file=(\d+)"


def _spoiled(t: Tables, record: Column, whole, name: str, list_name: str, numbered: bool = True) -> str:
    """Small pages of ``part``, one file each, six of seven spoiled in one of six ways."""
    path = shared_dir(t.spark, name)
    rows = t.part.select(F.floor(F.col("p_partkey") / SMALL).cast("int").alias("f"), record.alias("r")).groupBy("f").agg(F.collect_list("r").alias("rs"))
    kind = F.col("f") % 7
    json = F.to_json(whole(F.when((kind == 3) & F.lit(numbered), F.col("f") + 100_000).otherwise(F.col("f")), F.when(kind == 5, F.concat("rs", "rs")).otherwise(F.col("rs")), F.when(kind != 6, F.lit(9))))
    text = (
        F.when(kind == 1, F.left(json, F.length(json) - 40)).when(kind == 2, F.replace(json, F.lit(f'"{list_name}"'), F.lit('"error"')))
        .when(kind == 4, F.regexp_replace(json, r"\}\]", '},"x"]')).otherwise(json)
    )
    rows.select(F.col("f").alias("file"), text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


def _decree() -> Column:
    return F.struct(_s("p_partkey").alias("idNorma"), F.lit("Decreto").alias("tipo"), _s("p_partkey").alias("nuNorma"), _day().alias("data"), F.concat(F.lit("Decreto nº "), _s("p_partkey")).alias("nomeNorma"))


def _decree_pages(t: Tables) -> str:
    return _spoiled(t, _decree(), lambda n, rs, total: F.struct(n.alias("number"), total.alias("totalElements"), total.alias("totalPages"), rs.alias("content")), "spoiled", "content")


@query(f"SELECT f AS file, CASE f % 7 WHEN 3 THEN f + 100000 WHEN 1 THEN NULL ELSE f END AS page, {_BAD} AS reject FROM (SELECT DISTINCT p_partkey // {SMALL} AS f FROM part)")
def a2_page_rejects(t: Tables) -> DataFrame:
    """Every landed page with what its reader finds wrong with it."""
    got = L.pages(t.spark, _decree_pages(t), A.ALESP, _NUMBERED, True)
    return got.select(F.regexp_extract("file", _NUMBERED, 1).cast("long").alias("file"), "page", "reject")


@query(f"""
WITH p AS (SELECT p_partkey, p_size, p_partkey // {SMALL} AS f FROM part)
SELECT p_partkey::VARCHAR AS remote_id, 1950 + p_size AS year, NULL AS reject FROM p WHERE f % 7 = 0
UNION ALL SELECT DISTINCT '', NULL, 'page:' || {_BAD} || '#' || f FROM p WHERE f % 7 NOT IN (0, 1, 3) UNION ALL SELECT DISTINCT '', NULL, 'page:page#' || (f + 100000) FROM p WHERE f % 7 = 3
UNION ALL SELECT '', NULL, 'page:broken#' FROM (SELECT DISTINCT f FROM p WHERE f % 7 = 1)""")
def a2_alesp_fails_closed(t: Tables) -> DataFrame:
    """Norms of the good pages, and one row for each page that may hide some."""
    got = A.alesp(t.spark, _decree_pages(t), _NUMBERED, True)
    mark = F.when(F.col("reject").startswith("page:"), F.concat("reject", F.lit("#"), F.coalesce(_s("number_of_page"), F.lit("")))).otherwise(F.col("reject"))
    return got.withColumnRenamed("page", "number_of_page").select("remote_id", "year", mark.alias("reject"))


@query(f"SELECT f AS file, CASE WHEN f % 7 <> 0 THEN 'page:' || {_BAD} END AS reject, count(*) FILTER (f % 7 = 0) + max(CASE WHEN f % 7 <> 0 THEN 1 ELSE 0 END) AS n FROM (SELECT p_partkey // {SMALL} AS f FROM part) GROUP BY f")
def a3_page_rejects(t: Tables) -> DataFrame:
    """Pages of the second service by what their reader gives for them: their norms, or one row with the reason."""
    record = F.struct(_s("p_partkey").alias("id"), F.lit("1").alias("tipo"), _s("p_size").alias("numero"), (1950 + F.col("p_size")).cast("string").alias("ano"))
    path = _spoiled(t, record, lambda n, rs, total: F.struct(F.struct(n.alias("page"), total.alias("total_entries")).alias("pagination"), rs.alias("results")), "spoiled", "results")
    landed = L.pages(t.spark, path, A.SAPL, _NUMBERED, True)
    got = L.records(landed.withColumn("page", F.regexp_extract("file", _NUMBERED, 1).cast("long")), schemas.SAPL_PAGE, "results")
    return got.groupBy(F.col("page").alias("file"), F.col("page_reject").alias("reject")).agg(F.count("*").alias("n"))


@query(f"SELECT f AS file, nullif({_BAD.replace("WHEN 3 THEN 'page'", "WHEN 3 THEN ''")}, '') AS reject FROM (SELECT DISTINCT p_partkey // {SMALL} AS f FROM part)")
def a4_page_rejects(t: Tables) -> DataFrame:
    """Pages of the third service, which don't tell their number."""
    record = F.struct(_s("p_partkey").alias("_id"), F.struct(F.md5(_s("p_partkey")).alias("ch_norma")).alias("_source"))
    path = _spoiled(t, record, lambda n, rs, total: F.struct(total.alias("iTotalDisplayRecords"), rs.alias("aaData")), "spoiled", "aaData", numbered=False)
    got = L.quarantined(L.pages(t.spark, path, A.SINJ, None, True)).select("file", "reject")
    every = L.pages(t.spark, path, A.SINJ, None, True).select("file").join(got, "file", "left")
    return every.select(F.regexp_extract("file", _NUMBERED, 1).cast("long").alias("file"), "reject")


@query(f"""
SELECT md5(p_partkey::VARCHAR) AS remote_id, CASE WHEN p_size % 5 = 0 THEN 's/n' ELSE p_size::VARCHAR END AS number, {_ISO} AS signed, {_ISO} AS published, CASE WHEN p_size % 2 = 0 THEN 'application/pdf,text/html' ELSE 'text/html' END AS attachments,
  CASE WHEN p_size % 3 = 0 THEN 'Não verificado' ELSE 'Sem Revogação' END AS status, 'Portaria ' || CASE WHEN p_size % 5 = 0 THEN 's/n' ELSE p_size::VARCHAR END || ' de ' || {_DAY} AS title, NULL::VARCHAR AS reject FROM part""")
def a4_sinj_pages(t: Tables) -> DataFrame:
    source = lambda day, kind: F.struct(day.alias("dt_publicacao"), F.struct(F.lit(kind).alias("mimetype")).alias("ar_fonte"))
    record = F.struct(_s("p_partkey").alias("_id"), F.struct(
        F.upper(F.md5(_s("p_partkey"))).alias("ch_norma"), F.lit("Portaria").alias("nm_tipo_norma"), F.when(F.col("p_size") % 5 == 0, "0").otherwise(_s("p_size")).alias("nr_norma"), _day().alias("dt_assinatura"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise("Sem Revogação").alias("nm_situacao"), F.array(source(F.lit("?"), "Text/HTML"), source(_day(), "text/html")).alias("fontes"),
        F.struct(F.when(F.col("p_size") % 2 == 0, "application/pdf").alias("mimetype")).alias("ar_atualizado"),
    ).alias("_source"))
    path = _pages(t.part, "p_partkey", record, lambda n, rs: F.struct(n.alias("iTotalDisplayRecords"), rs.alias("aaData")), "sinj")
    got = A.sinj(t.spark, path)
    return got.select("remote_id", "number", _s("signed_at").alias("signed"), _s("published_at").alias("published"), F.array_join("attachments", ",").alias("attachments"), "status", "title", "reject")


@query("""
SELECT 'br' AS id, 'federal' AS kind, 'Brasil' AS name, NULL AS parent_id
UNION ALL SELECT 'br-' || chr(97 + n_nationkey % 26) || 'x', 'state', n_name, 'br' FROM nation
UNION ALL SELECT 'br-' || chr(97 + s_nationkey % 26) || 'x-' || s_suppkey, 'municipality', s_name, 'br-' || chr(97 + s_nationkey % 26) || 'x' FROM supplier""")
def a5_territory(t: Tables) -> DataFrame:
    """States and places as the reader meets them: a place's state on either of two paths."""
    uf = lambda c: F.concat(F.chr(65 + F.col(c) % 26), F.lit("X"))
    states = _pages(t.nation, "n_nationkey", F.struct(_s("n_nationkey").alias("id"), uf("n_nationkey").alias("sigla"), F.col("n_name").alias("nome")), lambda n, rs: rs, "states")
    named = F.struct(uf("s_nationkey").alias("sigla")).alias("UF")
    even = F.col("s_suppkey") % 2 == 0
    place = F.struct(_s("s_suppkey").alias("id"), F.col("s_name").alias("nome"), F.when(even, F.struct(F.struct(named).alias("mesorregiao"))).alias("microrregiao"), F.when(~even, F.struct(F.struct(named).alias("regiao-intermediaria"))).alias("regiao-imediata"))
    places = _pages(t.supplier, "s_suppkey", place, lambda n, rs: rs, "places")
    return A.jurisdictions(t.spark, states, places).select("id", "kind", "name", "parent_id")


@query("""
SELECT p_partkey, 'art:' || p_partkey || '.par:2' AS node_id, v.text, v.day, v.n AS source_number FROM part,
  LATERAL (SELECT p_name AS text, make_date(1950 + p_size, 1, 1)::VARCHAR AS day, NULL AS n UNION ALL SELECT p_type, make_date(1960 + p_size, 2, 3)::VARCHAR, p_size::VARCHAR) v""")
def a7_text_versions(t: Tables) -> DataFrame:
    """A provision's first text, and below it a later one with the law that brought it."""
    ident = F.concat(F.lit("urn:x!art"), _s("p_partkey"), F.lit("_par2"))
    year = lambda y: (F.lit(y) + F.col("p_size")).cast("string")
    law = F.struct(F.concat(F.lit("urn:lex:br:federal:lei:"), year(1960), F.lit("-02-03;"), _s("p_size"), F.lit("@"), year(1960)).alias("@id"), F.lit("Lei").alias("name"))
    later = F.struct(F.array(F.struct(ident.alias("legislationIdentifier"), F.col("p_type").alias("text"), F.concat(year(1960), F.lit("-02-03")).alias("legislationDate"), F.array(law).alias("legislationConsolidates"))).alias("workExample"))
    first = F.struct(ident.alias("legislationIdentifier"), F.concat("p_name", F.lit(" ")).alias("text"), F.concat(year(1950), F.lit("-01-01")).alias("legislationDate"))
    doc = F.to_json(F.struct(F.array(F.struct(first.alias("workExample"), later.alias("hasPart"))).alias("hasPart")))
    got = H.text_versions(t.part.select("p_partkey", doc.alias("doc")), "p_partkey", "doc")
    return got.select("p_partkey", "node_id", "text", _s("day").alias("day"), "source_number")


#: Lines with a number of their own in the order.
_ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


def _items(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")))


_CHANGED = "CASE l_returnflag WHEN 'R' THEN 'Revoga' WHEN 'A' THEN 'Altera' ELSE 'Cita' END"


def _change() -> Column:
    return F.when(F.col("l_returnflag") == "R", "Revoga").when(F.col("l_returnflag") == "A", "Altera").otherwise("Cita")


@query(f"""
SELECT l_orderkey::VARCHAR AS law_number, l_suppkey % 5 || '' AS source_id, 'Art. ' || l_partkey % 2 AS device_ref, arg_max({_CHANGED}, l_linenumber) AS relation, '2003-02-01' AS signed FROM {_ITEMS} WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3""")
def a8_senate_relations(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("<disp><nomeDispositivo>Art. "), (F.col("l_partkey") % 2).cast("string"), F.lit("</nomeDispositivo><refs><ref><comentario>"), _change(), F.lit("</comentario><codNormaPosterior>"), (F.col("l_suppkey") % 5).cast("string"), F.lit("</codNormaPosterior><dispositivo>Lei nº 5 de 01/02/2003</dispositivo></ref></refs></disp>"))
    docs = _items(t).select("l_orderkey", F.struct("l_linenumber", ref.alias("x")).alias("r")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "").alias("disps"))
    line = F.concat(F.lit("<documento><identificacao><numero>"), _s("l_orderkey"), F.lit("</numero></identificacao><disps>"), F.col("disps"), F.lit("</disps></documento>"))
    got = H.senate_relations(t.spark, _xml(docs, "l_orderkey", line, "relations"))
    return got.select("law_number", "source_id", "device_ref", "relation", _s("signed_at").alias("signed"))


@query(f"""
SELECT l_orderkey::VARCHAR AS law, 'alesp:' || l_linenumber AS source_id, 'https://www.al.sp.gov.br/norma/' || l_suppkey AS event_url, {_CHANGED.replace("Cita", "Ver")} AS relation, 'Lei ' || l_partkey AS event_label, 'corpo ' || l_partkey AS excerpt
FROM {_ITEMS} WHERE l_returnflag IN ('R', 'A')""")
def a9_alesp_relations(t: Tables) -> DataFrame:
    note = F.struct(
        F.when(_change() == "Cita", "Ver").otherwise(_change()).alias("tipoAnotacao"), _s("l_suppkey").alias("idNormaAnotadora"), _s("l_linenumber").alias("idAnotacao"), F.concat(F.lit("Lei "), _s("l_partkey")).alias("nomeNorma"),
        F.concat(F.lit("<b>corpo</b>  "), _s("l_partkey")).alias("anotadoraTxNorma"),
    )
    odd = F.col("l_linenumber") % 2 == 1
    docs = _items(t).groupBy("l_orderkey").agg(F.collect_list(F.when(odd, note)).alias("one"), F.collect_list(F.when(~odd, note)).alias("two"))
    record = F.struct(_s("l_orderkey").alias("idNorma"), F.col("one").alias("anotacoesAlteracao"), F.col("two").alias("anotacaoOutras"))
    got = H.alesp_relations(t.spark, _pages(docs, "l_orderkey", record, lambda n, rs: rs, "annotations"))
    return got.select(F.col("idNorma").alias("law"), "source_id", "event_url", "relation", "event_label", "excerpt")


@query(f"""
SELECT 'sinj:' || l_orderkey AS source_id, l_suppkey::VARCHAR AS amendment_id, arg_max({_CHANGED} || ' parte', l_linenumber) AS relation, arg_max('Lei ' || l_partkey, l_linenumber) AS event_label, arg_max('art. ' || l_linenumber || CASE WHEN l_quantity > 25 THEN '; § 2' ELSE '' END, l_linenumber) AS device_ref
FROM {_ITEMS} WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'O' GROUP BY 1, 2""")
def a10_sinj_relations(t: Tables) -> DataFrame:
    vide = F.struct(
        F.col("l_linenumber").alias("k"), (F.col("l_linestatus") == "O").alias("in_norma_afetada"), F.concat(_change(), F.lit(" parte")).alias("ds_texto_relacao"), _s("l_orderkey").alias("ch_vide"), _s("l_suppkey").alias("ch_norma_vide"),
        F.lit("Lei").alias("nm_tipo_norma_vide"), _s("l_partkey").alias("nr_norma_vide"), _s("l_linenumber").alias("artigo_norma_vide"), F.when(F.col("l_quantity") > 25, "2").otherwise(" ").alias("paragrafo_norma_vide"),
    )
    got = H.sinj_relations(t.spark, _pages(_items(t), "l_orderkey", vide, lambda n, rs: F.struct(F.array_sort(rs).alias("vides")), "vides"))
    return got.select("source_id", "amendment_id", "relation", "event_label", "device_ref")


@query("""
SELECT o_orderkey::VARCHAR AS norm, o_custkey + 1000000000 || '' AS other, 'incoming' AS direction, CASE o_orderkey % 3 WHEN 0 THEN 'revoga' WHEN 1 THEN 'altera' END AS relation FROM orders
UNION ALL SELECT o_custkey + 1000000000 || '', o_orderkey::VARCHAR, 'outgoing', CASE o_orderkey % 3 WHEN 0 THEN 'revoga' WHEN 1 THEN 'altera' END FROM orders""")
def a11_sapl_relations(t: Tables) -> DataFrame:
    types = t.spark.createDataFrame([("0", "revoga"), ("1", "altera")], "id string, name string")
    record = F.struct(F.concat(F.lit("r"), _s("o_orderkey")).alias("id"), _s("o_orderkey").alias("norma_principal"), (F.col("o_custkey") + 1_000_000_000).cast("string").alias("norma_relacionada"), (F.col("o_orderkey") % 3).cast("string").alias("tipo_vinculo"))
    got = H.sapl_relations(t.spark, _pages(t.orders, "o_orderkey", record, lambda n, rs: F.struct(rs.alias("results")), "edges"), types)
    return got.select("norm", "other", "direction", "relation")


@query("SELECT l_orderkey, 'C' || l_orderkey % 7 AS committee, 'S' || l_suppkey AS member, CASE l_returnflag WHEN 'R' THEN 'SIM' ELSE 'NÃO' END AS vote FROM lineitem")
def a12_committee_votes(t: Tables) -> DataFrame:
    ballot = F.struct(F.concat(F.lit("S"), _s("l_suppkey")).alias("NomeParlamentar"), F.when(F.col("l_returnflag") == "R", "SIM").otherwise("NÃO").alias("Voto"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(ballot).alias("b"))
    session = F.struct(F.concat(F.lit("C"), (F.col("l_orderkey") % 7).cast("string")).alias("SiglaColegiado"), F.struct(F.col("b").alias("Voto")).alias("Votos"))
    doc = F.to_json(F.struct(F.struct(F.struct(F.array(session).alias("Votacao")).alias("Votacoes")).alias("VotacoesComissao")))
    return P.committee_votes(docs.select("l_orderkey", doc.alias("doc")), "l_orderkey", "doc").select("l_orderkey", "committee", "member", "vote")


def _wrapped(rows: Column, keys: tuple[str, ...], by: Column) -> Column:
    """JSON of a list of structs in turn plain, under each key, under two keys, and (if it has one element) as that object."""
    forms = [F.to_json(rows), *(F.to_json(F.struct(rows.alias(k))) for k in keys), F.to_json(F.struct(F.struct(rows.alias(keys[0])).alias(keys[-1])))]
    single = F.to_json(F.struct(rows[0].alias(keys[0])))
    chosen = F.get(F.array(*forms), (by % len(forms)).cast("int"))
    return F.when((F.size(rows) == 1) & (by % 2 == 0), single).otherwise(chosen)


def _lists(t: Tables, record: Column, keys: tuple[str, ...]) -> DataFrame:
    rows = _items(t).select("l_orderkey", F.struct("l_linenumber", record.alias("x")).alias("r")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("rs"))
    return rows.select("l_orderkey", _wrapped(F.col("rs"), keys, F.col("l_orderkey")).alias("doc"))


@query(f"""
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq, l_partkey::VARCHAR AS process_id, CASE l_returnflag WHEN 'R' THEN 'LEI' WHEN 'A' THEN 'lei' END AS norm_type,
  CASE WHEN l_returnflag IN ('R', 'A') THEN l_suppkey::VARCHAR END AS norm_number, CASE WHEN l_returnflag IN ('R', 'A') THEN 1990 + l_linenumber END AS norm_year FROM {_ITEMS}""")
def a12_processes(t: Tables) -> DataFrame:
    """The norm that a process made as an object, in words, or missing; the list in any of five shapes."""
    year = (1990 + F.col("l_linenumber")).cast("string")
    made = F.struct(F.lit("LEI").alias("siglaTipo"), F.concat(F.lit("0"), _s("l_suppkey")).alias("numero"), year.alias("anoAssinatura"))
    words = F.concat(F.lit("Lei nº "), _s("l_suppkey"), F.lit(" de 05/06/"), year)
    # one JSON field of two types: written as text and put in by hand
    plain = F.struct(F.col("l_linenumber"), F.concat(F.lit('{"id":'), _s("l_partkey"), F.lit(',"normaGerada":'), F.when(F.col("l_returnflag") == "R", F.to_json(made)).when(F.col("l_returnflag") == "A", F.concat(F.lit('"'), words, F.lit('"'))).otherwise("null"), F.lit("}")).alias("x"))
    rows = _items(t).select("l_orderkey", plain.alias("r")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), ",").alias("xs"), F.count("*").alias("n"))
    turn, one = F.col("l_orderkey") % 4, F.col("n") == 1
    listed = F.concat(F.lit("["), "xs", F.lit("]"))
    under = lambda k, x: F.concat(F.lit(f'{{"{k}":'), x, F.lit("}"))
    doc = F.when(one & (turn == 0), F.col("xs")).when(one & (turn == 1), under("processo", F.col("xs"))).when(turn == 0, listed).when(turn == 1, under("processos", listed)).when(turn == 2, under("items", listed)).otherwise(under("processos", under("processo", listed)))
    got = P.processes(rows.select("l_orderkey", doc.alias("doc")), "l_orderkey", "doc")
    return got.select("l_orderkey", F.col("seq").cast("long").alias("seq"), "process_id", "norm_type", "norm_number", F.col("norm_year").cast("long").alias("norm_year"))


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq, l_partkey::VARCHAR AS amendment_id, 'S' || l_suppkey AS author FROM {_ITEMS}")
def a12_amendments(t: Tables) -> DataFrame:
    record = F.struct(F.col("l_partkey").alias("id"), F.concat(F.lit("S"), _s("l_suppkey")).alias("autoria"))
    got = P.amendments(_lists(t, record, P.AMENDMENT_KEYS), "l_orderkey", "doc")
    return got.select("l_orderkey", F.col("seq").cast("long").alias("seq"), "amendment_id", P.at(F.col("record"), "autoria").alias("author"))


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq, l_partkey::VARCHAR AS vote_id, l_quantity > 25 AS secret, l_suppkey AS yes FROM {_ITEMS}")
def a12_plenary_votes(t: Tables) -> DataFrame:
    record = F.struct(F.col("l_partkey").alias("codigoSessaoVotacao"), (F.col("l_quantity") > 25).alias("secreta"), F.struct(F.col("l_suppkey").alias("sim")).alias("totais"))
    got = P.plenary_votes(_lists(t, record, P.PLENARY_KEYS), "l_orderkey", "doc")
    return got.select("l_orderkey", F.col("seq").cast("long").alias("seq"), "vote_id", P.at(F.col("record"), "secreta", "boolean").alias("secret"), P.at(F.col("record"), "totais.sim", "bigint").alias("yes"))


@query("""
SELECT l_orderkey, 'C' || l_orderkey % 7 AS committee, CASE WHEN l_orderkey % 5 <> 4 THEN 'S' || l_suppkey END AS member, CASE WHEN l_orderkey % 5 <> 4 THEN CASE l_returnflag WHEN 'R' THEN 'SIM' ELSE 'NÃO' END END AS vote FROM lineitem WHERE l_orderkey % 5 <> 4
UNION ALL SELECT DISTINCT l_orderkey, 'C' || l_orderkey % 7, NULL, NULL FROM lineitem WHERE l_orderkey % 5 = 4""")
def a12_committee_shapes(t: Tables) -> DataFrame:
    """Sessions and ballots as objects or lists, with and without the wrappers, some without ballots."""
    ballot = F.struct(F.concat(F.lit("S"), _s("l_suppkey")).alias("NomeParlamentar"), F.when(F.col("l_returnflag") == "R", "SIM").otherwise("NÃO").alias("Voto"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(ballot).alias("b"))
    code = F.concat(F.lit("C"), (F.col("l_orderkey") % 7).cast("string")).alias("SiglaColegiado")
    turn = F.col("l_orderkey") % 5
    listed, one = F.struct(code, F.struct(F.col("b").alias("Voto")).alias("Votos")), F.struct(code, F.struct(F.col("b")[0].alias("Voto")).alias("Votos"))
    session = F.when((F.size("b") == 1) & (turn < 4), F.to_json(one)).when(turn == 4, F.to_json(F.struct(code))).when(turn % 2 == 0, F.to_json(listed)).otherwise(F.to_json(F.struct(code, F.col("b").alias("Votos"))))
    under = lambda k, x: F.concat(F.lit(f'{{"{k}":'), x, F.lit("}"))
    many = F.concat(F.lit("["), session, F.lit("]"))
    doc = F.when(turn == 0, under("VotacoesComissao", under("Votacoes", under("Votacao", session)))).when(turn == 1, under("VotacoesComissao", under("Votacoes", many))).when(turn == 2, under("Votacoes", under("Votacao", many))).otherwise(under("VotacoesComissao", under("Votacoes", under("Votacao", many))))
    return P.committee_votes(docs.select("l_orderkey", doc.alias("doc")), "l_orderkey", "doc").select("l_orderkey", "committee", "member", "vote")


@query("SELECT s_suppkey, length(s_name) + 1 AS size_bytes, sha256(s_name || chr(10)) AS checksum FROM supplier")
def a14_raw_documents(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "raw")
    # the folder is new and read after the write only, so tasks may move their many files there themselves; the number of
    # tasks is set, as short rows would else become one task's, which made and moved all files
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    landing = t.supplier.select("s_suppkey", "s_name").repartition(parts, "s_suppkey").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    landing.partitionBy("s_suppkey").text(path)
    got = A.raw_documents(t.spark, path)
    return got.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), "size_bytes", F.sha2("raw_body", 256).alias("checksum"))


@query("SELECT l_suppkey % 10 AS part, l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
def a15_merged_partitions(t: Tables) -> DataFrame:
    """Two loads into a partitioned table; the second replaces the partitions that it touches with what they hold and what is new."""
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("part"), "l_orderkey").agg(F.max("l_quantity").alias("q"))
    path = shared_dir(t.spark, "merged")
    A.merge_partitioned(rows.where("l_orderkey % 2 = 0").withColumn("q", F.lit(0.0)), path, "part", ["l_orderkey"])
    A.merge_partitioned(rows, path, "part", ["l_orderkey"])
    return stored(t.spark.read.parquet(path), "loaded").select(F.col("part").cast("long").alias("part"), "l_orderkey", "q")
