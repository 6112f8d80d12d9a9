"""Readers of landed histories: relations between norms and dated text versions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark import schemas
from normspark.functions.scalars import any_date, device_node, strip_tags, urn_number, urn_of, urn_year
from normspark.operators.changes import last_wins

SENATE_WORDS = "altera|revoga|restaura|acrescenta|inclui|suprime|substitui|nova redação|derroga"
ALESP_WORDS = "alter|revog|restaur|repristin|retific"
SINJ_WORDS = "altera|acrescent|revog|restaur|repristin|retific|nova redação|derroga"


def _digits(x: str) -> Column:
    return F.coalesce(F.trim(x), F.lit("")).rlike("^[0-9]+$")


def senate_relations(spark: SparkSession, path: str) -> DataFrame:
    """Provision by reference with a change word in its comment; the last per (source, provision) wins."""
    rows = spark.read.format("xml").option("rowTag", "documento").schema(schemas.SENATE_DETAIL).load(path)
    rows = rows.select("identificacao.numero", F.posexplode("disps.disp").alias("i", "d")).select("numero", "i", F.col("d.nomeDispositivo").alias("device_ref"), F.posexplode("d.refs.ref").alias("j", "r"))
    rows = rows.where(F.lower("r.comentario").rlike(SENATE_WORDS) & (F.trim("r.codNormaPosterior") != "") & (F.trim("r.dispositivo") != ""))
    label_date = F.try_to_date(F.regexp_extract("r.dispositivo", r"\bde\s+(\d{2}/\d{2}/\d{4})\b", 1), "dd/MM/yyyy")
    rows = rows.select(
        F.col("numero").alias("law_number"), F.trim("r.codNormaPosterior").alias("source_id"), F.trim("device_ref").alias("device_ref"), F.trim("r.comentario").alias("relation"), F.trim("r.dispositivo").alias("event_label"),
        F.coalesce(any_date(F.col("r.datAssinatura")), label_date).alias("signed_at"), any_date(F.col("r.datapub")).alias("publication_date"), (F.col("i") * 100000 + F.col("j")).alias("position"),
    )
    return last_wins(rows, ["law_number", "source_id", "device_ref"], "position").drop("position")


def alesp_relations(spark: SparkSession, path: str) -> DataFrame:
    """Both annotation arrays; change words in the relation's type; numeric ids; the last per (source, url) wins."""
    rows = spark.read.option("multiLine", True).schema(schemas.ALESP_DETAIL).json(path)
    one = rows.select("idNorma", F.posexplode("anotacoesAlteracao").alias("i", "a"))
    two = rows.select("idNorma", F.posexplode("anotacaoOutras").alias("i", "a")).withColumn("i", F.col("i") + 1_000_000)
    both = one.unionByName(two).where(F.lower("a.tipoAnotacao").rlike(ALESP_WORDS) & _digits("a.idNormaAnotadora"))
    both = both.withColumn("annotation", F.coalesce(F.nullif(F.trim("a.idAnotacao"), F.lit("")), F.concat("a.idNormaAnotadora", F.lit("-"), (F.col("i") % 1_000_000).cast("string")))).where(_digits("annotation"))
    own = F.concat(F.lit("https://www.al.sp.gov.br/norma/"), F.trim("a.idNormaAnotadora"))
    label = F.coalesce(F.nullif(F.trim("a.nomeNorma"), F.lit("")), F.concat_ws(" ", "a.anotadoraTpNorma", "a.anotadoraNuNorma"))
    both = both.select(
        "idNorma", F.concat(F.lit("alesp:"), "annotation").alias("source_id"), F.col("a.tipoAnotacao").alias("relation"), F.left(label, F.lit(240)).alias("event_label"), own.alias("event_url"),
        any_date(F.coalesce("a.anotadoraDtNorma", "a.dataOrdenacao")).alias("signed_at"), any_date(F.col("a.anotadoraDtPublicacao")).alias("publication_date"), F.left(strip_tags(F.col("a.anotadoraTxNorma")), F.lit(1600)).alias("excerpt"), "i",
    )
    return last_wins(both, ["idNorma", "source_id", "event_url"], "i").drop("i")


def sinj_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations that affect this norm and name a change; the device text joins its non-blank parts."""
    rows = spark.read.option("multiLine", True).schema(schemas.SINJ_RELATIONS).json(path).select(F.posexplode("vides").alias("i", "v"))
    action = F.concat_ws(" ", "v.ds_texto_relacao", "v.nm_tipo_relacao")
    rows = rows.where(F.col("v.in_norma_afetada") & F.lower(action).rlike(SINJ_WORDS))
    part = lambda c, name: F.when(F.trim(f"v.{c}_norma_vide") != "", F.concat(F.lit(name + " "), F.trim(f"v.{c}_norma_vide")))
    device = F.concat_ws("; ", part("artigo", "art."), part("paragrafo", "§"), part("inciso", "inciso"), part("alinea", "alínea"), part("anexo", "anexo"))
    rows = rows.select(
        F.concat(F.lit("sinj:"), F.lower(F.trim("v.ch_vide"))).alias("source_id"), F.coalesce(F.nullif(F.trim("v.ds_texto_relacao"), F.lit("")), "v.nm_tipo_relacao").alias("relation"),
        F.trim(F.concat_ws(" ", "v.nm_tipo_norma_vide", "v.nr_norma_vide")).alias("event_label"), F.lower(F.trim("v.ch_norma_vide")).alias("amendment_id"), any_date(F.col("v.dt_assinatura_norma_vide")).alias("signed_at"), device.alias("device_ref"), "i",
    )
    return last_wins(rows, ["source_id", "amendment_id"], "i").drop("i")


def both_directions(edges: DataFrame, principal: str, related: str, cols: list[str]) -> DataFrame:
    """Each edge from both ends: ``norm``, ``other`` and the direction."""
    one = edges.select(F.col(principal).alias("norm"), F.col(related).alias("other"), F.lit("incoming").alias("direction"), *cols)
    return one.unionByName(edges.select(F.col(related).alias("norm"), F.col(principal).alias("other"), F.lit("outgoing").alias("direction"), *cols))


def sapl_relations(spark: SparkSession, path: str, types: DataFrame) -> DataFrame:
    """Incoming and outgoing relations with their type's name; the last per (norm, source, other) wins."""
    rows = spark.read.option("multiLine", True).schema(schemas.SAPL_RELATIONS).json(path).select(F.posexplode("results").alias("i", "r")).select("i", "r.*")
    rows = rows.where(_digits("norma_principal") & _digits("norma_relacionada")).join(types.select(F.col("id").alias("tipo_vinculo"), F.col("name").alias("relation")), "tipo_vinculo", "left")
    out = both_directions(rows, "norma_principal", "norma_relacionada", ["id", "relation", "resumo", "i"])
    return last_wins(out, ["norm", "id", "other"], "i").drop("i")


def text_versions(docs: DataFrame, law: str, doc: str) -> DataFrame:
    """Dated texts of provisions found at any depth below ``hasPart`` of JSON-LD documents, in document order.

    Arrow batches flatten the nesting; identities, dates and pairing are native afterwards.
    """

    def walk(value, out: list) -> None:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack.extend(reversed(v))
            elif isinstance(v, dict):
                examples = v.get("workExample") or []
                for e in [examples] if isinstance(examples, dict) else examples:
                    if isinstance(e, dict) and e.get("text"):
                        source = e.get("legislationConsolidates") or {}
                        source = next((s for s in source if isinstance(s, dict)), {}) if isinstance(source, list) else source
                        out.append((str(e.get("legislationIdentifier") or ""), str(e["text"]), str(e.get("legislationDate") or ""), str(e.get("additionalType") or ""), str(source.get("@id") or ""), str(source.get("name") or "")))
                stack.extend(c for k, c in reversed(list(v.items())) if k != "workExample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[law], pdf[doc], strict=True):
                found: list = []
                try:
                    walk(json.loads(text or "{}").get("hasPart", []), found)
                except (ValueError, AttributeError):
                    found = []
                rows += [(key, i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[law, "seq", "identifier", "text", "day", "operation", "source_url", "source_label"])

    kind = docs.schema[law].dataType.simpleString()
    flat = docs.select(law, doc).mapInPandas(run, f"{law} {kind}, seq long, identifier string, text string, day string, operation string, source_url string, source_label string")
    path = F.substring_index(F.get(F.split("identifier", "!"), F.lit(1)), ",", 1)
    urn = F.coalesce(urn_of(F.col("source_url")), F.get(F.split("source_url", "[@!]"), F.lit(0)))
    rows = flat.select(law, "seq", device_node(path).alias("node_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.try_to_date("day", "yyyy-MM-dd").alias("day"), "operation", urn.alias("source_urn"), urn_number(urn).alias("source_number"), urn_year(urn).alias("source_year"), "source_label", "identifier")
    return rows.where("node_id is not null and day is not null").dropDuplicates([law, "identifier", "text"]).drop("identifier")
