"""Proceedings of norms from JSON payloads whose shape changes: a list may be one object, and sit under any of several keys.

Payloads are VARIANT columns; each step down is one projection, so the plan grows with the depth and not with its power.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.sources.landed import is_object, items

#: Keys under which the services put their lists.
PROCESS_KEYS = ("processos", "processo", "items")
AMENDMENT_KEYS = ("emendas", "emenda", "Emendas", "Emenda", "items", "dados")
PLENARY_KEYS = ("votacoes", "votacao", "Votacoes", "Votacao", "items", "dados")
#: Wrappers that may lie around each other.
DEPTH = 4


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _either(v: Column, *paths: str) -> Column:
    """The first non-empty text under ``paths``."""
    return F.coalesce(*(F.nullif(F.trim(at(v, p)), F.lit("")) for p in paths))


def _objects(v: Column) -> Column:
    """A list's objects, or an object that is not empty as a list of its own; else an empty list."""
    return F.when(items(v).isNotNull(), F.filter(items(v), is_object)).when(is_object(v) & (F.schema_of_variant(v) != "OBJECT<>"), F.array(v)).otherwise(F.array().cast("array<variant>"))


def entries(rows: DataFrame, law: str, doc: str | Column, keys: Sequence[str]) -> DataFrame:
    """``law``, ``seq`` and ``record`` (VARIANT): the objects of the list that ``doc`` (JSON text or VARIANT) is or holds under the first key present."""
    column = F.col(doc) if isinstance(doc, str) else doc
    if rows.select(column.alias("d")).schema["d"].dataType.simpleString() != "variant":
        column = F.try_parse_json(column)
    found = rows.select(law, column.alias("__v"))
    for _ in range(DEPTH):
        down = F.coalesce(*(F.try_variant_get("__v", f"$.{k}", "variant") for k in keys), F.col("__v"))
        found = found.withColumn("__v", F.when(is_object(F.col("__v")), down).otherwise(F.col("__v")))
    return found.select(law, F.posexplode(_objects(F.col("__v"))).alias("seq", "record"))


def processes(rows: DataFrame, law: str, doc: str) -> DataFrame:
    """``process_id, sigla, number, year`` and the norm that the process made, given as an object or in words (``Lei nº 1.234 de 05/06/2011``)."""
    r = F.col("record")
    found = entries(rows, law, doc, PROCESS_KEYS)
    words = at(r, "normaGerada")
    pattern = r"(?i)^(.*?)\bn[º°o.]?\s*([\d.]+(?:-\d+)?)\s+de\s+\d{2}/\d{2}/(\d{4})"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(words, pattern, i)), F.lit(""))
    plain = lambda x: F.when(x.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r"[^0-9-]", ""), "^0+", ""), F.lit("")), F.lit("0")))
    made = is_object(F.try_variant_get(r, "$.normaGerada", "variant"))
    return found.select(
        law, "seq", _either(r, "id").alias("process_id"), _either(r, "sigla").alias("sigla"), _either(r, "numero").alias("number"), _either(r, "ano").alias("year"),
        F.when(made, _either(r, "normaGerada.siglaTipo")).otherwise(F.lower(part(1))).alias("norm_type"),
        plain(F.when(made, _either(r, "normaGerada.numero")).otherwise(part(2))).alias("norm_number"),
        F.when(made, F.regexp_replace(_either(r, "normaGerada.anoAssinatura"), r"\D", "")).otherwise(part(3)).try_cast("int").alias("norm_year"),
    )


def amendments(rows: DataFrame, law: str, doc: str) -> DataFrame:
    """One row an amendment: its id and the whole record."""
    return entries(rows, law, doc, AMENDMENT_KEYS).select(law, "seq", _either(F.col("record"), "id", "idEmenda", "codigo").alias("amendment_id"), "record")


def plenary_votes(rows: DataFrame, law: str, doc: str) -> DataFrame:
    """One row a vote in plenary: its id and the whole record."""
    return entries(rows, law, doc, PLENARY_KEYS).select(law, "seq", _either(F.col("record"), "id", "codigoSessaoVotacao", "codigo").alias("vote_id"), "record")


def committee_sessions(rows: DataFrame, law: str, doc: str) -> DataFrame:
    """``law``, ``seq``, committee, its code, time, description, matter and ``votes`` (array of VARIANT) of each session."""
    found = rows.select(law, F.try_parse_json(doc).alias("__v"))
    for key in ("VotacoesComissao", "Votacoes"):
        inner = F.try_variant_get("__v", f"$.{key}", "variant")
        found = found.withColumn("__v", F.coalesce(inner, F.col("__v")) if key == "VotacoesComissao" else inner)
    found = found.withColumn("__v", F.when(is_object(F.col("__v")), F.try_variant_get("__v", "$.Votacao", "variant")).otherwise(F.col("__v")))
    s = F.col("s")
    each = found.select(law, F.posexplode(_objects(F.col("__v"))).alias("seq", "s")).withColumn("__b", F.try_variant_get("s", "$.Votos", "variant"))
    each = each.withColumn("__b", F.when(is_object(F.col("__b")), F.try_variant_get("__b", "$.Voto", "variant")).otherwise(F.col("__b")))
    return each.select(
        law, "seq", _either(s, "NomeColegiado", "SiglaColegiado").alias("committee"), _either(s, "SiglaColegiado").alias("committee_code"), _either(s, "DataHoraInicioReuniao").alias("held_at"),
        _either(s, "DescricaoVotacao").alias("description"), _either(s, "IdentificacaoMateria").alias("matter"), _objects(F.col("__b")).alias("votes"),
    )


def committee_votes(rows: DataFrame, law: str, doc: str) -> DataFrame:
    """One row a ballot; a session without ballots gives one row without member and vote."""
    each = committee_sessions(rows, law, doc).select(law, "committee", "held_at", F.explode_outer("votes").alias("b"))
    return each.select(law, "committee", "held_at", at(F.col("b"), "NomeParlamentar").alias("member"), at(F.col("b"), "Voto").alias("vote"))
