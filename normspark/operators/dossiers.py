"""Legislative dossiers: processes of a norm, cross-house references, votes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.functions.scalars import comparable_number
from normspark.storage import salted_join

# How ballots are shown.
VOTE_LABELS = {"SIM": "Sim", "NÃO": "Não", "NAO": "Não", "ABSTENCAO": "Abstenção", "OBSTRUCAO": "Obstrução"}


def norm_key(kind: Column, number: Column, year: Column) -> Column:
    return F.concat_ws("|", F.upper(F.trim(kind)), comparable_number(number), year.cast("string"))


def matched_processes(processes: DataFrame, norms: DataFrame) -> DataFrame:
    """Pairs with equal normalised keys. Both sides: ``id``, ``kind``, ``number``, ``year``."""
    key = norm_key(F.col("kind"), F.col("number"), F.col("year"))
    left = processes.select(F.col("id").alias("process_id"), key.alias("key"))
    return left.join(norms.select(F.col("id").alias("norm_id"), key.alias("key")), "key").select("process_id", "norm_id")


def cross_references(details: DataFrame, process: str, refs: str, house: str = "CD") -> DataFrame:
    """References to the other house in order, valid ones only, the first of each normalised key. ``refs``: array of (house, kind, number, year)."""
    rows = details.select(process, F.posexplode(refs).alias("pos", "r"))
    rows = rows.where((F.col("r.house") == house) & F.col("r.kind").rlike("^[A-Za-z]{2,5}$") & F.col("r.number").rlike("^[0-9]{1,6}$") & F.col("r.year").cast("string").rlike("^(19|20)[0-9]{2}$"))
    rows = rows.withColumn("key", norm_key(F.col("r.kind"), F.col("r.number"), F.col("r.year")))
    return rows.groupBy(process, "key").agg(F.min("pos").alias("pos"))


def resolved(refs: DataFrame, candidates: DataFrame, key: list[str], candidate: str) -> DataFrame:
    """Per reference: not_found, found with the id, or ambiguous with the number of candidates (and the smallest)."""
    pool = candidates.groupBy(*key).agg(F.count("*").alias("n"), F.min(candidate).alias("one"))
    out = refs.join(pool, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("outcome", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous")).withColumn("resolved_id", F.when(F.col("n") == 1, F.col("one"))).drop("one")


def ambiguous(refs: DataFrame, candidates: DataFrame, key: list[str], candidate: str) -> DataFrame:
    """The candidates of each reference that several fit, one row each: the list beside ``resolved``, of any length."""
    several = candidates.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").select(*key)
    return salted_join(refs.join(several, key, "left_semi"), candidates.select(*key, candidate), key, candidate)


def ballots(sessions: DataFrame, process: str, votes: str) -> DataFrame:
    """One row per ballot of nested sessions. ``votes``: array of (session, ballots: array of (member, vote))."""
    rows = sessions.select(process, F.explode_outer(votes).alias("s")).select(process, "s.session", F.explode_outer("s.ballots").alias("b"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in VOTE_LABELS.items() for x in kv)), F.upper("b.vote"))
    return rows.select(process, "session", "b.member", F.coalesce(label, "b.vote").alias("vote"))


def dossier_status(processes: DataFrame, law: str, failed: Column) -> DataFrame:
    """Per law: complete, or partial if a part could not be read. Laws without a row have no process."""
    return processes.groupBy(law).agg(F.when(F.bool_or(failed), "partial").otherwise("complete").alias("status"))
