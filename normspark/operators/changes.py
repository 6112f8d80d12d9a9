"""Changes of provisions: before/after pairs, history, blame and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_WORDS = "altera|revoga|restaura|acrescenta|inclui|suprime|substitui"
OPERATIONS = {"Text_Change": "UPDATE", "Insertion": "ADD", "Repeal": "REPEAL"}


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def before_after(rows: DataFrame, key: Sequence[str], day: str, seq: str, text: str, kind: str | None = None) -> DataFrame:
    """Each dated version with the text of the latest strictly earlier day (first record of that day).

    ``kind`` names Insertion (empty before), Repeal (a missing text reads "(Revogado)") or anything else, which
    needs a predecessor. Equal texts are dropped.
    """
    span = Window.partitionBy(*key).orderBy(F.unix_date(F.col(day).cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.struct(F.col(day).alias("d"), (-F.col(seq)).alias("s"), F.col(text).alias("t"))).over(span)
    out = rows.withColumn("before_text", previous["t"]).withColumn("after_text", F.col(text))
    if kind:
        out = out.withColumn("before_text", F.when(F.col(kind) == "Insertion", "").otherwise(F.col("before_text")))
        out = out.withColumn("after_text", F.when((F.col(kind) == "Repeal") & F.coalesce(F.col(text) == "", F.lit(True)), "(Revogado)").otherwise(F.col("after_text")))
    return out.where("before_text is not null and after_text is not null and before_text <> after_text")


def is_change(relation: Column) -> Column:
    return F.lower(relation).rlike(CHANGE_WORDS)


def last_wins(rows: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    return latest(rows, key, [F.desc(position)])


def unseen(events: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    return events.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def event_id(provider: str, law: Column, source: Column, device: Column) -> Column:
    """The id of an event, the same whenever it is met: of provider, law, source and device (null: empty)."""
    from normspark.functions.scalars import uuid5

    return uuid5(F.concat(F.lit(f"{provider}:"), law.cast("string"), F.lit(":"), source.cast("string"), F.lit(":"), F.coalesce(device.cast("string"), F.lit(""))))


def match_events(events: DataFrame, changes: DataFrame, equal: Sequence[str], residual: Sequence[str]) -> DataFrame:
    """Pairs that agree on ``equal`` and on each of ``residual`` that the event names: an equi join with a filter."""
    e, c = events.alias("e"), changes.alias("c")
    fits = F.lit(True)
    for r in residual:
        fits = fits & (F.col(f"e.{r}").isNull() | (F.col(f"e.{r}") == F.col(f"c.{r}")))
    on = None
    for k in equal:
        term = F.col(f"e.{k}") == F.col(f"c.{k}")
        on = term if on is None else on & term
    return e.join(c, on).where(fits).select("e.event_id", "c.change_id")


def compared(events: DataFrame, changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events marked as compared or pending, and one derived event per change without an event."""
    hit = pairs.select("event_id").distinct().withColumn("hit", F.lit(True))
    known = events.select("event_id").join(hit, "event_id", "left").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("hit"), "compared").otherwise("pending").alias("status"))
    lonely = changes.select("change_id").join(pairs.select("change_id").distinct(), "change_id", "left_anti")
    return known.unionByName(lonely.select(F.concat(F.lit("change:"), F.col("change_id").cast("string")).alias("id"), F.lit("derived").alias("status")))


def evidence_level(host: Column, comparable: Column, primary: Sequence[str]) -> Column:
    from normspark.functions.scalars import allowed_host

    return F.when(~comparable, "partial").when(allowed_host(host, primary), "verified_primary").otherwise("verified_source")


def blame(nodes: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Every node with its newest change; ``status`` tells whether there is one."""
    newest = latest(changes, key, order).select(*key, *cols, F.lit(True).alias("__has"))
    out = nodes.join(newest, list(key), "left")
    return out.withColumn("status", F.when(F.col("__has"), "identified").otherwise("not_identified")).drop("__has")


def with_ancestors(nodes: DataFrame, law: str, node: str, carried: Sequence[str] = ()) -> DataFrame:
    """Each node with itself and all provisions above it: ``holder`` and ``distance`` (0 for itself). ``art:1.par:2`` is below ``art:1``."""
    parts = F.split(node, r"\.")
    depth = F.size(parts)
    above = F.transform(F.sequence(F.lit(0), depth - 1), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), depth - d), ".").alias("holder"), d.alias("distance")))
    return nodes.select(law, node, *carried, F.inline(above))


def device_relations(nodes: DataFrame, relations: DataFrame, law: str, node: str) -> DataFrame:
    """The relations of every node and of the provisions that hold it: ``law``, ``node``, ``holder``, ``distance`` and the relation's columns, one row each.

    A node's path is exploded once, into as many keys as it is deep, and joined by (law, path); nothing is collected by node.
    Spark sizes exploded rows as if there were one per row before, so the merge hint keeps them from being sent to the driver.
    """
    paths = with_ancestors(nodes.select(law, node).where(F.col(node).isNotNull()).distinct(), law, node).hint("merge")
    related = relations.withColumnRenamed(node, "holder")
    return paths.join(related, [law, "holder"]).select(law, node, "holder", "distance", *(c for c in related.columns if c not in (law, "holder")))


def provenance(nodes: DataFrame, changes: DataFrame, relations: DataFrame, law: str, node: str, change: str, comparable: str, order: Sequence[Column]) -> DataFrame:
    """Every node's change (the first comparable one in ``order``, else the first), its own relations and those of the provisions above it, counted, and ``status``.

    verified: there is a comparable change; partial: another change or a relation of its own; else not_identified.
    """
    chosen = latest(changes, [law, node], [F.desc(F.coalesce(F.col(comparable), F.lit(False))), *order]).select(law, node, F.col(change).alias("change_id"), F.coalesce(F.col(comparable), F.lit(False)).alias("__comparable"))
    # counted by provision first, so that a provision with many relations meets those below it as one row
    known = relations.groupBy(law, F.col(node).alias("holder")).agg(F.count("*").alias("__n"))
    counted = with_ancestors(nodes.select(law, node).where(F.col(node).isNotNull()).distinct(), law, node).hint("merge").join(known, [law, "holder"])
    counted = counted.groupBy(law, node).agg(F.sum(F.when(F.col("distance") == 0, F.col("__n")).otherwise(0)).alias("relations"), F.sum(F.when(F.col("distance") > 0, F.col("__n")).otherwise(0)).alias("inherited"))
    # changes of well-compressed files look small, too
    out = nodes.join(chosen.hint("merge"), [law, node], "left").join(counted.hint("merge"), [law, node], "left")
    none = F.lit(0).cast("long")
    out = out.withColumn("relations", F.coalesce("relations", none)).withColumn("inherited", F.coalesce("inherited", none))
    status = F.when(F.col("__comparable"), "verified").when(F.col("__comparable").isNotNull() | (F.col("relations") > 0), "partial").otherwise("not_identified")
    return out.withColumn("status", status).drop("__comparable")


def timeline(changes: DataFrame, events: DataFrame) -> DataFrame:
    """One schema (law, kind, id, day) for changes and events; a missing date sorts as 0000-01-01, the newest first."""
    both = changes.withColumn("kind", F.lit("change")).unionByName(events.withColumn("kind", F.lit("event")))
    return both.withColumn("sort_day", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("0000-01-01")))


def history_status(laws: DataFrame, jobs: DataFrame) -> DataFrame:
    """``law, status``: that of the newest history job still queued or running, else the coverage's ``history``, else ``not_requested``.

    ``laws``: law, history; ``jobs``: law, job_id, job_type, status, created_at.
    """
    active = jobs.where("job_type = 'history' and status in ('queued', 'running')").groupBy("law").agg(F.max(F.struct("created_at", "job_id", "status")).alias("j"))
    return laws.join(active, "law", "left").select("law", F.coalesce("j.status", F.nullif("history", F.lit("")), F.lit("not_requested")).alias("status"))


def history(laws: DataFrame, jobs: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """The timeline of ``laws`` with each law's overall ``status``; events that were compared are changes already and don't come twice.

    ``changes``: law, id, day, comparable (then a ``diff``, else a ``relation``); ``events``: law, id, day, event_status (null: not compared).
    """
    rows = timeline(
        changes.select("law", "id", "day", "comparable"),
        events.where("event_status is null or event_status <> 'compared'").select("law", "id", "day", F.lit(False).alias("comparable")),
    )
    rows = rows.withColumn("item", F.when(F.coalesce("comparable", F.lit(False)), "diff").otherwise("relation"))
    return rows.join(history_status(laws, jobs), "law").select("law", "status", "kind", "item", "id", "sort_day")


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """ADD, MODIFY and REVOKE between two versions by stable id; unchanged nodes are left out."""
    both = old.select(*key, F.col(text).alias("old_text"), F.lit(1).alias("__o")).join(new.select(*key, F.col(text).alias("new_text"), F.lit(1).alias("__n")), list(key), "full_outer")
    kind = F.when(F.col("__o").isNull(), "ADD").when(F.col("__n").isNull(), "REVOKE").when(~F.col("old_text").eqNullSafe(F.col("new_text")), "MODIFY")
    return both.withColumn("operation", kind).where("operation is not null").drop("__o", "__n")


def operation_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in OPERATIONS.items() for x in kv)), kind), F.lit("OTHER"))


def contained_passages(docs: DataFrame, passages: DataFrame, block: int = 8) -> DataFrame:
    """(passage, doc) pairs where the doc's flat text contains the passage's: found by the passage's first ``block``
    words as a key, so that only documents sharing them are compared. ``docs`` (doc_id, text), ``passages`` (item_id, text).
    """
    from normspark.functions.scalars import collapse

    key = passages.select("item_id", collapse(F.col("text")).alias("p"))
    key = key.withColumn("w", F.split("p", " ")).where(F.size("w") >= block).select("item_id", "p", F.xxhash64(F.array_join(F.slice("w", 1, block), " ")).alias("k"))
    words = docs.select("doc_id", F.split(collapse(F.coalesce("text", F.lit(""))), " ").alias("w")).where(F.size("w") >= block)
    keyed = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (block - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, block), " "))))).alias("k"))
    pairs = keyed.join(key.select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    texts = docs.select("doc_id", collapse(F.coalesce("text", F.lit(""))).alias("t"))
    return pairs.join(texts, "doc_id").join(key.select("item_id", "p"), "item_id").where(F.expr("contains(t, p)")).select("item_id", "doc_id")


def flat_passages(docs: DataFrame, passages: DataFrame, least: int = 40) -> DataFrame:
    """(passage, doc) pairs where the doc's letters and digits contain the passage's, of at least ``least``.

    Docs are cut into blocks of half that length; a passage's first ``least`` characters hold one whole block wherever they
    lie, so its keys are all substrings of that length there. ``docs`` (doc_id, text), ``passages`` (item_id, text).
    """
    from normspark.functions.scalars import flat_folded

    half = least // 2
    items = passages.select("item_id", flat_folded(F.col("text")).alias("p")).where(F.length("p") >= least)
    keys = items.select("item_id", F.explode(F.array_distinct(F.array(*(F.substring("p", i, half) for i in range(1, least - half + 2))))).alias("k"))
    texts = docs.select("doc_id", flat_folded(F.col("text")).alias("t"))
    blocks = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"(.{{{half}}})"), F.lit(1)))).alias("k"))
    pairs = blocks.join(keys, "k").select("doc_id", "item_id").distinct()
    return pairs.join(texts, "doc_id").join(items, "item_id").where(F.contains("t", F.col("p"))).select("item_id", "doc_id")


def verified_additions(nodes: DataFrame, amendments: DataFrame, least: int = 40) -> DataFrame:
    """Paragraphs whose note names an amending law (number and year) that repeats their text.

    ``nodes``: ``law``, ``node_id``, ``node_type``, ``source_note``, ``text``; ``amendments``: ``number`` as printed, ``year``, ``text``.
    """
    from normspark.functions.scalars import flat_folded, note_law_number, note_law_year

    note = F.col("source_note")
    named = nodes.where("node_type = 'paragraph'").select("law", "node_id", note_law_number(note).alias("number"), note_law_year(note).alias("year"), flat_folded(F.col("text")).alias("p"))
    bodies = amendments.select("number", "year", flat_folded(F.col("text")).alias("t"))
    return named.where(F.length("p") >= least).join(bodies, ["number", "year"]).where(F.contains("t", F.col("p"))).select("law", "node_id", "number", "year").distinct()
