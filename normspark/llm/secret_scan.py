"""Secret scans over content-addressed texts with an incremental ledger (DataFrame functions only).

A text is a *blob*, addressed by the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table, partitioned by the
blob's first digit; a row is one scan of a blob: the rules with their versions, and the spans found. ``scan`` looks
up by ids alone which (blob, rule version) pairs the ledger lacks, fetches the texts of those blobs only, scans each
text once for the rules it lacks, appends the outcome, and joins the findings of the current rules back to every
path that carries the blob. A run without new pairs moves no text at all.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results;
an empty table gives an empty result and no ledger rows; path columns may have any names
(inner columns start with ``__``). Offsets are code points, the end is exclusive. Matches of one rule
never overlap; spans of different rules may. Running sums over a blob's matches are windows over
exploded rows, so very long texts with many matches spill instead of growing one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_side, stored


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group`` of a match must have ``least`` characters; ``hint`` is a literal
    that every match contains, looked for first."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The first three are the contract's base kinds; the rest are well-known credential formats.
RULES = (
    Rule("assign", 1, rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, "eyJ"),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]+", 36, 0, "gh"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]+", 20, 0, "xox"),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob string, scanned array<string>, hits array<struct<start:int,end:int,kind:string,version:int>>, part string"

#: Unseen blobs (about 300 bytes each: id and rule keys) whose ids are broadcast to pick out their texts.
UNSEEN = 100_000


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _passes(rule: Rule, match: Column) -> Column:
    if not rule.least:
        return F.lit(True)
    value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
    return F.length(value) >= rule.least


def _matches(text: Column, rule: Rule) -> Column:
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


def _hits(text: Column, rule: Rule) -> Column:
    """Per match, in order: characters since the match before, its length, and whether it counts."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.arrays_zip(gaps.alias("gap"), _matches(text, rule).alias("found"))
    steps = F.transform(
        found,
        lambda x: F.struct(x["gap"].alias("gap"), F.length(x["found"]).alias("long"), _passes(rule, x["found"]).alias("ok")),
    )
    # the text after the last match makes one gap more than there are matches
    return F.filter(steps, lambda x: x["long"].isNotNull())


def _scan(todo: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A ledger row for each blob of ``todo`` (``__blob``, ``__text``, ``__todo`` rule keys), with or without spans."""
    text = F.col("__text")

    def of(rule: Rule) -> Column:
        may = F.array_contains("__todo", rule.key)
        if rule.hint:
            may = may & text.contains(rule.hint)
        return F.when(may & text.rlike(rule.pattern), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), _hits(text, rule).alias("hits")))

    each = todo.select("__blob", "__todo", F.explode_outer(F.array_compact(F.array(*map(of, rules)))).alias("__r"))
    each = each.select("__blob", "__todo", "__r.kind", "__r.version", F.posexplode_outer("__r.hits").alias("__pos", "__hit"))
    upto = Window.partitionBy("__blob", "kind", "version").orderBy("__pos")
    end = F.sum(F.col("__hit.gap") + F.col("__hit.long")).over(upto).cast("int")
    each = each.withColumn("end", end)
    span = F.when(F.col("__hit.ok"), F.struct((F.col("end") - F.col("__hit.long")).cast("int").alias("start"), "end", "kind", "version"))
    rows = each.groupBy("__blob").agg(F.first("__todo").alias("scanned"), F.array_sort(F.collect_list(span)).alias("hits"))
    return rows.select(F.col("__blob").alias("blob"), "scanned", "hits", F.left("__blob", F.lit(1)).alias("part"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty where nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def extend_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Scan the (blob, rule version) pairs of ``docs`` that the ledger at ``ledger`` lacks and append them.

    Ids are compared first. The texts of few unseen blobs are picked out by their broadcast ids before anything
    is shuffled; those of many are made distinct in one shuffle. Either way equal texts meet as partial aggregates
    in each map task, so a huge group of copies is one row a task. The write is one Spark job with committed
    output, so a lost executor costs only its own tasks.
    """
    spark = docs.sparkSession
    every = F.array(*(F.lit(r.key) for r in rules))
    seen = read_ledger(spark, ledger).groupBy(F.col("blob").alias("__blob")).agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("__seen"))
    ids = docs.select(blob_id(F.col(text_col)).alias("__blob")).distinct()
    todo = ids.join(seen, "__blob", "left").select("__blob", F.array_except(every, F.coalesce("__seen", F.array().cast("array<string>"))).alias("__todo")).where(F.size("__todo") > 0)
    todo = stored(todo, "unseen")
    n = todo.limit(UNSEEN + 1).count()
    if not n:
        return
    rows = docs.select(blob_id(F.col(text_col)).alias("__blob"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if n <= UNSEEN:
        blobs = rows.join(F.broadcast(todo), "__blob").groupBy("__blob").agg(F.first("__text").alias("__text"), F.first("__todo").alias("__todo"))
    else:
        blobs = rows.groupBy("__blob").agg(F.first("__text").alias("__text")).join(todo, "__blob")
    _scan(blobs, rules).write.mode("append").partitionBy("part").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per blob with a secret: ``__blob`` and ``__spans`` (start, kind rank, end, kind) in order of start, then rule.

    A scan that is in the ledger twice (two jobs at once, a job run again after its write) counts once.
    """
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    current = lambda h: rank[F.concat_ws("@", h["kind"], h["version"].cast("string"))]
    hits = F.filter("hits", lambda h: current(h).isNotNull())
    rows = read_ledger(spark, ledger).where(F.size("hits") > 0).select("blob", hits.alias("hits")).where(F.size("hits") > 0)
    one = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), current(h).alias("rank"), h["end"].alias("end"), h["kind"].alias("kind")))
    return rows.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(one)))).alias("__spans"))


def scan(docs: DataFrame, paths: Sequence[str], ledger: str | None = None, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row's ``paths`` columns with ``blob`` and ``spans`` (array of start, rank, end, kind; null without any).

    ``ledger`` None keeps the increment in a new folder of the shared directory. A blob's spans are aggregated and
    stored before they meet the paths, so that the adaptive skew join can split the paths of one hot blob.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_dir(spark, "ledger")
    extend_ledger(docs, ledger, text_col, rules)
    rows = docs.select(*paths, blob_id(F.col(text_col)).alias("__blob"))
    return rows.join(stored(findings(spark, ledger, rules), "findings"), "__blob", "left").select(*paths, F.col("__blob").alias("blob"), F.col("__spans").alias("spans"))


def _masker(rule: Rule, mask: str):
    def piece(x: Column) -> Column:
        """A gap and the match after it, masked if it counts; the last gap has no match."""
        match = x["found"]
        value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        name = F.left(match, F.length(match) - F.length(value))
        return F.concat(x["gap"], F.coalesce(F.when(_passes(rule, match), F.concat(name, F.lit(mask))).otherwise(match), F.lit("")))

    return piece


def redacted(rows: DataFrame, chosen: Column, text_col: str = "text", rules: Sequence[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``rows`` where the ``chosen`` ones have each counted match replaced by ``mask``, rule after rule (an assignment keeps its name).

    One projection a rule: as a single expression every rule would repeat the text of all rules before it.
    """
    for rule in rules:
        text = F.col(text_col)
        parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), _matches(text, rule).alias("found"))
        done = F.array_join(F.transform(parts, _masker(rule, mask)), "")
        may = chosen & text.contains(rule.hint) if rule.hint else chosen
        rows = rows.withColumn(text_col, F.when(may & text.rlike(rule.pattern), done).otherwise(text))
    return rows


def spans_text(spans: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The columns of query ``op1_secret_scan``."""
    rows = scan(docs, ["doc_id"], ledger)

    def count(kind: str) -> Column:
        return F.when(F.col("spans").isNull(), 0).otherwise(F.size(F.filter("spans", lambda s: s["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with secrets come back redacted (``n_chars`` follows the text), all others as they were."""
    ledger = shared_dir(spark, "ledger")
    extend_ledger(docs, ledger)
    hit = small_side(stored(findings(spark, ledger).select("__blob", F.lit(True).alias("__hit")), "hits"), 200_000)  # 64 bytes each
    rows = docs.withColumn("__blob", blob_id(F.col("text"))).join(hit, "__blob", "left")
    rows = redacted(rows, F.coalesce("__hit", F.lit(False)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``digest``: the pieces between matches give the offsets."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {r.group})" if r.group else "m"
        parts.append(f"""
    SELECT rid, {i} AS rank, '{r.kind}' AS kind, s AS start, s + length(m) AS stop FROM (
      SELECT rid, m, (sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY pos) - length(m))::BIGINT AS s FROM (
        SELECT rid, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS pos FROM (
          SELECT rid, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}'))))
    WHERE length({value}) >= {r.least}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    one = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
by_doc AS (
  SELECT rid, {counts},
    coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '') AS base,
    string_agg({one}, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (rid)"""
