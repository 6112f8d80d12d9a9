"""Quality rules as a learned decision list.

A bounded, hashed sample of labelled rows (``max_labelled``) trains the list by sequential covering: a rule
grows by the threshold with the largest FOIL gain, up to ``max_conditions``, is pruned back on held-back
rows, and is kept while its held-back precision reaches ``precision``. At most ``max_rules`` rules are learned:
both limits belong to the model, like the depth of a tree. The list is emitted as one ordered Spark ``CASE``
expression over the statistics of every text: the first rule that fits drops the document, otherwise it is kept.
Ids are sampled before texts are read, so statistics are made for the sample and then once for every text.

Defined results: a null text has no words (all counts 0, base_failed, not kept); ties between thresholds
go to the first statistic and the smaller threshold; conflicting labels of one doc_id count as the lower
quality; without labelled rows the list is empty and the base rule alone decides; repeated rows repeat; an
empty table stays empty; very long texts are counted whole, at some 500 bytes of working memory a word;
columns of any name may come along, also those of the statistics.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, stored, table

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_distinct", "n_ends")
#: Statistics that rules may test: name and its expression over the counts.
RATIOS = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "end_ratio": "n_ends / greatest(n_words, 1)",
}
_BLANK = b" \t\n\x0b\x0c\r"


def _sum(hist: np.ndarray, chars: bytes) -> int:
    return int(hist[list(chars)].sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one whole text. Words are runs without ASCII blanks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, sum(raw.count(bytes([c])) for c in b"#*$%&|<>"), *[0] * (len(COUNTS) - 3))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[0x80:0xC0].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    repeats = 0
    if len(words) >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            covered = -1
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    return (
        len(words), points - _sum(hist, _BLANK), _sum(hist, b"#*$%&|<>"), len(lines) - len(set(lines)), repeats,
        len(lines), _sum(hist, b"0123456789"), int(hist[65:91].sum()), len(set(words)), _sum(hist, b".!?"),
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep`` (struct of the ``keep`` columns) and the counts of every whole text."""

    def run(texts: list[str | None]) -> np.ndarray:
        return np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(COUNTS)).T

    return per_text(docs, keep, ", ".join(f"{c} long" for c in COUNTS), run)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value >= F.lit(float(self.threshold)) if self.above else value <= F.lit(float(self.threshold))


Rule = tuple[Condition, ...]


def _fits(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(n, bool)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, choice = 1e-9, None
        for name in RATIOS:
            values = x[name][inside]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            cut = np.flatnonzero(np.diff(v)) + 1
            below = np.cumsum(b)[cut - 1] if len(cut) else np.zeros(0)
            for above, p, n in ((False, below, cut - below), (True, p0 - below, len(v) - cut - (p0 - below))):
                if not len(cut):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, choice = gain[i], Condition(name, above, float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if choice is None:
            break
        rule += (choice,)
        inside &= choice.holds(x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, max_conditions: int = 3, max_rules: int = 12, least: int = 3) -> list[Rule]:
    """Ordered rules that each pick out rows marked ``bad``. Every third row is held back for pruning."""
    back = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & left & ~back).sum() >= least:
        part = lambda m: {k: v[m] for k, v in x.items()}
        grown = _grow(part(left & ~back), bad[left & ~back], max_conditions)
        xs, ys = part(left & back), bad[left & back]
        worth = []
        for k in range(1, len(grown) + 1):
            fit = _fits(grown[:k], xs, len(ys))
            p, n = int((ys & fit).sum()), int((~ys & fit).sum())
            worth.append((p + 1) / (p + n + 2) if p >= least - 2 else 0.0)
        if not grown or max(worth) <= 0:
            break
        rule = grown[: int(np.argmax(worth)) + 1]
        fit = _fits(rule, xs, len(ys))
        if ys[fit].mean() < precision or (bad & _fits(rule, x, len(bad)) & left).sum() < least:
            break
        rules.append(rule)
        left &= ~_fits(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that fits, null for none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        fit = F.lit(True)
        for c in rules[i]:
            fit = fit & c.column()
        out = F.when(fit, F.lit(i + 1)).otherwise(out)
    return out


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[Rule]:
    """Rules from the statistics of at most ``max_labelled`` labelled documents, taken in the order of a hash of doc_id."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    some = stored(some.orderBy(order, "doc_id").limit(max_labelled), "labelled")  # its rows bound the broadcast: 16 bytes each
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    rows = with_statistics(texts, ["doc_id"]).where(~base_failed()).select(F.col("__keep.doc_id").alias("doc_id"), *(F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()))
    rows = rows.join(F.broadcast(some), "doc_id").withColumn("h", order)
    got = rows.orderBy("h", *(c for c in rows.columns if c != "h")).limit(max_labelled).toPandas()
    x = {k: got[k].to_numpy(float) for k in RATIOS}
    return learn_list(x, got["__q"].to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep``, the counts, ``base_failed``, ``rule`` (first fitting rule) and ``kept``, in one pass over the texts."""
    rules = learn(docs, labels)
    out = with_statistics(docs, keep).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of query ``op2_quality_rules``."""
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return rows.select("__keep.doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base rule or fit a rule of the list go. No join brings texts to a shuffle."""
    return judged(docs, table(spark, sf_dir, "labels"), docs.columns).where("kept").select("__keep.*")
