"""URL filters by the ratio of two character language models.

Rules decide first: of those that fit a URL's host (the rule's host or a subdomain of it) and path (by
prefix) the longest wins. URLs with an allow or block rule are the accepted and rejected examples of two
Markov models of variable order: counts of all n-grams up to ``ORDER`` + 1 bytes over all examples, every one
of them, as a stored table. A window of ``ORDER`` + 1 bytes fits a long, and its low bytes are its shorter
grams, so scoring is joins of windows: each order's probabilities come from the order below. They are joined
by merge: a small file holds millions of grams or URLs, which Spark would take for few and send to the driver. A model
backs off by Witten-Bell smoothing, the longest context first, down to uniform bytes. A URL's score is the
difference of the two log-likelihoods per byte; the cut is calibrated on a hashed fifth of the examples that
no count has seen, from histograms of scores by class.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is scored as
it stands; null and empty URLs score 0; scores at the cut are allowed; without examples of both classes
everything that no rule decides is allowed; repeated rows repeat; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

ORDER = 5


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Name and verdict of the longest rule that fits, as a struct; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each position's byte and the ``ORDER`` before it, the byte itself lowest, zeros before the start; each position's URL."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r)) or b"\0", np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raw], np.int64)
    of = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(sizes.sum()) + ORDER * (of + 1)
    window = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        window |= data[at - k] << (8 * k)
    return window, of


def windows(urls: DataFrame) -> DataFrame:
    """``id, window, n, yes, no``: how often a window is in a URL (``id``, ``url``), and in accepted and rejected examples.

    ``accepted`` is null for URLs that are no examples; ``copies`` rows have the URL.
    """

    def run(batches):
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            texts, accepted = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            good, bad = np.array([a is True for a in accepted]), np.array([a is False for a in accepted])
            for s in slices([len(u) for u in texts], 400_000):
                window, of = _windows(texts[s])
                order = np.lexsort((window, of))
                window, of = window[order], of[order]
                first = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (of[1:] != of[:-1])][: len(of)])
                n, of = np.diff(np.r_[first, len(window)]), of[first]
                times = n * copies[s][of]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids[s][of], window[first], n, times * good[s][of], times * bad[s][of])], names=["id", "window", "n", "yes", "no"])

    return urls.select("id", "url", "copies", "accepted").mapInArrow(run, "id long, window long, n long, yes long, no long")


def gains(found: DataFrame) -> DataFrame:
    """``window, gain``: log-probability of each window's last byte in the accepted model less that in the rejected one."""
    each = found.groupBy("window").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    low = lambda k: F.col("window").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
    grams = each.select("yes", "no", F.posexplode(F.array(*(low(k) for k in range(ORDER + 1)))).alias("k", "gram")).groupBy("k", "gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    context = Window.partitionBy("k", F.shiftright("gram", 8))  # at most 256 rows
    stats = grams.select("k", "gram", *(c for side in ("yes", "no") for c in (F.col(side), F.sum(side).over(context).alias(f"{side}_total"), F.count_if(F.col(side) > 0).over(context).alias(f"{side}_kinds"))))
    stats = stored(stats, "url-grams")
    out = None
    for k in range(ORDER + 1):
        level = stats.where(F.col("k") == k)
        if out is None:
            level = level.select("*", *(F.lit(1 / 256).alias(f"{side}_p") for side in ("yes", "no")))
        else:  # at most 256 grams share a shorter one
            level = level.withColumn("below", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(out.hint("merge"), "below")
        mixed = lambda side: F.when(F.col(f"{side}_total") > 0, (F.col(side) + F.col(f"{side}_kinds") * F.col(f"{side}_p")) / (F.col(f"{side}_total") + F.col(f"{side}_kinds"))).otherwise(F.col(f"{side}_p"))
        out = level.select(F.col("gram").alias("below"), mixed("yes").alias("yes_p"), mixed("no").alias("no_p"))
    return out.select(F.col("below").alias("window"), (F.log("yes_p") - F.log("no_p")).alias("gain"))


def scores(urls: DataFrame) -> DataFrame:
    """``url`` and ``score`` of the distinct ``urls``: accepted less rejected log-likelihood per byte."""
    found = windows(urls)
    sums = found.select("id", "window", "n").join(gains(found).hint("merge"), "window").groupBy("id").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    return urls.join(sums.hint("merge"), "id").select("url", (F.col("gain") / F.octet_length("url")).alias("score"))


def calibrate(scores: DataFrame, bins: int = 200) -> float:
    """The cut that maximises balanced accuracy over ``score, accepted``; scores fall into bins of 1 / ``bins``."""
    cells = scores.groupBy(F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(-50 * bins)), F.lit(50 * bins)).alias("b"), "accepted").agg(F.count("*").alias("n")).collect()
    yes = sum(r["n"] for r in cells if r["accepted"])
    no = sum(r["n"] for r in cells if not r["accepted"])
    if not yes or not no:
        return float("-inf")
    best, cut, passed_yes, passed_no, before = -1.0, 0.0, yes, 0, None
    for b in sorted({r["b"] for r in cells}):
        worth = passed_yes / yes + passed_no / no  # cut below bin b, in the middle of the empty bins there
        if worth > best:
            best, cut = worth, (b if before is None else (before + 1 + b) / 2) / bins
        before = b
        passed_yes -= sum(r["n"] for r in cells if r["b"] == b and r["accepted"])
        passed_no += sum(r["n"] for r in cells if r["b"] == b and not r["accepted"])
    return cut


def judged(pages: DataFrame, keep: list[str], rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""
    url = F.col("url")
    rows = pages.select(F.struct(*keep).alias("__k"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    urls = rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("copies"), F.any_value("r.verdict").alias("verdict"))
    urls = urls.select(F.monotonically_increasing_id().alias("id"), "url", "copies", F.when(~held, F.col("verdict") == "allow").alias("accepted"))
    got = scores(stored(urls, "urls"))
    out = stored(rows.join(got.hint("merge"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "url-scores")
    cut = calibrate(out.where(F.col("r").isNotNull() & held).select("score", (F.col("r.verdict") == "allow").alias("accepted")))
    by_score = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return out.select("__k.*", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_score).alias("verdict"), "score")


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query ``op7_url_filter``."""
    return judged(pages, ["page_id"])
