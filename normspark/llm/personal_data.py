"""Personal data by weak supervision.

Candidates come from strict patterns (the base kinds, always spans) and from looser ones: addresses with a written
"(at)", IPv6 addresses, telephone numbers without a country code, and card-like numbers whose check digit fails. Three
labelers vote on every candidate (for, against, abstain): its form (checksum, range, numbering plan), a gazetteer
(top-level domains, country codes, card issuers, reserved networks) and the words just before it. Votes are counted by
pattern over all documents; expectation-maximisation, with a weak prior that votes rather agree with the truth, turns
these bounded counts into labeler reliabilities and a posterior by pattern; a logistic span classifier is then trained on
candidate features with the posteriors as soft labels, and decides on the looser candidates. One that neither the
gazetteer nor the context supports is never taken.

Defined results: a null text counts as empty and has no spans; a loose candidate that overlaps a base span
of any kind is dropped; spans of one kind never overlap; without votes nothing is added to the base;
repeated rows repeat; an empty table stays empty; columns of any name may come along. Offsets are code points, the
end is exclusive. All scans are linear in the text, so very long texts and digit runs are fine.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, stored

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# digit runs are tried from their start only: from inside they cannot match where the start does not
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])"),
    "phone": re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
}

#: Gazetteers (fixed values).
TOP_LEVEL = frozenset("com org net edu gov io de fr es en uk eu it nl br pt info biz".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358")
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
CUES = {
    "email": ("mail", "contact", "write to", "@", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse", "from", "client"),
    "card": ("card", "visa", "pay", "karte", "carte", "tarjeta", "account"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "fon", "llame", "appel"),
}
COUNTER_CUES = ("version", "release", "order no", "invoice", "isbn", "section", "build", " v.")
_NEAR = 24


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Left to right from each ``@``; what an earlier address took is not used again."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    taken = sorted(s for spans in base.values() for s in spans)
    found: list[tuple[str, int, int]] = []
    if "at)" in text or "at]" in text or "at}" in text:
        found += [("email", *m.span()) for m in _LOOSE["email"].finditer(text)]
    if ":" in text:
        found += [("ip", *m.span()) for m in _LOOSE["ip"].finditer(text)]
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _LOOSE["phone"].finditer(text)]
        for m in _CARD.finditer(text):
            if 13 <= len(m[0].replace(" ", "").replace("-", "")) <= 19:
                found.append(("card", *m.span()))
    if not taken:
        return found
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate([e for _, e in taken])
    keep = []
    for kind, a, b in found:
        i = int(np.searchsorted(starts, b, "left")) - 1  # the last base span that starts before the end
        if i < 0 or ends[i] <= a:
            keep.append((kind, a, b))
    return keep


def _form(kind: str, span: str, strict: bool) -> int:
    """Whether the candidate's own digits can be right: a strict one has been checked already."""
    if strict or kind == "email":
        return 1
    if kind == "ip":
        try:
            ipaddress.IPv6Address(span)
        except ValueError:
            return -1
        return 1
    if kind == "phone":  # neither the area code nor the exchange begins with 0 or 1
        digits = re.sub(r"[^0-9]", "", span)
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    return -1


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int, int]:
    """Form, gazetteer and context, each 1, 0 or -1."""
    span, before = text[start:end], text[max(0, start - _NEAR) : start].lower()
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        known = 1 if re.split(r"[. )\]}]", span)[-1].lower() in TOP_LEVEL else -1
    elif kind == "ip":
        known = 0 if ":" in span else (-1 if span.split(".")[0].lstrip("0") in ("", "127") else 1)
    elif kind == "card":
        known = 1 if digits.startswith(CARD_ISSUERS) else -1
    else:
        known = 1 if digits.startswith(COUNTRY_CODES) and strict else 0
    near = any(c in before for c in CUES[kind]) - any(c in before for c in COUNTER_CUES)
    return _form(kind, span, strict), known, near


#: A candidate's code: kind, votes, and its length in eighths; small integers, so their counts are bounded.
def code(kind: str, v: tuple[int, int, int], size: int) -> int:
    return ((KINDS.index(kind) * 3 + v[0] + 1) * 3 + v[1] + 1) * 3 + v[2] + 1 + 1000 * min(size // 8, 9)


def decode(c: int) -> tuple[int, tuple[int, int, int], int]:
    c, size = c % 1000, c // 1000
    return c // 27, (c // 9 % 3 - 1, c // 3 % 3 - 1, c % 3 - 1), size


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep`` and ``found``: array of (kind number, start, end, strict, code)."""

    def run(texts: list[str | None]) -> list[list]:
        out = []
        for t in texts:
            text = t or ""
            base = base_spans(text)
            rows = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(*x, False) for x in _loose_spans(text, base)]
            out.append([{"kind": KINDS.index(k), "start": a, "end": b, "strict": s, "code": code(k, votes(text, k, a, b, s), b - a)} for k, a, b, s in rows])
        return [out]

    return per_text(docs, keep, "found array<struct<kind:int,start:long,end:long,strict:boolean,code:int>>", run)


#: Pseudo-counts of votes -1, 0, 1 by class: before any data, a vote rather agrees with the truth. Who abstains says nothing.
BELIEF = np.array([[3.0, 0.0, 0.5], [0.5, 0.0, 3.0]])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior by vote pattern, prior, and reliabilities (labeler, class, vote + 1)."""
    n, labelers = patterns.shape
    given = np.diag([1.0, 0.0, 1.0])[patterns + 1]  # pattern, labeler, vote
    post = np.clip(0.5 + 0.2 * patterns.sum(axis=1), 0.05, 0.95)
    prior, theta = 0.5, np.full((labelers, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float((weight[1].sum() + 2) / (weight.sum() + 4))
        theta = np.einsum("yn,njv->jyv", weight, given) + BELIEF
        theta /= theta.sum(axis=2, keepdims=True)
        fit = np.einsum("njv,jyv->yn", given, np.log(np.maximum(theta, 1e-300))) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(fit[0] - fit[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, prior, theta


def _features(codes: list[int]) -> np.ndarray:
    rows = []
    for c in codes:
        kind, v, size = decode(c)
        rows.append([1.0, *(float(kind == k) for k in range(len(KINDS))), *map(float, v), v[0] * v[1], v[1] * v[2], size / 8])
    return np.array(rows)


def train(codes: list[int], counts: list[int], rounds: int = 50, ridge: float = 1e-3) -> dict[int, float]:
    """Probability of personal data by candidate code, from votes alone: a logistic fit by Newton's steps."""
    if not codes:
        return {}
    n = np.array(counts, float)
    kinds = np.array([decode(c)[0] for c in codes])
    patterns = np.array([decode(c)[1] for c in codes])
    soft = np.zeros(len(codes))
    for k in set(kinds.tolist()):
        mine = kinds == k
        soft[mine] = expectation_maximisation(patterns[mine], n[mine])[0]
    x = _features(codes)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (soft - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def accepted(found: DataFrame, least: float = 0.9) -> list[int]:
    """Codes of loose candidates that the classifier takes. Counting is Spark's; the driver sees at most 1,080 codes."""
    cells = found.select(F.explode("found").alias("c")).groupBy("c.code").agg(F.count("*").alias("n")).orderBy("code").collect()
    score = train([r["code"] for r in cells], [r["n"] for r in cells])
    return sorted(c for c, p in score.items() if p >= least and max(decode(c)[1][1:]) > 0)


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep`` and ``spans``: strict ones and accepted loose ones by kind, then start."""
    found = stored(candidates(docs, keep), "candidates")
    codes = accepted(found)
    taken = F.array(*(F.lit(c) for c in codes)).cast("array<int>")
    spans = F.filter("found", lambda s: s["strict"] | F.array_contains(taken, s["code"]))
    return found.select("__keep", F.array_sort(spans).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op8_personal_data``."""
    rows = found_spans(docs, ["doc_id"])
    base = F.filter("spans", lambda s: s["strict"])

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return rows.select("__keep.doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
