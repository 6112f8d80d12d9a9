"""Column functions of the legislative domain; all native expressions, null in gives null out unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and what is left of them without.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝºª"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYoa"


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def dotted(digits: Column) -> Column:
    """Groups of three from the right, joined by dots; leading zeros stay."""
    return F.reverse(F.regexp_replace(F.reverse(digits), r"(\d{3})(?=\d)", "$1."))


def official_number(title: Column, digits: Column) -> Column:
    """The number printed in a title after ``nº``, else the grouped digits, else ``s/n``."""
    printed = F.regexp_extract(title, r"(?iu)\bn[º°o.]\s*([0-9]{1,3}(?:\.[0-9]{3})*(?:-[0-9]+)?)", 1)
    return F.coalesce(F.nullif(printed, F.lit("")), F.nullif(dotted(digits_only(digits)), F.lit("")), F.lit("s/n"))


def full_year(text: Column, pivot: int = 50) -> Column:
    """Two-digit years below the pivot are of this century."""
    year = text.cast("int")
    return F.when(F.length(text) == 2, year + F.when(year < pivot, 2000).otherwise(1900)).otherwise(year)


def any_date(x: Column, formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    return F.coalesce(*(F.try_to_date(x, f) for f in formats))


@lru_cache(maxsize=1)
def _case_folds() -> dict[str, str]:
    """Characters whose case folding holds ASCII letters that lower case does not give."""
    plain = lambda x: re.sub("[^a-z0-9]", "", x)
    lower = (chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and chr(i).lower() == chr(i))
    return {c: plain(c.casefold()) for c in lower if plain(c.casefold())}


def flat_folded(x: Column) -> Column:
    """The ASCII letters and digits of the case-folded text; marked letters go."""
    out = F.lower(x)
    for c, v in _case_folds().items():
        out = F.replace(out, F.lit(c), F.lit(v))
    return F.regexp_replace(F.when(x.rlike(r"[^\x00-\x7f]"), out).otherwise(F.lower(x)), "[^a-z0-9]", "")


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other integers as they are."""
    places = (
        (1000, ["M", "MM", "MMM"]),
        (100, ["C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
        (10, ["X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
        (1, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
    )
    whole = F.concat(*(F.coalesce(F.get(F.array(F.lit(""), *map(F.lit, names)), F.floor(n / size).cast("int") % 10), F.lit("")) for size, names in places))
    return F.when((n >= 1) & (n <= 3999), whole).otherwise(n.cast("string"))


def without_marks(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def flat(x: Column, strip_marks: bool = True) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(without_marks(x) if strip_marks else x), "[^a-z0-9]", "")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_tags(x: Column) -> Column:
    return collapse(F.regexp_replace(x, "<[^>]*>", " "))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def allowed_host(host: Column, domains: Sequence[str]) -> Column:
    """The host is one of ``domains`` or below one."""
    alternatives = "|".join(d.replace(".", r"\.") for d in domains)
    return F.coalesce(F.lower(host).rlike(rf"(^|\.)({alternatives})$"), F.lit(False))


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def distinct_concat(*arrays: Column) -> Column:
    """Elements of all arrays, first occurrences in order."""
    return F.array_distinct(F.concat(*arrays))


def first_json(doc: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(doc, p) for p in paths))


def band(x: Column, bounds: Sequence[tuple[float, str]], above: str) -> Column:
    """Name of the first bound that ``x`` is below."""
    out = F.lit(above)
    for bound, name in reversed(bounds):
        out = F.when(x < bound, name).otherwise(out)
    return F.when(x.isNull(), "unknown").otherwise(out)


def utc_timestamp(x: Column) -> Column:
    """Null on bad input; without a zone it counts as UTC (the session's zone)."""
    return F.try_to_timestamp(x)


def effects_spacing(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<=\S)(?=Produção de efeitos)", " ")


def comparable_number(x: Column) -> Column:
    """Digits without leading zeros, ``0`` when nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(digits_only(x), "^0+", ""), F.lit("")), F.lit("0"))


def canonical_article(x: Column) -> Column:
    bare = F.regexp_replace(x, r"(?iu)(?<=\d)\s*(?:º|°|o)(?=\s*(?:-|$))", "")
    return F.lower(F.regexp_replace(bare, r"[.\s]", ""))


def article_label(x: Column) -> Column:
    n = canonical_article(x)
    base = F.concat(F.lit("Art. "), F.substring_index(n, "-", 1), F.lit("º"))
    return F.when(F.contains(n, F.lit("-")), F.concat(base, F.lit("-"), F.upper(F.regexp_extract(n, "-(.*)$", 1)))).otherwise(base)


# Fixed value: how a drafting note names the amending law.
_NOTE_LAW = r"(?iu)Lei\s+n[º°o]?\s*([\d.]+)\s*,?\s*de\s*(\d{4})"


def note_law_number(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, _NOTE_LAW, 1), F.lit(""))


def note_law_year(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, _NOTE_LAW, 2), F.lit("")).cast("int")


def device_node(path: Column) -> Column:
    """``art7_par2_inc8`` as ``art:7.par:2.inciso:VIII``; null when a part is unknown."""
    parts = F.split(F.lower(path), "_")
    head = F.regexp_extract(F.get(parts, F.lit(0)), r"^art(\d{1,3}(?:\.\d{3})+|\d+)([a-z]?)$", 1)
    letter = F.regexp_extract(F.get(parts, F.lit(0)), r"^art(\d{1,3}(?:\.\d{3})+|\d+)([a-z]?)$", 2)

    def step(p: Column) -> Column:
        number = F.regexp_extract(p, r"(\d+)", 1).cast("int")
        return (
            F.when(p.isin("cpt", ""), F.lit(""))
            .when(p.rlike(r"^par\d+u$"), F.lit(".par:unico"))
            .when(p.rlike(r"^par\d+$"), F.concat(F.lit(".par:"), number.cast("string")))
            .when(p.rlike(r"^inc\d+$"), F.concat(F.lit(".inciso:"), roman(number)))
            .when(p.rlike(r"^ali\d+$"), F.concat(F.lit(".alinea:"), F.char(number + 96)))
            .when(p.rlike(r"^al[a-z]$"), F.concat(F.lit(".alinea:"), F.substring(p, 3, 1)))
        )

    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), step)
    known = (head != "") & F.forall(rest, lambda s: s.isNotNull())
    return F.when(known, F.concat(F.lit("art:"), F.regexp_replace(head, r"\.", ""), letter, F.array_join(rest, "")))


NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based identifier, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.get(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4)
    parts = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.when(name.isNotNull(), parts)


def retry_delay(attempts: Column, base: int = 15, most: int = 3600, give_up: int = 5) -> Column:
    """Seconds before the next attempt; null once given up."""
    return F.when(attempts < give_up, F.least(F.lit(most), (base * F.pow(F.lit(2), attempts - 1)).cast("int")))


def urn_of(url: Column) -> Column:
    """The base of the ``urn`` query parameter, without version or part."""
    return F.get(F.split(F.try_parse_url(url, F.lit("QUERY"), F.lit("urn")), "[@!]"), F.lit(0))


def urn_number(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r";([0-9.]+)(?:-[0-9]+)?$", 1), F.lit(""))


def urn_year(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r":([0-9]{4})(?:-[0-9]{2}-[0-9]{2})?;", 1), F.lit("")).cast("int")


# ------------------------------------------------------------------ search


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding and NFKD without combining marks make of single lower-case characters, where that changes a normalised text.

    The first table maps to one character or none, the second to several. Other word characters count as ``_``, the rest as a space.
    """
    seen = lambda c: c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "_" if c.isalnum() or c == "_" else " "
    one, many = {}, {}
    for i in range(0x80, 0x110000):
        c = chr(i)
        if c.lower() != c or 0xD800 <= i < 0xE000:
            continue
        got = "".join(map(seen, (m for m in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(m))))
        got = re.sub(r"([_ ])\1+", r"\1", got)
        if got != seen(c):
            (one if len(got) < 2 else many)[c] = got
    return one, many


def _fold(x: Column) -> Column:
    """Lower-case text without marks, as case folding and NFKD leave it; other letters and digits are ``_``."""
    one, many = _folds()
    text = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    rest = {k: v for k, v in many.items() if k != "ß"}  # rare ones: only texts that hold any are taken apart
    # one text, not a literal for each entry: every plan that folds would carry thousands of expressions
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in rest.items())), F.lit(","), F.lit(":"))
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    spans: list[list[str]] = []
    for c in rest:
        if spans and ord(spans[-1][1]) + 1 == ord(c):
            spans[-1][1] = c
        else:
            spans.append([c, c])
    text = F.when(text.rlike(f"[{''.join(f'{a}-{b}' for a, b in spans)}]"), apart).otherwise(text)
    keys = sorted(one, key=lambda c: not one[c])  # those that go stand last
    return F.regexp_replace(F.translate(text, "".join(keys), "".join(one[c] for c in keys)), r"[\p{L}\p{N}&&[^a-z0-9]]", "_")


def normalize_query(x: Column) -> Column:
    """Case and marks folded, the words numero / no / n dropped, other characters to single spaces."""
    folded = F.when(x.rlike(r"[^\x00-\x7f]"), _fold(x)).otherwise(F.lower(x))
    dropped = F.regexp_replace(folded, r"(?<![a-z0-9_])(?:numero|no|n)(?![a-z0-9_])", " ")
    return collapse(F.regexp_replace(dropped, "[^a-z0-9]+", " "))


# Phrases of a query and the type of law they name; the first that occurs wins.
TYPE_PHRASES = (
    ("lei complementar", "Lei Complementar"),
    ("emenda constitucional", "Emenda Constitucional"),
    ("medida provisoria", "Medida Provisória"),
    ("decreto legislativo", "Decreto Legislativo"),
    ("resolucao do senado federal", "Resolução do Senado Federal"),
    ("resolucao senado", "Resolução do Senado Federal"),
    ("decreto lei", "Decreto-Lei"),
    ("constituicao", "Constituição"),
)
TYPE_WORDS = (
    ("lc", "Lei Complementar"),
    ("lcp", "Lei Complementar"),
    ("mpv", "Medida Provisória"),
    ("emc", "Emenda Constitucional"),
    ("ec", "Emenda Constitucional"),
    ("dlg", "Decreto Legislativo"),
    ("rsf", "Resolução do Senado Federal"),
    ("lei", "Lei"),
)


def query_type(x: Column) -> Column:
    def named(normal: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, name in reversed(TYPE_WORDS):
            out = F.when(normal.rlike(rf"\b{word}\b"), name).otherwise(out)
        for phrase, name in reversed(TYPE_PHRASES):
            out = F.when(F.contains(normal, F.lit(phrase)), name).otherwise(out)
        return out

    # one element, so that the text is normalised once
    return F.get(F.transform(F.array(normalize_query(x)), named), F.lit(0))


# How articles and numbers are written in a query.
_ARTICLE = r"(?iu)\b(?:art(?:igo)?\.?\s*)(\d+[a-z]?)\b"
_NUMBER_YEAR = r"(?iu)(?<!\d)(\d{1,3}(?:[.\s]\d{3})*|\d{4,8})(?:-(\d+))?\s*(?:/|\s+de\s+|\s+)(\d{2,4})(?!\d)"
_NUMBER = r"(?iu)(?<!\d)(\d{1,3}(?:[.\s]\d{3})+|\d{4,8})(?:-(\d+))?(?!\d)"
_NO_TERM = r"(?iu)\b(lei|decreto|decreto lei|artigo|art|n|no|numero|de)\b"


def parse_query(x: Column) -> Column:
    """Struct of article, number, sequence, year, law type and the free terms of a search text."""
    blank = F.lit("")
    got = lambda pattern, group: F.nullif(F.regexp_extract(x, pattern, group), blank)
    reference = got(_NUMBER_YEAR, 0)
    number = digits_only(F.coalesce(got(_NUMBER_YEAR, 1), F.when(reference.isNull(), got(_NUMBER, 1))))
    sequence = F.when(reference.isNotNull(), got(_NUMBER_YEAR, 2)).otherwise(got(_NUMBER, 2))
    rest = F.regexp_replace(x, _ARTICLE, " ")
    # a bare number is taken out as digits, so a dotted one stays among the terms
    rest = F.when(reference.isNotNull(), F.replace(rest, reference, F.lit(" "))).when(number.isNotNull(), F.regexp_replace(rest, F.concat(F.lit(r"(?<!\d)"), number, F.lit(r"(?!\d)")), F.lit(" "))).otherwise(rest)
    rest = F.regexp_replace(rest, _NO_TERM, " ")
    return F.struct(
        F.lower(got(_ARTICLE, 1)).alias("article"), number.alias("number"), sequence.alias("number_sequence"),
        full_year(got(_NUMBER_YEAR, 3)).alias("year"), query_type(x).alias("law_type"), normalize_query(rest).alias("terms"),
    )


def adjacent_transpositions(word: Column) -> Column:
    """All variants of a word of 4 to 20 letters with two different neighbours exchanged."""
    spots = F.sequence(F.lit(1), F.length(word) - 1)
    swap = lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2))
    differ = lambda i: F.substr(word, i, F.lit(1)) != F.substr(word, i + 1, F.lit(1))
    fits = word.rlike(r"^\p{L}{4,20}$")
    return F.when(fits, F.array_distinct(F.transform(F.filter(spots, differ), swap))).otherwise(F.array().cast("array<string>"))
