"""SQL-callable forms of the scalar functions, query parsing and the document parser, for ad-hoc queries:
temporary SQL functions, two table functions and a view of provisions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from normspark.functions import scalars
from normspark.functions.scalars import ACCENTED, PLAIN
from normspark.operators.documents import legal_nodes, paragraphs_of
from normspark.operators.node_table import LegalNodes

_FOLD = f"translate(lower(x), '{ACCENTED}', '{PLAIN}')"
_DIGITS = "regexp_replace(x, '[^0-9]', '')"


def _roman() -> str:
    places = ((1000, ("M", "MM", "MMM")), (100, ("C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    parts = [f"coalesce(get(array('', {', '.join(repr(n) for n in names)}), (n div {size}) % 10), '')" for size, names in places]
    return f"CASE WHEN n BETWEEN 1 AND 3999 THEN concat({', '.join(parts)}) ELSE cast(n AS STRING) END"


def _fold_rare() -> str:
    """Letters that fold to several characters, or to one or none; the same tables as the column function's."""
    one, many = scalars._folds()
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in many.items())
    apart = f"array_join(transform(split(t, ''), c -> coalesce(try_element_at(map({pairs}), c), c)), '')"
    keys = sorted(one, key=lambda c: not one[c])
    folded = f"translate({apart}, '{''.join(keys)}', '{''.join(one[c] for c in keys)}')"
    return rf"CASE WHEN t RLIKE R'[^\x00-\x7f]' THEN regexp_replace({folded}, R'[\p{{L}}\p{{N}}&&[^a-z0-9]]', '_') ELSE t END"


def _type_of() -> str:
    phrases = " ".join(f"WHEN contains(n, '{phrase}') THEN '{name}'" for phrase, name in scalars.TYPE_PHRASES)
    words = " ".join(rf"WHEN n RLIKE R'\b{word}\b' THEN '{name}'" for word, name in scalars.TYPE_WORDS)
    return f"CASE {phrases} {words} END"


def _parse() -> str:
    def got(pattern: str, group: int) -> str:
        return f"nullif(regexp_extract(x, R'{pattern}', {group}), '')"

    dated, bare = scalars._NUMBER_YEAR, scalars._NUMBER
    reference = got(dated, 0)
    number = f"digits_only(coalesce({got(dated, 1)}, CASE WHEN {reference} IS NULL THEN {got(bare, 1)} END))"
    sequence = f"CASE WHEN {reference} IS NOT NULL THEN {got(dated, 2)} ELSE {got(bare, 2)} END"
    rest = f"regexp_replace(x, R'{scalars._ARTICLE}', ' ')"
    whole = rf"concat(R'(?<!\d)', {number}, R'(?!\d)')"
    rest = f"CASE WHEN {reference} IS NOT NULL THEN replace({rest}, {reference}, ' ') WHEN {number} IS NOT NULL THEN regexp_replace({rest}, {whole}, ' ') ELSE {rest} END"
    return f"""named_struct('article', lower({got(scalars._ARTICLE, 1)}), 'number', {number}, 'number_sequence', {sequence}, 'year', full_year({got(dated, 3)}),
        'law_type', query_type(x), 'terms', normalize_query(regexp_replace({rest}, R'{scalars._NO_TERM}', ' ')))"""


_SWAPS = """CASE WHEN x RLIKE R'^\\p{L}{4,20}$' THEN array_distinct(transform(filter(sequence(1, length(x) - 1), i -> substr(x, i, 1) <> substr(x, i + 1, 1)),
    i -> concat(left(x, i - 1), substr(x, i + 1, 1), substr(x, i, 1), substr(x, i + 2)))) ELSE cast(array() AS ARRAY<STRING>) END"""

#: name, parameters, result type, body; a function may call those above it
FUNCTIONS = (
    ("digits_only", "x STRING", "STRING", _DIGITS),
    ("dotted_number", "x STRING", "STRING", r"reverse(regexp_replace(reverse(x), '(\\d{3})(?=\\d)', '$1.'))"),
    ("comparable_number", "x STRING", "STRING", f"coalesce(nullif(regexp_replace({_DIGITS}, '^0+', ''), ''), '0')"),
    ("full_year", "x STRING", "INT", "CASE WHEN length(x) = 2 THEN cast(x AS INT) + CASE WHEN cast(x AS INT) < 50 THEN 2000 ELSE 1900 END ELSE cast(x AS INT) END"),
    ("any_date", "x STRING", "DATE", "coalesce(cast(try_to_timestamp(x, 'dd/MM/yyyy') AS DATE), cast(try_to_timestamp(x, 'yyyy-MM-dd') AS DATE), cast(try_to_timestamp(x) AS DATE))"),
    ("flat_text", "x STRING", "STRING", f"regexp_replace({_FOLD}, '[^a-z0-9]', '')"),
    ("fold_text", "t STRING", "STRING", _fold_rare()),
    ("normalize_query", "x STRING", "STRING", r"trim(regexp_replace(regexp_replace(fold_text(lower(x)), R'(?<![a-z0-9_])(?:numero|no|n)(?![a-z0-9_])', ' '), '[^a-z0-9]+', ' '))"),
    ("type_of_normalized", "n STRING", "STRING", _type_of()),
    ("query_type", "x STRING", "STRING", "type_of_normalized(normalize_query(x))"),
    ("parse_query", "x STRING", "STRUCT<article: STRING, number: STRING, number_sequence: STRING, year: INT, law_type: STRING, terms: STRING>", _parse()),
    ("adjacent_transpositions", "x STRING", "ARRAY<STRING>", _SWAPS),
    ("roman_numeral", "n INT", "STRING", _roman()),
    ("retry_delay", "attempts INT", "INT", "CASE WHEN attempts < 5 THEN least(3600, cast(15 * power(2, attempts - 1) AS INT)) END"),
)


@udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())]))
class HtmlParagraphs:
    """Lines of one page in order."""

    def eval(self, html):
        for i, line in enumerate(paragraphs_of(html or "")[0]):
            yield i, line


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable in this session's SQL; returns their names."""
    for name, params, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("html_paragraphs", HtmlParagraphs)
    spark.udtf.register("legal_nodes", LegalNodes)
    return [f[0] for f in FUNCTIONS] + ["html_paragraphs", "legal_nodes"]


def nodes_view(spark: SparkSession, documents: str, doc: str, name: str = "legal_nodes", lines: str = "lines") -> None:
    """Make the provisions of the view ``documents`` (columns ``doc`` and ``lines``, an array of paragraphs) a temporary view.

    This is the parser as joins and windows over whole tables; ``legal_nodes(TABLE(...) PARTITION BY ...)`` gives the same rows.
    """
    legal_nodes(spark.table(documents), doc, lines).createOrReplaceTempView(name)
