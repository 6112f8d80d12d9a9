import uuid

from pyspark.sql import functions as F

from normspark.functions import scalars as S


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_numbers_and_dates(spark):
    L = F.lit
    assert one(spark, S.dotted(L("13709")), S.dotted(L("7")), S.dotted(L("0001234567")), S.digits_only(L("a1.2-b"))) == ("13.709", "7", "0.001.234.567", "12")
    assert one(spark, S.official_number(L("Lei nº 13.709 de 14/08/2018"), L("13709")), S.official_number(L("Ato"), L("1234")), S.official_number(L("Ato"), L(""))) == ("13.709", "1.234", "s/n")
    assert one(spark, S.full_year(L("18")), S.full_year(L("50")), S.full_year(L("1988"))) == (2018, 1950, 1988)
    assert [str(x) for x in one(spark, S.any_date(L("14/08/2018")), S.any_date(L("2018-08-14")), S.any_date(L("2018-08-14T10:11:12")), S.any_date(L("x")))] == ["2018-08-14"] * 3 + ["None"]
    assert one(spark, *(S.roman(L(n)) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 3999, 4000, 0))) == ("I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", "4000", "0")
    assert one(spark, S.comparable_number(L("00042")), S.comparable_number(L("000")), S.comparable_number(L("x"))) == ("42", "0", "0")
    assert one(spark, *(S.retry_delay(L(n)) for n in (1, 2, 4, 5))) == (15, 30, 120, None)


def test_identifiers(spark):
    L = F.lit
    assert one(spark, S.uuid5(L("law:42")), S.uuid5(L("ação"))) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "law:42")), str(uuid.uuid5(uuid.NAMESPACE_URL, "ação")))
    assert one(spark, S.canonical_article(L("1.000º-A")), S.article_label(L("1.000º-A")), S.canonical_article(L("2o")), S.article_label(L("7"))) == ("1000-a", "Art. 1000º-A", "2", "Art. 7º")
    assert one(spark, *(S.device_node(L(p)) for p in ("art7_par2_inc8", "art19_par4u", "art1.000a_cpt_ali2", "art5_alb", "art5_odd", "x"))) == ("art:7.par:2.inciso:VIII", "art:19.par:unico", "art:1000a.alinea:b", "art:5.alinea:b", None, None)
    note = L("(Incluído pela Lei nº 14.550, de 2023)")
    assert one(spark, S.note_law_number(note), S.note_law_year(note), S.note_law_number(L("(Vide)"))) == ("14.550", 2023, None)
    urn = S.urn_of(L("https://normas.example/?urn=urn:lex:br:federal:lei:2018-08-14;13709@2020!art1"))
    assert one(spark, urn, S.urn_number(urn), S.urn_year(urn)) == ("urn:lex:br:federal:lei:2018-08-14;13709", "13709", 2018)


def test_query_parsing(spark):
    L = F.lit
    assert one(spark, S.normalize_query(L("Lei nº 13.709 / 2018"))) == ("lei 13 709 2018",)
    p = one(spark, S.parse_query(L("Lei nº 13.709/18")))[0]
    assert (p.number, p.number_sequence, p.year, p.law_type, p.article) == ("13709", None, 2018, "Lei", None)
    p = one(spark, S.parse_query(L("MPV 2.206-1/2001")))[0]
    assert (p.number, p.number_sequence, p.year, p.law_type) == ("2206", "1", 2001, "Medida Provisória")
    # a dotted number without a year stays among the terms
    assert one(spark, S.parse_query(L("lei 13.709")))[0].terms == "13 709"
    assert one(spark, S.parse_query(L("art. 121 código penal")))[0].article == "121"
    variants = one(spark, S.adjacent_transpositions(L("lgdp")))[0]
    assert "lgpd" in variants and one(spark, S.adjacent_transpositions(L("abc")))[0] == [] and "aabb" not in one(spark, S.adjacent_transpositions(L("aabb")))[0]


def test_nulls(spark):
    N = F.lit(None).cast("string")
    assert one(spark, S.dotted(N), S.normalize_query(N), S.roman(F.lit(None).cast("int")), S.any_date(N), S.uuid5(N)) == (None,) * 5
