from pyspark.sql import functions as F

from normspark import sql
from normspark.functions import scalars


def test_functions_in_sql(spark):
    names = sql.register(spark)
    row = spark.sql("""SELECT digits_only('a1.2'), dotted_number('13709'), comparable_number('000'), full_year('18'), full_year('1988'), any_date('14/08/2018'), flat_text('Ação nº 1'),
        normalize_query('Lei nº 13.709 / 2018'), roman_numeral(1994), retry_delay(3), retry_delay(9)""").first()
    assert [str(x) for x in row] == ["12", "13.709", "0", "2018", "1988", "2018-08-14", "acaono1", "lei 13 709 2018", "MCMXCIV", "60", "None"]
    got = spark.sql("SELECT p.pos, p.text FROM VALUES ('<p>a</p><li>b  c</li>') AS t(html), LATERAL html_paragraphs(html) p ORDER BY pos").collect()
    assert [tuple(r) for r in got] == [(0, "a"), (1, "b c")] and len(names) == len(sql.FUNCTIONS) + 2


QUERIES = ["Lei nº 13.709/2018", "art. 5o da lei 8.078 de 1990", "decreto-lei 200", "LC 101/00", "emenda constitucional 45-2 de 2004", "Medida Provisória 1.234", "Straße ﬁm ½ Ação ǅ ①", "consumo", "", None, "12.345.678", "n. numero no x"]


def test_query_functions_equal_the_column_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(q,) for q in QUERIES], "q string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT q, normalize_query(q) AS n, query_type(q) AS t, parse_query(q) AS p, adjacent_transpositions(q) AS s FROM asked").collect()
    want = spark.table("asked").select("q", scalars.normalize_query(F.col("q")).alias("n"), scalars.query_type(F.col("q")).alias("t"), scalars.parse_query(F.col("q")).alias("p"), scalars.adjacent_transpositions(F.col("q")).alias("s")).collect()
    assert got == want
    assert got[0].p.asDict() == {"article": None, "number": "13709", "number_sequence": None, "year": 2018, "law_type": "Lei", "terms": ""}


def test_view_of_provisions(spark):
    spark.createDataFrame([("a", ["Art. 1º Fica criado o registro.", "I - de pessoas;", "Parágrafo único. O prazo é de um ano."])], "law string, lines array<string>").createOrReplaceTempView("given")
    sql.nodes_view(spark, "given", "law")
    got = spark.sql("SELECT node_type, count(*) AS n FROM legal_nodes WHERE law = 'a' GROUP BY 1").collect()
    assert sum(r.n for r in got) == 3 and "article" in {r.node_type for r in got}
