"""Scalar functions over whole tables, and references to any number of segments."""

from pyspark.sql import functions as F

from normspark import plans

def grouped(n):
    return f"{n:,}".replace(",", ".")


def parts(spark, path):
    rows = [(n, i % 120 + 1) for i, n in enumerate([*range(1, 140), *range(990, 1130), 99999, 1234567, 12345678])]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return rows


def test_numbers(spark, tmp_path):
    rows = parts(spark, tmp_path)
    got = {r.p_partkey: r.number for r in plans.queries()["j3_official_number_all"](spark, str(tmp_path)).collect()}
    assert got == {n: "s/n" if size % 3 == 2 else grouped(n) for n, size in rows}
    got = {r.p_partkey: (r.number, r.sequence, r.year) for r in plans.queries()["e2_parse_query_all"](spark, str(tmp_path)).collect()}
    for n, size in rows:
        # one digit after the slash is no year, and without a year a number of up to three digits is none
        year = None if size < 10 else 2000 + size if size < 50 else 1900 + size if size < 100 else size
        numbered = year is not None or n > 999
        assert got[n] == (str(n) if numbered else None, "4" if numbered and size % 2 == 0 else None, year), (n, size)


def test_roman(spark, tmp_path):
    spark.createDataFrame([(n,) for n in (1, 4, 3999, 4000, 60000, 60000)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.n: r.roman for r in plans.queries()["j6_roman_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "I", 4: "IV", 3999: "MMMCMXCIX", 4000: "4000", 60000: "60000"}


def test_many_segments(spark, tmp_path):
    spark.range(150).select(F.col("id").alias("c_custkey"), F.concat(F.lit("S"), "id").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    got = plans.queries()["h3_resolved"](spark, str(tmp_path)).collect()
    assert len(got) == 151 * 2 and sum(r.outcome == "found" for r in got) == 150
