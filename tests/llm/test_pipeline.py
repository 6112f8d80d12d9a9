import corpus_pipeline as C
from tests.llm.conftest import DOCS, prose


def _corpus(spark, tmp_path):
    docs = [(i, prose(i, 90) + ".", "en", "s", 0) for i in range(40)]
    docs += [(50 + i, docs[i][1], "en", "s", 0) for i in range(3)]
    docs += [(60, docs[5][1].replace("the ", "THE ", 1), "en", "s", 0), (61, docs[6][1] + ' token = "0123456789abcdef0123"', "en", "s", 0)]
    docs += [(70 + i, " ".join(f"#{j * i} |$ <{j}> ab" for j in range(30)), "en", "s", 0) for i in range(20)]
    docs += [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "123 456 !!", "en", "s", 0), (93, "too short", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 70), 0) for r in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[1] for r in docs}


def test_stages_take_effect(spark, tmp_path):
    texts = _corpus(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        df = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen[name] = {r.doc_id: r.text for r in df.collect()}
    assert set(texts) - set(seen["language ID"]) == {90, 91, 92}
    assert set(seen["quality rules"]) == set(range(40)) | {50, 51, 52, 60, 61}
    assert set(seen["near duplicates"]) == set(range(40))
    assert seen["secret scan"] == seen["near duplicates"]
    packed = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(range(40)) and C.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
