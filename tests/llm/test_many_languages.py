from normspark.llm import language_id as L


def test_every_language_is_learned(spark):
    rows = [(i * 100 + k, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 9, f"l{i:02}") for i in range(70) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(L.learn(docs)) == 70
    want = {d: lang for d, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in L.digest(docs).collect())
