from siftlog.llm import langid


def test_every_language_is_learned(spark):
    rows = [(n, f"text {n} of a language", f"l{n:03d}") for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r[0] for r in df.where(langid.fold_of("doc_id", langid.FOLDS) == langid.HELD).select("lang").collect()}
    want = sorted({r[2] for r in rows} - held)
    assert len(want) > 200
    assert langid.train(df)["languages"] == want
