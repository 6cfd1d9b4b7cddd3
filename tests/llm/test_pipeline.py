import corpus_pipeline
from samples import edited, words


def test_stages_take_effect(spark, documents, tmp_path):
    base, passage, question = words(1, 200, 10**6), words(2, 60, 10**6), words(3, 20, 10**6)
    texts = [base, edited(base, 0.01, 1), base, words(4, 100, 10**6) + " " + passage, words(5, 100, 10**6) + " " + passage, "words " + question, "12 34", None, words(6, 50, 10**6)]
    documents(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(at["language"]) == {0, 1, 2, 3, 4, 5, 8}
    assert set(at["near_duplicates"]) == {0, 3, 4, 5, 8}
    assert at["substring_dedup"][3] == words(4, 100, 10**6) and at["substring_dedup"][8] == words(6, 50, 10**6)
    assert set(at["decontamination"]) == {0, 3, 4, 8}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 3, 4, 8}


def test_stage_calls_on_empty_documents(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), str(tmp_path)).count() == 0, name


def test_rows_are_judged_by_themselves(spark, documents, tmp_path):
    """Rows without a doc_id, and different texts with one."""
    base, passage, question = words(1, 200, 10**6), words(2, 60, 10**6), words(3, 20, 10**6)
    other = [words(k, 90, 10**6) for k in range(4, 12)]
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(stage, rows):
        docs = documents([(d, t, "en") for d, t in rows])
        return sorted([(r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()], key=str)

    def same(a, b):
        return a == sorted(b, key=str)

    rows = [(1, base), (2, other[0]), (2, "12 34"), (None, "56 78"), (None, other[1]), (None, None)]
    assert same(left(corpus_pipeline.keep_known_languages, rows), [(1, base), (2, other[0]), (None, other[1])])
    copy = edited(base, 0.01, 1)
    rows = [(1, base), (2, copy), (2, other[0]), (2, other[1]), (None, copy), (None, other[2]), (3, other[3]), (3, other[3]), (None, other[4]), (None, other[4]), (4, None), (4, None)]
    want = [(1, base), (2, other[0]), (2, other[1]), (None, other[2]), (3, other[3]), (None, other[4]), (4, None), (4, None)]
    assert same(left(corpus_pipeline.keep_one_of_each_group, rows), want)
    rows = [(None, other[0] + " " + passage), (1, other[1] + " " + passage), (1, other[2]), (None, other[3]), (2, other[4]), (2, other[4])]
    want = [(None, other[0]), (1, other[1]), (1, other[2]), (None, other[3]), (2, ""), (2, "")]
    assert same(left(corpus_pipeline.cut_repeated_passages, rows), want)
    rows = [(None, "words " + question), (1, question), (1, other[0]), (None, other[1])]
    assert same(left(corpus_pipeline.keep_uncontaminated, rows), [(1, other[0]), (None, other[1])])
