"""Rows without doc_id are answered like others where nothing depends on it."""

from samples import words

from fundtrace.llm import decontaminate, language, licences, packing, quality_model, quality_rules, substring, toxicity


def test_null_ids(spark, documents):
    long = words(1, 50, 10**6)
    df = documents([(None, long, "en"), (None, None, None), (3, long, "en")])
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "x y"), (2, long)], "item_id long, text string")
    for out in (
        language.identify(df), toxicity.score(df, labels), quality_model.grade(df, quality_model.ratings(labels)), quality_rules.quality_rules(df, labels),
        licences.licence_scan(df), decontaminate.decontaminate(df, bench), substring.dedup(df), packing.pack(packing.token_pieces(df, packing.tokenizer_path())),
    ):
        assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "None", "None"]
