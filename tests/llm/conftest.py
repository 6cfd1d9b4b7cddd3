import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of the documents table from texts, or (doc_id, text, lang) rows."""
    def make(rows, extra=""):
        out = []
        for i, r in enumerate(rows):
            d, t, lang = r if isinstance(r, tuple) else (i, r, "en")
            out.append((d, t, lang, f"s{i % 3}", None if t is None else len(t)))
        df = spark.createDataFrame(out, DOCS)
        for name in extra.split():
            df = df.selectExpr("*", f"1 AS {name}")
        return df
    return make
