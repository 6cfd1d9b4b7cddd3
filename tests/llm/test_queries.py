"""Queries with SQL agree with it; the others keep their contract on whole tables."""

import pytest
from oracle import same

from fundtrace.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    assert same(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"op1_html_text", "op9_packing"}))
def test_one_row_per_document(spark, name):
    rows = [r.doc_id for r in entry.queries()[name](spark, SF).select("doc_id").collect()]
    assert sorted(rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
