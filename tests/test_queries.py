"""Every registered query of the library against its SQL."""

import pytest
from conftest import SF, rows_of

import __spark_entry__
from corpusforge import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_oracle(spark, oracle, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), oracle(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(got)


@pytest.mark.parametrize("name", ["q_anchor", "q_dimension", "q_strip_overview", "q_heading_shift", "q_add_h1", "q_quote_tags", "q_quote_struct", "q_summary_star", "q_colon_star", "q_link_rewrite", "q_clean_chain"])
def test_changes_rows(spark, name):
    before = {r.doc_id: r.content for r in Q.view(spark, SF, "md").select("doc_id", "content").collect()}
    changed = sum(before[r.doc_id] != r.content for r in Q.QUERIES[name](spark, SF).collect())
    assert changed > 300


def test_pages(spark):
    out = Q.QUERIES["q_html_md"](spark, SF).toPandas()
    assert len(out) == 250 and out.error.isna().all() and out.content.str.len().min() > 0
    assert not out.content.str.contains("<p>|<div", regex=True).any()


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_is_pruned(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(Q.QUERIES["q_catalog"](spark, SF)._jdf.queryExecution(), "formatted")
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]
