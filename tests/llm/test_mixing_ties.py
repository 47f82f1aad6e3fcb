"""Prefixes of leaves whose rows share ids, or are equal."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import mixing


def chosen(spark, rows, share):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = mixing.mix(df, mixing.TARGET, [F.lit("x")], budget_share=share, max_epochs=1).collect()
    texts = {r.row: r.text for r in df.select(mixing.row_hash().alias("row"), "text").collect()}
    return [(r.doc_id, texts[r.row], r.tokens) for r in out]


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows"])
def test_ranges_of_repeated_ids_split(spark, monkeypatch, kind):
    """No range of more than a few rows is ordered at once, whatever repeats."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    own = None if kind == "null ids" else 7
    rows = [(own, "same text of five words" if kind == "equal rows" else f"text {i} of five words") for i in range(400)]
    out = chosen(spark, rows, 0.5)
    assert len(out) == 200 and sum(t for *_, t in out) == 1000
    if kind != "equal rows":
        # By the text's hash, as a plain sort has it.
        df = spark.createDataFrame(rows, "doc_id long, text string").select("text", mixing.row_hash().alias("row"))
        assert {t for _, t, _ in out} == {r.text for r in df.orderBy("row").limit(200).collect()}
    assert max(Counter(out).values()) == (200 if kind == "equal rows" else 1)


def test_too_many_leaves_are_refused(spark):
    df = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(5)], "doc_id long, text string, leaf string")
    with pytest.raises(ValueError, match="more than 4 leaves"):
        mixing.mix(df, mixing.TARGET, [F.col("leaf")], max_leaves=4)
    assert mixing.mix(df, mixing.TARGET, [F.col("leaf")], budget_share=1.0, max_leaves=5).count() == 5
