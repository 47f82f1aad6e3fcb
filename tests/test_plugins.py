"""Cleaners that may fail for a document."""

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import plugins as P
from corpusforge.plans.build import build
from corpusforge.sources.config import BuildConfig

DOCS = [("a/x.md", "### one"), ("a/y.md", "bad ### two"), ("a/z.md", None), (None, ""), ("a/n.md", "number"), ("a/s.md", "surrogate")]


@pytest.fixture(autouse=True)
def registry(monkeypatch):
    monkeypatch.setattr(P, "PLUGINS", dict(P.PLUGINS))

    # Local functions: workers get them by value.
    def upper(text, path):
        return None if text is None else text.upper()

    def picky(text, path):
        if text and "BAD" in text:
            raise ValueError("not good")
        if text == "NUMBER":
            return 7
        return "\ud800" if text == "SURROGATE" else text

    P.register_plugin("upper", upper)
    P.register_plugin("picky", picky)
    P.register_plugin("silent", lambda text, path: 1 // 0)


def test_failed_rows_keep_their_text_and_tell_why(spark):
    df = spark.createDataFrame(DOCS, "path string, content string").withColumn("n", F.lit(1))
    out = {(r.path or "-").split("/")[-1]: r for r in P.clean_with_plugins(df, chain=("headings", "upper", "picky", "add_h1")).collect()}
    assert out["x.md"].content == "# x\n\n## ONE" and out["x.md"].failed is None
    assert out["y.md"].content == "bad ### two" and (out["y.md"].failed, out["y.md"].error) == ("picky", "not good")
    assert out["z.md"].content is None and out["-"].content == "" and out["-"].n == 1
    assert out["n.md"].content == "number" and out["n.md"].error == "int is no text"
    assert out["s.md"].content == "surrogate" and "surrogates not allowed" in out["s.md"].error
    assert [(d.name, d.delta) for d in out["x.md"].deltas] == [("upper", 0), ("picky", 0)] and [d.name for d in out["y.md"].deltas] == ["upper"]


def test_steps_after_a_failure_are_not_run(spark):
    df = spark.createDataFrame([("p", "t")], "path string, content string")
    row = P.clean_with_plugins(df, chain=("silent", "colon_stars", "upper")).first()
    assert (row.content, row.failed, row.deltas) == ("t", "silent", []) and "division" in row.error
    assert [tuple(r) for r in P.plugin_errors(P.clean_with_plugins(df, chain=("silent",))).collect()] == [("p", "clean silent", row.error)]
    assert P.clean_with_plugins(df.limit(0), chain=("silent",)).collect() == []
    with pytest.raises(ValueError):
        P.clean_with_plugins(df.withColumn("error", F.lit(1)), chain=("upper",))
    with pytest.raises(ValueError):
        P.register_plugin("headings", str)


def test_neighbours_share_a_pass(spark):
    df = spark.createDataFrame([("p", "t")], "path string, content string")
    plan = spark._jvm.PythonSQLUtils.explainString(P.clean_with_plugins(df, chain=("upper", "picky", "colon_stars", "upper"))._jdf.queryExecution(), "simple")
    assert plan.count("MapInArrow") == 2


def test_build_reports_documents_that_a_plugin_fails_on(spark, tmp_path):
    (tmp_path / "1.a").mkdir()
    for name, text in {"x": "fine 1.a > x.docx", "y": "bad 1.a > x.docx"}.items():
        (tmp_path / f"1.a/{name}.txt").write_text(text)
    built = build(spark, str(tmp_path), "docs", str(tmp_path), BuildConfig(), chain=("upper", "picky", "colon_stars"))
    out = {r.path: r.content for r in built.documents.collect()}
    assert out == {"docs/1.a/x.md": "# X\n\nFINE 1.A > X.DOCX", "docs/1.a/y.md": "# y\n\nbad 1.a > x.docx"}
    assert [(r.path, r.stage, r.error) for r in built.errors.collect()] == [("docs/1.a/y.md", "clean picky", "not good")]
