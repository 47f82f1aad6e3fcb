"""Links and the catalog."""

from corpusforge.operators import catalog as A
from corpusforge.operators import links as L


def rewrite(spark, text, pointing=()):
    docs = spark.createDataFrame([("p.md", text)], "path string, content string")
    return L.rewrite_links(docs, spark.createDataFrame(list(pointing), "dir string, name string")).first().content


def test_plain_and_pointing(spark):
    assert rewrite(spark, "见 1.系统 > A b.docx。") == "见 [`1.系统 > A b.docx`](/docx/插件详细手册/1.系统/A b.md)。"
    assert rewrite(spark, "见 1.系统 > A.docx", [("1.系统", "A")]) == "见 [`1.系统 > A.docx`](/docx/插件详细手册/1.系统/（指向）A.md)"


def test_a_mention_inside_another(spark):
    out = rewrite(spark, "1.系统 > A.docx 和 11.系统 > A.docx", [("11.系统", "A")])
    assert out == "[`1.系统 > A.docx`](/docx/插件详细手册/1.系统/A.md) 和 [`11.系统 > A.docx`](/docx/插件详细手册/11.系统/（指向）A.md)"


def test_banned_letters_and_no_links(spark):
    assert rewrite(spark, "1.plugin > X.docx") == "1.plugin > X.docx"
    assert rewrite(spark, "nothing $1 \\ here") == "nothing $1 \\ here"


def test_catalog(spark):
    rows = A.catalog_rows(spark.createDataFrame([("d", "b.docx"), ("d", "（指向）a.txt"), ("e", "c.doc")], "dir string, file string"))
    assert {r.dir: r.names for r in A.catalog(rows).collect()} == {"d": ["b", "（指向）a"], "e": ["c"]}
    assert [tuple(r) for r in A.pointing_rows(rows).collect()] == [("d", "a")]
    ignored = spark.createDataFrame([("x/a",), ("x/b",), ("y/~$c",), ("x2/a",)], "path string")
    assert {r.path for r in A.ignore_filter(ignored, ["x"]).collect()} == {"x2/a"}
    assert {r.path for r in A.ignore_filter(ignored, [], spark.createDataFrame([("x/a",)], "path string")).collect()} == {"x/b", "x2/a"}
