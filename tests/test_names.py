"""Names, paths and images."""

from pyspark.sql import functions as F

from corpusforge.functions import names as N
from corpusforge.functions.jstext import padded
from corpusforge.operators.images import name_images


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def test_archive_names(spark):
    assert column(spark, ["a.gz", "A.ZIP", ".zip", "x.7z.001", "X.7Z.12", "a.txt", "a.7z"], N.is_archive) == [True, True, False, True, True, False, True]
    assert column(spark, ["a.7z.001", "a.7Z.001", "a.7z"], N.is_volume) == [True, False, False]
    assert column(spark, ["031.gz", "125.zip", "12图.gz", "1.rar"], N.is_archive_candidate) == [True, True, False, False]
    assert column(spark, ["12图.gz"], lambda c: N.is_archive_candidate(c, True)) == [True]


def test_stems(spark):
    assert column(spark, ["a.b.c", ".hidden", "plain", "a."], N.file_stem) == ["a.b", ".hidden", "plain", "a"]
    assert column(spark, ["a.b.c", ".hidden", "plain", "a."], N.extension) == [".c", "", "", "."]
    assert column(spark, ["x\\y/z.a.md", "q"], N.stem) == ["z.a", "q"]
    assert column(spark, ["a.b.docx", "none"], N.catalog_name) == ["a.b", ""]


def test_pointing_marker_goes_once(spark):
    assert column(spark, ["（指向）a（指向）", "b（指向）", "c"], N.strip_pointing) == ["a（指向）", "b", "c"]


def test_paths(spark):
    assert column(spark, ["a//b\\c", "./a/./b", "a/x/../b/", "../a", "/a/../../b", "a/" * 12 + "../" * 12 + "f", "../x/../../y", ""], N.normal_path) == ["a/b/c", "a/b", "a/b", "../a", "/b", "f", "../../y", ""]
    assert column(spark, ["a/b", "a/bc", "a/b/c"], lambda c: N.under(c, "a/b")) == [True, False, True]
    assert column(spark, ["src/d.x/n.tar.gz", "src/n"], lambda c: N.target_path(c, "src", "out")) == ["out/d.x/n.tar.md", "out/n"]


def test_safe_names(spark):
    assert column(spark, ["Doc: 1/v?.", "a..", "x" * 60, "a　 b"], N.safe_name) == ["Doc_1_v_", "a", "x" * 50, "a_b"]
    assert column(spark, ["7", "1000"], padded) == ["007", "1000"]


def test_images(spark):
    rows = [(1, "A b", 1, "image/png", 100), (1, "A b", 2, "image/x-emf", 100), (1, "A b", 3, "image/jpeg", 100), (1, "A b", 4, "odd", None), (1, "A b", 5, "image/tiff", 50)]
    out = name_images(spark.createDataFrame(rows, "doc_id long, doc_name string, pos int, content_type string, b64_len long")).orderBy("seq").collect()
    assert [(r.seq, r.status, r.src) for r in out] == [
        (1, "ok", "./images/A_b/A_b-001.png"), (2, "unsupported", "./images/placeholder.png"), (3, "ok", "./images/A_b/A_b-003.jpg"),
        (4, "empty", "./images/placeholder.png"), (5, "ok", "./images/A_b/A_b-005.png"),
    ]
