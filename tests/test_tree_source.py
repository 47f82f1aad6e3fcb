"""The data source of file trees against os.walk."""

import os

import pytest
from pyspark.sql import functions as F

from corpusforge.sources.listing import list_tree
from corpusforge.sources.tree_source import TreeReader, read_tree


@pytest.fixture
def folders(tmp_path):
    for p in ("a.txt", "_b/.c/d.txt", ".e/f_/g.zip", "h/i/j/k.txt", "h/_l", "m/n.txt", "z/empty/x"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text("x")
    (tmp_path / "t/z/empty/x").unlink()
    (tmp_path / "t/link").symlink_to(tmp_path / "t/h")
    return str(tmp_path / "t")


def walked(root):
    out = set()
    for at, dirs, files in os.walk(root):
        for names, kind in ((dirs, "dir"), (files, "file")):
            for n in names:
                path = os.path.join(at, n)
                link = os.path.islink(path)
                out.add((root, at, path, at.removeprefix(root), n, "file" if link else kind, at.removeprefix(root).count("/") + 1))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_equals_os_walk(spark, folders, depth):
    df = read_tree(spark, folders, split_depth=depth)
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == walked(folders) and len(rows) == len(set(rows))
    assert sorted(rows) == sorted(tuple(r) for r in list_tree(spark, folders).collect())
    assert df.rdd.getNumPartitions() == len(TreeReader([folders], depth).partitions())
    assert (df.rdd.getNumPartitions() == 1) == (depth == 0)


def test_filters_are_taken_by_the_reader(spark, folders):
    df = read_tree(spark, folders)
    for test in ("depth = 1 AND kind = 'file'", "depth < 3", "depth <= 2 AND kind IN ('dir')", "depth > 1 AND depth >= 3", "kind = 'file' AND name LIKE '%.txt'", "depth = 2 AND kind = 'none'"):
        want = [tuple(r) for r in spark.createDataFrame(list(walked(folders)), df.schema).where(test).collect()]
        assert sorted(map(tuple, df.where(test).collect())) == sorted(want)
    plan = spark._jvm.PythonSQLUtils.explainString(df.where("depth = 1 AND kind = 'file'")._jdf.queryExecution(), "formatted")
    assert "file_tree" in plan and "Filter" not in plan.split("== Physical Plan ==")[-1].split("\n(1)")[0]


def test_several_roots_and_none(spark, folders, tmp_path):
    (tmp_path / "u").mkdir()
    two = read_tree(spark, f"{folders}/h", str(tmp_path / "u"), f"{folders}/_b")
    assert {r.root: r.n for r in two.groupBy("root").agg(F.count("*").alias("n")).collect()} == {f"{folders}/h": 4, f"{folders}/_b": 2}
    assert read_tree(spark, str(tmp_path / "u")).collect() == []
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        read_tree(spark, str(tmp_path / "none")).collect()
