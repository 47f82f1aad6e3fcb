"""A written corpus is removed by tasks, and nothing outside of it is."""

import os

import pytest

from corpusforge import queries as Q
from corpusforge.plans import write
from corpusforge.plans.build import Built


@pytest.mark.parametrize("name", ["q_manifest", "q_tree_source"])
def test_the_driver_removes_no_documents(spark, monkeypatch, name):
    left = []

    def counted(session, folder, real=write.remove):
        left.extend(os.path.join(at, f) for at, _, names in os.walk(folder) for f in names)
        real(session, folder)

    monkeypatch.setattr(write, "remove", counted)
    monkeypatch.setattr(Q, "remove", counted)
    base = Q.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(base))
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100
    assert left and all(f"/{write.MANIFEST}/" in f for f in left)
    assert not {n for n in set(os.listdir(base)) - before if n.startswith("written-")}


def test_all_of_a_corpus_goes_and_what_links_lead_to_stays(spark, tmp_path):
    texts = [(f"docs/{d}/x {k}é.txt", str(k)) for k, d in enumerate(["a", "b/c", ".d", "e"] * 5)]
    errors = spark.createDataFrame([], "path string, stage string, error string")
    write.write_corpus(spark, Built(spark.createDataFrame(texts, "path string, content string"), None, errors), "docs", str(tmp_path))
    (tmp_path / "docs/e").rename(tmp_path / "other")
    (tmp_path / "docs/e").symlink_to(tmp_path / "other")
    (tmp_path / "docs/a/mine").write_text("in no list")
    (tmp_path / "docs/.manifest/.more.tsv").write_text("0\t1\t../other/x 3é.txt\n0\t1\t\n0\t1\tb\nodd\n")
    write.remove_written(spark, str(tmp_path / "docs"))
    assert os.listdir(tmp_path) == ["other"] and len(os.listdir(tmp_path / "other")) == 5
    write.remove_written(spark, str(tmp_path / "docs"))
