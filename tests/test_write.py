"""The builder never harms its sources, nor a corpus that it cannot replace."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusforge.plans import shared, write
from corpusforge.plans.build import Built, build
from corpusforge.sources.fetch import fetch_corpus


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*")) if p.is_file()}


def corpus(folder, n=3):
    for i in range(n):
        (folder / f"1.a/x{i}.txt").parent.mkdir(parents=True, exist_ok=True)
        (folder / f"1.a/x{i}.txt").write_text(f"text {i}")
    return folder


@pytest.mark.parametrize("target", ["", " ", ".", "..", "../other", "/abs", "a/../..", "docs", "docs/1.a", "docs/1.a/deep"])
def test_targets_that_overlap_or_lead_out_are_refused(spark, tmp_path, target, capsys):
    """The source is S/docs: equal, above, below and outside names are all refused."""
    source = corpus(tmp_path / "docs")
    (tmp_path / "keep.txt").write_text("k")
    before = tree(tmp_path)
    assert write.main([str(source), str(tmp_path), "--target", target]) == 1
    assert tree(tmp_path) == before
    assert capsys.readouterr().err


def test_source_inside_the_target_and_links_are_seen(spark, tmp_path):
    source = corpus(tmp_path / "out/docs/in")
    link = tmp_path / "out/alias"
    link.symlink_to(tmp_path / "out/docs")
    before = tree(tmp_path / "out")
    for target in ("docs", "alias", "docs/in"):
        with pytest.raises(ValueError, match="overlap"):
            shared.checked_target(spark, str(tmp_path / "out"), target, [str(source)])
    assert tree(tmp_path / "out") == before
    assert shared.checked_target(spark, str(tmp_path / "out"), "docsx", [str(source)]).endswith("/out/docsx")


def test_a_failed_build_keeps_the_old_corpus(spark, tmp_path):
    source, out = corpus(tmp_path / "in"), tmp_path / "out"
    assert write.main([str(source), str(out)]) == 0
    old = tree(out)
    broken = spark.createDataFrame([("docs/a.md",)], "path string").withColumn("content", F.raise_error(F.lit("stop")).cast("string"))
    errors = spark.createDataFrame([], "path string, stage string, error string")
    with pytest.raises(Exception, match="stop"):
        write.write_corpus(spark, Built(broken, None, errors), "docs", str(out))
    assert tree(out) == old
    # A file that cannot be written: nothing is swapped, and its row says why.
    half = spark.createDataFrame([("docs/a.md", "a"), ("docs/../../b.md", "b")], "path string, content string")
    failed = write.write_corpus(spark, Built(half, None, errors), "docs", str(out)).collect()
    assert [(r.path, r.stage) for r in failed] == [("docs/../../b.md", "write")] and tree(out) == old
    write.write_corpus(spark, Built(half, None, errors), "docs", str(out), partial=True)
    assert (out / "docs/a.md").read_bytes() == b"a" and not (out / "docs/1.a").exists()
    assert [p.name for p in out.iterdir()] == ["docs"]


def test_a_repeated_build_is_the_same_and_its_manifest_is_true(spark, tmp_path):
    source, out = corpus(tmp_path / "in", 5), tmp_path / "out"
    assert write.main([str(source), str(out), "--target", "a/docs"]) == 0
    first = {p: d for p, d in tree(out).items() if ".manifest" not in p}
    assert write.main([str(source), str(out), "--target", "a/docs"]) == 0
    assert {p: d for p, d in tree(out).items() if ".manifest" not in p} == first and len(first) == 5
    rows = write.manifest_of(spark, str(out / "a/docs")).collect()
    assert {f"a/docs/{r.path}": (r.bytes, r.sha256) for r in rows} == {p: (len(d), hashlib.sha256(d).hexdigest()) for p, d in first.items()}


def test_an_empty_build_and_a_swap_that_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    errors = spark.createDataFrame([], "path string, stage string, error string")
    none = Built(spark.createDataFrame([], "path string, content string"), None, errors)
    write.write_corpus(spark, none, "docs", str(tmp_path / "out"))
    assert (tmp_path / "out/docs").is_dir()
    (tmp_path / "out/docs/old.md").write_text("old")
    real, calls = shared.move, []

    def move(spark, src, dst):
        calls.append(dst)
        if len(calls) == 2:
            raise OSError("no")
        real(spark, src, dst)

    monkeypatch.setattr(shared, "move", move)
    with pytest.raises(OSError):
        write.write_corpus(spark, none, "docs", str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"docs/old.md": b"old"}


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    """A corpus of word-processor files: one read of each, however many outputs."""
    import test_plans

    source = corpus(tmp_path / "in")
    (source / "1.a/d.docx").write_bytes(test_plans.docx(test_plans.PARAGRAPH))
    built = build(spark, str(source), "docs", str(source))
    for df in (built.documents, built.images, built.errors):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "MapInArrow" not in plan


def test_fetch_keeps_what_it_cannot_replace(tmp_path, monkeypatch):
    target = tmp_path / "t"
    target.mkdir()
    (target / "old.txt").write_text("old")
    assert fetch_corpus(f"file://{tmp_path}/none", target) != 0
    assert tree(tmp_path) == {"t/old.txt": b"old"}
    monkeypatch.chdir(target)
    with pytest.raises(ValueError):
        fetch_corpus(f"file://{tmp_path}/none", tmp_path)
