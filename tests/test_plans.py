"""Sources, the corpus builder, plans and their execution on temporary folders."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusforge.plans import build as B
from corpusforge.plans import cli
from corpusforge.plans import unpack as U
from corpusforge.plans import write
from corpusforge.plans.commit import commit
from corpusforge.plans.organize import plan_extractions, plan_organize, plan_targets, plan_volumes
from corpusforge.sources import listing
from corpusforge.sources.archives import extract
from corpusforge.sources.config import OrganizeConfig, find_config_dir, load_config, merged, strip_quotes, validate_target
from corpusforge.sources.docx import docx_to_html
from corpusforge.sources.html import html_to_markdown
from corpusforge.streaming import clean_stream, document_stream, write_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(body: str, images: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{R}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><w:body>{body}</w:body></w:document>')
        rels = "".join(f'<Relationship Id="{k}" Target="media/{k}.{n}"/>' for k, n in (x.split(".") for x in images or {}))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for name, data in (images or {}).items():
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


PARAGRAPH = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> &lt;x&gt;</w:t></w:r></w:p>'
PICTURE = '<w:p><w:r><w:drawing><a:blip r:embed="{}"/></w:drawing></w:r></w:p>'


def test_html_to_markdown():
    assert html_to_markdown("<h2>T</h2><p>a <b>b</b> <i>c</i><p>d<br>e") == "## T\n\na **b** *c*\n\nd\ne\n"
    assert html_to_markdown("<ul><li>x<li>y<ol><li>z</ol></ul>") == "- x\n- y\n  1. z\n"
    assert html_to_markdown('<a href="u">t</a><img src="s" alt="q"><script>no</script>') == "[t](u)![q](s)\n"
    assert html_to_markdown("<table><tr><th>a<th>b<tr><td>1<td>x|y</table>") == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"
    assert html_to_markdown("<pre>a\n  b</pre><blockquote>q</blockquote>") == "```\na\n  b\n```\n\n> q\n"
    assert html_to_markdown("<p>open <b>never closed") == "open **never closed**\n"
    assert html_to_markdown(None) == html_to_markdown("") == ""


def test_docx(spark):
    data = docx(PARAGRAPH + PICTURE.format("i1") + PICTURE.format("i2"), {"i1.png": b"x" * 40, "i2.emf": b"y" * 40})
    files = spark.createDataFrame([("in/a.docx", data), ("in/b.doc", b"old"), ("in/~$a.docx", b"")], "path string, content binary")
    out = {r.path: r for r in docx_to_html(files).collect()}
    assert set(out) == {"in/a.docx", "in/b.doc"} and out["in/b.doc"].error
    assert out["in/a.docx"].html.startswith("<h2>Top</h2><p><strong>bold</strong> &lt;x&gt;</p>")
    good, images, bad = B.office_documents(files, "in", "out")
    assert good.first().content == "## Top\n\n**bold** <x>\n\n![](./images/a/a-001.png)\n\n![](./images/placeholder.png)\n"
    assert [(r.name, r.status) for r in images.orderBy("seq").collect()] == [("a-001.png", "ok"), ("a-002.png", "unsupported")]
    assert [(r.path, r.stage) for r in bad.collect()] == [("in/b.doc", "docx")]


def test_build(spark, tmp_path):
    base = tmp_path / "corpus"
    for path, data in {"manual/1.系统/开始.txt": "hello\n\n见 1.系统 > 开始.docx".encode(), "manual/1.系统/（指向）开始.docx": docx(PARAGRAPH), "manual/1.系统/开始.docx": docx(PARAGRAPH), "manual/1.系统/~$t.docx": b"", "skip/z.txt": b"z"}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(data)
    from corpusforge.sources.config import BuildConfig

    built = B.build(spark, str(base), "out", f"{base}/manual", BuildConfig(ignored_folders=(f"file:{base}/skip",)))
    out = {r.path: r.content for r in built.documents.collect()}
    assert set(out) == {"out/manual/1.系统/开始.md", "out/manual/1.系统/（指向）开始.md"}
    assert out["out/manual/1.系统/开始.md"].startswith("# 开始\n\n## Top")
    assert built.errors.count() == 0


def test_same_target_is_won_by_office(spark):
    docs = spark.createDataFrame([("o/a.md", "i/a.txt", "t"), ("o/a.md", "i/a.docx", "d"), ("o/b.md", "i/b.txt", "b")], "path string, source string, content string")
    assert {r.path: r.content for r in B.last_writer(docs).collect()} == {"o/a.md": "d", "o/b.md": "b"}
    assert [tuple(r) for r in B.collisions(docs).collect()] == [("o/a.md", 2)]


def test_listing(spark, tmp_path):
    for p in ("a.txt", "s/b.txt", "s/_c.txt", "s/d.docx", "~$e.docx", "s/t/f.zip"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(listing.scan_texts(spark, str(tmp_path))) == ["a.txt", "b.txt"]
    assert names(listing.scan_documents(spark, str(tmp_path))) == ["d.docx"]
    tree = listing.list_tree(spark, str(tmp_path))
    assert names(listing.collect_files(tree, True)) == ["_c.txt", "a.txt", "b.txt", "d.docx", "~$e.docx"]
    assert names(listing.flat(tree, "dir")) == ["s"]
    assert listing.existing(spark.createDataFrame([(str(tmp_path / "s"),), ("/no",)], "path string"), tree, "dir").count() == 1
    plan = spark._jvm.PythonSQLUtils.explainString(listing.scan_texts(spark, str(tmp_path)).select("path")._jdf.queryExecution(), "formatted")
    assert "content" not in plan.split("ReadSchema")[1]


def test_extract(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/x.txt", "hi")
    files = spark.createDataFrame([("a.zip", z.getvalue()), ("b.7z", b"?"), ("c.zip", b"bad")], "path string, content binary")
    out = {r.path: (r.member, r.status) for r in extract(files).collect()}
    assert out == {"a.zip": ("d/x.txt", "ok"), "b.7z": (None, "unsupported"), "c.zip": (None, "error")}


def test_config(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/corpusforge.json").write_text(json.dumps({"dirtyFiles": ["n"], "isDeletePackages": False, "folderRange": {"start": 1, "end": 2}}))
    assert find_config_dir(tmp_path / "a/b") == tmp_path / "a"
    c = load_config(tmp_path / "a/b")
    assert (c.dirty_files, c.delete_packages, c.folder_range, c.password) == (("n",), False, (1, 2), "secret")
    with pytest.raises(ValueError):
        merged(OrganizeConfig(), {"nope": 1})
    assert strip_quotes("'x'") == strip_quotes('"x"') == "x" and strip_quotes("'x\"") == "'x\""
    for bad in ("rel", str(tmp_path / "none"), str(tmp_path / "a/corpusforge.json")):
        with pytest.raises(ValueError):
            validate_target(bad)


def test_organize_a_folder(spark, tmp_path):
    n = "x - NO.213 y"
    root = tmp_path / "213"
    for p in (f"{n}/{n}/01.jpg", f"{n}/{n}/02.jpg", f"{n}/01.jpg", f"{n}/junk.url", f"{n}/v.zip"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    (tmp_path / "221.zip").write_text("x")
    config = OrganizeConfig(folder_range=(213, 221))
    top = listing.list_tree(spark, str(tmp_path))
    targets = plan_targets(spark, top, config, str(tmp_path))
    assert {(r.number, r.phase) for r in targets.collect()} == {(213, "organize"), (221, "decompress")}
    assert [(r.op, r.src.rsplit("/", 1)[1]) for r in plan_extractions(targets, config).orderBy("seq").collect()] == [("extract", "221.zip"), ("delete", "221.zip")]
    plan = plan_organize(spark, listing.list_tree(spark, str(root)).select("root", F.col("dir"), "name", "kind"), config)
    assert {d.status for d in commit(plan, tmp_path)} == {"planned"} and (root / n).exists()
    commit(plan, tmp_path, dry_run=False)
    done = tmp_path / n
    assert sorted(p.name for p in done.iterdir()) == ["01-1.jpg", "01.jpg", "02.jpg"] and not root.exists()


def test_commit_stays_inside(spark, tmp_path):
    row = [("r", 1, "delete", str(tmp_path.parent / "other"), None, "x")]
    with pytest.raises(ValueError):
        commit(spark.createDataFrame(row, "root string, seq int, op string, src string, dst string, reason string"), tmp_path, dry_run=False)


def test_volumes(spark):
    files = spark.createDataFrame([("/r", "/a", "s.7z.001"), ("/r", "/a", "s.7z.002"), ("/r", "/a", "n.txt")], "root string, dir string, name string")
    got = [(r.seq, r.op, r.src) for r in plan_volumes(files, OrganizeConfig()).orderBy("seq", "src").collect()]
    assert got == [(10, "delete", "/r/a/n.txt"), (11, "extract", "/r/a/s.7z.001"), (12, "delete", "/r/a/s.7z.001"), (12, "delete", "/r/a/s.7z.002")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(f"d/{i}.md", f"### 概述\n### h{i}\n<T{i}>") for i in range(20)], "path string, content string")
    docs.write.parquet(str(tmp_path / "in"))
    query = write_stream(clean_stream(document_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(clean_stream(docs).collect())


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


ROW = "root string, seq int, op string, src string, dst string, reason string"


def test_an_extraction_that_is_not_done_keeps_its_archive(spark, tmp_path):
    def broken(src, dst):
        raise {"a": TimeoutError, "b": RuntimeError, "c": OSError}[src.stem]("no")

    for name in "abc":
        (tmp_path / f"{name}.zip").write_bytes(b"x")
    plan = spark.createDataFrame([(str(tmp_path / n), k, op, str(tmp_path / f"{n}.zip"), str(tmp_path / n) if op == "extract" else None, "x") for n in "abcd" for k, op in enumerate(("extract", "delete"))], ROW)
    for extractor in (None, broken):
        done = commit(plan, tmp_path, dry_run=False, extractor=extractor)
        assert [d.status for d in done if d.op == "delete"] == ["skipped"] * 4 and "done" not in {d.status for d in done}
        assert sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "b.zip", "c.zip"]


def test_command_line_unpacks_flattens_and_renames(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "221.zip").write_bytes(zipped({"x/01.jpg": b"1", "x/y/01.jpg": b"2", "junk.url": b"j"}))
    (tmp_path / "222.7z").write_bytes(b"no archive")
    (tmp_path / "223.zip").write_bytes(b"broken")
    (tmp_path / "224.zip").write_bytes(zipped({"deep/set.7z.001": b"a", "deep/set.7z.002": b"b", "deep/other.txt": b"c"}))
    monkeypatch.setattr(U, "_program", lambda: None)
    assert cli.main([str(tmp_path)]) == 0 and "done" not in capsys.readouterr().out
    assert sorted(p.name for p in tmp_path.iterdir()) == ["221.zip", "222.7z", "223.zip", "224.zip"]
    assert cli.main([str(tmp_path), "--apply"]) == 0
    shown = capsys.readouterr().out
    assert "failed extract" in shown and "no reader for .7z" in shown
    left = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    # 222 and 223 could not be unpacked and stay; the volume set of 224 has no reader, so its volumes stay.
    assert left == {"221/01.jpg", "221/01-1.jpg", "222.7z", "223.zip", "224/deep/set.7z.001", "224/deep/set.7z.002"}

    def volumes(src, into, password):
        return ["/bin/cp", str(src), str(into / "big.jpg")]

    monkeypatch.setattr(U, "_command", lambda src, into, password: volumes(src, into, password) if src.suffix == ".001" else [U.sys.executable, "-m", U.__name__, str(src), str(into)])
    (tmp_path / "224.zip").write_bytes(zipped({"deep/set.7z.001": b"a", "deep/set.7z.002": b"b"}))
    for name in ("222.7z", "223.zip"):
        (tmp_path / name).unlink()
    assert cli.main([str(tmp_path), "--apply"]) == 0
    left = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    assert {"set/big.jpg"} <= left and not any("7z" in x or x.endswith(".zip") for x in left)


def test_time_limit_and_paths(tmp_path, monkeypatch):
    (tmp_path / "a.zip").write_bytes(zipped({"../out.txt": b"x"}))
    with pytest.raises(RuntimeError, match="outside"):
        U.extractor(OrganizeConfig())(tmp_path / "a.zip", tmp_path / "a")
    monkeypatch.setattr(U, "_command", lambda *a: ["/bin/sleep", "30"])
    with pytest.raises(TimeoutError):
        U.extractor(OrganizeConfig(timeout=0.2))(tmp_path / "a.zip", tmp_path / "a")
    assert [p.name for p in tmp_path.iterdir()] == ["a.zip"]


def test_build_and_write(spark, tmp_path, capsys):
    base, out = tmp_path / "corpus", tmp_path / "out"
    picture = docx(PARAGRAPH + PICTURE.format("i1"), {"i1.png": b"x" * 40})
    for path, data in {"1.a/x.txt": b"hello", "1.a/corpus.docx": picture, "1.a/old.doc": b"old", "skip/z.txt": b"z"}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(data)
    (out / "docs").mkdir(parents=True)
    (out / "docs/stale.md").write_text("gone")
    assert write.main([str(base), str(out), "--ignore", f"file:{base}/skip"]) == 0
    assert capsys.readouterr().out == "docx 1\n"
    files = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert set(files) == {"docs/1.a/x.md", "docs/1.a/corpus.md", "docs/images/corpus/corpus-001.png"}
    assert files["docs/1.a/x.md"].decode().startswith("# x") and files["docs/images/corpus/corpus-001.png"] == b"x" * 40
    bad = write.write_files(spark.createDataFrame([("../a", b"x"), ("b", None)], "path string, data binary"), str(out)).collect()
    assert [(r.path, bool(r.error)) for r in bad] == [("../a", True), ("b", False)] and (out / "b").read_bytes() == b""


def test_links_in_documents_without_a_key(spark):
    from corpusforge.operators.links import rewrite_links

    docs = spark.createDataFrame([("p", "1.a > X.docx", None), ("p", "1.a > X.docx 1.a > Y.docx", 2), (None, None, 3), ("q", "none", 4)], "path string, content string, `odd.name` int")
    known = spark.createDataFrame([("1.a", "X"), ("1.a", "X")], "dir string, name string")
    out = rewrite_links(docs, known)
    assert out.columns == docs.columns and out.count() == 4
    got = {r["odd.name"]: r.content for r in out.collect()}
    assert got[None] == "[`1.a > X.docx`](/docx/插件详细手册/1.a/（指向）X.md)" and got[2] == got[None] + " [`1.a > Y.docx`](/docx/插件详细手册/1.a/Y.md)"
    assert got[3] is None and got[4] == "none"


def test_blocks_in_cells_and_open_tags():
    assert html_to_markdown("<table><tr><td><p>x</p><p>y</p></td><td><ul><li>a<li>b</ul></td></tr><tr><td><h3>h</h3></td><td>z</td></tr></table>") == "| x y | a b |\n| --- | --- |\n| h | z |\n"
    assert html_to_markdown("<table><tr><td>a<table><tr><td>i<td>j</table></td><td>b</td></tr></table><p>after") == "| a i j | b |\n| --- | --- |\n\nafter\n"
    assert html_to_markdown("<p>a</p><svg><path><p>b</p>") == "a\n\nb\n"
    assert html_to_markdown("<title>t<h1>x</h1><noscript><p>n</p></noscript><p>y") == "# x\n\ny\n"
    assert html_to_markdown("<svg><title>t</title></svg>z") == "z\n"


def test_fetch_a_corpus(tmp_path):
    import subprocess

    from corpusforge.sources.fetch import fetch_corpus

    source, target = tmp_path / "source", tmp_path / "in/target"
    git = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    source.mkdir()
    git("init", "-q")
    (source / "a.txt").write_text("x")
    git("add", ".")
    git("commit", "-qm", "one")
    target.mkdir(parents=True)
    (target / "old.txt").write_text("old")
    assert fetch_corpus(f"file://{source}", target) == 0
    assert sorted(p.name for p in target.iterdir()) == [".git", "a.txt"]
    assert fetch_corpus(f"file://{tmp_path}/none", target) != 0
    with pytest.raises(OSError):
        fetch_corpus(str(source), target, git="no-such-program")


def test_formatter_and_its_failures(spark):
    from corpusforge.operators.formatting import format_markdown

    df = spark.createDataFrame([(1, "a é"), (2, None), (3, "")], "doc_id long, content string")
    read = lambda *command, **more: {r.doc_id: r.content for r in format_markdown(df, command=command, **more).collect()}
    assert read("tr", "a", "b") == {1: "b é", 2: None, 3: ""}
    same = {1: "a é", 2: None, 3: ""}
    assert read("no-such-program") == read("false") == read("sleep", "9", timeout=0.1) == same
