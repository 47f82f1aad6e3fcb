"""Corpora of many small files."""

import duckdb
import pytest
from conftest import SF, rows_of

from corpusforge import queries as Q
from corpusforge.plans import write
from corpusforge.sources import listing


def test_small_files_fill_partitions(spark, tmp_path):
    for k in range(400):
        (tmp_path / f"{k}.txt").write_text(str(k))
    before = [spark.conf.get(k) for k in listing.SMALL_FILES]
    with listing.small_files(spark):
        rows = listing.read_binaries(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() <= 5
        assert sorted(int(bytes(r.content)) for r in rows.collect()) == list(range(400))
    assert [spark.conf.get(k) for k in listing.SMALL_FILES] == before


def test_files_without_bytes_have_rows(spark, tmp_path):
    """In folders and links that Spark looks into, by patterns, on a disk and elsewhere."""
    for d in ("", "a b", "_k=1/c", "_u", ".h", "_metadata.d"):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        for name in ("é %20+.txt", "k\\l.bin", "o.docx", "_m.bin", "_metadata", ".z", "x._COPYING_"):
            (tmp_path / d / name).write_bytes(b"")
            (tmp_path / d / (name[0] + "1" + name[1:])).write_bytes(b"x")
    (tmp_path / "l").symlink_to(tmp_path / "a b")
    (tmp_path / "gone").symlink_to(tmp_path / "none")
    open(bytes(tmp_path) + b"/\xff.bin", "wb").close()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.emptiness.link./in", f"file://{tmp_path}")
    folders = ("", "/a b", "/_k=1/c", "/_metadata.d", "/l")
    for root in (f"file:{tmp_path}", "viewfs://emptiness/in"):
        for pattern, names in (("*", ("é %20+.txt", "k\\l.bin", "o.docx")), ("*.{doc,docx}", ("o.docx",)), ("[é]*", ("é %20+.txt",))):
            want = {f"{root}{d}/{n}": b"" for d in folders for n in names}
            want |= {f"{root}{d}/{n[0]}1{n[1:]}": b"x" for d in folders for n in names}
            binaries, texts = listing.read_binaries(spark, root, pattern).collect(), listing.read_texts(spark, root, pattern).collect()
            assert len(binaries) == len(texts) == len(want)
            assert {r.path: bytes(r.content) for r in binaries} == {r.path: r.content.encode() for r in texts} == want
            assert {r.path: r.length for r in listing.scan(spark, root, pattern).collect()} == {p: len(b) for p, b in want.items()}
    assert [r.path for r in listing.read_binaries(spark, f"{tmp_path}/{{a b,.h}}/o.docx").collect()] == [f"file:{tmp_path}/.h/o.docx", f"file:{tmp_path}/a b/o.docx"]


@pytest.mark.parametrize("name", ["q_read_binaries", "q_read_texts", "q_scan_texts"])
def test_queries_of_texts_that_are_empty_or_have_no_id(spark, tmp_path, name):
    odd = "CASE WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 < 4 THEN NULL ELSE text END"
    docs = duckdb.sql(f"SELECT * REPLACE ({odd} AS text, CASE WHEN doc_id % 50 <> 7 THEN doc_id END AS doc_id) FROM '/root/testdata/sf0.001/documents.parquet'")
    docs.write_parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        want = con.sql(Q.ORACLES[name]).df()
    assert rows_of(Q.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(want)


@pytest.mark.parametrize("name", ["q_read_binaries", "q_read_texts", "q_scan_texts"])
def test_queries_where_the_shared_folder_has_a_name_of_the_corpus(spark, oracle, tmp_path, monkeypatch, name):
    (tmp_path / "docs/a b").mkdir(parents=True)
    monkeypatch.setattr(Q, "shared_folder", lambda _: f"file:{tmp_path}/docs/a b")
    assert rows_of(Q.QUERIES[name](spark, SF).toPandas()) == rows_of(oracle(Q.ORACLES[name]))


def test_a_file_without_a_path_is_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(None, b"x"), ("a", b"y")], "path string, data binary")
    assert [(r.path, r.error) for r in write.write_files(rows, str(tmp_path)).collect()] == [(None, "a file without a path"), ("a", None)]
    assert [p.name for p in tmp_path.iterdir()] == ["a"]
