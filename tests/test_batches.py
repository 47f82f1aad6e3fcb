"""Python works on pieces of bounded size, whatever batches Spark hands it."""

import io
import zipfile

import pyarrow as pa
import pytest

from corpusforge import queries as Q
from corpusforge.functions import batches as B
from corpusforge.operators import plugins as P
from corpusforge.sources import archives, docx, html

LONG = "x" * (B.PIECE_BYTES - 100_000)


class Rows:
    """Stands for a DataFrame: gives the function that would run in tasks."""

    schema = None
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run


def test_pieces_keep_rows_and_order():
    b = pa.RecordBatch.from_pydict({"k": list(range(100)), "t": ["é" * (7 * k) for k in range(100)]})
    out = list(B.pieces(iter([b, b.slice(0, 0)]), 3000))
    assert pa.Table.from_batches(out).to_pydict() == b.to_pydict()
    assert len(out) > 10 and all(x.num_rows == 1 or x.nbytes <= 3000 for x in out if x.num_rows)


def _file(name: str, text: str) -> bytes:
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr(name, text)
    return file.getvalue()


def test_docx_in_pieces():
    data = _file("word/document.xml", f'<w:document xmlns:w="{docx._W[1:-1]}"><w:body><w:p><w:r><w:t>{LONG}</w:t></w:r></w:p></w:body></w:document>')
    out = list(docx._read(iter([pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [data] * 3})])))
    assert [x.to_pydict()["path"] for x in out] == [["a"], ["b"], ["c"]]
    assert all(x.to_pydict()["html"] == [f"<p>{LONG}</p>"] for x in out)


def test_plugins_in_pieces(monkeypatch):
    texts = {"content": [LONG] * 3, "path": ["a", "b", "c"], "failed": [None] * 3, "error": [None] * 3, "deltas": [[]] * 3}
    kind = pa.schema([("content", pa.string()), ("path", pa.string()), ("failed", pa.string()), ("error", pa.string()), ("deltas", pa.list_(pa.struct([("name", pa.string()), ("delta", pa.int64())])))])
    run = P._pass(Rows(), [("end", lambda text, path: text + path)], "content", "path")
    out = list(run(iter([pa.RecordBatch.from_pydict(texts, kind)])))
    assert [x.to_pydict()["content"] for x in out] == [[LONG + "a"], [LONG + "b"], [LONG + "c"]]


def test_pages_in_pieces():
    out = list(html._convert(iter([pa.RecordBatch.from_pydict({"id": [1, 2, 3], "html": [f"<p>{LONG}</p>"] * 3})])))
    assert [x.to_pydict() for x in out] == [{"id": [k], "content": [LONG + "\n"], "error": [None]} for k in (1, 2, 3)]


def test_archives_are_turned_into_objects_by_pieces(monkeypatch):
    given = []
    monkeypatch.setattr(archives, "pieces", lambda b: given.append(1) or B.pieces(b))
    run = archives.extract(Rows())
    data = _file("m", LONG)
    out = list(run(iter([pa.RecordBatch.from_pydict({"path": ["a.zip", "b.zip"], "content": [data] * 2})])))
    assert given and [x.to_pydict()["path"] for x in out] == [["a.zip"], ["b.zip"]]


@pytest.mark.parametrize("name", ["q_docx_lists", "q_plugin_chain", "q_extract", "q_zip_split"])
def test_queries_ask_for_small_batches(spark, name):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for k in before:
            spark.conf.unset(k)
        Q.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(rows)) <= B.BATCH_ROWS and int(spark.conf.get(size).rstrip("b")) <= B.BATCH_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_errors_of_plugins_in_pieces():
    def fail(text, path):
        raise ValueError(f"{len(text)} in {path}")

    kind = pa.schema([("content", pa.string()), ("path", pa.string()), ("failed", pa.string()), ("error", pa.string()), ("deltas", pa.list_(pa.struct([("name", pa.string()), ("delta", pa.int64())])))])
    texts = {"content": [LONG] * 3, "path": ["a", "b", "c"], "failed": [None, "old", None], "error": [None, "was", None], "deltas": [[]] * 3}
    out = list(P._pass(Rows(), [("fail", fail)], "content", "path")(iter([pa.RecordBatch.from_pydict(texts, kind)])))
    assert [(x.to_pydict()["failed"], x.to_pydict()["error"]) for x in out] == [(["fail"], [f"{len(LONG)} in a"]), (["old"], ["was"]), (["fail"], [f"{len(LONG)} in c"])]
    assert all(x.to_pydict()["content"] == [LONG] for x in out)
