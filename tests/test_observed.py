"""Counts that come with a pass, links without moved contents, archives by members."""

import io
import zipfile

import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusforge import queries as Q
from corpusforge.functions import cleaners as C
from corpusforge.operators import catalog, links
from corpusforge.sources.archives import EXTRACTORS, extract_split, zip_members


def explain(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_file_counts_come_with_the_filter(spark):
    ignored = ["corpus/manual/1.src1/doc1.docx"]
    files = Q.view(spark, SF, "files")
    kept, seen = catalog.observed_filter(files, [Q.IGNORED], ignored)
    rows = kept.select("path").collect()
    assert seen.get == Q.QUERIES["q_file_counts"](spark, SF).first().asDict() and len(rows) == seen.get["n_kept"]
    assert sorted(r.path for r in rows) == sorted(r.path for r in catalog.ignore_filter(files, [Q.IGNORED], ignored).select("path").collect())
    assert explain(spark, kept.select("path")).split("(1)")[1].count("Scan") <= 1


def test_match_metrics_come_with_the_cleaning(spark):
    md = Q.view(spark, SF, "md")
    out, seen = C.observed_clean(md)
    plain = {r.doc_id: r.content for r in C.clean_frame(md).collect()}
    assert {r.doc_id: r.content for r in out.collect()} == plain and out.columns == md.columns
    per = Q.QUERIES["q_match_metrics"](spark, SF).agg(F.sum("n_overview").alias("n"), F.sum("overview_shorter").alias("d"), F.count_if(F.col("n_overview") > 0).alias("docs")).first()
    assert (seen.get["overview_matches"], -seen.get["overview_delta"], seen.get["overview_docs"]) == (per.n, per.d, per.docs)
    total = out.agg(F.sum(F.length("content"))).first()[0] - md.agg(F.sum(F.length("content"))).first()[0]
    assert sum(seen.get[f"{s}_delta"] for s in C.CHAIN) == total
    assert explain(spark, C.observed_clean(md)[0]).split("(1)")[0].count("Scan parquet") == 1


DOCS = [("p", "1.a > X.docx", 1), ("p", "1.a > X.docx 1.a > Y.docx", 2), (None, None, 3), ("q", "none", 4), ("r", "1.a > Y.docx", 5), ("r", "1.a > Y.docx", 6), ("s", "", 7)]


@pytest.mark.parametrize("limit", [0, 16 << 20])
def test_contents_stay_where_they_are(spark, limit):
    docs = spark.createDataFrame(DOCS, "path string, content string, n int")
    known = spark.createDataFrame([("1.a", "X"), ("1.a", "X"), ("2.b", "Z")], "dir string, name string")
    df = links.rewrite_links(docs, known, broadcast_bytes=limit, small_index=0)
    got = {r.n: r.content for r in df.collect()}
    x, y = "[`1.a > X.docx`](/docx/插件详细手册/1.a/（指向）X.md)", "[`1.a > Y.docx`](/docx/插件详细手册/1.a/Y.md)"
    assert {r.n: r.content for r in links.rewrite_links(docs, known).collect()} == got
    assert {r.n: r.content for r in links.rewrite_links(docs, known.limit(0)).collect()}[1] == x.replace("（指向）", "")
    assert got == {1: x, 2: f"{x} {y}", 3: None, 4: "none", 5: y, 6: y, 7: ""} and df.columns == docs.columns
    plan = explain(spark, df)
    if limit:
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    else:
        # Only texts that the filter lets through are shuffled; the others are read apart.
        assert "Union" in plan and "hashpartitioning(__sha" in plan


def test_links_of_all_documents_with_a_small_limit(spark):
    md, pointing = Q.view(spark, SF, "md"), catalog.pointing_rows(Q._rows(spark, SF))
    want = {r.doc_id: r.content for r in links.rewrite_links(md, pointing).collect()}
    for limit in (0, 16 << 20):
        assert {r.doc_id: r.content for r in links.rewrite_links(md, pointing, broadcast_bytes=limit, small_index=0).collect()} == want


def test_filter_loses_nothing(spark, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("d"), F.col("id") % 7).alias("dir"), F.col("id").cast("string").alias("key"))
    half = rows.where("key % 2 = 0")
    for bits in (1 << 24, 1 << 10):
        monkeypatch.setattr(links, "FILTER_BITS", bits)
        filled = links.bloom(half, "dir", "key")
        out = rows.select("key", links.may_hold(filled, F.col("dir"), F.col("key")).alias("may")).collect()
        assert all(r.may for r in out if int(r.key) % 2 == 0)
        wrong = sum(r.may for r in out if int(r.key) % 2)
        assert wrong < 100 or bits == 1 << 10
    assert not any(links.bloom(half.limit(0), "dir", "key"))


@pytest.fixture
def archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(300):
            z.writestr(f"d/{i:03d}.txt", f"text {i} " * (i + 1), zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
        z.mkdir("empty")
        z.writestr("b.txt", b"packed otherwise " * 50, zipfile.ZIP_BZIP2)
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("good", b"g" * 40)
        z.writestr("hurt", b"h" * 40)
    (tmp_path / "hurt.zip").write_bytes(data.getvalue().replace(b"h" * 40, b"x" * 40))
    return tmp_path


def test_members_are_spread_over_tasks(spark, archives):
    paths = spark.createDataFrame([(f"{archives}/{n}.zip",) for n in ("many", "none", "bad", "hurt", "gone")], "path string")
    df = extract_split(paths, tasks=6)
    rows = [(r.path.rsplit("/", 1)[1], r.member, r.content, r.status) for r in df.collect()]
    many = {m: bytes(c) for p, m, c, s in rows if p == "many.zip" and s == "ok"}
    data = (archives / "many.zip").read_bytes()
    assert many == dict(EXTRACTORS[".zip"]("many.zip", data, None)) and len(many) == 301
    rest = {(p, m, s) for p, m, _, s in rows if p != "many.zip"}
    assert rest == {("bad.zip", None, "error"), ("hurt.zip", "good", "ok"), ("hurt.zip", "hurt", "error"), ("gone.zip", None, "error")}
    per = df.where("path LIKE '%many.zip'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per) == 6 and max(r["count"] for r in per) < 100
    assert zip_members(paths.where("path LIKE '%many.zip'")).agg(F.sum("size")).first()[0] == sum(map(len, many.values()))
