"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import chat, exact_dedup, jaccard_join, license_scan, line_dedup, media, mixing, pieces, pii, toxicity

LONG = "word " * 40_000 + "\n" + "x" * 100_000 + "\n" + "é😀" * 20_000
TEXTS = [(1, "Hello idiot world, you idiot."), (2, None), (3, ""), (4, LONG), (5, "same text here for all of us"), (6, "same text here for all of us"), (6, "same text here for all of us"), (None, "no id at all"), (7, " \n\t "), (8, "\x00\x01 ￿ ▁ \\<|im_end|>")]
CLASH = ["id", "node", "kept", "line", "number", "tokens", "score", "part", "sha", "folded", "window", "h", "k", "n"]
OPS = {
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Grammar()),
    "pii": pii.find_pii,
    "pieces": pieces.encode_pieces,
    "mixing": lambda d: mixing.mix(d, mixing.TARGET, mixing.tree_levels(), budget_share=1.0, max_epochs=1),
    "jaccard": lambda d: jaccard_join.jaccard_join(d)[0],
    "exact": exact_dedup.exact_dedup,
    "media": media.text_media,
    "license": license_scan.license_scan,
    "lines": line_dedup.line_dedup,
}


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "src1", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@pytest.mark.parametrize("name", sorted(OPS))
def test_edge_rows(spark, name):
    out = OPS[name](documents(spark)).collect()
    ids = sorted((r.doc_id for r in out), key=lambda x: (x is None, x))
    if name == "mixing":
        assert ids == [1, 3, 4, 5, 6, 6, 7, 8, None]  # 2 is alone in a leaf without tokens
    else:
        assert ids == [1, 2, 3, 4, 5, 6, 6, 7, 8, None]


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, name):
    out = OPS[name](documents(spark, []))
    assert out.collect() == [] and "doc_id" in out.columns


def test_edge_results(spark):
    docs = documents(spark)
    rows = exact_dedup.exact_dedup(docs).collect()
    exact = {(r.doc_id): r for r in rows}
    assert exact[5].group_size == 3 and exact[5].keep_id == 6 and not exact[5].kept and [r.kept for r in rows if r.doc_id == 6].count(True) == 1
    assert exact[2].group_size == 2 and exact[2].keep_id == 3
    assert exact[None].kept and exact[None].keep_id is None
    near = {r.doc_id: r for r in jaccard_join.jaccard_join(docs)[0].collect()}
    assert near[6].class_id == 5 and near[6].copies == 3 and near[6].n_links == 0
    assert near[2].class_id == 2 and near[3].class_id == 3 and near[7].class_id == 7
    lines = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert lines[2].text == "" and lines[2].n_lines == 1 and lines[6].n_dropped == 1 and lines[5].n_dropped == 0
    assert lines[4].text == LONG


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 1, "assistant", "x"), (2, 1, "system", "s<|im_sep|>"), (2, 2, "we\nird", "\\|<|")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, at string, tokens string")
    out = {r.conv_id: r for r in chat.format_chat(df).withColumn("t", chat.parse_chat(F.col("formatted"))).withColumn("l", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out[1].t] == [("", ""), ("assistant", "b"), ("assistant", "b"), ("user", "a")] and out[1].l == ["b", "b"]
    assert [tuple(t) for t in out[2].t] == [("system", "s<|im_sep|>"), ("we\nird", "\\|<|")]
    assert out[None].l == ["x"]
    assert chat.format_chat(df.limit(0)).count() == 0


def stages():
    return pytest.importorskip("corpus_pipeline")


def near(text, k=3):
    words = text.split()
    words[k] = "other"
    return " ".join(words)


A = " ".join(f"w{i}" for i in range(80))
B = " ".join(f"unique{i}" for i in range(70))


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Nulls, empty and long texts, repeats, empty tables and clashing columns."""
    P = stages()
    stage = P.STAGES[k][1]
    extra = documents(spark, [*TEXTS, (9, None), (None, None)]).withColumn("extra", F.lit("e")).withColumn("carried", F.lit(1)).withColumn("row", F.lit("r"))
    sf = "/root/testdata/sf0.001"
    out = stage(spark, extra, sf)
    rows = out.collect()
    if k < 4:
        assert out.columns == extra.columns and dict(out.dtypes) == dict(extra.dtypes)
        assert all(r.extra == "e" and r.carried == 1 and r.row == "r" for r in rows)
    ids = sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))
    want = {
        0: [2, 3, 4, 5, 6, 6, 7, 8, 9, None, None],  # 1 is an insult at somebody
        1: [1, 2, 3, 4, 5, 7, 8, 9, None, None],  # 6 holds only copies
        2: [1, 2, 3, 4, 5, 7, 8, 9, None, None],
        4: [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None, None],
    }
    if k == 3:
        assert set(ids) <= set(want[4]) and ids
    else:
        assert ids == want[k]
    empty = stage(spark, extra.limit(0), sf)
    assert empty.collect() == [] and (k == 4 or empty.columns == extra.columns)


def test_repeated_ids_keep_unique_texts(spark):
    P = stages()
    docs = documents(spark, [(3, A), (5, near(A)), (5, B), (5, B), (None, near(B, 9))])
    one = [(r.doc_id, r.text) for r in P.keep_one_of_similar(spark, docs, "").collect()]
    assert sorted(one) == [(3, A), (5, B)]
    docs = documents(spark, [(5, "alpha beta gamma delta\nfirst line of some words"), (5, "second quite unique line\nalpha beta gamma delta"), (7, "second quite unique line\nlast")])
    two = [(r.doc_id, r.text) for r in P.drop_repeated_lines(spark, docs, "").collect()]
    lines = [x for _, t in two for x in t.split("\n")]
    assert sorted(lines) == ["alpha beta gamma delta", "first line of some words", "last", "second quite unique line"]
    many = documents(spark, [(1, f"text number {i} of this leaf") for i in range(50)])
    kept = [r.text for r in P.mix_sources(spark, many, "").collect()]
    assert len(kept) == len(set(kept)) == 45


def test_line_order_with_null_ids(spark):
    line = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [(2, near(line)), (None, line), (1, line + "\nz")])
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert out == {None: line, 1: "z", 2: ""}


def test_mixing_ties(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (1, "c d"), (2, "")])
    out = mixing.mix(docs, mixing.TARGET, [F.lit("x")], budget_share=1.0, max_epochs=1).collect()
    assert sorted((r.doc_id, r.tokens) for r in out if r.tokens) == [(1, 2), (1, 2), (1, 2)]


def test_heavy_keys(spark, monkeypatch):
    """Heavy keys apart give what a plain join gives."""
    from corpusforge.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HEAVY_KEYS", 5)
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = common.join_heavy(big, small, "k", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    assert common.join_heavy(big.limit(0), small.limit(0), "k", "n").count() == 0
