"""Cleaners: worked examples, quirks, and a plain model on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import cleaners as C
from corpusforge.functions.jstext import HTML_TAGS

WS = "[\\s   -     　﻿]"


def run(spark, name, rows):
    rows = [r if isinstance(r, tuple) else (r, "a/b.md") for r in rows]
    df = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(rows)], "i int, content string, path string").repartition(2)
    out = df.select("i", C.CLEANERS[name](F.col("content"), F.col("path")).alias("o")).collect()
    return [r.o for r in sorted(out, key=lambda r: r.i)]


CASES = [
    ("overview", "### 概述\n\n正文", "#正文"),
    ("overview", "## 概述部分", "部分"),
    ("overview", "##　概述\n\n\nx", "x"),
    ("headings", "### a\n#### b", "## a\n### b"),
    ("headings", "###\n\ntext", "## text"),
    ("headings", "# top\n### a", "# top\n### a"),
    ("headings", "## a", "## a"),
    ("add_h1", ("body", "x\\y/开始.v2.md"), "# 开始.v2\n\nbody"),
    ("add_h1", ("# C# guide", "a/b.md"), "# b\n\n# C# guide"),
    ("add_h1", ("#\n\nfoo", "a/b.md"), "#\n\nfoo"),
    ("add_h1", ("body", None), "body"),
    ("tags", "<p小>", "<p小>"),
    ("tags", "<h7> <BR> <br> <h1:2>", "`<h7>` `<BR>` <br> <h1:2>"),
    ("tags", "<><>", "`<>``<>`"),
    ("tags", "<Y>a<Z>", "<Y>a<Z>"),
    ("tags", "`<ok>` </x> <a b> <a-b> List<String>", "`<ok>` </x> <a b> <a-b> List<String>"),
    ("tags", "<x　y> <单选:A:B>", "<x　y> `<单选:A:B>`"),
    ("structs", "@type struct<Foo> `@type struct<Bar>`", "`@type struct<Foo>` `@type struct<Bar>`"),
    ("summary_stars", "a**小结\\*\\*b", "ab"),
    ("colon_stars", "说：**x** 说： **y", "说：** x** 说： **y"),
    ("colon_stars", "：** x", "：**  x"),
    ("anchors", "a[]{#id .anchor}b[]{#x\n.anchor}", "ab"),
    ("dimensions", 'i{width="1in"\nheight="2in"}j', "ij"),
]


@pytest.mark.parametrize("name, given, want", CASES)
def test_case(spark, name, given, want):
    assert run(spark, name, [given]) == [want]


MODEL = {
    "overview": lambda t: re.sub(f"##{WS}*概述{WS}*\n?", "", t),
    "headings": lambda t: t if re.search(rf"(?m)^#{WS}+[^#\n]+$", t) else re.sub(rf"(?m)^(#{{3,}}){WS}+(.+)$", lambda m: m[1][1:] + " " + m[2], t),
    "tags": lambda t: re.sub(rf"(?<![`\w])<(?!/)(?!(?:{'|'.join(HTML_TAGS)})\b)[^<>/\s　]*>(?![`\w])", lambda m: f"`{m[0]}`", t, flags=re.ASCII),
    "structs": lambda t: re.sub(rf"(?<!`)(@type{WS}+struct<[^>]*>)(?!`)", lambda m: f"`{m[1]}`", t),
    "summary_stars": lambda t: t.replace("**小结\\*\\*", ""),
    "colon_stars": lambda t: t.replace("：**", "：** "),
}


@pytest.mark.parametrize("name", sorted(MODEL))
def test_model_on_random_texts(spark, name):
    rng = random.Random(name)
    bits = ["#", "##", " ", "\n", "<", ">", "`", "p", "br", "Foo", "概述", "*", "**", "：", "小结", "\\*", "@type", "struct", "　", "x", "/", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert run(spark, name, texts) == [MODEL[name](t) for t in texts]


def test_chain_order_and_registry(spark):
    df = spark.createDataFrame([("### 概述\n### a\n：**b", "d/t.md")], "content string, path string")
    want = "# t\n\n### a\n：** b"  # the overview leaves "####", which is then shifted
    assert df.select(C.clean(F.col("content"), F.col("path"))).first()[0] == want
    assert C.clean_frame(df).first().content == want
    C.register("upper", lambda c, p: F.upper(c))
    assert C.clean_frame(df, chain=["upper"]).first().content.endswith("：**B")
    del C.CLEANERS["upper"]


def test_counts_and_samples(spark):
    df = spark.createDataFrame([("<A> <B> <A> <C> <D>",)], "content string")
    row = df.select(C.match_count(F.col("content"), "tags"), C.distinct_matches(F.col("content"), "tags"), C.first_matches(F.col("content"), "tags")).first()
    assert list(row) == [5, ["<A>", "<B>", "<C>", "<D>"], ["<A>", "<B>", "<C>"]]


def test_text_to_markdown(spark):
    df = spark.createDataFrame([(" a \r\n\r\n　b﻿\n \n", "x/n.TXT"), ("", "x/n.txt")], "c string, p string")
    assert [r[0] for r in df.select(C.text_to_markdown(F.col("c"), F.col("p"))).collect()] == ["# n.TXT\n\na\n\nb", "# n\n\n"]


def test_long_text_and_blanks(spark):
    long = "<" * 50_000 + "x>" + "：**" * 1000
    assert run(spark, "tags", [long])[0].count("`<x>`") == 1
    assert run(spark, "blanks", ["\n\na  \n\n\n\nb\r\n", ""]) == ["a\n\nb\n", ""]


def test_length_deltas(spark):
    row = C.length_deltas(spark.createDataFrame([("## 概述\n<A>：**", "d/t.md")], "content string, path string")).first()
    assert (row.overview_delta, row.headings_delta, row.add_h1_delta, row.tags_delta, row.colon_stars_delta) == (-6, 0, 5, 2, 1)
