"""Registered queries over decorated views of the test tables, and their SQL.

The raw texts match none of the cleaners' patterns, so the views add headings,
tags, links and names to whole texts' rows by fixed rules; the same SQL text
makes them in Spark and in DuckDB. The oracles use no lookaround (DuckDB's
engine has none): they split texts and look at the pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleaners as C
from .functions import names as N
from .functions.batches import pieces, small_batches
from .functions.jstext import HTML_TAGS, WS_INNER_RE2, WS_RE2
from .operators import catalog, images, links, plugins, renames, targets, tree
from .plans.build import Built, all_errors, clean_checked, clean_documents, collisions, office_documents, overwritten, report
from .plans.organize import plan_dirty, plan_extractions, plan_organize, plan_targets, plan_volumes
from .sources import listing
from .plans.shared import kept, make, remove, shared_folder
from .plans.write import manifest_of, remove_written, write_corpus
from .sources.archives import EXTRACTORS, extract, extract_split, register_extractor
from .sources.config import OrganizeConfig
from .sources.docx import docx_to_html
from .sources.html import pages_to_markdown
from .sources.tree_source import read_tree

FILES = """SELECT doc_id, root || '/' || dir || '/' || base || '.' || ext AS path, dir, base AS name, base || '.' || ext AS file, ext FROM (
 SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'corpus/node_modules' ELSE 'corpus/manual' END AS root,
  CAST(doc_id % 30 AS STRING) || '.' || source AS dir,
  CASE WHEN doc_id % 11 = 0 THEN '~$' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '（指向）' ELSE '' END || 'doc' || CAST(doc_id AS STRING) AS base,
  CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'docx' ELSE 'doc' END AS ext FROM documents) q"""
MD = """SELECT doc_id, 'docs/docx/manual/' || CAST(doc_id % 30 AS STRING) || '.' || source || '/' || CASE doc_id % 17 WHEN 0 THEN '.md' WHEN 1 THEN 'doc.' ELSE 'doc' || CAST(doc_id AS STRING) || '.md' END AS path,
 CASE WHEN doc_id % 7 = 0 THEN '# 标题' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN '### 概述' ELSE '## 概述' END || chr(10) || chr(10)
 || '### ' || lang || ' ' || source || chr(10) || '#### 小节' || chr(10) || coalesce(text, '') || chr(10)
 || '<' || lang || '> <br> <单选:' || CAST(doc_id AS STRING) || ':A:B> List<String> <p小> `<ok>` <>' || chr(10)
 || '@type struct<' || source || '>' || chr(10)
 || CASE WHEN doc_id % 3 = 0 THEN '**小结' || chr(92) || '*' || chr(92) || '*' || chr(10) ELSE '' END
 || '说明：**' || lang || '**' || chr(10)
 || '参考 ' || CAST(doc_id % 30 AS STRING) || '.' || source || ' > doc' || CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS STRING) || '.docx。' || chr(10)
 || '[]{#' || lang || ' .anchor}{width="1in"' || chr(10) || 'height="2in"}' || chr(10) AS content FROM documents"""
_PAD = "CASE WHEN p_partkey < 10 THEN '00' WHEN p_partkey < 100 THEN '0' ELSE '' END || CAST(p_partkey AS STRING)"
ENTRIES = f"""SELECT * FROM (SELECT p_partkey AS number, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS STRING) || '.gz' WHEN 1 THEN {_PAD} || '.zip' WHEN 2 THEN CAST(p_partkey AS STRING)
 WHEN 3 THEN {_PAD} || 'tu' WHEN 4 THEN {_PAD} || ' NO.' || CAST(p_partkey AS STRING) ELSE CAST(p_partkey AS STRING) || 'x.7z' END AS name,
 CASE WHEN p_partkey % 6 IN (2, 3, 4) THEN 'dir' ELSE 'file' END AS kind FROM part
 UNION ALL SELECT p_partkey, {_PAD} || '.7z', 'file' FROM part WHERE p_partkey % 12 = 2) q"""
TREE = """SELECT DISTINCT l_orderkey AS root, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber % 2 = 0 THEN '/a' WHEN l_linenumber % 5 = 0 THEN '/a/b.zip' ELSE '/a/c' END AS dir,
 CASE WHEN l_returnflag = 'R' THEN 'set.7z.00' || CAST(l_linenumber AS STRING) WHEN l_linenumber = 4 THEN 'junk.url' ELSE 'img' || CAST(l_linenumber % 3 AS STRING) || '.jpg' END AS name FROM lineitem"""
#: Trees with files named like numbered ones.
TAKEN = """SELECT DISTINCT l_orderkey AS root, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber % 2 = 0 THEN '/a' ELSE '/a/c' || CAST(l_linenumber AS STRING) END AS dir,
 CASE WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'img0-1.jpg' ELSE 'img0.jpg' END ELSE 'img' || CAST(l_linenumber % 2 AS STRING) || '.jpg' END AS name FROM lineitem"""
IMAGES = """SELECT l_orderkey AS doc_id, 'Doc: ' || CAST(l_orderkey AS STRING) || '/v?.' AS doc_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos,
 CASE l_returnflag WHEN 'A' THEN 'image/png' WHEN 'N' THEN 'image/jpeg' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'image/x-emf' WHEN l_linenumber % 3 = 1 THEN 'bmp' ELSE 'image/tiff' END END AS content_type,
 CASE WHEN l_linestatus = 'O' AND l_linenumber % 4 = 0 THEN 4 ELSE 400 END AS b64_len FROM lineitem"""
_SOURCES = {"taken": (TAKEN, "lineitem"), "files": (FILES, "documents"), "md": (MD, "documents"), "entries": (ENTRIES, "part"), "tree": (TREE, "lineitem"), "images": (IMAGES, "lineitem")}
#: The same with its rows repeated, for what does not mind them.
_SOURCES["tree_rows"] = (TREE.replace("SELECT DISTINCT", "SELECT", 1), "lineitem")
IGNORED = "corpus/node_modules"
IGNORED_DIRTY = ["junk"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A decorated view as a DataFrame."""
    sql, source = _SOURCES[name]
    braced = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(braced, source=_table(spark, sf_dir, source))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with(*names: str, **more: str) -> str:
    # Worked out once: a view that is read in a subquery is else made for each look.
    parts = [f"fx_{n} AS MATERIALIZED ({_SOURCES[n][0]})" for n in names] + [f"{k} AS MATERIALIZED ({v})" if k == "sets" else f"{k} AS ({v})" for k, v in more.items()]
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- texts ---------------------------------------------------------------------

_TRIM = f"regexp_replace(x, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


@query("q_txt_md", f"""SELECT doc_id, '# doc' || CAST(doc_id AS STRING) || chr(10) || chr(10) || array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: {_TRIM}), lambda x: x <> ''), chr(10) || chr(10)) AS content FROM documents""")
def txt_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("corpus/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select("doc_id", C.text_to_markdown(F.coalesce("text", F.lit("")), path).alias("content"))


_H1_SQL = f"regexp_matches(content, '(?m)^#{WS_RE2}+[^#\\n]+$')"
_STEM_SQL = r"regexp_extract(path, '([^/]*?)(\.[^./]+)?$', 1)"
_TAGS_SQL = "[" + ", ".join(f"'{t}'" for t in HTML_TAGS) + "]"
_WORD = "[`A-Za-z0-9_]"
#: Cleaner -> SQL of its result; ``content`` and ``path`` are columns.
STEPS = {
    "anchors": r"regexp_replace(content, '\[\]\{#[^\n}]+(\n)?\.anchor\}', '', 'g')",
    "dimensions": rf"""regexp_replace(content, '\{{width="[^"]*"{WS_RE2}+.*?height="[^"]*"\}}', '', 'g')""",
    "overview": rf"regexp_replace(content, '##{WS_RE2}*概述{WS_RE2}*\n?', '', 'g')",
    "headings": rf"CASE WHEN {_H1_SQL} THEN content ELSE regexp_replace(content, '(?m)^#(#{{2,}}){WS_RE2}+(.+)$', '\1 \2', 'g') END",
    "add_h1": f"CASE WHEN {_H1_SQL} THEN content ELSE '# ' || {_STEM_SQL} || chr(10) || chr(10) || content END",
    "tags": f"""(SELECT a[1] || array_to_string(list_transform(range(2, len(a) + 1), lambda k:
        CASE WHEN contains(a[k], '>') AND NOT regexp_matches(string_split(a[k], '>')[1], '[{WS_INNER_RE2}/]')
              AND NOT regexp_matches(right(a[k - 1], 1), '{_WORD}') AND NOT regexp_matches(substr(a[k], length(string_split(a[k], '>')[1]) + 2, 1), '{_WORD}')
              AND NOT list_contains({_TAGS_SQL}, regexp_extract(string_split(a[k], '>')[1], '^[A-Za-z0-9_]*'))
             THEN '`<' || string_split(a[k], '>')[1] || '>`' || substr(a[k], length(string_split(a[k], '>')[1]) + 2)
             ELSE '<' || a[k] END), '') FROM (SELECT string_split(content, '<') AS a))""",
    "structs": f"""(SELECT a[1] || array_to_string(list_transform(range(2, len(a) + 1), lambda k:
        CASE WHEN regexp_matches(a[k], '^{WS_RE2}+struct<[^>]*>') AND right(a[k - 1], 1) <> '`'
              AND substr(a[k], length(regexp_extract(a[k], '^{WS_RE2}+struct<[^>]*>')) + 1, 1) <> '`'
             THEN '`@type' || regexp_extract(a[k], '^{WS_RE2}+struct<[^>]*>') || '`' || substr(a[k], length(regexp_extract(a[k], '^{WS_RE2}+struct<[^>]*>')) + 1)
             ELSE '@type' || a[k] END), '') FROM (SELECT string_split(content, '@type') AS a))""",
    "summary_stars": "replace(content, '**小结' || chr(92) || '*' || chr(92) || '*', '')",
    "colon_stars": "replace(content, '：**', '：** ')",
}


def _cleaner(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, "md").select("doc_id", C.CLEANERS[name](F.col("content"), F.col("path")).alias("content"))

    return run


for _query, _name in {"q_anchor": "anchors", "q_dimension": "dimensions", "q_strip_overview": "overview", "q_heading_shift": "headings", "q_add_h1": "add_h1", "q_quote_tags": "tags", "q_quote_struct": "structs", "q_summary_star": "summary_stars", "q_colon_star": "colon_stars"}.items():
    query(_query, _with("md") + f"SELECT doc_id, {STEPS[_name]} AS content FROM fx_md")(_cleaner(_name))


# --- catalog and links -----------------------------------------------------------

_CATALOG = "SELECT dir, regexp_extract(file, '^(.*)\\.[^.]*$', 1) AS name FROM fx_files"
_POINTING = "SELECT dir, CASE WHEN contains(name, '（指向）') THEN substr(name, 1, instr(name, '（指向）') - 1) || substr(name, instr(name, '（指向）') + 4) END AS name FROM cat WHERE contains(name, '（指向）')"
_LINK = links.LINK.replace("\\s", "\\s\\x{000B}")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_rows(view(spark, sf_dir, "files"))


@query("q_catalog", _with("files", cat=_CATALOG) + "SELECT dir, string_agg(name, '|' ORDER BY name) AS names FROM cat GROUP BY dir")
def q_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(_rows(spark, sf_dir)).select("dir", F.array_join("names", "|").alias("names"))


@query("q_pointing", _with("files", cat=_CATALOG, pnt=_POINTING) + "SELECT dir, string_agg(name, '|' ORDER BY name) AS names FROM pnt GROUP BY dir")
def q_pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog(catalog.pointing_rows(_rows(spark, sf_dir))).select("dir", F.array_join("names", "|").alias("names"))


@query("q_catalog_counts", _with("files", cat=_CATALOG, pnt=_POINTING) + "SELECT (SELECT count(DISTINCT dir) FROM cat) AS n_dirs, (SELECT count(*) FROM cat) AS n_names, (SELECT count(DISTINCT dir) FROM pnt) AS n_pointing_dirs, (SELECT count(*) FROM pnt) AS n_pointing")
def q_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_counts(_rows(spark, sf_dir))


_MENTIONS = f"""SELECT doc_id, path, i - 1 AS seq, regexp_extract(m[i], '{_LINK}', 1) AS dir, regexp_extract(m[i], '{_LINK}', 2) AS name
    FROM (SELECT doc_id, path, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, path, regexp_extract_all(content, '{_LINK}') AS m FROM @src@))"""
_RESOLVED = "SELECT DISTINCT k.doc_id, k.seq, k.dir, k.name, p.name IS NOT NULL AS pointing FROM mentions k LEFT JOIN pnt p ON p.dir = k.dir AND p.name = k.name"
_LINK_CTES = {"cat": _CATALOG, "pnt": _POINTING, "mentions": _MENTIONS.replace("@src@", "fx_md"), "resolved": _RESOLVED}


@query("q_link_extract", _with("files", "md", **_LINK_CTES) + f"SELECT doc_id, CAST(seq AS INT) AS seq, dir, name, pointing, '{links.BASE}/' || dir || '/' || CASE WHEN pointing THEN '（指向）' ELSE '' END || name || '.md' AS target FROM resolved")
def q_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(view(spark, sf_dir, "md"), catalog.pointing_rows(_rows(spark, sf_dir)), keys=("doc_id",))


def _rewrite_sql(src: str) -> str:
    shown = f"'[`' || r.dir || ' > ' || r.name || '.docx`]({links.BASE}/' || r.dir || '/' || CASE WHEN r.pointing THEN '（指向）' ELSE '' END || r.name || '.md)'"
    return f"""SELECT d.doc_id, string_agg(d.gap || coalesce({shown}, ''), '' ORDER BY d.i) AS content
        FROM (SELECT doc_id, i - 1 AS i, g[i] AS gap FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, string_split_regex(content, '{_LINK}') AS g FROM {src}))) d
        LEFT JOIN resolved r ON r.doc_id = d.doc_id AND r.seq = d.i GROUP BY d.doc_id"""


@query("q_link_rewrite", _with("files", "md", **_LINK_CTES) + _rewrite_sql("fx_md"))
def q_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rewrite_links(view(spark, sf_dir, "md"), catalog.pointing_rows(_rows(spark, sf_dir))).select("doc_id", "content")


@query("q_dangling_links", _with("files", "md", **_LINK_CTES) + "SELECT doc_id, CAST(seq AS INT) AS seq, dir, name FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.dir = r.dir AND c.name = CASE WHEN r.pointing THEN '（指向）' ELSE '' END || r.name)")
def q_dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    found = links.extract_links(view(spark, sf_dir, "md"), catalog.pointing_rows(rows), keys=("doc_id",))
    return links.dangling_links(found, rows).select("doc_id", "seq", "dir", "name")


def _chain_ctes() -> dict[str, str]:
    out, src = {}, "fx_md"
    for i, name in enumerate(C.CHAIN):
        out[f"step{i}"] = f"SELECT doc_id, path, {STEPS[name]} AS content FROM {src}"
        src = f"step{i}"
    return out | {"cat": _CATALOG, "pnt": _POINTING, "mentions": _MENTIONS.replace("@src@", src), "resolved": _RESOLVED}


@query("q_clean_chain", _with("files", "md", **_chain_ctes()) + _rewrite_sql(f"step{len(C.CHAIN) - 1}"))
def q_clean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(view(spark, sf_dir, "md"), catalog.pointing_rows(_rows(spark, sf_dir))).select("doc_id", "content")


# Plug-ins of the queries below: one rewrites, one fails by what a text holds.
def _mark_starts(text: str | None, path: str | None) -> str | None:
    return text if text is None else text.replace("the ", "the* ")


def _even_words(text: str | None, path: str | None) -> str | None:
    if text is not None and text.count("the*") % 4 == 3:
        raise ValueError(f"{text.count('the*')} marks in {(path or '').rsplit('/', 1)[-1]}")
    return text


plugins.register_plugin("mark_starts", _mark_starts)
plugins.register_plugin("even_words", _even_words)
CHECKED = ("overview", "mark_starts", "even_words", "headings", "add_h1", "colon_stars")
_MARKED = f"replace({STEPS['overview']}, 'the ', 'the* ')"
_MARKS = "(length(marked) - length(replace(marked, 'the*', ''))) // 4"


def _checked_ctes() -> dict[str, str]:
    out = {"marks": f"SELECT *, {_MARKS} AS n FROM (SELECT doc_id, path, content AS original, {_MARKED} AS marked FROM fx_md)", "step0": "SELECT doc_id, path, marked AS content FROM marks WHERE n % 4 <> 3"}
    for i, name in enumerate(CHECKED[3:], 1):
        out[f"step{i}"] = f"SELECT doc_id, path, {STEPS[name]} AS content FROM step{i - 1}"
    return out | {"cat": _CATALOG, "pnt": _POINTING, "mentions": _MENTIONS.replace("@src@", "step3"), "resolved": _RESOLVED}


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    good, bad = clean_checked(view(spark, sf_dir, "md"), catalog.pointing_rows(_rows(spark, sf_dir)), CHECKED)
    return good, bad


@query("q_plugin_chain", _with("files", "md", **_checked_ctes()) + f"SELECT doc_id, content FROM ({_rewrite_sql('step3')}) UNION ALL SELECT doc_id, original FROM marks WHERE n % 4 = 3")
def q_plugin_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column cleaners and plug-ins in one chain; documents that one fails on stay as they were."""
    return _checked(spark, sf_dir)[0].select("doc_id", "content")


@query("q_plugin_errors", _with("files", "md", **_checked_ctes()) + "SELECT path, 'clean even_words' AS stage, CAST(n AS STRING) || ' marks in ' || regexp_extract(path, '([^/]*)$', 1) AS error FROM marks WHERE n % 4 = 3")
def q_plugin_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1]


@query("q_match_metrics", _with("md") + rf"""SELECT doc_id, len(regexp_extract_all(content, '##{WS_RE2}*概述{WS_RE2}*\n?')) AS n_overview, len(regexp_extract_all(content, '(?m)^#(#{{2,}}){WS_RE2}+(.+)$')) AS n_headings,
    len(regexp_extract_all(content, '@type{WS_RE2}+struct<[^>]*>')) AS n_structs, len(regexp_extract_all(content, '：\*\*')) AS n_colon_stars, (length(content) - length(replace(content, '**小结' || chr(92) || '*' || chr(92) || '*', ''))) // 8 AS n_summary_stars,
    len(content) - len({STEPS["overview"]}) AS overview_shorter FROM fx_md""")
def q_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = view(spark, sf_dir, "md")
    c = F.col("content")
    counts = [C.match_count(c, n).alias(f"n_{n}") for n in ("overview", "headings", "structs", "colon_stars", "summary_stars")]
    return md.select("doc_id", *counts, (F.length(c) - F.length(C.strip_overview(c, F.col("path")))).cast("long").alias("overview_shorter"))


# --- listings ---------------------------------------------------------------------


@query("q_ignore_filter", _with("files") + f"SELECT doc_id, path FROM fx_files WHERE path <> '{IGNORED}' AND NOT starts_with(path, '{IGNORED}/') AND NOT starts_with(file, '~$') AND path <> 'corpus/manual/1.src1/doc1.docx'")
def q_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ignore_filter(view(spark, sf_dir, "files"), [IGNORED], ["corpus/manual/1.src1/doc1.docx"]).select("doc_id", "path")


@query("q_target_path", _with("files") + r"SELECT doc_id, 'docs/docx' || regexp_replace(substr(path, 7), '\.[^./]*$', '.md') AS target FROM fx_files")
def q_target_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("doc_id", N.target_path(F.col("path"), "corpus", "docs/docx").alias("target"))


_SAFE = rf"""substr(regexp_replace(regexp_replace(doc_name, '[<>:"/\\|?*{WS_INNER_RE2}]+', '_', 'g'), '\.+$', ''), 1, 50)"""


@query("q_sanitize", _with("images") + f"SELECT DISTINCT doc_name, {_SAFE} AS safe FROM fx_images")
def q_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "images").select("doc_name").distinct().select("doc_name", N.safe_name(F.col("doc_name")).alias("safe"))


_NAMED = f"""SELECT doc_id, CAST(pos AS INT) AS seq, k AS image_type, {_SAFE} AS safe, b64_len,
    {_SAFE} || '-' || printf('%03d', pos) || '.' || CASE WHEN k = 'jpeg' THEN 'jpg' WHEN k IN ('png', 'jpg') THEN k ELSE 'png' END AS name,
    CASE WHEN k IN ('x-emf', 'gif', 'wmf', 'emf') THEN 'unsupported' WHEN b64_len < 10 THEN 'empty' ELSE 'ok' END AS status
    FROM (SELECT *, CASE WHEN contains(content_type, '/') THEN string_split(content_type, '/')[2] ELSE 'png' END AS k FROM fx_images)"""


@query("q_image_names", _with("images", named=_NAMED) + f"SELECT doc_id, seq, image_type, name, status, CASE WHEN status = 'ok' THEN './images/' || safe || '/' || name ELSE '{images.PLACEHOLDER}' END AS src FROM named")
def q_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.name_images(view(spark, sf_dir, "images"))


@query("q_image_types", _with("images", named=_NAMED) + "SELECT string_agg(DISTINCT image_type, ',' ORDER BY image_type) AS types FROM named WHERE status <> 'unsupported'")
def q_image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_types(view(spark, sf_dir, "images")).select(F.array_join("types", ",").alias("types"))


# --- trees ------------------------------------------------------------------------

_ARCHIVE = r"regexp_matches({0}, '(?i).\.(?:gz|zip|7z)$|(?i)\.7z\.[0-9]+$')"
_SUFFIX = r"regexp_extract(name, '^(.+?)(\.[^.]*)?$', {0})"


@query("q_archive_select", _with("entries") + f"SELECT name, {_ARCHIVE.format('name')} AS archive, {_SUFFIX.format(1)} AS stem FROM fx_entries WHERE kind = 'file' AND lower({_SUFFIX.format(2)}) IN ('.gz', '.zip', '.7z') AND regexp_matches({_SUFFIX.format(1)}, '^[0-9]+$')")
def q_archive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return targets.select_archives(view(spark, sf_dir, "entries")).select("name", N.is_archive(name).alias("archive"), N.file_stem(name).alias("stem"))


_TARGETS = """SELECT number, CASE WHEN rank <= 6 THEN 'decompress' ELSE 'organize' END AS phase, '/base/' || name AS full_path, name FROM (
    SELECT number, name, rank, row_number() OVER (PARTITION BY number ORDER BY rank, name) AS rn FROM (
        SELECT w.number, e.name, CASE
            WHEN kind = 'file' AND e.name = w.bare || '.gz' THEN 1 WHEN kind = 'file' AND e.name = w.full_ || '.gz' THEN 2
            WHEN kind = 'file' AND e.name = w.bare || '.zip' THEN 3 WHEN kind = 'file' AND e.name = w.full_ || '.zip' THEN 4
            WHEN kind = 'file' AND e.name = w.bare || '.7z' THEN 5 WHEN kind = 'file' AND e.name = w.full_ || '.7z' THEN 6
            WHEN kind = 'dir' AND e.name = w.bare THEN 7 WHEN kind = 'dir' AND e.name = w.full_ THEN 8
            WHEN kind = 'dir' AND NOT contains(e.name, 'NO.') THEN 9 END AS rank
        FROM (SELECT i AS number, CAST(i AS STRING) AS bare, printf('%03d', i) AS full_ FROM (SELECT unnest(range(min(number), max(number) + 1)) AS i FROM fx_entries)) w
        JOIN fx_entries e ON regexp_extract(e.name, '^[0-9]*') IN (w.bare, w.full_)) WHERE rank IS NOT NULL) WHERE rn = 1"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "entries")
    ends = entries.agg(F.min("number").alias("a"), F.max("number").alias("z")).first()
    return targets.detect_targets(targets.number_range(spark, ends.a, ends.z), entries, "/base")


query("q_range_targets", _with("entries") + _TARGETS)(_targets)


@query("q_phase_counts", _with("entries", found=_TARGETS) + "SELECT phase, count(*) AS n FROM found GROUP BY phase")
def q_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.phase_counts(_targets(spark, sf_dir))


@query("q_dirty", _with("tree") + f"SELECT root, dir, name FROM fx_tree WHERE name = 'junk' OR {_SUFFIX.format(1)} = 'junk'")
def q_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dirty_files(view(spark, sf_dir, "tree"), spark.createDataFrame([(n,) for n in IGNORED_DIRTY], "name string"))


_SETS = r"""SELECT root, dir, regexp_replace(min(name), '\.7z\.[0-9]+$', '') AS base, string_agg(name, ',' ORDER BY name) AS files FROM (
    SELECT *, dense_rank() OVER (PARTITION BY root ORDER BY dir) AS r FROM fx_tree WHERE regexp_matches(name, '\.7z\.[0-9]+$')) WHERE r = 1 GROUP BY root, dir"""


@query("q_volume_sets", _with("tree") + _SETS)
def q_volume_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.volume_sets(view(spark, sf_dir, "tree")).select("root", "dir", "base", F.array_join("files", ",").alias("files"))


#: Every file with the first directory of its tree that holds volumes, and the base of
#: the first volume of its own directory; windows alone, as a join is not needed.
_HELD = r"""SELECT root, dir, name, volume, min(CASE WHEN volume THEN dir END) OVER (PARTITION BY root) AS held, regexp_replace(min(CASE WHEN volume THEN name END) OVER (PARTITION BY root, dir), '\.7z\.[0-9]+$', '') AS base
    FROM (SELECT *, regexp_matches(name, '\.7z\.[0-9]+$') AS volume FROM fx_tree)"""


@query("q_nonvolume", _with("tree", sets=_HELD) + "SELECT root, dir, name FROM sets WHERE dir = held AND NOT starts_with(name, base || '.7z.')")
def q_nonvolume(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "tree")
    return tree.non_volume_files(files, tree.volume_sets(files))


_UNIQUE = f"""SELECT root, dir, name, CASE WHEN n = 0 THEN name ELSE {_SUFFIX.format(1)} || '-' || CAST(n AS STRING) || {_SUFFIX.format(2)} END AS dest
    FROM (SELECT *, row_number() OVER (PARTITION BY root, name ORDER BY dir <> '', dir) - 1 AS n FROM fx_tree {{where}})"""


@query("q_unique_names", _with("tree") + _UNIQUE.format(where=""))
def q_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.unique_names_exact(view(spark, sf_dir, "tree"))


_TAKEN = f"""SELECT root, dir, name, CASE WHEN n = 0 THEN name ELSE {_SUFFIX.format(1)} || '-' || CAST(n + CASE WHEN name = 'img0.jpg' AND numbered THEN 1 ELSE 0 END AS STRING) || {_SUFFIX.format(2)} END AS dest
    FROM (SELECT *, row_number() OVER (PARTITION BY root, name ORDER BY dir <> '', dir) - 1 AS n, bool_or(name = 'img0-1.jpg') OVER (PARTITION BY root) AS numbered FROM fx_taken)"""


@query("q_unique_names_taken", _with("taken") + _TAKEN)
def q_unique_names_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.unique_names_exact(view(spark, sf_dir, "taken"))


@query("q_flatten_moves", _with("tree") + f"SELECT * FROM ({_UNIQUE.format(where='WHERE NOT ' + _ARCHIVE.format('name') + chr(32) + 'OR dir = ' + repr(''))}) WHERE dir <> ''")
def q_flatten_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.flatten_moves(view(spark, sf_dir, "tree"))


_DIRS = "SELECT DISTINCT root, unnest(CASE WHEN dir = '' THEN []::VARCHAR[] WHEN dir = '/a' THEN ['/a'] ELSE ['/a', dir] END) AS dir FROM fx_tree"
#: A directory keeps itself iff some plain file below it has only plainly named directories strictly between.
_KEEPS = f"""SELECT d.root, d.dir FROM dirs d WHERE EXISTS (SELECT 1 FROM fx_tree f WHERE f.root = d.root AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/')) AND NOT {_ARCHIVE.format('f.name')}
    AND NOT EXISTS (SELECT 1 FROM dirs b WHERE b.root = d.root AND starts_with(b.dir, d.dir || '/') AND (f.dir = b.dir OR starts_with(f.dir, b.dir || '/')) AND {_ARCHIVE.format("regexp_extract(b.dir, '[^/]*$')")}))"""


@query("q_prune_dirs", _with("tree", dirs=_DIRS, keeps=_KEEPS) + "SELECT d.root, d.dir FROM dirs d WHERE EXISTS (SELECT 1 FROM dirs u WHERE u.root = d.root AND (u.dir = d.dir OR starts_with(d.dir, u.dir || '/')) AND NOT EXISTS (SELECT 1 FROM keeps k WHERE k.root = u.root AND k.dir = u.dir))")
def q_prune_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.pruned_dirs(view(spark, sf_dir, "tree"))


_PER = """SELECT root, dir, sum(d) AS n_dirs, sum(f) AS n_files, min(CASE WHEN d = 1 THEN name END) AS child FROM (
    SELECT root, dir, name, 0 AS d, 1 AS f FROM fx_tree UNION ALL SELECT root, regexp_replace(dir, '/[^/]*$', ''), regexp_extract(dir, '[^/]*$'), 1, 0 FROM dirs) GROUP BY ALL"""
_DOWN = """SELECT DISTINCT root, '' AS dir, NULL::VARCHAR AS detected, 0 AS depth FROM fx_tree
    UNION ALL SELECT w.root, w.dir || '/' || p.child, CASE WHEN p.n_files = 0 THEN p.child ELSE coalesce(w.detected, p.child) END, w.depth + 1
    FROM walk w JOIN per p ON p.root = w.root AND p.dir = w.dir LEFT JOIN per s ON s.root = w.root AND s.dir = w.dir || '/' || p.child
    WHERE p.n_dirs = 1 AND (p.n_files = 0 OR coalesce(s.n_files, 0) > 0)"""


@query("q_deepest_dir", _with("tree", dirs=_DIRS, per=_PER, walk=_DOWN) + "SELECT root, dir, coalesce(detected, '') AS detected FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth DESC) AS r FROM walk) WHERE r = 1")
def q_deepest_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.deepest_dirs_of(view(spark, sf_dir, "tree_rows"))
    return found.select("root", "dir", F.coalesce("detected", F.lit("")).alias("detected"))


@query("q_blanks", r"""SELECT doc_id, CASE WHEN c = '' THEN c ELSE c || chr(10) END AS content FROM (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS c FROM documents)""")
def q_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", C.normalise_blanks(F.coalesce("text", F.lit(""))).alias("content"))


def _zip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of whole texts, by the rest of the id: zip, gzip, and two that nothing reads."""

    def run(batches):
        import gzip
        import io
        import zipfile

        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = io.BytesIO()
                if path.endswith(".zip"):
                    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("a/b.txt", text)
                out.append(file.getvalue() if path.endswith(".zip") else gzip.compress(text.encode()) if path.endswith(".gz") else b"?")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    ext = F.element_at(F.array(*map(F.lit, ("zip", "gz", "7z", "tar"))), (F.col("doc_id") % 4 + 1).cast("int"))
    texts = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "path string, content binary")


@query("q_extract", """SELECT 'd/' || doc_id || '.' || ext AS path, CASE ext WHEN 'zip' THEN 'a/b.txt' WHEN 'gz' THEN doc_id::VARCHAR ELSE '' END AS member, CASE WHEN ext IN ('zip', 'gz') THEN 'ok' ELSE 'unsupported' END AS status,
    CASE WHEN ext IN ('zip', 'gz') THEN sha256(coalesce(text, '')) ELSE '' END AS sha FROM (SELECT *, ['zip', 'gz', '7z', 'tar'][doc_id % 4 + 1] AS ext FROM documents)""")
def q_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_zip_files(spark, sf_dir))
    return out.select("path", F.coalesce("member", F.lit("")).alias("member"), "status", F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha"))


# --- pages and errors ------------------------------------------------------------------


@query("q_html_md")
def q_html_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_markdown(_table(spark, sf_dir, "pages"), key="page_id").select("page_id", "content", "error")


#: Word-processor files of the view that hold no document: an empty archive, or none.
_OFFICE = "SELECT path, CASE WHEN doc_id % 4 = 0 THEN '\"There is no item named ''word/document.xml'' in the archive\"' ELSE 'File is not a zip file' END AS error, ext FROM fx_files WHERE ext IN ('doc', 'docx') AND NOT starts_with(file, '~$')"


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.unhex(F.lit("504B0506" + "00" * 18))
    files = view(spark, sf_dir, "files").where(F.col("ext").isin("doc", "docx"))
    return files.select("path", "ext", F.when(F.col("doc_id") % 4 == 0, empty).otherwise(F.lit("old").cast("binary")).alias("content"))


@query("q_errors", _with("files", office=_OFFICE) + "SELECT 'docx' AS stage, path, error FROM office")
def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors that the builder's readers give, of two runs put together."""
    parts = [office_documents(_broken(spark, sf_dir).where(F.col("ext") == ext).drop("ext"), "corpus", "docs")[2] for ext in ("doc", "docx")]
    return all_errors(parts).select("stage", "path", "error")


@query("q_error_report", _with("files", office=_OFFICE) + "SELECT 'docx' AS stage, count(*) AS n FROM office")
def q_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(Built(*office_documents(_broken(spark, sf_dir).drop("ext"), "corpus", "docs")))


@query("q_file_counts", _with("files") + f"SELECT count(*) AS n_found, count(*) FILTER (NOT k) AS n_ignored, count(*) FILTER (k) AS n_kept FROM (SELECT NOT starts_with(path, '{IGNORED}/') AND NOT starts_with(file, '~$') AND path <> 'corpus/manual/1.src1/doc1.docx' AS k FROM fx_files)")
def q_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_counts(view(spark, sf_dir, "files"), [IGNORED], ["corpus/manual/1.src1/doc1.docx"])


@query("q_distinct_matches", _with("md") + rf"""SELECT doc_id, len(m) AS n, array_to_string(list_sort(list_distinct(m)), '|') AS found, coalesce(m[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(content, '@type{WS_RE2}+struct<[^>]*>') AS m FROM fx_md)""")
def q_distinct_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return view(spark, sf_dir, "md").select("doc_id", C.match_count(c, "structs").alias("n"), F.array_join(F.array_sort(C.distinct_matches(c, "structs")), "|").alias("found"), F.coalesce(F.get(C.first_matches(c, "structs"), F.lit(0)), F.lit("")).alias("first"))


@query("q_length_deltas", _with("md") + f"SELECT doc_id, length({STEPS['anchors']}) - length(content) AS anchors_delta, length({STEPS['colon_stars'].replace('content', '(' + STEPS['anchors'] + ')')}) - length({STEPS['anchors']}) AS colon_stars_delta FROM fx_md")
def q_length_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.length_deltas(view(spark, sf_dir, "md"), chain=("anchors", "colon_stars"))
    return out.select("doc_id", F.col("anchors_delta").cast("long").alias("anchors_delta"), F.col("colon_stars_delta").cast("long").alias("colon_stars_delta"))


_UP = "../" * 12


@query("q_normal_path", _with("files") + "SELECT doc_id, path AS a, '/' || path AS b, '../' || file AS c FROM fx_files")
def q_normal_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same path, from forms with backslashes, empty parts, dots and twelve levels up."""
    down = F.lit("x/" * 12)
    bent = F.concat(F.lit("./"), down, F.lit(_UP), F.replace(F.col("path"), F.lit("/"), F.lit("\\.\\\\")))
    return view(spark, sf_dir, "files").select("doc_id", N.normal_path(bent).alias("a"), N.normal_path(F.concat(F.lit("//../"), bent, F.lit("/"))).alias("b"), N.normal_path(F.concat(F.lit("q/../../"), "dir", F.lit("/../"), "file")).alias("c"))


@query("q_scan_documents", _with("files") + "SELECT path FROM fx_files WHERE ext IN ('doc', 'docx') AND NOT starts_with(file, '~$')")
def q_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.documents_among(view(spark, sf_dir, "files")).select("path")


@query("q_catalog_files", _with("files") + "SELECT dir, file FROM fx_files WHERE starts_with(path, 'corpus/manual/')")
def q_catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.catalog_files(view(spark, sf_dir, "files").select("path"), "corpus/manual")


_LISTED = "SELECT name, kind, name AS path, CAST(1 + number % 3 AS INT) AS depth FROM fx_entries"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "entries").select("name", "kind", F.col("name").alias("path"), (1 + F.col("number") % 3).cast("int").alias("depth"))


@query("q_collect_files", _with("tree") + f"SELECT root, dir, name FROM fx_tree WHERE NOT {_ARCHIVE.format('name')}")
def q_collect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "tree").withColumn("kind", F.lit("file"))
    dirs = tree.directories(entries).select("root", "dir", F.lit("d").alias("name"), F.lit("dir").alias("kind"))
    return listing.collect_files(entries.unionByName(dirs), exclude_archives=True).select("root", "dir", "name")


@query("q_flat_entries", _with("entries", listed=_LISTED) + "SELECT name FROM listed WHERE kind = 'dir' AND depth = 1")
def q_flat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.flat(_listed(spark, sf_dir), "dir").select("name")


@query("q_existing", _with("entries", listed=_LISTED) + "SELECT CAST(p_partkey AS STRING) || '.gz' AS path FROM part WHERE CAST(p_partkey AS STRING) || '.gz' IN (SELECT path FROM listed WHERE kind = 'file')")
def q_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".gz")).alias("path"))
    return listing.existing(wanted, _listed(spark, sf_dir), "file")


@query("q_collisions", _with("files") + r"SELECT target AS path, count(DISTINCT path) AS n FROM (SELECT path, 'docs/' || regexp_replace(file, '[0-9]*\.[^./]*$', '.md') AS target FROM fx_files) GROUP BY 1 HAVING n > 1")
def q_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions(_same_targets(spark, sf_dir))


@query("q_overwritten", _with("files") + r"""SELECT target AS path, path AS source FROM (
    SELECT path, target, row_number() OVER (PARTITION BY target ORDER BY ext IN ('doc', 'docx') DESC, path DESC) AS r FROM (SELECT path, ext, 'docs/' || regexp_replace(file, '[0-9]*\.[^./]*$', '.md') AS target FROM fx_files)) WHERE r > 1""")
def q_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overwritten(_same_targets(spark, sf_dir))


def _same_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select(F.concat(F.lit("docs/"), F.regexp_replace("file", r"[0-9]*\.[^./]*$", ".md")).alias("path"), F.col("path").alias("source"))


# --- plans -----------------------------------------------------------------------------

_CONFIG = OrganizeConfig(dirty_files=tuple(IGNORED_DIRTY))


def _actions_of(plan: DataFrame) -> DataFrame:
    return plan.select("root", F.col("seq").cast("long").alias("seq"), "op", "src", "dst", "reason")


@query("q_plan_targets", _with("entries") + r"SELECT 'decompress' AS phase, '/base/' || name AS full_path, name FROM fx_entries WHERE kind = 'file' AND regexp_matches(name, '^[0-9]+\.(gz|zip|7z)$')")
def q_plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a range every archive is a target."""
    return plan_targets(spark, view(spark, sf_dir, "entries").withColumn("depth", F.lit(1)), _CONFIG, "/base").select("phase", "full_path", "name")


@query("q_plan_extractions", _with("entries", found=_TARGETS) + r"""SELECT '/base/' || regexp_extract(name, '^[0-9]+') AS root, CAST(s AS BIGINT) AS seq, CASE s WHEN 0 THEN 'extract' ELSE 'delete' END AS op, full_path AS src,
    CASE s WHEN 0 THEN '/base/' || regexp_extract(name, '^[0-9]+') END AS dst, CASE s WHEN 0 THEN 'archive' ELSE 'package' END AS reason FROM found, range(2) t(s) WHERE phase = 'decompress'""")
def q_plan_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In range mode the targets of a phase are unpacked, then their packages go."""
    return _actions_of(plan_extractions(_targets(spark, sf_dir), _CONFIG))


_AT = "'/t/' || CAST({0}.root AS STRING)"


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tree").select(F.concat(F.lit("/t/"), F.col("root").cast("string")).alias("root"), "dir", "name")


@query("q_plan_volumes", _with("tree", sets=_HELD) + f"""SELECT {_AT.format('t')} AS root, CAST(10 AS BIGINT) AS seq, 'delete' AS op, {_AT.format('t')} || dir || '/' || name AS src, NULL::VARCHAR AS dst, 'not a volume' AS reason
    FROM sets t WHERE dir = held AND NOT starts_with(name, base || '.7z.')
    UNION ALL SELECT DISTINCT {_AT.format('s')}, 11, 'extract', {_AT.format('s')} || dir || '/' || base || '.7z.001', {_AT.format('s')} || dir, 'volumes' FROM sets s WHERE dir = held
    UNION ALL SELECT {_AT.format('s')}, 12, 'delete', {_AT.format('s')} || dir || '/' || name, NULL, 'volume' FROM sets s WHERE dir = held AND volume""")
def q_plan_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions_of(plan_volumes(_rooted(spark, sf_dir), _CONFIG))


@query("q_plan_dirty", _with("tree") + f"SELECT {_AT.format('t')} AS root, CAST(5 AS BIGINT) AS seq, 'delete' AS op, {_AT.format('t')} || dir || '/' || name AS src, NULL::VARCHAR AS dst, 'junk' AS reason FROM fx_tree t WHERE name = 'junk' OR {_SUFFIX.format(1)} = 'junk'")
def q_plan_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions_of(plan_dirty(spark, _rooted(spark, sf_dir).withColumn("kind", F.lit("file")), _CONFIG))


_WRAPPED = "SELECT number, name, CASE number % 3 WHEN 0 THEN 'x' ELSE name END AS inner_name FROM fx_entries WHERE kind = 'dir'"


@query("q_plan_rename", _with("entries", wrapped=_WRAPPED) + """SELECT root, CAST(seq AS BIGINT) AS seq, op, src, dst, reason FROM (
    SELECT '/t/' || name AS root, 21 AS seq, 'move' AS op, '/t/' || name || '/' || inner_name || '/a.jpg' AS src, '/t/' || name || '/a.jpg' AS dst, 'flatten' AS reason FROM wrapped
    UNION ALL SELECT '/t/' || name, 22, 'delete', '/t/' || name || '/' || inner_name, NULL, 'empty' FROM wrapped
    UNION ALL SELECT '/t/' || name, 24, 'rename', '/t/' || name, '/t/' || inner_name, 'detected name' FROM wrapped WHERE name <> inner_name)""")
def q_plan_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold one folder: its files move up, it goes, its name is taken."""
    wrapped = view(spark, sf_dir, "entries").where("kind = 'dir'").withColumn("inner", F.when(F.col("number") % 3 == 0, F.lit("x")).otherwise(F.col("name")))
    root = F.concat(F.lit("/t/"), "name").alias("root")
    entries = wrapped.select(root, F.lit("").alias("dir"), F.col("inner").alias("name"), F.lit("dir").alias("kind")).unionByName(wrapped.select(root, F.concat(F.lit("/"), "inner").alias("dir"), F.lit("a.jpg").alias("name"), F.lit("file").alias("kind")))
    return _actions_of(plan_organize(spark, entries, _CONFIG))


#: Folders by their number's rest: a chain of three, cycles of two and three, a name
#: that stays with a chain behind it, two that want one name and one that wants the loser's.
_WANTED = """SELECT '/t/' || CAST(p_partkey AS STRING) AS src, '/t/' || CASE p_partkey % 20 WHEN 0 THEN CAST(p_partkey + 1 AS STRING) WHEN 1 THEN CAST(p_partkey + 1 AS STRING) WHEN 2 THEN 'free' || CAST(p_partkey AS STRING)
 WHEN 3 THEN CAST(p_partkey + 1 AS STRING) WHEN 4 THEN CAST(p_partkey - 1 AS STRING) WHEN 5 THEN CAST(p_partkey + 1 AS STRING) WHEN 6 THEN CAST(p_partkey + 1 AS STRING) WHEN 7 THEN CAST(p_partkey - 2 AS STRING)
 WHEN 8 THEN CAST(p_partkey + 1 AS STRING) WHEN 10 THEN CAST(p_partkey - 2 AS STRING) WHEN 11 THEN 'same' || CAST(p_partkey - 11 AS STRING) WHEN 13 THEN 'same' || CAST(p_partkey - 13 AS STRING) WHEN 14 THEN CAST(p_partkey - 1 AS STRING)
 ELSE CAST(p_partkey AS STRING) END AS dst FROM part"""
_SOURCES["wanted"] = (_WANTED, "part")
_RENAMED = """WITH RECURSIVE fx_wanted AS MATERIALIZED (@wanted@),
 marked AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) > 1 AS lost FROM fx_wanted WHERE src <> dst),
 walk AS (SELECT src, dst AS loc, 1 AS n FROM marked WHERE NOT lost UNION ALL SELECT w.src, m.dst, w.n + 1 FROM walk w JOIN marked m ON m.src = w.loc AND NOT m.lost WHERE w.loc <> w.src),
 ends AS (SELECT src, arg_max(loc, n) AS loc, max(n) AS n FROM walk GROUP BY src)
 SELECT m.src, m.dst, CASE WHEN m.lost THEN 'collision' WHEN e.loc = m.src OR e.loc NOT IN (SELECT src FROM fx_wanted) THEN 'rename' WHEN e.n = 1 THEN 'taken' ELSE 'blocked' END AS status,
  CASE WHEN NOT m.lost AND (e.loc = m.src OR e.loc NOT IN (SELECT src FROM fx_wanted)) THEN m.dst ELSE m.src END AS final FROM marked m LEFT JOIN ends e ON e.src = m.src"""


@query("q_renames", _RENAMED.replace("@wanted@", _WANTED))
def q_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each rename, and where its folder is at the end."""
    wanted = view(spark, sf_dir, "wanted")
    out = renames.resolve_renames(wanted, wanted.select(F.col("src").alias("path")))
    return out.select("src", "dst", "status", F.when(F.col("status") == renames.RENAME, F.col("dst")).otherwise(F.col("src")).alias("final"))


# --- readers ----------------------------------------------------------------------------

#: Lines of whole texts without what XML cannot hold.
_PLAIN_SQL = "regexp_replace(coalesce(text, ''), '[^\\n\\x20-\\x7e\\x{00A1}-\\x{D7FF}]', ' ', 'g')"


def _docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-processor file for each text, a paragraph for each line."""

    def run(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for b in pieces(batches):
            out = []
            for text in b.column(1).to_pylist():
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n\x20-\x7e\u00A1-\uD7FF]", " ")
    texts = _table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), plain.alias("text"))
    return texts.mapInArrow(run, "path string, content binary")


_PARAGRAPHS = f"list_filter(string_split({_PLAIN_SQL}, chr(10)), lambda x: trim(x) <> '')"


@query("q_docx_html", f"SELECT 'corpus/' || CAST(doc_id AS STRING) || '.docx' AS path, array_to_string(list_transform({_PARAGRAPHS}, lambda x: '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'), '') AS html FROM documents")
def q_docx_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx_to_html(_docx_files(spark, sf_dir)).select("path", "html")


#: Parts of a file whose lists have three levels: bullets, numbers that a style says,
#: and bullets of a style that is based on another one.
_NUMBERED = (
    ("numbering", '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="2"><w:lvl w:ilvl="2"><w:numFmt w:val="bullet"/></w:lvl></w:lvlOverride></w:num>'),
    ("styles", '<w:style w:styleId="Base"><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr></w:style><w:style w:styleId="Deep"><w:basedOn w:val="Base"/><w:pPr><w:numPr><w:ilvl w:val="2"/></w:numPr></w:pPr></w:style>'),
)
_LEVELS = ('<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>', '<w:pStyle w:val="Base"/>', '<w:pStyle w:val="Deep"/>')


def _list_files(spark: SparkSession, sf_dir: str, odd: str = r"[^\n\x20-\x7e\u00A1-\uD7FF]") -> DataFrame:
    """A word-processor file for each text: its lines are items of levels 0, 1, 2, 0, ..."""

    def run(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        for b in pieces(batches):
            out = []
            for text in b.column(1).to_pylist():
                lines = [x for x in text.split("\n") if x.strip(" ")]
                body = "".join(f'<w:p><w:pPr>{_LEVELS[i % 3]}</w:pPr><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(lines))
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
                    for name, part in _NUMBERED:
                        z.writestr(f"word/{name}.xml", f"<w:{name} {space}>{part}</w:{name}>")
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    plain = F.regexp_replace(F.coalesce("text", F.lit("")), odd, " ")
    texts = _table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), plain.alias("text"))
    return texts.mapInArrow(run, "path string, content binary")


_ITEM = "CASE WHEN i = 1 THEN '<ul><li>' WHEN i % 3 = 1 THEN '</li></ul></li></ol></li><li>' WHEN i % 3 = 2 THEN '<ol><li>' ELSE '<ul><li>' END || replace(replace(replace(p[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("q_docx_lists", f"""SELECT path, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: {_ITEM}), '')
    || CASE len(p) % 3 WHEN 1 THEN '</li></ul>' WHEN 2 THEN '</li></ol></li></ul>' ELSE '</li></ul></li></ol></li></ul>' END END AS html
    FROM (SELECT 'corpus/' || CAST(doc_id AS STRING) || '.docx' AS path, {_PARAGRAPHS} AS p FROM documents)""")
def q_docx_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three levels, told by numberings, styles and what styles are based on."""
    return docx_to_html(_list_files(spark, sf_dir)).select("path", "html")


#: Lines of whole texts in letters that Markdown and white space rules leave alone.
_BARE = r"[^\n\x20-\x29\x2b-\x7d\u00A1-\u024F]"
_BARE_SQL = "regexp_replace(coalesce(text, ''), '[^\\n\\x20-\\x29\\x2b-\\x7d\\x{00A1}-\\x{024F}]', ' ', 'g')"
_FOLDED = f"list_filter(list_transform(string_split({_BARE_SQL}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"


@query("q_list_markdown", f"""SELECT path, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE i % 3 WHEN 1 THEN '- ' WHEN 2 THEN '  1. ' ELSE '     - ' END || p[i]), chr(10)) || chr(10) END AS content
    FROM (SELECT 'corpus/' || CAST(doc_id AS STRING) || '.docx' AS path, {_FOLDED} AS p FROM documents)""")
def q_list_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three levels, from word-processor files to Markdown."""
    return pages_to_markdown(docx_to_html(_list_files(spark, sf_dir, _BARE)), key="path").select("path", "content")


@query("q_html_text", f"""SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE '## ' || array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 4 = 2 THEN '**' || p[i] || '**' WHEN i % 4 = 3 THEN '> ' || p[i] ELSE p[i] END), chr(10) || chr(10)) || chr(10) END AS content
    FROM (SELECT doc_id, {_FOLDED} AS p FROM documents)""")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of whole texts: a heading, then plain, bold and quoted paragraphs by turns."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), _BARE, " "), "\n"), lambda x: F.trim(x) != "")
    clean = F.transform(lines, lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    html = F.transform(clean, lambda x, i: F.when(i == 0, tag("h2", x)).when(i % 4 == 1, tag("p", tag("b", F.trim(x)))).when(i % 4 == 2, tag("blockquote", tag("p", x))).otherwise(tag("p", x)))
    pages = _table(spark, sf_dir, "documents").select("doc_id", F.array_join(html, "\n").alias("html"))
    return pages_to_markdown(pages, key="doc_id").select("doc_id", "content")


_PAGE = "'<h2>' || lang || '</h2><p>see <b>' || source || '</b> and <a href=\"u' || doc_id || '\">' || n_chars || '</a></p><ul><li>one<li>two</ul><table><tr><th>a<th>b<tr><td><p>' || lang || '</p><td>x|y</table>'"


@query("q_html_blocks", "SELECT doc_id, '## ' || lang || chr(10) || chr(10) || 'see **' || source || '** and [' || n_chars || '](u' || doc_id || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | x' || chr(92) || '|y |' || chr(10) AS content FROM documents")
def q_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, marks, links, lists and tables to Markdown."""
    pages = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGE).alias("html"))
    return pages_to_markdown(pages, key="doc_id").select("doc_id", "content")


# --- files -----------------------------------------------------------------------------

#: Where whole texts are written, and what makes a name of theirs.
_WRITTEN = "SELECT CASE WHEN doc_id % 7 = 0 THEN '.h' WHEN doc_id % 7 = 1 THEN '_u' ELSE 'd' || CAST(doc_id % 30 AS STRING) END AS dir, CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.bin' END AS name, coalesce(text, '') AS content FROM documents"
_SOURCES["written"] = (_WRITTEN, "documents")


def _on_disk(spark: SparkSession, sf_dir: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """Whole texts written as files of a corpus, read again, and removed.

    A row without an id has no name, and so no file.
    """
    base = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}".removeprefix("file:")
    texts = view(spark, sf_dir, "written").select(F.concat(F.lit("docs/"), "dir", F.lit("/"), "name").alias("path"), "content").where("path IS NOT NULL")
    try:
        failed = write_corpus(spark, Built(texts, None, spark.createDataFrame([], "path string, stage string, error string")), "docs", base)
        if not failed.isEmpty():
            raise OSError(failed.first().error)
        with listing.small_files(spark):
            return kept(read(f"{base}/docs"))
    finally:
        try:
            remove_written(spark, f"{base}/docs")
        finally:
            remove(spark, base)


#: The path below the written corpus, from one as listings show it.
_BELOW = "regexp_extract(path, '/written-[0-9a-f]{32}/docs/(.*)$', 1) AS path"


_FILE_ROWS = "SELECT dir || '/' || name AS path, octet_length(encode(content)) AS bytes, sha256(content) AS sha FROM fx_written"


@query("q_read_binaries", _with("written") + f"SELECT path, sha FROM ({_FILE_ROWS}) WHERE NOT starts_with(path, '.') AND NOT starts_with(path, '_')")
def q_read_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as bytes; Spark's readers pass over hidden folders."""
    return _on_disk(spark, sf_dir, lambda d: listing.read_binaries(spark, d).select(F.expr(_BELOW), F.sha2("content", 256).alias("sha")))


@query("q_read_texts", _with("written") + f"SELECT path, sha FROM ({_FILE_ROWS}) WHERE path LIKE '%.txt' AND NOT starts_with(path, '.') AND NOT starts_with(path, '_')")
def q_read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_disk(spark, sf_dir, lambda d: listing.read_texts(spark, d).select(F.expr(_BELOW), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")))


@query("q_scan_texts", _with("written") + f"SELECT path, CAST(bytes AS BIGINT) AS bytes FROM ({_FILE_ROWS}) WHERE path LIKE '%.txt' AND NOT starts_with(path, '.') AND NOT starts_with(path, '_')")
def q_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_disk(spark, sf_dir, lambda d: listing.scan_texts(spark, d).select(F.expr(_BELOW), F.col("length").alias("bytes")))


@query("q_manifest", _with("written") + f"SELECT path, CAST(bytes AS BIGINT) AS bytes, sha FROM ({_FILE_ROWS})")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tasks that wrote a corpus say of its files."""
    return _on_disk(spark, sf_dir, lambda d: manifest_of(spark, d).select("path", "bytes", F.col("sha256").alias("sha")))


@query("q_tree_source", _with("written") + "SELECT '/' || dir AS dir, name, 'file' AS kind, 2 AS depth FROM fx_written UNION ALL SELECT DISTINCT '', dir, 'dir', 1 FROM fx_written")
def q_tree_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a written corpus but its manifest, hidden ones too."""
    return _on_disk(spark, sf_dir, lambda d: read_tree(spark, d).where("dir <> '/.manifest' AND name <> '.manifest'").select("dir", "name", "kind", "depth"))


def _slow(name: str, data: bytes, password: str | None):
    raise TimeoutError(f"{name} takes too long")


@query("q_extract_status", """SELECT path, CASE e WHEN 'zip' THEN 'error' WHEN 'gz' THEN 'ok' WHEN 'slow' THEN 'timeout' ELSE 'unsupported' END AS status,
    CASE e WHEN 'zip' THEN 'File is not a zip file' WHEN 'gz' THEN '' WHEN 'slow' THEN path || ' takes too long' ELSE 'no reader for .rar' END AS error
    FROM (SELECT 'd/' || doc_id || '.' || e AS path, e FROM (SELECT doc_id, ['zip', 'gz', 'slow', 'rar'][doc_id % 4 + 1] AS e FROM documents))""")
def q_extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of archives that are no archives, take too long or have no reader."""
    ext = F.element_at(F.array(*map(F.lit, ("zip", "gz", "slow", "rar"))), (F.col("doc_id") % 4 + 1).cast("int"))
    empty = F.unhex(F.lit("1F8B08000000000002FF03000000000000000000"))
    text = F.encode(F.concat(F.lit("no archive "), F.coalesce("text", F.lit(""))), "UTF-8")
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.when(ext == "gz", empty).otherwise(text).alias("content"))
    register_extractor(".slow", _slow)
    try:
        out = extract(files)
    finally:
        EXTRACTORS.pop(".slow")
    return out.select("path", "status", F.coalesce("error", F.lit("")).alias("error"))


@query("q_zip_split", "SELECT 'z' || CAST(doc_id // 64 AS STRING) || '.zip' AS path, 't/' || CAST(doc_id AS STRING) AS member, 'ok' AS status, sha256(coalesce(text, '')) AS sha FROM documents")
def q_zip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives on disk, of at most 64 texts each, whose members are read by their byte ranges."""

    def run(batches):
        import zipfile

        for b in pieces(batches):
            for path, members in zip(b.column("path").to_pylist(), b.column("members").to_pylist(), strict=True):
                with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(m["name"], m["text"])
            yield b.select(["path"])

    base = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}".removeprefix("file:")
    make(spark, base)
    try:
        text = F.struct(F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
        path = F.concat(F.lit(f"{base}/z"), F.floor(F.col("doc_id") / 64).cast("string"), F.lit(".zip"))
        archives = _table(spark, sf_dir, "documents").select(path.alias("path"), text.alias("m")).groupBy("path").agg(F.collect_list("m").alias("members"))
        paths = kept(archives.mapInArrow(run, "path string"))
        return kept(extract_split(paths).select(F.element_at(F.split("path", "/"), -1).alias("path"), "member", "status", F.sha2("content", 256).alias("sha")))
    finally:
        remove(spark, base)


def _pictured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-processor file for each text: its lines, and the text as a picture."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        w, r, a = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/drawingml/2006/main"
        for b in pieces(batches):
            out = []
            for kind, text in zip(b.column("kind").to_pylist(), b.column("text").to_pylist(), strict=True):
                body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:drawing><a:blip r:embed="p"/></w:drawing></w:r></w:p>'
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}" xmlns:a="{a}"><w:body>{body}</w:body></w:document>')
                    z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="p" Target="media/p.{kind}"/></Relationships>')
                    z.writestr(f"word/media/p.{kind}", text)
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    kind = F.element_at(F.array(*map(F.lit, ("png", "jpeg", "emf"))), (F.col("doc_id") % 3 + 1).cast("int"))
    texts = _table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "path string, content binary")


_PICTURED = """SELECT CAST(doc_id AS STRING) AS d, ['png', 'jpeg', 'emf'][doc_id % 3 + 1] AS kind, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 2 THEN 'unsupported' WHEN octet_length(encode(coalesce(text, ''))) < 7 THEN 'empty' ELSE 'ok' END AS status,
    CAST(doc_id AS STRING) || '-001.' || ['png', 'jpg', 'png'][doc_id % 3 + 1] AS name FROM documents"""


@query("q_office_images", f"SELECT 'corpus/' || d || '.docx' AS path, 1 AS seq, name, status, CASE WHEN status = 'ok' THEN './images/' || d || '/' || name ELSE '{images.PLACEHOLDER}' END AS src, sha256(text) AS sha FROM ({_PICTURED})")
def q_office_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures out of word-processor files, with their bytes."""
    found = office_documents(_pictured_files(spark, sf_dir), "corpus", "docs")[1]
    return found.select("path", "seq", "name", "status", "src", F.sha2("data", 256).alias("sha"))


@query("q_office_documents", f"SELECT 'docs/' || d || '.md' AS path, '## Top' || chr(10) || chr(10) || '![](' || CASE WHEN status = 'ok' THEN './images/' || d || '/' || name ELSE '{images.PLACEHOLDER}' END || ')' || chr(10) AS content FROM ({_PICTURED})")
def q_office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From word-processor files to Markdown, with the pictures' own addresses."""
    return office_documents(_pictured_files(spark, sf_dir), "corpus", "docs")[0].select("path", "content")
