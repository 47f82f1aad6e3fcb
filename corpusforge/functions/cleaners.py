"""The text cleaners, as functions from columns to a column.

A cleaner takes the text and the document's path. Their order is part of the
result: ``CHAIN`` is the active one, and ``clean`` folds it over a column. More
can be registered; see ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .jstext import HTML_TAGS, WS, WS_INNER, trim
from .names import stem

Cleaner = Callable[[Column, Column], Column]

#: What the cleaners look for.
H1 = rf"(?m)^#{WS}+[^#\n]+$"
OVERVIEW = rf"##{WS}*概述{WS}*\n?"
HEADING = rf"(?m)^#(#{{2,}}){WS}+(.+)$"
ANCHOR = r"\[\]\{#[^\n}]+(\n)?\.anchor\}"
DIMENSION = rf'\{{width="[^"]*"{WS}+.*?height="[^"]*"\}}'
#: A flat class: it accepts what a nested repetition would, without its cost.
TAG = rf"(?<![`\w])<(?!/)(?!(?:{'|'.join(HTML_TAGS)})(?!\w))[^<>/{WS_INNER}]*>(?![`\w])"
STRUCT = rf"(?<!`)(@type{WS}+struct<[^>]*>)(?!`)"
SUMMARY = r"**小结\*\*"
COLON = "：**"


def has_h1(c: Column) -> Column:
    return c.rlike(H1)


def strip_anchors(c: Column, path: Column) -> Column:
    return F.regexp_replace(c, ANCHOR, "")


def strip_dimensions(c: Column, path: Column) -> Column:
    return F.regexp_replace(c, DIMENSION, "")


def strip_overview(c: Column, path: Column) -> Column:
    """The overview heading, wherever its text stands."""
    return F.regexp_replace(c, OVERVIEW, "")


def shift_headings(c: Column, path: Column) -> Column:
    """Third level and deeper up by one, unless there is a first level."""
    return F.when(has_h1(c), c).otherwise(F.regexp_replace(c, HEADING, "$1 $2"))


def add_h1(c: Column, path: Column) -> Column:
    """A first-level heading from the file name, unless there is one."""
    return F.when(path.isNull() | (path == "") | has_h1(c), c).otherwise(F.concat(F.lit("# "), stem(path), F.lit("\n\n"), c))


def quote_tags(c: Column, path: Column) -> Column:
    """Backticks around what looks like a tag but is not one of HTML's."""
    return F.regexp_replace(c, TAG, "`$0`")


def quote_structs(c: Column, path: Column) -> Column:
    return F.regexp_replace(c, STRUCT, "`$1`")


def strip_summary_stars(c: Column, path: Column) -> Column:
    return F.replace(c, F.lit(SUMMARY), F.lit(""))


def space_colon_stars(c: Column, path: Column) -> Column:
    return F.replace(c, F.lit(COLON), F.lit(COLON + " "))


#: All cleaners by name; the links come from ``operators.links`` (they need the
#: index of names) and stand between "colon_stars" and the end of the chain.
CLEANERS: dict[str, Cleaner] = {
    "anchors": strip_anchors,
    "dimensions": strip_dimensions,
    "overview": strip_overview,
    "headings": shift_headings,
    "add_h1": add_h1,
    "tags": quote_tags,
    "structs": quote_structs,
    "summary_stars": strip_summary_stars,
    "colon_stars": space_colon_stars,
}
#: The active chain, in order; anchors and dimensions are off by default.
CHAIN: tuple[str, ...] = ("overview", "headings", "add_h1", "tags", "structs", "summary_stars", "colon_stars")
#: What each cleaner's count of matches is taken from.
PATTERNS = {"anchors": ANCHOR, "dimensions": DIMENSION, "overview": OVERVIEW, "headings": HEADING, "tags": TAG, "structs": STRUCT, "summary_stars": r"\*\*小结\\\*\\\*", "colon_stars": r"：\*\*"}


def register(name: str, cleaner: Cleaner) -> None:
    """Add a cleaner; name it in a chain to use it."""
    CLEANERS[name] = cleaner


def clean(c: Column, path: Column, chain: Sequence[str | Cleaner] = CHAIN) -> Column:
    """The chain folded over a text column."""
    steps = [CLEANERS[s] if isinstance(s, str) else s for s in chain]
    return reduce(lambda text, step: step(text, path), steps, c)


def clean_frame(df, content: str = "content", path: str = "path", chain: Sequence[str | Cleaner] = CHAIN):
    """``content`` cleaned. Guarded cleaners read their input three times, so
    each step is a column of its own and not one nested expression."""
    for s in chain:
        df = df.withColumn(content, (CLEANERS[s] if isinstance(s, str) else s)(F.col(content), F.col(path)))
    return df


def length_deltas(df, content: str = "content", path: str = "path", chain: Sequence[str] = CHAIN):
    """``df`` with a column ``<cleaner>_delta`` per step: characters gained or lost."""
    for s in chain:
        out = CLEANERS[s](F.col(content), F.col(path))
        df = df.withColumn("__next", out).withColumn(f"{s}_delta", F.length("__next") - F.length(content)).withColumn(content, F.col("__next")).drop("__next")
    return df


def observed_clean(df: DataFrame, content: str = "content", path: str = "path", chain: Sequence[str] = CHAIN) -> tuple[DataFrame, Observation]:
    """``clean_frame`` and what it did, counted in the same pass.

    Once the rows are read the observation has for each cleaner that is known by a
    pattern the matches that it met (``<cleaner>_matches``) and the documents with
    any (``<cleaner>_docs``), and for each cleaner the characters that it added or
    took (``<cleaner>_delta``).
    """
    seen, metrics = Observation(), []
    for s in chain:
        before, out = f"__{s}_before", CLEANERS[s](F.col(content), F.col(path))
        if s in PATTERNS:
            df = df.withColumn(f"__{s}_n", match_count(F.col(content), s))
            metrics += [F.coalesce(F.sum(f"__{s}_n"), F.lit(0)).alias(f"{s}_matches"), F.count_if(F.col(f"__{s}_n") > 0).alias(f"{s}_docs")]
        df = df.withColumn(before, F.length(content)).withColumn(content, out)
        df = df.withColumn(before, F.length(content) - F.col(before))
        metrics.append(F.coalesce(F.sum(before), F.lit(0)).alias(f"{s}_delta"))
    return df.observe(seen, *metrics).drop(*[c for c in df.columns if c.startswith("__")]), seen


def match_count(c: Column, name: str) -> Column:
    return F.regexp_count(c, F.lit(PATTERNS[name])).cast("long")


def distinct_matches(c: Column, name: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PATTERNS[name]), F.lit(0)))


def first_matches(c: Column, name: str, n: int = 3) -> Column:
    """What a log line shows of the matches."""
    return F.slice(distinct_matches(c, name), 1, n)


def text_body(c: Column) -> Column:
    """Plain text as Markdown paragraphs: trimmed non-blank lines, one blank line between."""
    lines = F.transform(F.split(c, r"\r?\n", -1), trim)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def text_to_markdown(c: Column, path: Column) -> Column:
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.concat(F.lit("# "), F.regexp_replace(name, r"\.txt\z", ""), F.lit("\n\n"), text_body(c))


def normalise_blanks(c: Column, path: Column | None = None) -> Column:
    """A plain white-space formatter: no trailing blanks, at most one empty
    line in a row, one line end at the end. It is not the external formatter of
    the original chain, whose bytes cannot be had without it."""
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\A\n+|\n+\z", "")
    return F.when(out == "", out).otherwise(F.concat(out, F.lit("\n")))


register("blanks", normalise_blanks)
