"""Web pages to Markdown, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import pieces

_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "address", "form", "fieldset", "dl", "dd", "dt"}
_SILENT = {"script", "style", "template", "noscript", "title", "svg"}
_PARTS = {"table", "tr", "td", "th", "ul", "ol", "li", "blockquote", "pre", "hr"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}


class _Writer(HTMLParser):
    """Writes Markdown as tags come; what a page leaves open is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.lists: list[list] = []  # [kind, number]
        self.open: list[tuple[str, str]] = []  # inline marks
        self.prefix = ""
        self.quote = 0
        self.silent: list[str] = []  # open tags whose text is not shown
        self.inner = 0  # tables inside a cell
        self.pre = False
        self.link: list[str] = []
        self.table: list[list[str]] | None = None
        self.cell = False

    def end_cell(self) -> None:
        if self.cell and self.table:
            self.table[-1].append(re.sub(r"\s+", " ", "".join(self.line)).strip().replace("|", "\\|"))
        self.line, self.open, self.cell = [], [], False

    def flush(self) -> None:
        for _, mark in reversed(self.open):
            self.line.append(mark)
        self.open = []
        text = "".join(self.line)
        self.line = []
        if not self.pre:
            text = re.sub(r"(?:[ \t]*\n[ \t]*)+", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
            text = re.sub(r"(\*\*|~~|(?<!\*)\*(?!\*))\s*\1", "", text).strip()
        if text:
            lead = "> " * self.quote
            body = (self.prefix + text).replace("\n", "\n" + lead)
            self.blocks.append(lead + body)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        while self.silent and self.silent[-1] in ("svg", "title") and (tag in _BLOCKS or tag in _HEADINGS or tag in _PARTS):
            self.silent.pop()  # no such tag can stand in them, so they were left open
        if tag in _SILENT:
            self.silent.append(tag)
        elif self.silent:
            return
        elif self.cell and tag == "table":
            self.inner += 1
        elif self.cell and (tag in _BLOCKS or tag in _HEADINGS or (tag in _PARTS and (self.inner or tag not in ("tr", "td", "th")))):
            self.line.append(" ")  # a cell is one line
        elif tag in _HEADINGS:
            self.flush()
            self.prefix = "#" * _HEADINGS[tag] + " "
        elif tag in _BLOCKS:
            self.flush()
        elif tag == "br":
            self.line.append("\n")
        elif tag == "hr":
            self.flush()
            self.blocks.append("---")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            # An inner list stands below the text of the item that holds it.
            marks = ["- " if k == "ul" else f"{max(1, n)}. " for k, n in self.lists or [kind]]
            self.prefix = " " * sum(map(len, marks[:-1])) + marks[-1]
        elif tag == "blockquote":
            self.flush()
            self.quote += 1
        elif tag == "pre":
            self.flush()
            self.pre = True
        elif tag == "code" and not self.pre:
            self.open.append((tag, "`"))
            self.line.append("`")
        elif tag in _MARKS:
            self.open.append((tag, _MARKS[tag]))
            self.line.append(_MARKS[tag])
        elif tag == "a":
            self.link.append(a.get("href") or "")
            self.line.append("[")
        elif tag == "img":
            self.line.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.flush()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.end_cell()
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.end_cell()
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        elif self.silent:
            return
        elif self.inner and tag == "table":
            self.inner -= 1
            self.line.append(" ")
        elif self.cell and (tag in _BLOCKS or tag in _HEADINGS or (tag in _PARTS and (self.inner or tag not in ("tr", "td", "th", "table")))):
            self.line.append(" ")
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag == "blockquote":
            self.flush()
            self.quote = max(0, self.quote - 1)
        elif tag == "pre":
            text = "".join(self.line).strip("\n")
            self.line, self.pre = [], False
            self.blocks.append(f"```\n{text}\n```")
        elif tag in ("td", "th", "tr") and self.table:
            self.end_cell()
        elif tag == "table" and self.table is not None:
            self.end_cell()
            rows = [r for r in self.table if r]
            self.table = None
            if rows:
                wide = max(map(len, rows))
                rows = [r + [""] * (wide - len(r)) for r in rows]
                self.blocks.append("\n".join(["| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * wide, *rows[1:]]]))
        elif tag == "a" and self.link:
            self.line.append(f"]({self.link.pop()})")
        elif any(t == tag for t, _ in self.open):
            while self.open:
                t, mark = self.open.pop()
                self.line.append(mark)
                if t == tag:
                    break
        elif tag in _BLOCKS or tag in _HEADINGS or tag == "li":
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.line.append(data if self.pre else data.replace("\n", " "))


def html_to_markdown(html: str | None) -> str:
    writer = _Writer()
    writer.feed(html or "")
    writer.close()
    while writer.link:
        writer.line.append(f"]({writer.link.pop()})")
    writer.flush()
    out: list[str] = []
    for block in writer.blocks:
        # Items of a list stand together; all else is set apart.
        tight = out and re.match(r"\s*(?:- |\d+\. )", block) and re.match(r"\s*(?:- |\d+\. )", out[-1])
        out.append(("\n" if tight else "\n\n" if out else "") + block)
    return "".join(out) + ("\n" if out else "")


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        out, errors = [], []
        for html in b.column(1).to_pylist():
            try:
                out.append(html_to_markdown(html))
                errors.append(None)
            except Exception as e:  # one bad page is a row of the error table
                out.append(None)
                errors.append(str(e) or type(e).__name__)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["id", "content", "error"])


def pages_to_markdown(pages: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """key, content, error: one row per page, a failed one with its message."""
    own = pages.select(F.col(key).alias("id"), F.col(html).alias("html"))
    kind = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])
    return own.mapInArrow(_convert, kind).withColumnRenamed("id", key)
