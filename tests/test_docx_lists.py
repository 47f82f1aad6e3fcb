"""Numbering of word-processor files: levels, kinds, styles, nesting."""

import io
import zipfile

import pytest

from corpusforge.sources.docx import Docx
from corpusforge.sources.html import html_to_markdown

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
NUMBERING = """<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="lowerLetter"/><w:pStyle w:val="Bound"/></w:lvl></w:abstractNum>
<w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="2"/></w:num>
<w:num w:numId="7"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:lvlOverride></w:num>"""
STYLES = """<w:style w:styleId="Listed"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="Heir"><w:basedOn w:val="Listed"/></w:style>
<w:style w:styleId="Bound"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style>"""


def p(text, number=None, level=None, style=None):
    inner = f'<w:pStyle w:val="{style}"/>' if style else ""
    if number is not None or level is not None:
        inner += "<w:numPr>" + (f'<w:ilvl w:val="{level}"/>' if level is not None else "") + (f'<w:numId w:val="{number}"/>' if number is not None else "") + "</w:numPr>"
    return f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def html(*paragraphs, parts=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{''.join(paragraphs)}</w:body></w:document>")
        if parts:
            z.writestr("word/numbering.xml", f"<w:numbering {SPACE}>{NUMBERING}</w:numbering>")
            z.writestr("word/styles.xml", f"<w:styles {SPACE}>{STYLES}</w:styles>")
    return Docx(out.getvalue()).html()


@pytest.mark.parametrize(
    ("paragraphs", "want"),
    [
        ([p("a", 5, 0), p("b", 5, 0)], "<ol><li>a</li><li>b</li></ol>"),
        ([p("a", 5, 0), p("b", 5, 1), p("c", 5, 1), p("d", 5, 0), p("e")], "<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol><p>e</p>"),
        ([p("a", 5, 0), p("b", 5, 2), p("c", 5, 1)], "<ol><li>a<ol><li><ol><li>b</li></ol></li></ol><ul><li>c</li></ul></li></ol>"),
        ([p("a", 5, 0), p("b", 6, 0), p("c", 7, 0)], "<ol><li>a</li></ol><ul><li>b</li><li>c</li></ul>"),
        ([p("a", style="Listed"), p("b", style="Heir"), p("c", level=1, style="Heir")], "<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>"),
        ([p("a", style="Bound")], "<ol><li><ol><li><ol><li>a</li></ol></li></ol></li></ol>"),
        ([p("a", 0, style="Listed"), p("b", style="A")], "<p>a</p><p>b</p>"),
        ([p("a", 99, 0), p("b", 99, 0, "ListNumber")], "<ul><li>a</li></ul><ol><li>b</li></ol>"),
        ([p("", 5, 0), "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>", p("x", 5, 0)], "<ol><li></li></ol><table><tr><td></td></tr></table><ol><li>x</li></ol>"),
    ],
)
def test_lists(paragraphs, want):
    assert html(*paragraphs) == want


def test_without_numbering_parts():
    assert html(p("a", 1, 0), p("b", 1, 1, "ListNumber2"), parts=False) == "<ul><li>a<ol><li>b</li></ol></li></ul>"


def test_nested_lists_as_markdown():
    assert html_to_markdown(html(p("a", 5, 0), p("b", 5, 1), p("c", 5, 1), p("d", 5, 0))) == "1. a\n   - b\n   - c\n2. d\n"
