"""Word-processor files (docx) to HTML, and their images.

A docx file is a zip of XML parts. Headings, paragraphs, bold and italic runs,
links, lists of any depth, tables and images are read; what a file holds beside
that is left out. Whether a paragraph is a list item, of which level and kind,
follows from its own numbering or that of its style and the styles it is based on. A file that is no zip (the old binary format among them) gives a row
with an error.
"""

from __future__ import annotations

import base64
import io
import posixpath
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/wmf"}


def _value(e: ElementTree.Element | None, path: str) -> str | None:
    found = e.find("/".join(f"{_W}{t}" for t in path.split("/"))) if e is not None else None
    return None if found is None else found.get(f"{_W}val")


class Numbering:
    """numbering.xml and styles.xml: level and kind of list items."""

    def __init__(self, numbering: ElementTree.Element | None, styles: ElementTree.Element | None):
        #: Abstract numbering -> level -> (format, style that the level belongs to).
        self.abstract: dict[str, dict[int, tuple[str, str | None]]] = {}
        #: Numbering -> (abstract numbering, formats that it has of its own).
        self.known: dict[str, tuple[str, dict[int, str]]] = {}
        #: Style -> (style it is based on, numbering, level, name).
        self.styles: dict[str, tuple[str | None, str | None, str | None, str]] = {}
        for a in numbering.iter(f"{_W}abstractNum") if numbering is not None else ():
            levels = {int(l.get(f"{_W}ilvl", "0")): (_value(l, "numFmt") or "decimal", _value(l, "pStyle")) for l in a.findall(f"{_W}lvl")}
            self.abstract[a.get(f"{_W}abstractNumId", "")] = levels
        for n in numbering.findall(f"{_W}num") if numbering is not None else ():
            own = {int(o.get(f"{_W}ilvl", "0")): f for o in n.findall(f"{_W}lvlOverride") if (f := _value(o, "lvl/numFmt"))}
            self.known[n.get(f"{_W}numId", "")] = (_value(n, "abstractNumId") or "", own)
        for s in styles.iter(f"{_W}style") if styles is not None else ():
            self.styles[s.get(f"{_W}styleId", "")] = (_value(s, "basedOn"), _value(s, "pPr/numPr/numId"), _value(s, "pPr/numPr/ilvl"), _value(s, "name") or "")

    def chain(self, style: str | None) -> Iterator[str]:
        """A style and those it is based on, nearest first."""
        seen: set[str] = set()
        while style is not None and style not in seen:
            seen.add(style)
            yield style
            style = self.styles[style][0] if style in self.styles else None

    def item(self, p: ElementTree.Element) -> tuple[int, str] | None:
        """(level, "ol" or "ul") of a paragraph, if it is a list item."""
        style = _value(p, "pPr/pStyle")
        number, level = _value(p, "pPr/numPr/numId"), _value(p, "pPr/numPr/ilvl")
        marked = p.find(f"{_W}pPr/{_W}numPr") is not None
        for s in self.chain(style):
            _, n, l, _ = self.styles.get(s, (None, None, None, ""))
            if number is None and n is not None:
                number = n
                # A style that is bound to a level of its list has that level.
                bound = [k for k, (_, of) in self.abstract.get(self.known.get(n, ("", {}))[0], {}).items() if of == s]
                l = str(bound[0]) if bound else l
            level = l if level is None else level
        if number == "0" or (number is None and not marked):
            return None
        at = int(level) if level and level.isdigit() else 0
        abstract, own = self.known.get(number or "", ("", {}))
        form = own.get(at) or self.abstract.get(abstract, {}).get(at, (None, None))[0]
        if form is None:
            return at, "ol" if "number" in (style or "").lower() else "ul"
        return at, "ul" if form in ("bullet", "none") else "ol"


class Docx:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        part = lambda name: ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else None
        self.numbering = Numbering(part("word/numbering.xml"), part("word/styles.xml"))
        self.body = ElementTree.fromstring(self.zip.read("word/document.xml")).find(f"{_W}body")
        self.targets: dict[str, str] = {}
        if "word/_rels/document.xml.rels" in self.zip.namelist():
            for r in ElementTree.fromstring(self.zip.read("word/_rels/document.xml.rels")).iter(f"{_P}Relationship"):
                self.targets[r.get("Id", "")] = r.get("Target", "")
        self.images: list[tuple[str, bytes]] = []  # (content type, bytes), in order

    def _image(self, blip: ElementTree.Element) -> str:
        target = self.targets.get(blip.get(f"{_R}embed", ""), "")
        name = posixpath.normpath(posixpath.join("word", target)).lstrip("/")
        data = self.zip.read(name) if name in self.zip.namelist() else b""
        self.images.append((TYPES.get(name.rsplit(".", 1)[-1].lower(), "image/png"), data))
        return f'<img src="image:{len(self.images)}">'

    def _inline(self, element: ElementTree.Element) -> str:
        out = []
        for e in element:
            if e.tag == f"{_W}r":
                text = "".join(self._run(x) for x in e)
                style = e.find(f"{_W}rPr")
                on = lambda t, style=style: style is not None and (x := style.find(f"{_W}{t}")) is not None and x.get(f"{_W}val", "1") not in ("0", "false")
                if text.strip():
                    text = f"<em>{text}</em>" if on("i") else text
                    text = f"<strong>{text}</strong>" if on("b") else text
                out.append(text)
            elif e.tag == f"{_W}hyperlink":
                inner = self._inline(e)
                url = self.targets.get(e.get(f"{_R}id", ""), "") or "#" + (e.get(f"{_W}anchor") or "")
                out.append(f'<a href="{escape(url)}">{inner}</a>')
            elif e.tag in (f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent"):
                out.append(self._inline(e))
        return "".join(out)

    def _run(self, e: ElementTree.Element) -> str:
        if e.tag == f"{_W}t":
            return escape(e.text or "", quote=False)
        if e.tag == f"{_W}tab":
            return "\t"
        if e.tag in (f"{_W}br", f"{_W}cr"):
            return "<br>"
        return "".join(self._image(b) for b in e.iter(f"{_A}blip"))

    def _blocks(self, parent: ElementTree.Element) -> Iterator[tuple[tuple[int, str] | None, str]]:
        """(level and kind of a list item, html) of each block."""
        for e in parent:
            if e.tag == f"{_W}p":
                style = e.find(f"{_W}pPr/{_W}pStyle")
                name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
                inner = self._inline(e)
                item = self.numbering.item(e)
                if name.startswith("heading") and name[7:8].isdigit():
                    yield None, f"<h{min(6, int(name[7]))}>{inner}</h{min(6, int(name[7]))}>"
                elif name == "title":
                    yield None, f"<h1>{inner}</h1>"
                elif item is not None:
                    yield item, inner
                elif inner.strip():
                    yield None, f"<p>{inner}</p>"
            elif e.tag == f"{_W}tbl":
                rows = ["<tr>" + "".join(f"<td>{'<br>'.join(self._inline(p) for p in c.iter(f'{_W}p'))}</td>" for c in r.findall(f"{_W}tc")) + "</tr>" for r in e.findall(f"{_W}tr")]
                yield None, f"<table>{''.join(rows)}</table>"
            elif e.tag in (f"{_W}sdt", f"{_W}sdtContent"):
                yield from self._blocks(e)

    def html(self) -> str:
        out: list[str] = []
        lists: list[str] = []  # kinds of the open lists, each with an open item

        def close(depth: int) -> None:
            while len(lists) > depth:
                out.append(f"</li></{lists.pop()}>")

        for item, block in self._blocks(self.body if self.body is not None else []):
            if item is None:
                close(0)
                out.append(block)
                continue
            level, kind = item
            close(level + 1)
            if len(lists) == level + 1:
                if lists[-1] == kind:
                    out.append("</li><li>")
                else:
                    close(level)
            while len(lists) <= level:
                out.append(f"<{kind}><li>")
                lists.append(kind)
            out.append(block)
        close(0)
        return "".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    image = pa.struct([("seq", pa.int32()), ("content_type", pa.string()), ("b64_len", pa.int64()), ("data", pa.binary())])
    for b in pieces(batches):
        rows: list[list] = [[], [], [], []]
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                doc = Docx(data or b"")
                html = doc.html()
                images = [{"seq": i, "content_type": t, "b64_len": len(base64.b64encode(d)), "data": d} for i, (t, d) in enumerate(doc.images, 1)]
                found = (path, html, images, None)
            except Exception as e:  # one bad file is a row of the error table
                found = (path, None, [], str(e) or type(e).__name__)
            for into, x in zip(rows, found, strict=True):
                into.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(image)), pa.array(rows[3], pa.string())], ["path", "html", "images", "error"])


def docx_to_html(files: DataFrame) -> DataFrame:
    """path, html, images, error of files with columns path and content.

    Lock files are left out. Image ``n`` of a document stands in its html as
    ``image:n``; see ``plans.build`` for the names that replace it.
    """
    own = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")
    return own.mapInArrow(_read, "path string, html string, images array<struct<seq:int,content_type:string,b64_len:long,data:binary>>, error string")
