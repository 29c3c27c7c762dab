"""Blocks of HTML pages and of DOCX documents as rows. A page or document is read by a small helper in the task that holds it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that make a block, and those whose text isn't content.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li td th div".split())
SILENT = frozenset("head title script style".split())


def html_attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a start tag, quoted or not; null if it isn't there."""
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])


class _Blocks(HTMLParser):
    """(kind, text, style) of each block with text, in page order; text outside any block is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str | None]] = []
        self.kind, self.style, self.text, self.silent = "p", None, [], 0

    def _close(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.kind, text, self.style))
        self.kind, self.style, self.text = "p", None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self._close()
            self.kind, self.style = tag, dict(attrs).get("style")
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.silent:
            self.silent -= 1
        elif tag in BLOCKS or tag in ("tr", "table", "ul", "ol"):
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, kind, text, style): the blocks of each page in order, white space collapsed; null and empty pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in enumerate(batch.column(html).to_pylist()):
                blocks = _Blocks()
                blocks.feed(page or "")
                blocks.close()
                blocks._close()
                if blocks.found:
                    kinds, texts, styles = zip(*blocks.found, strict=True)
                    n = len(kinds)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([k] * n)), pa.array(range(n), pa.int32()), pa.array(kinds), pa.array(texts), pa.array(styles, pa.string())], [key, "n", "kind", "text", "style"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, n int, kind string, text string, style string")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraph(x) -> tuple[str, str | None]:
    """(text, style) of a paragraph."""
    parts, style = [], None
    for y in x.iter():
        name = _local(y.tag)
        if name == "t":
            parts.append(y.text or "")
        elif name in ("tab", "br"):
            parts.append("\t" if name == "tab" else "\n")
        elif name == "pStyle":
            style = next((v for k, v in y.attrib.items() if _local(k) == "val"), None)
    return "".join(parts), style


def _docx(content: bytes) -> Iterator[tuple]:
    """(kind, row, column, text, style): paragraphs and cells in order, then header and footer."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(x for x in ElementTree.parse(archive.open("word/document.xml")).getroot() if _local(x.tag) == "body")
        for x in body:
            if _local(x.tag) == "p":
                yield "paragraph", None, None, *_paragraph(x)
            elif _local(x.tag) == "tbl":
                for r, row in enumerate(y for y in x if _local(y.tag) == "tr"):
                    for c, cell in enumerate(y for y in row if _local(y.tag) == "tc"):
                        yield "cell", r, c, "\n".join(_paragraph(y)[0] for y in cell if _local(y.tag) == "p"), None
        for kind in ("header", "footer"):
            if f"word/{kind}1.xml" in archive.namelist():
                yield kind, None, None, "\n".join(_paragraph(y)[0] for y in ElementTree.parse(archive.open(f"word/{kind}1.xml")).getroot().iter() if _local(y.tag) == "p"), None


def docx_blocks(files: DataFrame) -> DataFrame:
    """(path, n, kind, row, column, text, style, error) of the documents (path, content); a damaged one has a row with its error."""
    names = ["path", "n", "kind", "row", "column", "text", "style", "error"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, n, *x, None) for n, x in enumerate(_docx(content))]
                except Exception as e:  # noqa: BLE001  a damaged file is data, not a failure of the job
                    rows = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, n int, kind string, row int, `column` int, text string, style string, error string")
