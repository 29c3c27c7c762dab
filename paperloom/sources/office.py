"""Spreadsheets and text documents: cells and text out of files, and files out of rows.

Files come as rows (path, content), as the ``binaryFile`` source gives them; each is read where it lies, so that only
one file has to fit in a task. A file that can't be read is one row with its error.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from paperloom.sources.segments import bound

#: The most bytes that a part of a file may unpack to.
MAX_PART = 256 * 1024 * 1024
CELLS = "path string, row long, ref string, kind string, text string, number double, error string"
#: What cells of a type are; the names of the relation to a sheet and of its main namespace.
KINDS = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: What elements of a document stand for; the parts that differ from file to file; the records of an archive.
BREAKS = {"tab": "\t", "br": "\n", "p": "\n"}
CONTENTS = ("word/document.xml", "xl/worksheets/sheet1.xml")
END, ENTRY, LOCAL = struct.Struct("<4sI2H2IH"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")
COMMON, REST = struct.Struct("<5H3I2H"), struct.Struct("<3H2I")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def csv_values(record: Column) -> Column:
    """The values of a CSV record as text, however many there are; a quoted one loses its quotes."""
    found = F.regexp_extract_all(record, F.lit(r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.call_function("replace", F.substring(x, 2, F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def csv_line(values: Column) -> Column:
    """A CSV record of values as text: those with a comma, a quote or a line end are quoted. Null: empty."""
    quoted = lambda x: F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.call_function("replace", x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    return F.array_join(F.transform(values, quoted), ",")


def csv_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows of CSV files under the names of their first lines, all as text; short rows end in nulls, what a row has beyond
    its header is in the array ``_rest``. ``multi_line``: quoted values may hold line ends; files are not split then."""
    names = spark.read.option("header", True).option("multiLine", multi_line).csv(path).columns
    # a record of more than one value doesn't fit this schema, and so comes whole
    raw = spark.read.schema("__one string, __raw string").option("columnNameOfCorruptRecord", "__raw").option("header", True).option("enforceSchema", True).option("multiLine", multi_line).csv(path)
    values = bound(raw, v=F.when(F.col("__raw").isNull(), F.array("__one")).otherwise(csv_values(F.col("__raw"))))
    extra = F.slice("v", len(names) + 1, F.greatest(F.size("v") - len(names), F.lit(0)))
    return values.select(*[F.get("v", k).alias(name) for k, name in enumerate(names)], extra.alias("_rest"))


def csv_files(rows: DataFrame, path: str) -> None:
    """Writes the rows as CSV files with a header."""
    rows.select([F.col(c).cast("string").alias(c) for c in rows.columns]).write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def _part(archive: zipfile.ZipFile, name: str):
    if archive.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    return archive.open(name)


@functools.lru_cache(maxsize=1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _texts(item) -> str:
    """The text of a shared or inline string; readings over its characters don't belong to it."""
    return "".join(t.text or "" for child in item if _local(child.tag) != "rPh" for t in child.iter() if _local(t.tag) == "t")


def _sheet(archive: zipfile.ZipFile) -> str:
    """The part of the first sheet."""
    book = ElementTree.parse(_part(archive, "xl/workbook.xml"))
    first = next(x for x in book.iter() if _local(x.tag) == "sheet").get(f"{{{RELATIONS}}}id")
    links = ElementTree.parse(_part(archive, "xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links.iter() if x.get("Id") == first)
    return target[1:] if target.startswith("/") else f"xl/{target}"


def _value(kind: str, raw: str, cell, shared: list[str]) -> tuple:
    """(kind, text, number) of a cell."""
    if kind == "inlineStr":
        return "string", "".join(_texts(x) for x in cell if _local(x.tag) == "is"), None
    if kind == "s":
        if not raw.isdigit() or int(raw) >= len(shared):
            raise ValueError(f"bad shared string index `{raw}`")
        return "string", shared[int(raw)], None
    if kind == "b":
        return "boolean", "true" if raw in ("1", "true") else "false", None
    if kind in KINDS:
        return KINDS[kind], raw, None
    try:
        number = float(raw)
    except ValueError:
        return "string", raw, None
    return "number", str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number), number


def _cells(path: str, content: bytes) -> Iterator[tuple]:
    """The cells of the first sheet that aren't blank. A cell without a place follows the one before; of cells at a place
    that is taken or passed, the first stays."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = [_texts(x) for x in ElementTree.parse(_part(archive, "xl/sharedStrings.xml")).getroot() if _local(x.tag) == "si"]
        number = 0
        for _, row in ElementTree.iterparse(_part(archive, _sheet(archive))):
            if _local(row.tag) != "row":
                continue
            number = int(row.get("r") or number + 1)
            column = 0
            for cell in (x for x in row if _local(x.tag) == "c"):
                place = re.match("[A-Z]+", cell.get("r") or "")
                own = _column(place[0]) if place else column + 1
                raw = "".join(x.text or "" for x in cell if _local(x.tag) == "v").strip()
                kind = cell.get("t") or "n"
                if own <= column:
                    continue
                column = own
                if raw or kind != "n":
                    yield path, number, f"{_letters(own)}{number}", *_value(kind, raw, cell, shared), None
            row.clear()


def xlsx_cells(books: DataFrame) -> DataFrame:
    """(path, row, ref, kind, text, number, error) of each cell of each workbook's first sheet."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for cell in _cells(path, content):
                        rows.append(cell)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as e:  # noqa: BLE001  a damaged file is data, not a failure of the job
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in CELLS.split(", ")]
    return books.select("path", "content").mapInPandas(read, CELLS)


def flat_cells(cells: DataFrame) -> DataFrame:
    """(file, path, value) of the cells, to be compared: a path is a place such as B7."""
    return cells.where("ref is not null").select(F.col("path").alias("file"), F.col("ref").alias("path"), F.col("text").alias("value"))


def flat_lines(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """(key, path, value) of a document's lines, to be compared: a path is a number such as /p/3."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "value"))
    return lines.select(key, F.concat(F.lit("/p/"), F.col("n").cast("string")).alias("path"), "value")


def _told(parent, out: list[str], inner: bool = True) -> None:
    """The texts and breaks inside an element, in the order in which they end."""
    for x in parent:
        if inner and len(x):
            _told(x, out)
        name = _local(x.tag)
        if name == "t":
            out.append(x.text or "")
        elif name in BREAKS:
            out.append(BREAKS[name])


def _plain_part(content: bytes, name: bytes) -> bytes | None:
    """A part of an archive without anything unusual (comments, extra fields, encryption, 64-bit sizes, bytes before or between its
    entries that don't add up); null if there is any, or the part is damaged, missing or too large."""
    end = len(content) - END.size
    if end < 0:
        return None
    mark, disks, _, _, size, start, comment = END.unpack_from(content, end)
    if mark != b"PK\5\6" or disks or comment or start + size != end or content[end - 20 : end - 16] == b"PK\6\7":
        return None
    at, starts, own = start, [start], None
    while at < end:
        if at + ENTRY.size > end:
            return None
        entry = ENTRY.unpack_from(content, at)
        mark, _, version, flags, *_, chars, extra, remark, disk, _, _, offset = entry
        called = content[at + ENTRY.size : at + ENTRY.size + chars]
        at += ENTRY.size + chars
        if mark != b"PK\1\2" or version > 20 or flags & ~0x80E or extra or remark or disk or at > end or not called.isascii() or b"\0" in called:
            return None
        starts.append(offset)
        if called == name:
            own = entry
    if own is None or len(set(starts)) < len(starts):
        return None
    method, check, packed, size, offset = own[4], own[7], own[8], own[9], own[-1]
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or max(size, 1032 * packed) > MAX_PART or offset + LOCAL.size > start:
        return None
    mark, *_, chars, extra = LOCAL.unpack_from(content, offset)
    at = offset + LOCAL.size + chars + extra
    if mark != b"PK\3\4" or content[offset + LOCAL.size : offset + LOCAL.size + chars] != name or at + packed > min(x for x in starts if x > offset):
        return None
    data = content[at : at + packed]
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(data, -15, size + 1)
        except zlib.error:
            return None
    return data if len(data) == size and zlib.crc32(data) == check else None


def _document(content: bytes) -> str:
    data = _plain_part(content, b"word/document.xml")
    if data is None:  # unusual or damaged: the general reader reads it, or says what is wrong with it
        with zipfile.ZipFile(io.BytesIO(content)) as archive, _part(archive, "word/document.xml") as part:
            data = part.read()
    out: list[str] = []
    try:
        _told([ElementTree.fromstring(data)], out)
    except RecursionError:  # elements by the hundred in each other
        out = []
        for _, x in ElementTree.iterparse(io.BytesIO(data)):
            _told([x], out, False)
    return "".join(out).rstrip("\n")


@F.pandas_udf(StructType().add("text", "string").add("error", "string"))
def docx_text(contents: pd.Series) -> pd.DataFrame:
    """(text, error) of documents: paragraphs and breaks as new lines, tabs as tabs; headers and footers left out."""

    def one(content):
        try:
            return (None, None) if content is None else (_document(content), None)
        except Exception as e:  # noqa: BLE001  a damaged file is data, not a failure of the job
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(x) for x in contents], columns=["text", "error"], dtype=object)


def _entry(name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """A part of an archive: what its two headers have in common, its name and its packed bytes."""
    data = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}'.encode()
    stream = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    packed = stream.compress(data) + stream.flush()
    called = name.encode("ascii")
    return COMMON.pack(20, 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(data), len(packed), len(data), len(called), 0), called, packed  # 33: 1 January 1980


#: Parts that all documents have in common are packed once.
_fixed_entry = functools.lru_cache(maxsize=64)(_entry)


def _packed(parts: dict[str, str]) -> bytes:
    """An archive that depends on its parts alone, byte for byte as zipfile writes it."""
    local, central, at = [], [], 0
    for name, text in parts.items():
        common, called, packed = (_entry if name in CONTENTS else _fixed_entry)(name, text)
        local += (b"PK\3\4", common, called, packed)
        central += (b"PK\1\2\x14\3", common, REST.pack(0, 0, 0, 0o600 << 16, at), called)
        at += LOCAL.size + len(called) + len(packed)
    directory = b"".join(central)
    if at + len(directory) >= 1 << 31:
        raise ValueError("the file is too large")
    return b"".join((*local, directory, END.pack(b"PK\5\6", 0, len(parts), len(parts), len(directory), at, 0)))


def _package(main: str, kind: str, parts: dict[str, str], others: dict[str, str]) -> bytes:
    base = "http://schemas.openxmlformats.org/package/2006"
    types = "".join(f'<Override PartName="/{k}" ContentType="application/vnd.openxmlformats-officedocument.{v}+xml"/>' for k, v in {main: kind, **others}.items())
    rels = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    return _packed({
        "[Content_Types].xml": f'<Types xmlns="{base}/content-types">{rels}{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{base}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="{main}"/></Relationships>',
        **parts,
    })


_ILLEGAL = re.compile(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]")


def _legal(text: str) -> str:
    """The text for XML, without the characters that XML can't hold."""
    return escape(_ILLEGAL.sub("", text))


def _workbook(name: str, rows) -> bytes:
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, cell in enumerate(row["cells"], 1):
            if cell["number"] is not None and cell["number"] == cell["number"]:
                cells.append(f'<c r="{_letters(c)}{r}"><v>{cell["number"]!r}</v></c>')
            elif cell["text"] is not None:
                cells.append(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_legal(cell["text"])}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    sheet = escape(name, {'"': "&quot;"})
    return _package("xl/workbook.xml", "spreadsheetml.sheet.main", {
        "xl/workbook.xml": f'<workbook xmlns="{SHEETS}" xmlns:r="{RELATIONS}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEETS}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }, {"xl/worksheets/sheet1.xml": "spreadsheetml.worksheet"})


@F.pandas_udf(BinaryType())
def xlsx_file(names: pd.Series, rows: pd.Series) -> pd.Series:
    """A workbook of one sheet from its name and its rows; a row is (cells), its cells (text, number), and a cell with neither is blank."""
    return pd.Series([None if r is None else _workbook(n, r) for n, r in zip(names, rows, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def docx_file(paragraphs: pd.Series) -> pd.Series:
    """A document from its paragraphs."""

    def one(texts) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_legal(x or "")}</w:t></w:r></w:p>' for x in texts)
        return _package("word/document.xml", "wordprocessingml.document.main", {"word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body>{body}</w:body></w:document>'}, {})

    return pd.Series([None if x is None else one(x) for x in paragraphs], dtype=object)
