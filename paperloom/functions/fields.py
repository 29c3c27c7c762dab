"""Accessors and escapes over segments and values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.sources.segments import WHITE, cut, once, quoted


def first_segment(segments: Column, tag: str) -> Column:
    return F.get(F.filter(segments, lambda s: s["tag"] == tag), 0)


def field(segment: Column, n: int) -> Column:
    """Field n, from 1; null if absent."""
    return F.get(segment["fields"], n - 1)


def component(value: Column, m: int, separator: Column | str = "^") -> Column:
    return F.get(cut(value, F.lit(separator) if isinstance(separator, str) else separator), m - 1)


def repetitions(value: Column, separator: Column | str = "~") -> Column:
    """The repetitions that aren't empty."""
    return F.filter(cut(value, F.lit(separator) if isinstance(separator, str) else separator), lambda x: x != "")


def repetition(value: Column, r: int, separator: Column | str = "~") -> Column:
    """Repetition r, from 1, blank ones counted; null if absent."""
    return component(value, r, separator)


def hl7_escape_text(value: Column) -> Column:
    """Free text as one value: the five delimiters escaped, line ends as spaces."""
    value = F.regexp_replace(value, r"\\", r"\\E\\")
    for char, code in (("|", "F"), ("^", "S"), ("~", "R"), ("&", "T")):
        value = F.call_function("replace", value, F.lit(char), F.lit(f"\\{code}\\"))
    return F.regexp_replace(value, "[\r\n]", " ")


def hl7_escape_value(value: Column, delimiters: Column | None = None) -> Column:
    """A value whose components stay readable: the escape and field characters and line ends are escaped."""
    escape, field_mark = (F.lit("\\"), F.lit("|")) if delimiters is None else (delimiters["escape"], delimiters["field"])
    hidden = F.call_function("replace", value, escape, F.lit("\x00"))
    for char, code in ((field_mark, "F"), (F.lit("\r"), "X0D"), (F.lit("\n"), "X0A"), (F.lit("\x00"), "E")):
        hidden = F.call_function("replace", hidden, char, F.concat(escape, F.lit(code), escape))
    return hidden


def hl7_unescape(value: Column, delimiters: Column | None = None) -> Column:
    """Known escapes resolved in one pass: of a split at the escape character, the odd parts are codes. Unknown codes and an
    escape character without a partner stay as they are."""
    escape = F.lit("\\") if delimiters is None else delimiters["escape"]
    marks = {"F": ("|", "field"), "S": ("^", "component"), "R": ("~", "repeat"), "T": ("&", "subcomponent")}

    def resolved(parts: Column) -> Column:
        def shown(part: Column, i: Column) -> Column:
            code = F.when(part == "E", escape)
            for name, (usual, own) in marks.items():
                code = code.when(part == name, F.lit(usual) if delimiters is None else delimiters[own])
            lone = i == F.size(parts) - 1
            return F.when(i % 2 == 0, part).when(lone, F.concat(escape, part)).otherwise(F.coalesce(code, F.concat(escape, part, escape)))

        return F.array_join(F.transform(parts, shown), "")

    return once(value, lambda v: F.when(F.contains(v, escape), once(cut(v, escape), resolved)).otherwise(v))


def edifact_release(value: Column) -> Column:
    """A value with its syntax characters released (the terminator excepted, which can't be)."""
    return F.regexp_replace(value, r"([?+:])", r"?$1")


def edifact_unescape(value: Column, release: Column | None = None) -> Column:
    mark = F.lit("?") if release is None else release
    return F.regexp_replace(value, F.concat(F.lit("(?s)"), quoted(mark), F.lit("(.|$)")), F.lit("$1"))


def xml_escape(value: Column) -> Column:
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.call_function("replace", value, F.lit(char), F.lit(code))
    return value


def xml_error(value: Column) -> Column:
    """Why a value can't stand in XML 1.0, or null: it holds a control character or a lone surrogate."""
    return F.when(value.rlike("[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"), "a character that XML can't hold")


def json_pointer_escape(key: Column) -> Column:
    return F.call_function("replace", F.call_function("replace", key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def sheet_column_index(letters: Column) -> Column:
    """A spreadsheet column's number, from 1."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def is_fhir_datetime(value: Column) -> Column:
    """A date, or a day with a time to the minute at least and, if at all, an offset of 14 hours at most."""
    parts = F.split(value, "T", 2)
    time = r"^([01]\d|2[0-3]):[0-5]\d(:([0-5]\d|60))?(\.\d+)?(Z|[+-](0\d|1[0-4]):[0-5]\d)?$"
    return is_fhir_date(F.get(parts, 0)) & ((F.size(parts) == 1) | F.coalesce(F.get(parts, 1).rlike(time), F.lit(False)))


def is_instant(value: Column) -> Column:
    """Whether a text looks like a moment in time: a day and a time to the second, with an offset or Z."""
    return F.coalesce(value.rlike(r"^[0-9]{4}-..-..T..:..:..(.*Z|.*[+].*|.*-.*)$"), F.lit(False))


def is_fhir_date(value: Column) -> Column:
    """YYYY, YYYY-MM or a calendar day."""
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    return F.coalesce(value.rlike(r"^\d{4}$") | value.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") | day, F.lit(False))


def element_kind_ok(kind: Column, value: Column) -> Column:
    """Whether an EDI element's value fits its type."""
    return (
        F.when(kind == "an", F.lit(True))
        .when(kind.isin("n", "dt"), value.rlike(r"^[0-9]+$"))
        .when(kind == "r", value.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*)$"))
        .otherwise(value.rlike(r"^[A-Za-z0-9.\-+/]+$"))
    )


def sniffed(text: Column) -> Column:
    """The format of a text, or null."""
    own = F.when(text.startswith("﻿"), F.substring(text, 2, 1 << 30)).otherwise(text)
    return once(F.ltrim(own, F.lit(WHITE)), _sniffed)


def _sniffed(t: Column) -> Column:
    head = F.substring(t, 1, 4096)
    return (
        F.when(t.startswith("%PDF-"), "pdf")
        .when(t.startswith("MSH|"), "hl7v2")
        .when(t.startswith("ISA"), "x12")
        .when(t.startswith("UNA") | t.startswith("UNB"), "edifact")
        .when(t.startswith("{"), "fhir-json")
        .when(t.startswith("<") & (head.contains("<Invoice") | head.contains("<CreditNote")), "ubl")
        .when(t.startswith("<") & F.lower(head).rlike("<html|<!doctype html|<p|<h1"), "html")
    )


def sniffed_file(content: Column) -> Column:
    """The format of a file's bytes: an archive by the names of its parts, any other by its text."""
    has = lambda name: F.contains(content, F.lit(name).cast("binary"))
    archive = F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04"))
    return F.when(archive, F.when(has("word/document.xml"), "docx").when(has("xl/workbook.xml"), "xlsx")).otherwise(sniffed(F.decode(content, "UTF-8")))
