"""Messages as arrays of segments: HL7 v2, X12 and EDIFACT, as Column expressions.

A segment is (idx, tag, fields); fields[0] is the first field after the tag. For HL7 the separator is field 1 of MSH,
as the standard numbers it. Delimiters are read from each message. Nothing here leaves whole-stage Spark.
Null messages give null; messages that don't start as their format must give null too, with the reason from the
``*_error`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WHITE = " \t\n\x0b\f\r"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once. Catalyst copies a projected expression into every place that uses
    it, which for a parsed message means parsing it again and again; it doesn't copy through a generator."""
    for name, column in columns.items():
        df = df.select(*df.columns, F.explode(F.array(column)).alias(name))
    return df


def once(value: Column, use) -> Column:
    """What ``use`` makes of a value, the value computed once: an expression that is used twice is computed twice, a lambda's argument isn't. By the
    last step of a fold over nothing, since that, unlike a transform, doesn't copy what it gives."""
    return F.aggregate(F.array(), value, lambda done, _: done, use)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by key to as many tasks as a shuffle has: a table of small rows is one or a few splits of a file, however long each
    row's work is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def quoted(delimiter: Column) -> Column:
    """A delimiter as a regular expression for itself. A backslash before a character that is no letter or digit is what
    Java splits at without compiling an expression."""
    return F.when(delimiter.rlike("^[^A-Za-z0-9]$"), F.concat(F.lit("\\"), delimiter)).otherwise(F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def cut(text: Column, delimiter: Column, most: int = -1) -> Column:
    return F.call_function("split", text, quoted(delimiter), F.lit(most))


def _cut(text: Column, pattern: Column, most: int = -1) -> Column:
    """As :func:`cut`, at a delimiter that is quoted already: once a message, not once a segment."""
    return F.call_function("split", text, pattern, F.lit(most))


def _segments(parts: Column, fields) -> Column:
    """(idx, tag, fields) of each part; ``fields`` maps a part to its array, tag first."""

    def one(own: Column, i: Column) -> Column:
        return F.struct(i.alias("idx"), F.get(own, 0).alias("tag"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))).alias("fields"))

    return F.transform(parts, lambda part, i: once(fields(part), lambda own: one(own, i)))


def hl7_delimiters(message: Column) -> Column:
    """(field, component, repeat, escape, subcomponent) from the MSH segment."""
    at = {"field": 4, "component": 5, "repeat": 6, "escape": 7, "subcomponent": 8}
    return F.struct(*[F.substring(message, n, 1).alias(name) for name, n in at.items()])


def hl7_error(message: Column) -> Column:
    """Why a message can't be scanned, or null."""
    five = F.split(F.substring(message, 4, 5), "")
    return (
        F.when(message.isNull(), "empty message")
        .when(~message.startswith("MSH"), "message does not start with MSH")
        .when((F.length(message) < 8) | ~F.substring(message, 4, 5).rlike(r"^[\x21-\x7E]{5}$"), "MSH is too short for its delimiters")
        .when(F.size(F.array_distinct(five)) != 5, "delimiters are not distinct")
    )


def hl7_segments(message: Column, delimiters: Column | None = None) -> Column:
    """The segments; CR, LF and CRLF end one, empty ones are skipped, at most 256 parts each."""
    d = hl7_delimiters(message) if delimiters is None else delimiters
    lines = F.filter(F.split(F.translate(message, "\n", "\r"), "\r"), lambda x: x != "")

    def fields(line: Column, q: Column) -> Column:
        parts = _cut(line, q, 256)
        header = lambda x: F.concat(F.array(F.lit("MSH"), d["field"]), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))))
        return once(parts, lambda x: F.when(F.get(x, 0) == "MSH", header(x)).otherwise(x))

    found = once(quoted(d["field"]), lambda q: _segments(lines, lambda x: fields(x, q)))
    return found if delimiters is not None else F.when(hl7_error(message).isNull(), found)


def x12_delimiters(message: Column) -> Column:
    """(element, repetition, component, segment) from the fixed places of ISA."""
    at = {"element": 4, "repetition": 83, "component": 105, "segment": 106}
    return F.struct(*[F.substring(message, n, 1).alias(name) for name, n in at.items()])


def x12_error(message: Column) -> Column:
    d = x12_delimiters(message)
    return (
        F.when(message.isNull(), "empty interchange")
        .when((F.octet_length(message) < 106) | ~message.startswith("ISA"), "interchange does not start with a whole ISA")
        .when((d["component"] == d["element"]) | (d["segment"] == d["element"]), "separators are not distinct")
    )


def x12_segments(message: Column) -> Column:
    """The segments, each trimmed; at most 64 parts each."""
    d = x12_delimiters(message)
    parts = F.filter(F.transform(cut(message, d["segment"]), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    return F.when(x12_error(message).isNull(), once(quoted(d["element"]), lambda q: _segments(parts, lambda x: _cut(x, q, 64))))


def edifact_delimiters(message: Column) -> Column:
    """(component, element, decimal, release, terminator) from UNA, or the standard ones."""
    una = message.startswith("UNA") & (F.length(message) >= 9)
    standard = {"component": (4, ":"), "element": (5, "+"), "decimal": (6, "."), "release": (7, "?"), "terminator": (9, "'")}
    return F.struct(*[F.when(una, F.substring(message, n, 1)).otherwise(F.lit(x)).alias(name) for name, (n, x) in standard.items()])


def edifact_error(message: Column) -> Column:
    """Why an interchange can't be read to its end, or null: what follows the last terminator is no white space."""
    d = edifact_delimiters(message)
    tail = F.btrim(F.element_at(cut(message, d["terminator"]), -1), F.lit(WHITE))
    return F.when(message.isNull(), "empty interchange").when(F.btrim(message, F.lit(WHITE)) == "", "empty interchange").when(tail != "", "the last segment has no terminator")


def edifact_segments(message: Column) -> Column:
    """The segments. The terminator ends one even after a release character; elements keep their release characters."""
    return once(edifact_delimiters(message), lambda d: once(_edifact_marks(d), lambda q: _edifact_segments(message, d, q)))


def _edifact_marks(d: Column) -> Column:
    """What the segments of a message share, computed once a message: the quoted element separator, what finds a released character,
    and how one is shown again."""
    shown = F.concat(F.regexp_replace(d["release"], r"([\\$])", r"\\$1"), F.lit("$1"))
    return F.struct(quoted(d["element"]).alias("element"), F.concat(quoted(d["release"]), F.lit("(.)")).alias("pair"), shown.alias("shown"), F.concat(F.lit("\x01"), d["element"], F.lit("\x01")).alias("hidden"), F.concat(d["release"], d["element"]).alias("released"))


def _edifact_segments(message: Column, d: Column, q: Column) -> Column:
    body = F.when(message.startswith("UNA") & (F.length(message) >= 9), F.substring(message, 10, 1 << 30)).otherwise(message)
    bare = lambda x: F.when(x.startswith("\r") | x.startswith("\n"), F.ltrim(x, F.lit("\r\n"))).otherwise(x)
    parts = F.filter(F.transform(cut(body, d["terminator"]), bare), lambda x: x != "")
    mark = "\x01"

    def fields(part: Column) -> Column:
        # a released separator is hidden from the split, then shown again
        hidden = F.regexp_replace(part, q["pair"], F.lit(f"{mark}$1{mark}"))
        shielded = F.call_function("replace", hidden, q["hidden"], F.lit("\x02"))
        back = lambda x: F.regexp_replace(F.call_function("replace", x, F.lit("\x02"), q["released"]), f"{mark}(.){mark}", q["shown"])
        shown = F.transform(_cut(shielded, q["element"]), lambda x: F.when(F.contains(x, F.lit(mark)) | F.contains(x, F.lit("\x02")), back(x)).otherwise(x))
        return F.when(F.contains(part, d["release"]), shown).otherwise(_cut(part, q["element"]))

    return _segments(parts, fields)
