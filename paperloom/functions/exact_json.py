"""JSON as VARIANT with every number as it is written: 5.40 stays 5.40.

Parsers, VARIANT among them, keep a number's value, not its digits. So each number outside a string becomes a string that starts with
a mark before the text is parsed, and loses quotes and mark when it is written again. Everything is a Column expression: the text is
split at its quotes, of which those inside strings stand aside, so no pattern repeats over a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noncharacters, which are no text: before a number; in place of an escaped quote and an escaped backslash.
NUMBER, QUOTE, BACKSLASH = "\ufdd0", "\ufdd1", "\ufdd2"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.call_function("replace", text, F.lit(old), F.lit(new))


def marked_numbers(text: Column) -> Column:
    """The JSON text with its numbers as marked strings; null for a text that holds one of the marks itself."""
    aside = _replaced(_replaced(text, "\\\\", BACKSLASH), '\\"', QUOTE)
    parts = F.split(aside, '"')  # every other part is inside a string
    told = F.transform(parts, lambda x, k: F.when(k % 2 == 0, F.regexp_replace(x, "(-?[0-9][0-9.eE+-]*)", f'"{NUMBER}$1"')).otherwise(x))
    whole = _replaced(_replaced(F.array_join(told, '"'), QUOTE, '\\"'), BACKSLASH, "\\\\")
    return F.when(~text.rlike(f"[{NUMBER}{QUOTE}{BACKSLASH}]"), whole)


def exact_json(text: Column) -> Column:
    """The VARIANT of a JSON text, numbers as marked strings; null if it is no JSON."""
    return F.try_parse_json(marked_numbers(text))


def unmarked(json: Column) -> Column:
    """A text that was written with marked numbers, as JSON: they are numbers again."""
    return F.regexp_replace(json, f'"{NUMBER}([^"]*)"', "$1")


def json_text(value: Column) -> Column:
    """The JSON of a VARIANT of :func:`exact_json`: names in order, numbers with their digits."""
    return unmarked(F.to_json(value))


def digits(value: Column) -> Column:
    """The digits of a marked number; another text as it is."""
    return F.regexp_replace(value, f"^{NUMBER}", "")
