"""Texts for pages: character references, white space, inline styles and templates."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: The named references, the deepest nesting of blocks, the most bytes of a filled template.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
MAX_DEPTH = 16
MAX_OUTPUT = 16 * 1024 * 1024


def collapsed(text: Column) -> Column:
    """The text with each run of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _reference(m: re.Match) -> str:
    name = m[1]
    number = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", name)
    if number:
        code = int(number[1], 16) if number[1] else int(number[2])
        return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else m[0]
    return NAMED.get(name, m[0])


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """The text with references of up to 11 characters resolved once; unknown ones stay."""
    return texts.map(lambda t: re.sub(r"&([0-9A-Za-z#]{0,11});", _reference, t), na_action="ignore")


def length_pt(value: Column) -> Column:
    """A length in points; pixels are three quarters of one. Null for other units."""
    v, pattern = F.lower(F.trim(value)), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*(pt|px)$"
    number = F.regexp_extract(v, pattern, 1).try_cast("double")
    return F.when(F.regexp_extract(v, pattern, 2) == "px", number * 0.75).otherwise(number)


def _box(value: Column) -> Column:
    """Top, right, bottom and left of one to four lengths; null if one of them is none."""
    parts = F.transform(F.split(F.trim(value), r"\s+"), length_pt)
    n, at = F.size(parts), lambda i: F.get(parts, i)
    whole = F.array(at(0), F.when(n > 1, at(1)).otherwise(at(0)), F.when(n > 2, at(2)).otherwise(at(0)), F.when(n > 3, at(3)).when(n > 1, at(1)).otherwise(at(0)))
    return F.when((n <= 4) & ~F.exists(parts, lambda x: x.isNull()), whole)


def inline_style(style: Column) -> Column:
    """(font_size_pt, font_weight, text_align, margin, padding, page_break_before, page_break_after) of declarations; the
    last of a property counts, but a weight that is none is skipped. Unknown properties are left out."""
    own = F.filter(F.split(style, ";"), lambda x: x.contains(":"))
    pairs = F.transform(own, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "(?s)^([^:]*):(.*)$", 1))).alias("k"), F.trim(F.regexp_extract(x, "(?s)^([^:]*):(.*)$", 2)).alias("v")))
    last = lambda name: F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]
    weight = lambda v: F.when(v.isin("bold", "bolder"), 700).when(v.isin("normal", "lighter"), 400).when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("int"))
    weights = F.filter(F.transform(F.filter(pairs, lambda p: p["k"] == "font-weight"), lambda p: weight(F.lower(p["v"]))), lambda w: w.between(0, 65535))
    align = F.lower(last("text-align"))
    always = lambda name: F.coalesce(F.lower(last(name)) == "always", F.lit(False))
    return F.struct(
        length_pt(last("font-size")).alias("font_size_pt"), F.try_element_at(weights, F.lit(-1)).alias("font_weight"), F.when(align.isin("left", "right", "center", "justify"), align).alias("text_align"),
        _box(last("margin")).alias("margin"), _box(last("padding")).alias("padding"), always("page-break-before").alias("page_break_before"), always("page-break-after").alias("page_break_after"),
    )


class TemplateError(ValueError):
    pass


@lru_cache(maxsize=64)
def _blocks(template: str) -> list:
    """A template as (kind, name, body, otherwise) blocks, inner ones in the bodies."""
    top = ("", "", [], [])
    open_blocks, into = [top], [top[2]]
    for i, part in enumerate(re.split(r"\{\{(.*?)\}\}", template, flags=re.S)):
        if i % 2 == 0:
            if "{{" in part:
                raise TemplateError("unterminated `{{` tag")
            into[-1].append(("text", part, [], []))
            continue
        tag, inner = part.strip(), open_blocks[-1]
        head = re.match(r"#(if|each) (.*)", tag, re.S)
        if head:
            block = (head[1], head[2].strip(), [], [])
            into[-1].append(block)
            open_blocks.append(block)
            into.append(block[2])
            if len(open_blocks) > MAX_DEPTH + 1:
                raise TemplateError("blocks nested too deeply")
        elif tag == "else" and inner[0] == "if" and into[-1] is inner[2]:
            into[-1] = inner[3]
        elif inner[0] and tag == f"/{inner[0]}":
            open_blocks.pop()
            into.pop()
        elif tag == "else" or tag.startswith("/"):
            raise TemplateError(f"`#{inner[0]}` is never closed" if inner[0] else f"unexpected `{{{{{tag}}}}}`")
        elif tag.startswith("#"):
            raise TemplateError(f"unknown block `{{{{{tag}}}}}`")
        elif not tag:
            raise TemplateError("empty `{{}}` tag")
        else:
            into[-1].append(("value", tag, [], []))
    if len(open_blocks) > 1:
        raise TemplateError(f"`#{open_blocks[-1][0]}` is never closed")
    return top[2]


_MISSING = object()


def _found(path: str, scopes: list) -> object:
    """The value of a path in the innermost scope that has it; scopes[0] is the whole data."""
    if path == ".":
        if len(scopes) == 1:
            raise TemplateError("missing field `.`")
        return scopes[-1][0]
    for value, _ in reversed(scopes):
        for name in path.split("."):
            if isinstance(value, dict):
                value = value.get(name, _MISSING)
            elif isinstance(value, list) and re.fullmatch(r"\+?[0-9]+", name) and int(name) < len(value):
                value = value[int(name)]
            else:
                value = _MISSING
        if value is not _MISSING:
            return value
    raise TemplateError(f"missing field `{path}`")


def _shown(path: str, value: object) -> str:
    if isinstance(value, (dict, list)):
        raise TemplateError(f"field `{path}` is an array or object, not text")
    if isinstance(value, str):
        return value.translate({38: "&amp;", 60: "&lt;", 62: "&gt;", 34: "&quot;", 39: "&#39;"})
    return "" if value is None else json.dumps(value)


def _fill(blocks: list, scopes: list, out: list[str], size: int) -> int:
    """Adds the text of the blocks to out; returns the bytes so far."""
    for kind, name, body, otherwise in blocks:
        if kind == "if":
            size = _fill(body if _found(name, scopes) else otherwise, scopes, out, size)
        elif kind == "each":
            value = _found(name, scopes)
            if value is not None and not isinstance(value, (dict, list)):
                raise TemplateError(f"`#each {name}` needs an array or object")
            items = [value[k] for k in sorted(value)] if isinstance(value, dict) else value or []
            for i, item in enumerate(items):
                size = _fill(body, [*scopes, (item, i)], out, size)
        else:
            if kind == "value" and name == "@index" and len(scopes) == 1:
                raise TemplateError("`@index` used outside `#each`")
            text = name if kind == "text" else str(scopes[-1][1]) if name == "@index" else _shown(name, _found(name, scopes))
            out.append(text)
            size += len(text.encode())
        if size > MAX_OUTPUT:
            raise TemplateError("rendered output is too large")
    return size


@F.pandas_udf(StructType().add("text", "string").add("error", "string"))
def merged(templates: pd.Series, data: pd.Series) -> pd.DataFrame:
    """(text, error): each template filled from its JSON; {{path}}, {{#if path}}, {{else}}, {{#each path}} and {{@index}}."""

    def one(template, text):
        try:
            out: list[str] = []
            _fill(_blocks(template), [(json.loads(text), 0)], out, 0)
            return "".join(out), None
        except TemplateError as e:
            return None, str(e)
        except (TypeError, ValueError):
            return None, "data isn't JSON"

    return pd.DataFrame([one(a, b) for a, b in zip(templates, data, strict=True)], columns=["text", "error"], dtype=object)
