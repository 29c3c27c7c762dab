"""SQL functions over documents, registered in a session by :func:`register`.

Each is defined in SQL itself, so that ``spark.sql`` runs it as native expressions: no Python worker takes part, and Catalyst sees
through it. Scalar functions: ``sniff_format``, ``hl7_field_separator``, ``hl7_segments``, ``hl7_field``, ``hl7_component``,
``hl7_redact``, ``x12_segments``, ``x12_element``. Table functions, for ``LATERAL``: ``hl7_rows``, ``hl7_missing``.

Null gives null; a text that isn't of a function's format gives null, or no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperloom import rules


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _required() -> str:
    """The mandatory fields of HL7 segments as rows of SQL."""
    rows = [line.split(" ", 2) for line in rules.HL7_REQUIRED.strip().splitlines()]
    return ", ".join(f"({_literal(tag)}, {int(n)}, {_literal(name)})" for tag, n, name in rows)


def _cleared() -> str:
    """The fields that Safe Harbor clears or cuts to a year, as a map of SQL: segment-field to action."""
    own = [(f"{seg}-{n}", action) for seg, n, _, action, _ in rules.safe_harbor() if action in ("clear", "year")]
    return "map(" + ", ".join(f"{_literal(place)}, {_literal(action)}" for place, action in own) + ")"


SEGMENT = "array<struct<idx int, tag string, fields array<string>>>"

FUNCTIONS = {
    "sniff_format": """(t STRING) RETURNS STRING RETURN (
        SELECT CASE WHEN x LIKE '%PDF-%' AND startswith(x, '%PDF-') THEN 'pdf' WHEN startswith(x, 'MSH|') THEN 'hl7v2' WHEN startswith(x, 'ISA') THEN 'x12'
          WHEN startswith(x, 'UNA') OR startswith(x, 'UNB') THEN 'edifact' WHEN startswith(x, '{') THEN 'fhir-json'
          WHEN startswith(x, '<') AND (contains(left(x, 4096), '<Invoice') OR contains(left(x, 4096), '<CreditNote')) THEN 'ubl'
          WHEN startswith(x, '<') AND rlike(lower(left(x, 4096)), '<html|<!doctype html|<p|<h1') THEN 'html' END
        FROM (SELECT regexp_replace(t, '^\\\\uFEFF?[ \\\\t\\\\r\\\\n\\\\f\\\\x0b]*', '') AS x))""",
    "hl7_field_separator": "(m STRING) RETURNS STRING RETURN CASE WHEN startswith(m, 'MSH') AND length(m) >= 8 THEN substring(m, 4, 1) END",
    "hl7_segments": f"""(m STRING) RETURNS {SEGMENT} RETURN
        CASE WHEN hl7_field_separator(m) IS NOT NULL THEN transform(filter(split(translate(m, '\\n', '\\r'), '\\r'), x -> x <> ''), (x, i) -> named_struct(
          'idx', i, 'tag', split(x, concat('\\\\Q', hl7_field_separator(m), '\\\\E'))[0],
          'fields', CASE WHEN startswith(x, 'MSH') THEN concat(array(hl7_field_separator(m)), slice(split(x, concat('\\\\Q', hl7_field_separator(m), '\\\\E'), 256), 2, 256))
                    ELSE slice(split(x, concat('\\\\Q', hl7_field_separator(m), '\\\\E'), 256), 2, 256) END)) END""",
    "hl7_field": "(m STRING, seg STRING, n INT) RETURNS STRING RETURN get(get(filter(hl7_segments(m), s -> s.tag = seg), 0).fields, n - 1)",
    "hl7_component": "(m STRING, seg STRING, n INT, c INT) RETURNS STRING RETURN get(split(hl7_field(m, seg, n), concat('\\\\Q', substring(m, 5, 1), '\\\\E')), c - 1)",
    "hl7_redact": f"""(m STRING) RETURNS STRING RETURN
        array_join(transform(hl7_segments(m), s -> concat_ws(hl7_field_separator(m), s.tag, array_join(transform(
          CASE WHEN s.tag = 'MSH' THEN slice(s.fields, 2, 256) ELSE s.fields END,
          (x, i) -> CASE try_element_at({_cleared()}, concat(s.tag, '-', i + 1)) WHEN 'clear' THEN '' WHEN 'year' THEN left(x, 4) ELSE x END), hl7_field_separator(m)))), '\\r')""",
    "x12_segments": f"""(m STRING) RETURNS {SEGMENT} RETURN
        CASE WHEN startswith(m, 'ISA') AND length(m) >= 106 THEN transform(transform(filter(transform(split(m, concat('\\\\Q', substring(m, 106, 1), '\\\\E')), x -> btrim(x, ' \\t\\n\\r')), x -> x <> ''),
          x -> split(x, concat('\\\\Q', substring(m, 4, 1), '\\\\E'), 64)), (p, i) -> named_struct('idx', i, 'tag', p[0], 'fields', slice(p, 2, 64))) END""",
    "x12_element": "(m STRING, seg STRING, n INT) RETURNS STRING RETURN get(get(filter(x12_segments(m), s -> s.tag = seg), 0).fields, n - 1)",
    "hl7_rows": "(m STRING) RETURNS TABLE (idx INT, tag STRING, fields ARRAY<STRING>) RETURN SELECT s.idx, s.tag, s.fields FROM (SELECT explode(a) AS s FROM (SELECT hl7_segments(m) AS a))",
    "hl7_missing": f"""(m STRING) RETURNS TABLE (idx INT, tag STRING, field INT, message STRING) RETURN
        SELECT r.idx, r.tag, q.n, concat('missing mandatory field ', r.tag, '-', q.n, ' (', q.name, ')') FROM (SELECT s.idx, s.tag, s.fields FROM (SELECT explode(a) AS s FROM (SELECT hl7_segments(m) AS a))) r
        JOIN (VALUES {_required()}) AS q(tag, n, name) ON q.tag = r.tag WHERE trim(BOTH FROM coalesce(get(r.fields, q.n - 1), '')) = ''""",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, for ``spark.sql``."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
