"""Queries over whole documents, comparisons, FHIR resources, templates and office files, and the SQL that computes the
same from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fields import hl7_escape_text, xml_escape
from paperloom.operators import comparison, fhir, interchanges, markup
from paperloom.plans import messages as make
from paperloom.sources import office
from paperloom.sources.segments import bound, edifact_segments, hl7_delimiters, hl7_segments, x12_segments

MESSAGE = "message"


def _amount(column: str) -> Column:
    """What the lines of an array come to."""
    return F.aggregate(column, F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + F.round(x["quantity"] * x["price"], 2)).cast("decimal(18,2)"))


def _interchanges(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, message): orders, invoices and despatch advices by turns. Keys that divide by 17 name no buyer; those
    that divide by 13 are of another type, by 7 state a wrong count, by 11 lack the first line's item."""
    key, n = F.col("o_orderkey"), F.size("lines")
    turn = key % 3
    kind = F.when(key % 13 == 0, "INVRPT").when(turn == 0, "ORDERS").when(turn == 1, "INVOIC").otherwise("DESADV")
    item = lambda x, i: F.when((key % 11 == 0) & (i == 0), "").otherwise(F.concat(F.lit("P"), x["l_partkey"].cast("string"), F.lit(":VP")))
    lines = F.array_join(F.transform("lines", lambda x, i: make._text("LIN+", x["l_linenumber"].cast("string"), "++", item(x, i), "'QTY+21:", x["quantity"].cast("string"), "'")), "")
    due = F.when(turn == 1, make._text("MOA+9:", _amount("lines").cast("string"), "'")).otherwise("")
    count = n * 2 + 5 + F.when(turn == 1, 1).otherwise(0) + F.when(key % 7 == 0, 1).otherwise(0)
    buyer = F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    message = make._text("UNB+UNOA:1+B+S+260101:1200+1'UNH+1+", kind, ":D:96A:UN'BGM+380+", key.cast("string"), "+9'DTM+137:", F.col("day"), ":102'NAD+BY+", buyer, "'", lines, due, "UNT+", count.cast("string"), "+1'UNZ+1+1'")
    return bound(make.order_lines(spark, d), message=message).select("o_orderkey", "message")


def edifact_documents(spark: SparkSession, d: str) -> DataFrame:
    read = interchanges.edifact_documents(_interchanges(spark, d), edifact_segments(F.col(MESSAGE)), "o_orderkey")
    total = F.aggregate("lines", F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + x["quantity"].cast("decimal(18,2)")).cast("decimal(18,2)"))
    return read.select(F.col("o_orderkey").alias("order_key"), "error", "kind", "number", "date", "buyer", "amount_due", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"), total.alias("quantity"))


def x12_835_summaries(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    claims = F.array_join(F.transform("lines", lambda x: make._text("CLP*", key, "-", x["l_linenumber"].cast("string"), "*1*", x["price"].cast("string"), "*", x["quantity"].cast("string"), "~SVC*HC:P", x["l_partkey"].cast("string"), "*1~")), "")
    message = make._text(make.x12_header("000000001", "HP"), "ST*835*0001~BPR*I*", _amount("lines").cast("string"), "*C*ACH~", claims, "SE*1*0001~GE*1*1~IEA*1*000000001~")
    rows = bound(make.order_lines(spark, d), message=message)
    return bound(rows, s=x12_segments(F.col(MESSAGE))).select(F.col("o_orderkey").alias("order_key"), interchanges.remittance_summary(F.col("s")).alias("summary"))


def _changed(changes: DataFrame, key: str, name: str) -> DataFrame:
    return changes.withColumnRenamed(key, name).withColumnRenamed("left", "old").withColumnRenamed("right", "new")


def edifact_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every interchange against a later one: another code for keys that divide by 4, no date for 6, one segment more for 5."""
    left, key = _interchanges(spark, d), F.col("o_orderkey")
    m = F.when(key % 4 == 0, F.regexp_replace(MESSAGE, r"BGM\+380", "BGM+381")).otherwise(F.col(MESSAGE))
    m = F.when(key % 6 == 0, F.regexp_replace(m, r"DTM[^']*'", "")).otherwise(m)
    right = left.withColumn("message", F.when(key % 5 == 0, F.concat(m, F.lit("FTX+AAI'"))).otherwise(m))
    return _changed(comparison.compared_segments(left, right, edifact_segments(F.col(MESSAGE)), "o_orderkey", F.lit("+")), "o_orderkey", "order_key")


def hl7_component_changes(spark: SparkSession, d: str) -> DataFrame:
    """Admissions against later ones: a bed gone for keys that divide by 4, no EVN for 6, a second name for 10
    (which adds a repetition to one that was blank)."""
    key = F.col("c_custkey")
    left = make.hl7_adt(spark, d)
    m = F.when(key % 4 == 0, F.regexp_replace(MESSAGE, r"W4\^101", "W4")).otherwise(F.col(MESSAGE))
    m = F.when(key % 6 == 0, F.regexp_replace(m, r"EVN[^\r\n]*[\r\n]+", "")).otherwise(m)
    right = left.withColumn("message", F.when(key % 10 == 0, F.regexp_replace(m, r"\^MR\|\|", "^MR||A~B")).otherwise(m))
    left, right = (x.withColumn("d", hl7_delimiters(F.col(MESSAGE))) for x in (left, right))
    return _changed(comparison.compared_segments(left, right, hl7_segments(F.col(MESSAGE)), "c_custkey", F.col("d.field"), "d"), "c_custkey", "cust_key")


def json_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as JSON against later ones: a number that becomes a list for keys that divide by 4, a list that grows for
    3, a name with a slash that goes for 5."""
    key = F.col("c_custkey")
    k = key.cast("string")
    left = make._text('{"id":', k, ',"tags":["', F.col("c_mktsegment"), '"],"n":{"a/b":1,"c":2}}')
    right = make._text('{"n":{"c":', F.when(key % 4 == 0, "[2]").otherwise("2"), F.when(key % 5 == 0, "").otherwise(',"a/b":1'), '},"tags":["', F.col("c_mktsegment"), F.when(key % 3 == 0, '","new"]').otherwise('"]'), ',"id":', k, "}")
    rows = make.table(spark, d, "customer").select(key.alias("cust_key"), F.explode(comparison.json_changes(left, right)).alias("c"))
    return rows.select("cust_key", "c.path", "c.kind", F.col("c.left").alias("old"), F.col("c.right").alias("new"))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    return fhir.bundles(make.hl7_adt(spark, d), hl7_segments(F.col(MESSAGE)), hl7_delimiters(F.col(MESSAGE)), "c_custkey")


def fhir_bundles(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d).select(F.col("c_custkey").alias("cust_key"), "error", "bundle")


def _resources(spark: SparkSession, d: str) -> DataFrame:
    """The bundles' resources, edited: visits of keys that divide by 4 are finished, those of 6 end before they start."""
    key = F.col("c_custkey")
    b = F.when(key % 4 == 0, F.regexp_replace("bundle", "inprogress", "finished")).otherwise(F.col("bundle"))
    b = F.when(key % 6 == 0, F.regexp_replace(b, r'"period":\{', '"period":{"end":"2025-12-31",')).otherwise(b)
    return fhir.resources(_bundles(spark, d), b, "c_custkey")


def fhir_resource_counts(spark: SparkSession, d: str) -> DataFrame:
    return fhir.counts(_resources(spark, d), "c_custkey").withColumnRenamed("c_custkey", "cust_key")


def fhir_issues(spark: SparkSession, d: str) -> DataFrame:
    return fhir.issues(_resources(spark, d), "c_custkey").withColumnRenamed("c_custkey", "cust_key")


def fhir_patient_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(make.hl7_adt(spark, d), s=hl7_segments(F.col(MESSAGE)), d=hl7_delimiters(F.col(MESSAGE)))
    rows = bound(rows, p=fhir.patient(F.col("s"), F.col("d")))
    return rows.select(F.col("c_custkey").alias("cust_key"), fhir.patient_xml(F.col("p")).alias("xml"))


def fhir_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(_bundles(spark, d), r=fhir.redacted()(F.col("bundle")))
    return rows.select(F.col("c_custkey").alias("cust_key"), F.col("r.json").alias("bundle"), F.size("r.changes").alias("n_changes"))


TEMPLATE = "<h1>{{name}}</h1>{{#if first}}{{#each lines}}<p>{{@index}}: {{part}} of {{name}}{{#if late}} (late){{else}}{{/if}}</p>{{/each}}{{else}}none{{/if}}"


def merged_letters(spark: SparkSession, d: str) -> DataFrame:
    """A letter for each order; orders whose key divides by 4 say that there is nothing first, of those that divide by 9 the
    field is missing."""
    key = F.col("o_orderkey")
    lines = F.array_join(F.transform("lines", lambda x: make._text('{"part":', x["l_partkey"].cast("string"), ',"late":', (x["l_linenumber"] % 2 == 0).cast("string"), "}")), ",")
    first = F.when(key % 9 == 0, "").when(key % 4 == 0, '"first":0,').otherwise('"first":"x",')
    data = make._text("{", first, '"name":"O & <', key.cast("string"), '>","lines":[', lines, "]}")
    return bound(make.order_lines(spark, d), t=markup.merged(F.lit(TEMPLATE), data)).select(key.alias("order_key"), "t.text", "t.error")


def inline_styles(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    style = make._text("Font-Size: ", key.cast("string"), F.when(key % 3 == 0, "px").when(key % 3 == 1, "PT").otherwise("em"), ";color:red;text-align:", F.when(key % 2 == 0, " Center").otherwise("middle"), ";font-weight:bold;font-weight:heavy;margin: 4px ", key.cast("string"), "pt;page-break-after:always")
    rows = bound(make.table(spark, d, "part"), s=markup.inline_style(style))
    return rows.select(key.alias("part_key"), "s.font_size_pt", "s.font_weight", "s.text_align", F.array_join(F.transform("s.margin", lambda x: x.cast("decimal(18,2)").cast("string")), " ").alias("margin"), "s.page_break_before", "s.page_break_after")


def decoded_references(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their white space as it may stand and their special characters as references, decoded again."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" <&>'\""))
    rows = make.table(spark, d, "documents").select("doc_id", F.md5(markup.decoded(xml_escape(text)).cast("binary")).alias("text_md5"))
    return rows


def xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    """A workbook for each supplier, written and read."""
    cell = lambda text, number: F.struct(F.lit(text).cast("string").alias("text") if not isinstance(text, Column) else text.alias("text"), number.cast("double").alias("number"))
    nothing = F.lit(None)
    row = lambda *cells: F.struct(F.array(*cells).alias("cells"))
    rows = F.array(row(cell("name", nothing), cell("key", nothing)), row(cell(F.concat("s_name", F.lit(" & <>")), nothing), cell(None, F.col("s_suppkey")), cell(None, nothing), cell(None, F.col("s_suppkey") / 4)))
    books = make.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), office.xlsx_file(F.lit("Sheet & 1"), rows).alias("content"))
    return office.xlsx_cells(books).select("path", "row", "ref", "kind", "text", "number", "error")


def docx_text(spark: SparkSession, d: str) -> DataFrame:
    """A document for each order, one paragraph a line, written and read."""
    paragraphs = F.concat(F.array(hl7_escape_text(F.concat(F.lit("Order <"), F.col("o_orderkey").cast("string"), F.lit(">")))), F.transform("lines", lambda x: make._text(" P", x["l_partkey"].cast("string"), " ")))
    rows = bound(make.order_lines(spark, d), t=office.docx_text(office.docx_file(paragraphs)))  # one pass through a worker
    return rows.select(F.col("o_orderkey").alias("order_key"), "t.text", "t.error")


QUERIES = {f.__name__: f for f in (
    edifact_documents, x12_835_summaries, edifact_changes, hl7_component_changes, json_changes, fhir_bundles, fhir_resource_counts, fhir_issues, fhir_patient_xml, fhir_redacted, merged_letters, inline_styles, decoded_references,
    xlsx_cells, docx_text,
)}

_LINES = """
  SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y%m%d') AS day, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS x
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
_ORDERS = f"SELECT k, any_value(c) AS c, any_value(day) AS day, count(*) AS n, min(n) AS first, CAST(sum(q) AS DECIMAL(18,2)) AS q, CAST(sum(CAST(round(q * x, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS due FROM ({_LINES}) GROUP BY k"
_PATIENTS = """
  SELECT c_custkey AS k, n_name AS nation, c_name AS name, c_mktsegment AS seg, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS year, '-0' || (c_custkey % 9 + 1) || '-15' AS day,
         c_custkey % 7 <> 0 AS visit, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _bundle_sql(born: str, key: str, number: str, name: str, start: str) -> str:
    """The JSON of an admission's bundle, with SQL for what redaction changes."""
    return f"""'{{"entry":[{{"resource":{{"birthDate":"' || {born} || '","gender":"' || gender || '","id":"' || {key} || '","identifier":[{{"system":"urn:hl7v2:' || nation || '","value":"' || {number} || '"}}]' || {name} || ',"resourceType":"Patient"}}}}' ||
      CASE WHEN visit THEN ',{{"resource":{{"class":{{"code":"IMP","display":"inpatient encounter","system":"http://terminology.hl7.org/CodeSystem/v3-ActCode"}},"id":"M' || k || '-enc","period":{{"start":"{start}"}},"resourceType":"Encounter","status":"inprogress","subject":{{"reference":"Patient/' || {key} || '"}}}}}}' ELSE '' END ||
      '],"resourceType":"Bundle","type":"collection"}}'"""


ORACLE_SQL = {
    "edifact_documents": f"""
      WITH o AS ({_ORDERS}), e AS (
        SELECT *, CASE WHEN k % 13 = 0 THEN 'message type `INVRPT` is not one that is read' WHEN k % 7 = 0 THEN 'UNT counts ' || (2 * n + 6 + CAST(k % 3 = 1 AS INTEGER)) || ' segments but the message has ' || (2 * n + 5 + CAST(k % 3 = 1 AS INTEGER))
                       WHEN k % 11 = 0 THEN 'LIN ' || first || ' has no item number' END AS error FROM o)
      SELECT k AS order_key, error, CASE WHEN error IS NULL THEN CASE k % 3 WHEN 0 THEN 'ORDERS' WHEN 1 THEN 'INVOIC' ELSE 'DESADV' END END AS kind, CASE WHEN error IS NULL THEN CAST(k AS VARCHAR) END AS number,
             CASE WHEN error IS NULL THEN day END AS date, CASE WHEN error IS NULL AND k % 17 <> 0 THEN 'C' || c END AS buyer, CASE WHEN error IS NULL AND k % 3 = 1 THEN CAST(due AS VARCHAR) END AS amount_due,
             CASE WHEN error IS NULL THEN CAST(n AS INTEGER) END AS n_lines, CASE WHEN error IS NULL THEN q END AS quantity FROM e""",
    "x12_835_summaries": f"""
      SELECT k AS order_key, 'total payment ' || CAST(sum(CAST(round(q * x, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) || chr(10)
             || string_agg('claim ' || k || '-' || n || ' status 1 billed ' || x || ' paid ' || q || chr(10) || '  service HC:P' || p || chr(10), '' ORDER BY n, p, q, x) AS summary FROM ({_LINES}) GROUP BY k""",
    "edifact_changes": f"""
      WITH o AS ({_ORDERS})
      SELECT k AS order_key, 'BGM[0]-1' AS path, 'changed' AS kind, '380' AS old, '381' AS new FROM o WHERE k % 4 = 0
      UNION ALL SELECT k, 'DTM[0]', 'removed', 'DTM+137:' || day || ':102', NULL FROM o WHERE k % 6 = 0
      UNION ALL SELECT k, 'FTX[0]', 'added', NULL, 'FTX+AAI' FROM o WHERE k % 5 = 0""",
    "hl7_component_changes": """
      WITH c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS cust_key, 'PV1[0]-3.2' AS path, 'removed' AS kind, '101' AS old, NULL AS new FROM c WHERE k % 4 = 0
      UNION ALL SELECT k, 'EVN[0]', 'removed', 'EVN|A01|20261001120000', NULL FROM c WHERE k % 6 = 0
      UNION ALL SELECT k, 'PID[0]-5~1', 'added', NULL, 'A' FROM c WHERE k % 10 = 0
      UNION ALL SELECT k, 'PID[0]-5~2', 'added', NULL, 'B' FROM c WHERE k % 10 = 0""",
    "json_changes": """
      SELECT c_custkey AS cust_key, '/n/c' AS path, 'changed' AS kind, '2' AS old, '[2]' AS new FROM customer WHERE c_custkey % 4 = 0
      UNION ALL SELECT c_custkey, '/tags/1', 'added', NULL, 'new' FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, '/n/a~1b', 'removed', '1', NULL FROM customer WHERE c_custkey % 5 = 0""",
    "fhir_bundles": f"""SELECT k AS cust_key, CAST(NULL AS VARCHAR) AS error, {_bundle_sql("year || day", "k", "k", '''CASE WHEN k % 5 = 0 THEN '' ELSE ',"name":[{"family":"' || name || '","given":["' || seg || '"]}]' END''', "2026-10-01")} AS bundle FROM ({_PATIENTS})""",
    "fhir_resource_counts": f"""
      WITH p AS ({_PATIENTS}) SELECT k AS cust_key, 'Patient' AS kind, CAST(1 AS BIGINT) AS n FROM p UNION ALL SELECT k, 'Encounter', CAST(visit AS BIGINT) FROM p UNION ALL SELECT k, 'Observation', 0 FROM p UNION ALL SELECT k, 'Organization', 0 FROM p""",
    "fhir_issues": f"""
      WITH p AS (SELECT k FROM ({_PATIENTS}) WHERE visit)
      SELECT k AS cust_key, CAST(1 AS INTEGER) AS n, 'enc-3' AS rule, '/period/end' AS path, 'period end `2025-12-31` is before period start `2026-10-01`' AS message FROM p WHERE k % 6 = 0
      UNION ALL SELECT k, 1, 'enc-1', '/period/end', 'a `finished` encounter must have a period end' FROM p WHERE k % 4 = 0 AND k % 6 <> 0""",
    "fhir_patient_xml": f"""
      SELECT k AS cust_key, '<?xml version="1.0" encoding="UTF-8"?><Patient xmlns="http://hl7.org/fhir"><id value="' || k || '"/><identifier><system value="urn:hl7v2:' || nation || '"/><value value="' || k || '"/></identifier>'
             || CASE WHEN k % 5 = 0 THEN '' ELSE '<name><family value="' || name || '"/><given value="' || seg || '"/></name>' END || '<gender value="' || gender || '"/><birthDate value="' || year || day || '"/></Patient>' AS xml FROM ({_PATIENTS})""",
    "fhir_redacted": f"""
      SELECT k AS cust_key, {_bundle_sql("year", "'PATIENT-1'", "'ID-1'", "''", "2026")} AS bundle, CAST(3 + CAST(k % 5 <> 0 AS INTEGER) + 2 * CAST(visit AS INTEGER) AS INTEGER) AS n_changes FROM ({_PATIENTS})""",
    "merged_letters": f"""
      WITH t AS (SELECT k, 'O &amp; &lt;' || k || '&gt;' AS name, string_agg('<p>' || i || ': ' || p || ' of O &amp; &lt;' || k || '&gt;' || CASE WHEN n % 2 = 0 THEN ' (late)' ELSE '' END || '</p>', '' ORDER BY n, p, q, x) AS body
                 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, q, x) - 1 AS i FROM ({_LINES})) GROUP BY k)
      SELECT k AS order_key, CASE WHEN k % 9 <> 0 THEN '<h1>' || name || '</h1>' || CASE WHEN k % 4 = 0 THEN 'none' ELSE body END END AS text, CASE WHEN k % 9 = 0 THEN 'missing field `first`' END AS error FROM t""",
    "inline_styles": """
      SELECT p_partkey AS part_key, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 0.75::DOUBLE WHEN 1 THEN p_partkey::DOUBLE END AS font_size_pt, CAST(700 AS INTEGER) AS font_weight, CASE WHEN p_partkey % 2 = 0 THEN 'center' END AS text_align,
             '3.00 ' || p_partkey || '.00 3.00 ' || p_partkey || '.00' AS margin, false AS page_break_before, true AS page_break_after FROM part""",
    "decoded_references": """SELECT doc_id, md5(coalesce(text, '') || ' <&>''"') AS text_md5 FROM documents""",
    "xlsx_cells": """
      WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS path, s_suppkey AS k, s_name AS name FROM supplier)
      SELECT path, CAST(1 AS BIGINT) AS row, 'A1' AS ref, 'string' AS kind, 'name' AS text, CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS error FROM s
      UNION ALL SELECT path, 1, 'B1', 'string', 'key', NULL, NULL FROM s
      UNION ALL SELECT path, 2, 'A2', 'string', name || ' & <>', NULL, NULL FROM s
      UNION ALL SELECT path, 2, 'B2', 'number', CAST(k AS VARCHAR), CAST(k AS DOUBLE), NULL FROM s
      UNION ALL SELECT path, 2, 'D2', 'number', CASE WHEN k % 4 = 0 THEN CAST(k // 4 AS VARCHAR) ELSE CAST(k / 4 AS VARCHAR) END, k / 4, NULL FROM s""",
    "docx_text": f"""SELECT k AS order_key, 'Order <' || k || '>' || chr(10) || string_agg(' P' || p || ' ', chr(10) ORDER BY n, p, q, x) AS text, CAST(NULL AS VARCHAR) AS error FROM ({_LINES}) GROUP BY k""",
}
