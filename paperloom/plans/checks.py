"""Queries over written messages, reports, FHIR as XML, audit files and office comparisons, and the SQL that computes the same
from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.fields import hl7_unescape, is_fhir_datetime, sniffed_file
from paperloom.operators import bundles, comparison, fhir, reports, writers
from paperloom.operators import messages as ops
from paperloom.plans import exchange
from paperloom.plans import messages as make
from paperloom.sources import html, office
from paperloom.sources.segments import bound, edifact_segments, hl7_delimiters, hl7_segments, spread, x12_segments

def _message() -> Column:
    return F.col("message")


def hl7_unescaped_values(spark: SparkSession, d: str) -> DataFrame:
    """Values with every code, an unknown one and an escape character without a partner; odd parts have delimiters of their own."""
    odd = F.col("p_partkey") % 2 == 1
    marks = {"field": ("|", "#"), "component": ("^", "*"), "repeat": ("~", "+"), "escape": ("\\", "!"), "subcomponent": ("&", "%")}
    own = F.struct(*[F.when(odd, b).otherwise(a).alias(n) for n, (a, b) in marks.items()])
    rows = make.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", own.alias("d"))
    e = F.col("d.escape")
    code = lambda x: F.concat(e, F.lit(x), e)
    value = F.concat("p_name", code("F"), "p_brand", code(".br"), code("S"), code("R"), code("T"), code("E"), F.lit("end"), e, F.lit("q"))
    return bound(rows, v=value).select(F.col("p_partkey").alias("part_key"), hl7_unescape(F.col("v"), F.col("d")).alias("value"))


def hl7_written_messages(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    head = writers.hl7_header(("HIS", "A|B"), ("RIS", "C"), F.lit("20261001120000"), F.lit("ADT^A01"), F.concat(F.lit("M"), key))
    segments = F.array(head, writers.hl7_written_segment("PID", F.lit("1"), F.lit(None), F.concat(key, F.lit("^^^H^MR")), F.lit(None), F.concat("c_name", F.lit("\\x\n|y"))))
    segments = writers.hl7_with_segment(segments, writers.hl7_written_segment("NTE", F.lit("1"), F.lit(""), F.lit("a\\S\\b"), escaped=True))
    return make.table(spark, d, "customer").select(F.col("c_custkey").alias("cust_key"), writers.hl7_message(segments).alias("message"))


def fhir_datetimes(spark: SparkSession, d: str) -> DataFrame:
    """The grammar of dates with times: whole ones, impossible hours, offsets beyond 14 hours, times without a day."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    tail = F.when(key % 7 == 0, "T12:30").when(key % 7 == 1, "T12:30:59.5Z").when(key % 7 == 2, "T24:00:00Z").when(key % 7 == 3, "T12:30:00+15:00").when(key % 7 == 4, "T12:30:60-03:30").when(key % 7 == 5, "T1230").otherwise("")
    text = F.concat(F.when(key % 5 == 0, F.substring(day, 1, 7)).otherwise(day), tail)
    return make.table(spark, d, "orders").select(key.alias("order_key"), text.alias("text")).withColumn("is_datetime", is_fhir_datetime(F.col("text")))


def _encounters(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(make.hl7_adt(spark, d), s=hl7_segments(_message()), d=hl7_delimiters(_message()))
    return bound(rows, e=bundles.hl7_encounter(F.col("s"), F.col("d"))).where("e is not null")


def fhir_encounter_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = _encounters(spark, d)
    return rows.select(F.col("c_custkey").alias("cust_key"), writers.encounter_xml(F.col("e"), F.concat(F.lit("Patient/"), F.col("c_custkey").cast("string"))).alias("xml"))


def fhir_xml_resources(spark: SparkSession, d: str) -> DataFrame:
    """Patients, encounters and organizations written as XML and read again."""
    rows = _encounters(spark, d)
    key = F.col("c_custkey")
    visits = rows.select(key, writers.encounter_xml(F.col("e"), F.concat(F.lit("Patient/"), key.cast("string"))).alias("xml"))
    patients = bound(rows, p=fhir.patient(F.col("s"), F.col("d"))).select(key, fhir.patient_xml(F.col("p")).alias("xml"))
    wards = make.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), writers.organization_xml(F.col("s_suppkey"), F.concat("s_name", F.lit(" & Co"))).alias("xml"))
    read = bound(visits.unionByName(patients).unionByName(wards), r=writers.read_resource_xml(F.col("xml")))
    return read.select(key.alias("row_key"), "r.resourceType", "r.id", "r.status", "r.gender", F.col("r.subject.reference").alias("subject"), F.col("r.period.start").alias("start"), F.get("r.identifier", 0)["value"].alias("identifier"), "r.name")


def fhir_reading_issues(spark: SparkSession, d: str) -> DataFrame:
    """Patients as JSON: those of keys that divide by 4 are another type, by 6 born on a day that isn't, by 10 by the hour."""
    key = F.col("c_custkey")
    born = F.when(key % 6 == 0, "2026-02-30").when(key % 10 == 0, "2026-02-03T10:00").otherwise("2024-02-29")
    text = F.concat(F.lit('{"resourceType":"'), F.when(key % 4 == 0, "Device").otherwise("Patient"), F.lit('","birthDate":"'), born, F.lit('"}'))
    found = fhir.resources(make.table(spark, d, "customer"), text, "c_custkey")
    return writers.reading_issues(found, "c_custkey").withColumnRenamed("c_custkey", "cust_key")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(key, message) of purchase orders, admissions and bundles."""
    orders = make.x12_850(make.order_lines(spark, d)).select(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("key"), "message")
    visits = make.hl7_adt(spark, d).select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("key"), "message")
    return orders.unionByName(visits)


def report_issues(spark: SparkSession, d: str) -> DataFrame:
    return reports.report(_texts(spark, d), _message(), "key")


def report_first_issues(spark: SparkSession, d: str) -> DataFrame:
    return reports.first_issues(_texts(spark, d), _message(), "key")


def report_documents(spark: SparkSession, d: str) -> DataFrame:
    """Issues of EDIFACT orders that lack their last terminator for keys that divide by 5, of UBL invoices, and of FHIR results without
    a value for 4 and of another type for 6."""
    key = lambda kind, name="o_orderkey": F.concat(F.lit(kind), F.col(name).cast("string")).alias("key")
    n = F.col("o_orderkey")
    orders = make.edifact_orders(make.order_lines(spark, d)).select(key("e"), F.when(n % 5 == 0, F.regexp_replace("message", r".\s*$", "")).otherwise(F.col("message")).alias("message"))
    bills = exchange._invoices(spark, d).select(key("u"), F.col("xml").alias("message"))
    value = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit(',"valueQuantity":{"value":'), F.col("o_totalprice").cast("string"), F.lit("}")))
    result = F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient"}},{"resource":{"resourceType":"'), F.when(n % 6 == 0, "Device").otherwise("Observation"), F.lit('","status":"final"'), value, F.lit("}}]}"))
    results = spread(make.table(spark, d, "orders"), "o_orderkey").select(key("f"), result.alias("message"))
    return reports.report(orders.unionByName(bills).unionByName(results), _message(), "key")


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = make.hl7_adt(spark, d)
    issues = reports.report(texts, _message(), "c_custkey")
    return reports.report_texts(texts, issues, _message(), "c_custkey").withColumnRenamed("c_custkey", "cust_key")


def inspected_texts(spark: SparkSession, d: str) -> DataFrame:
    return reports.inspected(_texts(spark, d).where("key like 'h%'"), _message(), "key")


def edifact_element_issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a blank party for keys that divide by 5 and a count that is no number for 7."""
    key, m = F.col("o_orderkey"), _message()
    edited = F.when(key % 5 == 0, F.regexp_replace(m, r"(?<=NAD[+|])BY", " ")).otherwise(m)
    edited = F.when(key % 7 == 0, F.regexp_replace(edited, r"(?<=UNT[+|])[0-9]+", "4x")).otherwise(edited)
    rows = bound(make.edifact_orders(make.order_lines(spark, d)), edited=edited)
    return ops.element_issues(rows, edifact_segments(F.col("edited")), "o_orderkey", rules.EDIFACT_ELEMENTS).select(key.alias("order_key"), "tag", "position", "message")


def x12_changes(spark: SparkSession, d: str) -> DataFrame:
    """Purchase orders against later ones: another buyer for keys that divide by 4, no CTT for 6."""
    left, key = make.x12_850(make.order_lines(spark, d)), F.col("o_orderkey")
    m = F.when(key % 4 == 0, F.regexp_replace("message", r"N1\*BY\*C", r"N1*BY*D")).otherwise(_message())
    right = left.withColumn("message", F.when(key % 6 == 0, F.regexp_replace(m, r"CTT\*[0-9]+~", "")).otherwise(m))
    found = comparison.compared_segments(left, right, x12_segments(_message()), "o_orderkey", F.lit("*"))
    return found.select(key.alias("order_key"), "path", "kind", F.col("left").alias("old"), F.col("right").alias("new"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Chained entries of each user's events; even users' times are moments, odd ones' are numbers."""
    events = make.table(spark, d, "events").select("user_id", "event_id", "event_type", F.sha2(F.col("props").cast("binary"), 256).alias("payload_sha256"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    at = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("2026-01-01T00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("Z"))).otherwise(F.col("event_id").cast("string"))
    return ops.chain_entries(events.select("user_id", seq.alias("seq"), at.alias("at"), F.col("event_type").alias("event"), "payload_sha256"), "user_id")


def audit_jsonl_issues(spark: SparkSession, d: str) -> DataFrame:
    """Logs as files: entry 1 of users that divide by 3 was edited, line 2 of those that divide by 5 is no entry."""
    lines = writers.log_files(writers.jsonl_entries(_entries(spark, d), "user_id"), "user_id")
    user, n = F.col("user_id"), F.col("n")
    line = F.when((user % 5 == 0) & (n == 2), "no entry").when((user % 3 == 0) & (n == 1), F.regexp_replace("line", '"event":"', '"event":"not ')).otherwise(F.col("line"))
    return writers.jsonl_issues(lines.withColumn("line", line), "user_id")


def _one_large_log(spark: SparkSession, d: str) -> DataFrame:
    """Chained entries of the events: every second one stands in log 0, the others in their user's."""
    log = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id") + 1).cast("long")
    events = make.table(spark, d, "events").select(log.alias("log"), "event_id", "event_type", F.sha2(F.col("props").cast("binary"), 256).alias("payload_sha256"))
    rows = ops.numbered(events, "log", "event_id")
    return ops.chain_entries(rows.select("log", "seq", F.col("event_id").cast("string").alias("at"), F.col("event_type").alias("event"), "payload_sha256"), "log")


def audit_large_log(spark: SparkSession, d: str) -> DataFrame:
    """Log 0, with half of all events, has an entry in its middle edited, one behind it taken out; logs that divide by 3 have their last
    hash edited, which nothing after it shows."""
    rows = _one_large_log(spark, d)
    log, seq, last = F.col("log"), F.col("seq"), F.col("last")
    rows = rows.join(rows.groupBy("log").agg(F.max("seq").alias("last")), "log")
    middle = F.floor((last + 1) / 2)
    told = rows.where((log != 0) | (seq != middle + 7)).withColumn("event", F.when((log == 0) & (seq == middle), "edited").otherwise(F.col("event")))
    edited = told.withColumn("hash", F.when((log > 0) & (log % 3 == 0) & (seq == last), F.lit(ops.GENESIS)).otherwise(F.col("hash")))
    return ops.broken(edited.drop("last"), "log").select("log", F.col("seq").alias("first_bad"))


def audit_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = writers.provenance(_entries(spark, d), "user_id", F.concat(F.lit("Patient/"), F.col("user_id").cast("string")))
    part = lambda path: F.get_json_object("resource", path)
    return rows.select("user_id", "seq", "error", part("$.recorded").alias("recorded"), part("$.activity.text").alias("activity"), part("$.target[0].reference").alias("target"), part("$.entity[0].what.display").alias("payload"))


def xlsx_changes(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks against later ones: another number for keys that divide by 2, a new cell for 3."""
    key = F.col("s_suppkey")
    cell = lambda text, number: F.struct(text.cast("string").alias("text"), number.cast("double").alias("number"))
    none = F.lit(None)

    def cells(*later: Column) -> DataFrame:
        row = F.struct(F.array(cell(F.col("s_name"), none), *later).alias("cells"))
        books = make.table(spark, d, "supplier").select(key.cast("string").alias("path"), office.xlsx_file(F.lit("S"), F.array(row)).alias("content"))
        return office.flat_cells(office.xlsx_cells(books))

    found = comparison.compared_flats(cells(cell(none, key)), cells(cell(none, F.when(key % 2 == 0, key + 1).otherwise(key)), cell(F.when(key % 3 == 0, "new"), none)), "file")
    return found.select(F.col("file").cast("long").alias("supp_key"), "path", "kind", F.col("left").alias("old"), F.col("right").alias("new"))


def docx_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents against later ones: the second paragraph of keys that divide by 2 is another, those of 3 have a third one."""
    key = F.col("s_suppkey")

    def lines(second: Column, third: Column) -> DataFrame:
        paragraphs = F.array_compact(F.array(F.lit("To"), second, third))
        rows = bound(make.table(spark, d, "supplier").select("s_suppkey", "s_name"), t=office.docx_text(office.docx_file(paragraphs)))
        return office.flat_lines(rows, F.col("t.text"), "s_suppkey")

    none = F.lit(None).cast("string")
    found = comparison.compared_flats(lines(F.col("s_name"), none), lines(F.when(key % 2 == 0, F.lit("nobody")).otherwise(F.col("s_name")), F.when(key % 3 == 0, F.lit("end"))), "s_suppkey")
    return found.select(key.alias("supp_key"), "path", "kind", F.col("left").alias("old"), F.col("right").alias("new"))


def fhir_conversion_notes(spark: SparkSession, d: str) -> DataFrame:
    """Admissions whose gender FHIR doesn't have for keys that divide by 4 and whose birth is no date for 6."""
    key, m = F.col("c_custkey"), _message()
    edited = F.when(key % 4 == 0, F.regexp_replace(m, r"\|F(?=[\r\n])", "|X")).otherwise(m)
    edited = F.when(key % 6 == 0, F.regexp_replace(edited, r"\|\|19", "||x19")).otherwise(edited)
    rows = bound(make.hl7_adt(spark, d), edited=edited)
    found = fhir.conversion_notes(rows, hl7_segments(F.col("edited")), hl7_delimiters(F.col("edited")), "c_custkey")
    return found.select(key.alias("cust_key"), "place", "note")


def x12_set_issues(spark: SparkSession, d: str) -> DataFrame:
    """Claim payments made of purchase orders: they lack BPR and CLP, and those of keys that divide by 5 their end."""
    key = F.col("o_orderkey")
    m = F.regexp_replace("message", r"ST\*850", "ST*835")
    rows = make.x12_850(make.order_lines(spark, d)).withColumn("message", F.when(key % 5 == 0, F.regexp_replace(m, r"SE\*[0-9]+\*0001~", "")).otherwise(m))
    return ops.transaction_set_issues(rows, x12_segments(_message()), "o_orderkey").withColumnRenamed("o_orderkey", "order_key")


def html_block_counts(spark: SparkSession, d: str) -> DataFrame:
    blocks = html.html_blocks(make.table(spark, d, "pages"), "page_id", "html")
    return blocks.where("kind in ('h1', 'li')").groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def docx_block_rows(spark: SparkSession, d: str) -> DataFrame:
    files = make.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), office.docx_file(F.array(F.lit("To"), F.col("s_name"))).alias("content"))
    return html.docx_blocks(files.where(sniffed_file(F.col("content")) == "docx")).select("path", "n", "kind", "text", "error")


QUERIES = {f.__name__: f for f in (
    hl7_unescaped_values, hl7_written_messages, fhir_datetimes, fhir_encounter_xml, fhir_xml_resources, fhir_reading_issues, report_issues, report_first_issues, report_documents, report_texts, inspected_texts, edifact_element_issues, x12_changes,
    audit_jsonl_issues, audit_large_log, audit_provenance, xlsx_changes, docx_changes, fhir_conversion_notes, x12_set_issues, html_block_counts, docx_block_rows,
)}

_K = "k AS (SELECT o_orderkey AS k, count(*) AS n, min(l_linenumber) AS first FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"
_ISSUES = f"""
  {_K}, r AS (
  SELECT 'x' || k AS key, 'x12' AS format, 'SE[' || (n + 6) || ']' AS place, 'envelope' AS rule, 'SE count' AS message FROM k WHERE k % 7 = 0
  UNION ALL SELECT 'x' || k, 'x12', 'GE[' || (n + 7) || ']', 'envelope', 'GE control number' FROM k WHERE k % 11 = 0
  UNION ALL SELECT 'x' || k, 'x12', 'IEA[' || (n + 8) || ']', 'envelope', 'IEA count' FROM k WHERE k % 13 = 0
  UNION ALL SELECT 'h' || c_custkey, 'hl7v2', 'PID[2]-5', 'required', 'missing mandatory field PID-5 (Patient Name)' FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'h' || c_custkey, 'hl7v2', 'PV1[3]-2', 'required', 'missing mandatory field PV1-2 (Patient Class)' FROM customer WHERE c_custkey % 14 = 0
  UNION ALL SELECT 'h' || c_custkey, '', '', 'format', 'no checks for this format' FROM customer WHERE c_custkey % 2 = 1)"""
_USERS = "SELECT user_id, event_id, event_type, sha256(props) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events"

ORACLE_SQL = {
    "hl7_unescaped_values": r"""
      SELECT p_partkey AS part_key, CASE WHEN p_partkey % 2 = 1 THEN p_name || '#' || p_brand || '!.br!*+%!end!q' ELSE p_name || '|' || p_brand || '\.br\^~&\end\q' END AS value FROM part""",
    "hl7_written_messages": r"""
      SELECT c_custkey AS cust_key, 'MSH|^~\&|HIS|A\F\B|RIS|C|20261001120000||ADT^A01|M' || c_custkey || '|P|2.5.1' || chr(13) || 'PID|1||' || c_custkey || '^^^H^MR||' || c_name || '\E\x\X0A\\F\y' || chr(13) || 'NTE|1||a\S\b' || chr(13) AS message FROM customer""",
    "fhir_datetimes": """
      WITH t AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
      SELECT k AS order_key, CASE WHEN k % 5 = 0 THEN day[1:7] ELSE day END || CASE k % 7 WHEN 0 THEN 'T12:30' WHEN 1 THEN 'T12:30:59.5Z' WHEN 2 THEN 'T24:00:00Z' WHEN 3 THEN 'T12:30:00+15:00' WHEN 4 THEN 'T12:30:60-03:30' WHEN 5 THEN 'T1230' ELSE '' END AS text,
             k % 7 IN (0, 1, 4, 6) AS is_datetime FROM t""",
    "fhir_encounter_xml": """
      SELECT c_custkey AS cust_key, '<?xml version="1.0" encoding="UTF-8"?><Encounter xmlns="http://hl7.org/fhir"><id value="M' || c_custkey || '-enc"/><status value="in-progress"/><class><coding><system value="http://terminology.hl7.org/CodeSystem/v3-ActCode"/><code value="IMP"/></coding></class><subject><reference value="Patient/' || c_custkey || '"/></subject><period><start value="2026-10-01"/></period></Encounter>' AS xml
      FROM customer WHERE c_custkey % 7 <> 0""",
    "fhir_xml_resources": """
      WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0)
      SELECT k AS row_key, 'Encounter' AS "resourceType", 'M' || k || '-enc' AS id, 'in-progress' AS status, NULL AS gender, 'Patient/' || k AS subject, '2026-10-01' AS start, NULL AS identifier, NULL AS name FROM c
      UNION ALL SELECT k, 'Patient', CAST(k AS VARCHAR), NULL, CASE WHEN k % 2 = 0 THEN 'female' ELSE 'male' END, NULL, NULL, CAST(k AS VARCHAR), NULL FROM c
      UNION ALL SELECT s_suppkey, 'Organization', CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, s_name || ' & Co' FROM supplier""",
    "fhir_reading_issues": """
      WITH c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS cust_key, CAST(0 AS INTEGER) AS n, '/resourceType' AS path, '`Device` is no known resource type' AS message FROM c WHERE k % 4 = 0
      UNION ALL SELECT k, 0, '/birthDate', '`2026-02-30` is no date' FROM c WHERE k % 6 = 0
      UNION ALL SELECT k, 0, '/birthDate', '`2026-02-03T10:00` is no date' FROM c WHERE k % 10 = 0 AND k % 6 <> 0""",
    "report_issues": f"WITH {_ISSUES} SELECT * FROM r",
    "report_first_issues": f"WITH {_ISSUES} SELECT key, format, idx, place, rule, message FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx, place, rule, message) AS i FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(place, '\\[([0-9]+)', 1) AS INTEGER), 0) AS idx FROM r)) WHERE i = 1",
    "report_documents": f"""
      {_K.strip() if _K.strip().upper().startswith("WITH") else "WITH " + _K}
      SELECT 'e' || k AS key, 'edifact' AS format, '' AS place, 'unreadable' AS rule, 'the last segment has no terminator' AS message FROM k WHERE k % 5 = 0
      UNION ALL SELECT 'u' || order_key, 'ubl', path, rule, 'the rule is broken' FROM ({exchange.ORACLE_SQL["ubl_invoice_issues"]}) u
      UNION ALL SELECT 'f' || o_orderkey, 'fhir-json', '/1/valueQuantity', 'obs-7', 'a `final` observation must have a value or an effective time' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0
      UNION ALL SELECT 'f' || o_orderkey, 'fhir-json', '/1/resourceType', 'value', '`Device` is no known resource type' FROM orders WHERE o_orderkey % 6 = 0""",
    "report_texts": """
      WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AND c_custkey % 5 = 0 AS name, c_custkey % 2 = 0 AND c_custkey % 7 = 0 AS class, c_custkey % 2 = 1 AS odd FROM customer),
      t AS (SELECT *, CASE WHEN odd THEN '' ELSE 'hl7v2' END AS format, CAST(name AS INTEGER) + CAST(class AS INTEGER) + CAST(odd AS INTEGER) AS n FROM c)
      SELECT k AS cust_key, format, n = 0 AS valid,
             CASE WHEN name THEN 'error: PID[2]-5 (required): missing mandatory field PID-5 (Patient Name)' || chr(10) ELSE '' END || CASE WHEN class THEN 'error: PV1[3]-2 (required): missing mandatory field PV1-2 (Patient Class)' || chr(10) ELSE '' END
             || CASE WHEN odd THEN 'error:  (format): no checks for this format' || chr(10) ELSE '' END || format || ': ' || n || ' error(s)' || chr(10) AS report,
             '{"format":"' || format || '","valid":' || CASE WHEN n = 0 THEN 'true' ELSE 'false' END || ',"issues":[' || CASE WHEN name THEN '{"place":"PID[2]-5","rule":"required","message":"missing mandatory field PID-5 (Patient Name)"}' ELSE '' END || CASE WHEN name AND class THEN ',' ELSE '' END
             || CASE WHEN class THEN '{"place":"PV1[3]-2","rule":"required","message":"missing mandatory field PV1-2 (Patient Class)"}' ELSE '' END || CASE WHEN odd THEN '{"place":"","rule":"format","message":"no checks for this format"}' ELSE '' END || ']}' AS json FROM t""",
    "inspected_texts": r"""
      WITH c AS (SELECT c_custkey AS k, 'MSH|^~\&|HIS|ACME|RIS|ACME|20261001120000||ADT^A01|M' || c_custkey || '|P|2.5.1' || chr(13) || 'EVN|A01|20261001120000' || chr(13) || 'PID|1||' || c_custkey || '^^^' || n_name || '^MR||'
             || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || '^' || c_mktsegment END || '||19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '0' || (c_custkey % 9 + 1) || '15|F' || chr(13) || 'PV1|1|' || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'I' END || '|W4^101' || chr(13) AS m
             FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT 'h' || k AS key, 'format: ' || CASE WHEN k % 2 = 1 THEN 'unknown' ELSE 'hl7v2' END || chr(10) || 'size: ' || (strlen(m) + CASE WHEN k % 2 = 0 AND k % 3 = 1 THEN 4 ELSE 0 END) || ' bytes' || chr(10)
             || CASE WHEN k % 2 = 1 THEN '' ELSE 'segments: 4' || chr(10) || 'message type: ADT^A01' || chr(10) || 'control id: M' || k || chr(10) || 'layout: MSH EVN PID PV1' || chr(10) END AS summary FROM c""",
    "edifact_element_issues": f"""
      WITH {_K} SELECT k AS order_key, 'NAD' AS tag, CAST(1 AS INTEGER) AS position, 'empty mandatory element 1 of NAD' AS message FROM k WHERE k % 5 = 0
      UNION ALL SELECT k, 'UNT', 1, 'element 1 of UNT violates type `N`: `4x`' FROM k WHERE k % 7 = 0""",
    "x12_changes": f"""
      WITH {_K}, o AS (SELECT k.*, o_custkey AS c FROM k JOIN orders ON o_orderkey = k)
      SELECT k AS order_key, 'N1[0]-2' AS path, 'changed' AS kind, 'C' || c AS old, 'D' || c AS new FROM o WHERE k % 4 = 0
      UNION ALL SELECT k, 'CTT[0]', 'removed', 'CTT*' || n, NULL FROM o WHERE k % 6 = 0""",
    "audit_large_log": """
      WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id + 1 END AS log, count(*) AS n FROM events GROUP BY 1)
      SELECT CAST(log AS BIGINT) AS log, CAST(CASE WHEN log = 0 THEN n // 2 ELSE n - 1 END AS BIGINT) AS first_bad FROM e WHERE log % 3 = 0""",
    "audit_jsonl_issues": f"""
      WITH e AS (SELECT DISTINCT user_id, n FROM ({_USERS}))
      SELECT user_id, CASE WHEN user_id % 5 = 0 AND n > 2 THEN 'line 3 is no entry' ELSE 'the chain is broken at entry 1' END AS error FROM e WHERE (user_id % 5 = 0 AND n > 2) OR (user_id % 3 = 0 AND n > 1)""",
    "audit_provenance": f"""
      WITH e AS ({_USERS}), t AS (SELECT *, user_id % 2 = 0 AS good FROM e)
      SELECT user_id, CAST(seq AS BIGINT) AS seq, CASE WHEN NOT good THEN '`' || event_id || '` is no moment in time' END AS error, CASE WHEN good THEN '2026-01-01T00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || 'Z' END AS recorded,
             CASE WHEN good THEN event_type END AS activity, CASE WHEN good THEN 'Patient/' || user_id END AS target, CASE WHEN good THEN 'payload sha256 ' || p END AS payload FROM t""",
    "xlsx_changes": """
      SELECT CAST(s_suppkey AS BIGINT) AS supp_key, 'B1' AS path, 'changed' AS kind, CAST(s_suppkey AS VARCHAR) AS old, CAST(s_suppkey + 1 AS VARCHAR) AS new FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT s_suppkey, 'C1', 'added', NULL, 'new' FROM supplier WHERE s_suppkey % 3 = 0""",
    "docx_changes": """
      SELECT s_suppkey AS supp_key, '/p/1' AS path, 'changed' AS kind, s_name AS old, 'nobody' AS new FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT s_suppkey, '/p/2', 'added', NULL, 'end' FROM supplier WHERE s_suppkey % 3 = 0""",
    "fhir_conversion_notes": """
      WITH c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS cust_key, 'PID-8' AS place, '`X` is no gender that FHIR has and is left out' AS note FROM c WHERE k % 4 = 0
      UNION ALL SELECT k, 'PID-7', '`x19' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '0' || (k % 9 + 1) || '15` is no date and is left out' FROM c WHERE k % 6 = 0
      UNION ALL SELECT k, 'PV1-2', '`` is no class that FHIR has; there is no encounter' FROM c WHERE k % 7 = 0
      UNION ALL SELECT k, 'PV1-44', '`20261001120000` has no offset, so only its date is kept' FROM c WHERE k % 7 <> 0""",
    "x12_set_issues": f"""
      WITH {_K} SELECT k AS order_key, '835' AS set_id, t AS tag, 'the set lacks ' || t AS message FROM k CROSS JOIN (VALUES ('BPR'), ('CLP')) v(t)
      UNION ALL SELECT k, '835', 'SE', 'the set does not end with SE' FROM k WHERE k % 5 = 0""",
    "html_block_counts": """
      SELECT page_id, t AS kind, CAST(len(regexp_extract_all(html, '<' || t || '[ >]')) AS BIGINT) AS n FROM pages CROSS JOIN (VALUES ('h1'), ('li')) v(t) WHERE regexp_matches(html, '<' || t || '[ >]')""",
    "docx_block_rows": """
      SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(0 AS INTEGER) AS n, 'paragraph' AS kind, 'To' AS text, CAST(NULL AS VARCHAR) AS error FROM supplier
      UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, 'paragraph', s_name, NULL FROM supplier""",
}
