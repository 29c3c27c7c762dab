"""Queries over messages that are made of the tables, and the SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.fields import component, edifact_unescape, field, first_segment, hl7_escape_text, hl7_unescape, is_fhir_date, sheet_column_index, sniffed
from paperloom.operators import comparison, fhir, markup
from paperloom.operators import messages as ops
from paperloom.plans import messages as make
from paperloom.sources import office
from paperloom.sources.segments import bound, edifact_segments, hl7_delimiters, hl7_segments, x12_segments

def message():
    return F.col("message")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return make.order_lines(spark, d)


def _read(messages: DataFrame) -> DataFrame:
    """The messages with the body of their transaction set."""
    return bound(bound(messages, segments=x12_segments(message())), own=ops.body(F.col("segments")))


def _lines_of_850(spark: SparkSession, d: str) -> DataFrame:
    read = bound(_read(make.x12_850(_orders(spark, d))), p=ops.read_850(F.col("own")))
    return read.select("p.number", "p.date", "p.buyer", F.explode("p.lines").alias("l"))


def x12_850_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines_of_850(spark, d).select(F.col("number").cast("long").alias("order_key"), "date", "buyer", F.col("l.line").cast("int").alias("line"), F.get("l.products", 0)["value"].alias("product"), F.col("l.quantity").alias("quantity"))


def x12_850_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines_of_850(spark, d).select(F.col("number").cast("long").alias("order_key"), (F.col("l.quantity").cast("decimal(18,2)") * F.col("l.price").cast("decimal(18,2)")).alias("v"))
    return lines.groupBy("order_key").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("v").cast("decimal(38,4)").alias("total"))


def x12_810_totals(spark: SparkSession, d: str) -> DataFrame:
    read = bound(_read(make.x12_810(_orders(spark, d))), p=ops.read_810(F.col("own")))
    return read.select(F.col("o_orderkey").alias("order_key"), F.col("p.number").alias("number"), F.col("p.total_cents").cast("long").alias("total_cents"), F.size("p.lines").alias("n_lines"))


def x12_856_items(spark: SparkSession, d: str) -> DataFrame:
    items = ops.shipped_items(make.x12_856(_orders(spark, d)), x12_segments(message()), "o_orderkey")
    return items.select(F.col("o_orderkey").alias("order_key"), "product", F.col("quantity").cast("decimal(18,2)").alias("quantity"))


def x12_envelope_issues(spark: SparkSession, d: str) -> DataFrame:
    return ops.x12_envelope_issues(make.x12_850(_orders(spark, d)), x12_segments(message()), "o_orderkey").select(F.col("o_orderkey").alias("order_key"), "tag", "rule")


def x12_element_issues(spark: SparkSession, d: str) -> DataFrame:
    found = ops.element_issues(make.x12_810(_orders(spark, d)), x12_segments(message()), "o_orderkey", rules.X12_ELEMENTS)
    return found.select(F.col("o_orderkey").alias("order_key"), "tag", "position", "message")


def x12_required_segments(spark: SparkSession, d: str) -> DataFrame:
    """The purchase orders again, relabelled as claim payments, lack BPR and CLP."""
    relabelled = make.x12_850(_orders(spark, d)).withColumn("message", F.regexp_replace("message", r"ST\*850", "ST*835"))
    return ops.missing_segments(relabelled, x12_segments(message()), "o_orderkey").select(F.col("o_orderkey").alias("order_key"), "set_id", "tag")


def edifact_order_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = ops.edifact_lines(make.edifact_orders(_orders(spark, d)), edifact_segments(message()), "o_orderkey")
    return lines.select(F.col("o_orderkey").alias("order_key"), F.col("line").cast("int").alias("line"), "item", F.col("quantity").cast("decimal(18,2)").alias("quantity"))


def edifact_release_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    parts = make.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("+?:"), "p_brand").alias("v"))
    back = parts.select("p_partkey", F.concat(F.lit("BGM+"), make.released("v"), F.lit("+9'")).alias("message"))
    return back.select(F.col("p_partkey").alias("part_key"), edifact_unescape(field(F.get(edifact_segments(message()), 0), 1)).alias("name"))


def hl7_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.exploded(make.hl7_adt(spark, d), hl7_segments(message()), "c_custkey").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fields")).cast("long").alias("n_fields"))


def hl7_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(make.hl7_adt(spark, d), s=hl7_segments(message()), d=hl7_delimiters(message()))
    pid = first_segment(F.col("s"), "PID")
    separator = F.col("d.component")
    return rows.select(
        F.col("c_custkey").alias("cust_key"),
        component(field(pid, 3), 1, separator).cast("long").alias("id"),
        component(field(pid, 3), 4, separator).alias("nation"),
        component(field(pid, 5), 1, separator).alias("name"),
        field(pid, 8).alias("gender"),
        component(field(first_segment(F.col("s"), "MSH"), 9), 2, separator).alias("trigger"),
    )


def hl7_required_fields(spark: SparkSession, d: str) -> DataFrame:
    return ops.hl7_required_issues(make.hl7_adt(spark, d), hl7_segments(message()), "c_custkey").select(F.col("c_custkey").alias("cust_key"), "message")


def hl7_escape_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    texts = make.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("|^~&")).alias("t"))
    return texts.select("doc_id", F.md5(hl7_unescape(hl7_escape_text(F.col("t"))).cast("binary")).alias("text_md5"))


def hl7_patients(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    name = F.get(p["name"], 0)
    rows = bound(bound(make.hl7_adt(spark, d), s=hl7_segments(message()), d=hl7_delimiters(message())), p=fhir.patient(F.col("s"), F.col("d")))
    return rows.select("p.id", name["family"].alias("family"), F.get(name["given"], 0).alias("given"), "p.gender", F.col("p.birthDate").alias("birth_date"))


def hl7_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    events = make.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ops.pseudonyms(events, "user_id", "event_type", "event_id", "KIND-").select("user_id", "event_id", "pseudonym")


def hl7_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every admission against a corrected one: another gender for keys that divide by 4, no class for 6."""
    left = make.hl7_adt(spark, d)
    right = left.withColumn("message", F.when(F.col("c_custkey") % 4 == 0, F.regexp_replace("message", r"\|F\r", "|M\r")).when(F.col("c_custkey") % 6 == 0, F.regexp_replace("message", r"PV1\|1\|[I ]\|", "PV1|1||")).otherwise(message()))
    left, right = (x.withColumn("d", hl7_delimiters(message())) for x in (left, right))
    return comparison.compared_segments(left, right, hl7_segments(message()), "c_custkey", F.col("d.field"), "d").select(F.col("c_custkey").alias("cust_key"), "path", "kind")


def fhir_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date grammar over days, months, years and impossible days."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 5 == 0, F.substring(day, 1, 4)).when(key % 5 == 1, F.substring(day, 1, 7)).when(key % 5 == 2, F.concat(F.substring(day, 1, 8), F.lit("31"))).when(key % 5 == 3, F.concat(day, F.lit("T"))).otherwise(day)
    return make.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), text.alias("text")).withColumn("is_date", is_fhir_date(F.col("text")))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    events = make.table(spark, d, "events").select("user_id", "event_id", "event_type", F.sha2(F.col("props").cast("binary"), 256).alias("payload_sha256"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events.select("user_id", seq.alias("seq"), F.col("event_id").cast("string").alias("at"), F.col("event_type").alias("event"), "payload_sha256")


def audit_chain_heads(spark: SparkSession, d: str) -> DataFrame:
    return ops.chain_heads(_logs(spark, d), "user_id")


def audit_tampered(spark: SparkSession, d: str) -> DataFrame:
    """Entry 1 of every third user's log is edited afterwards: the check names it."""
    rows = ops.chain_entries(_logs(spark, d), "user_id")
    edited = rows.withColumn("event", F.when((F.col("user_id") % 3 == 0) & (F.col("seq") == 1), F.concat("event", F.lit("!"))).otherwise(F.col("event")))
    return ops.broken(edited, "user_id").select("user_id", F.col("seq").cast("long").alias("first_bad"))


def sniffed_formats(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    texts = [make.x12_850(orders).select("message"), make.edifact_orders(orders).select("message"), make.hl7_adt(spark, d).select("message"), make.table(spark, d, "pages").select(F.col("html").alias("message")), make.table(spark, d, "events").select(F.col("props").alias("message"))]
    every = texts[0]
    for x in texts[1:]:
        every = every.unionByName(x)
    return every.groupBy(sniffed(message()).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def template_conversations(spark: SparkSession, d: str) -> DataFrame:
    """One escaped list of turns for each conversation, by a template."""
    turns = make.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))  # one conversation's turns
    rows = bound(turns, t=markup.merged(F.lit("{{#each turns}}<li>{{role}}: {{text}}</li>{{/each}}"), F.to_json(F.struct("turns"))))
    return rows.select("conv_id", F.md5(F.col("t.text").cast("binary")).alias("list_md5"))


def csv_ragged_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of two or three values, one of them quoted, written and read without a header's help."""
    n = make.table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.col("n_name"), F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("odd"), (F.col("n_nationkey") % 2 == 0).alias("third"))
    line = office.csv_line(F.array_compact(F.array("n_name", "odd", F.when(F.col("third"), "x"))))
    rows = bound(n, v=office.csv_values(line))
    return rows.select("n_nationkey", F.size("v").alias("n_values"), F.get("v", 0).alias("first_value"), F.get("v", 1).alias("second_value"))


def sheet_columns(spark: SparkSession, d: str) -> DataFrame:
    return make.table(spark, d, "region").select("r_name", sheet_column_index(F.left(F.regexp_replace("r_name", "[^A-Z]", ""), F.lit(3))).alias("column_index"))


QUERIES = {f.__name__: f for f in (
    x12_850_totals, x12_850_lines, x12_810_totals, x12_856_items, x12_envelope_issues, x12_element_issues, x12_required_segments, edifact_order_lines, edifact_release_roundtrip, hl7_segment_counts, hl7_fields,
    hl7_required_fields, hl7_escape_roundtrip, hl7_patients, hl7_pseudonyms, hl7_changes, fhir_dates, audit_chain_heads, audit_tampered, sniffed_formats,
    template_conversations, csv_ragged_records, sheet_columns,
)}

_Q, _P = "CAST(l_quantity AS DECIMAL(18,2))", "CAST(l_extendedprice AS DECIMAL(18,2))"
_OWN = "orders JOIN lineitem ON o_orderkey = l_orderkey"
_LOGS = "SELECT user_id, event_id, event_type, sha256(props) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events"
_STEP = "sha256(unhex(lpad(hex(x.seq), 16, '0') || {0} || '0000000000000040' || hex(x.p) || '0000000000000040' || hex({1})))"
_SIZED = "lpad(hex(octet_length(encode({0}))), 16, '0') || hex({0})"

ORACLE_SQL = {
    "x12_850_totals": f"SELECT o_orderkey AS order_key, count(*) AS n_lines, CAST(sum({_Q} * {_P}) AS DECIMAL(38,4)) AS total FROM {_OWN} GROUP BY 1",
    "x12_850_lines": f"SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y%m%d') AS date, 'C' || o_custkey AS buyer, l_linenumber AS line, 'P' || l_partkey AS product, CAST({_Q} AS VARCHAR) AS quantity FROM {_OWN}",
    "x12_810_totals": f"SELECT o_orderkey AS order_key, 'I' || o_orderkey AS number, CAST(sum(round({_Q} * {_P} * 100, 0)) AS BIGINT) AS total_cents, CAST(count(*) AS INTEGER) AS n_lines FROM {_OWN} GROUP BY o_orderkey",
    "x12_856_items": f"SELECT o_orderkey AS order_key, 'P' || l_partkey AS product, {_Q} AS quantity FROM {_OWN}",
    "x12_envelope_issues": """
      WITH k AS (SELECT DISTINCT o_orderkey AS order_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
      SELECT order_key, 'SE' AS tag, 'SE count' AS rule FROM k WHERE order_key % 7 = 0
      UNION ALL SELECT order_key, 'GE', 'GE control number' FROM k WHERE order_key % 11 = 0
      UNION ALL SELECT order_key, 'IEA', 'IEA count' FROM k WHERE order_key % 13 = 0""",
    "x12_element_issues": "SELECT DISTINCT o_orderkey AS order_key, 'N1' AS tag, 1 AS position, 'empty mandatory element 1 of N1' AS message FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 = 0",
    "x12_required_segments": "SELECT DISTINCT o_orderkey AS order_key, '835' AS set_id, t AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey CROSS JOIN (VALUES ('BPR'), ('CLP')) v(t)",
    "edifact_order_lines": f"SELECT o_orderkey AS order_key, l_linenumber AS line, 'P' || l_partkey AS item, {_Q} AS quantity FROM {_OWN}",
    "edifact_release_roundtrip": "SELECT p_partkey AS part_key, p_name || '+?:' || p_brand AS name FROM part",
    "hl7_segment_counts": "SELECT t AS tag, count(*) AS n, CAST(sum(f) AS BIGINT) AS n_fields FROM customer CROSS JOIN (VALUES ('MSH', 12), ('EVN', 2), ('PID', 8), ('PV1', 3)) v(t, f) GROUP BY 1",
    "hl7_fields": "SELECT c_custkey AS cust_key, c_custkey AS id, n_name AS nation, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 'A01' AS trigger FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "hl7_required_fields": """
      SELECT c_custkey AS cust_key, 'missing mandatory field PID-5 (Patient Name)' AS message FROM customer WHERE c_custkey % 5 = 0
      UNION ALL SELECT c_custkey, 'missing mandatory field PV1-2 (Patient Class)' FROM customer WHERE c_custkey % 7 = 0""",
    "hl7_escape_roundtrip": r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') || '|^~&') AS text_md5 FROM documents",
    "hl7_patients": """
      SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS family, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS given, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
             '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-0' || (c_custkey % 9 + 1) || '-15' AS birth_date
      FROM customer""",
    "hl7_pseudonyms": """
      WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events)
      SELECT user_id, event_id, 'KIND-' || dense_rank() OVER (PARTITION BY user_id ORDER BY first, event_type) AS pseudonym FROM f""",
    "hl7_changes": """
      SELECT c_custkey AS cust_key, 'PID[0]-8' AS path, 'changed' AS kind FROM customer WHERE c_custkey % 4 = 0
      UNION ALL SELECT c_custkey, 'PV1[0]-2', 'removed' FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 4 <> 0""",
    "fhir_dates": r"""
      WITH t AS (SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
      u AS (SELECT order_key, CASE order_key % 5 WHEN 0 THEN day[1:4] WHEN 1 THEN day[1:7] WHEN 2 THEN day[1:8] || '31' WHEN 3 THEN day || 'T' ELSE day END AS text FROM t)
      SELECT order_key, text, regexp_matches(text, '^\d{4}$') OR regexp_matches(text, '^\d{4}-(0[1-9]|1[0-2])$') OR (regexp_matches(text, '^\d{4}-\d{2}-\d{2}$') AND try_cast(text AS DATE) IS NOT NULL) AS is_date FROM u""",
    "audit_chain_heads": f"""
      WITH RECURSIVE e AS ({_LOGS}),
      c AS (
        SELECT x.user_id, x.seq, {_STEP.format(_SIZED.format("CAST(x.event_id AS VARCHAR)") + " || " + _SIZED.format("x.event_type"), "repeat('0', 64)")} AS hash FROM e x WHERE x.seq = 0
        UNION ALL
        SELECT x.user_id, x.seq, {_STEP.format(_SIZED.format("CAST(x.event_id AS VARCHAR)") + " || " + _SIZED.format("x.event_type"), "c.hash")} FROM c JOIN e x ON x.user_id = c.user_id AND x.seq = c.seq + 1)
      SELECT user_id, max(seq) + 1 AS n, arg_max(hash, seq) AS head FROM c GROUP BY user_id""",
    "audit_tampered": f"WITH e AS ({_LOGS}) SELECT user_id, CAST(1 AS BIGINT) AS first_bad FROM e WHERE user_id % 3 = 0 AND seq = 1",
    "sniffed_formats": """
      WITH k AS (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
      SELECT 'x12' AS format, count(*) AS n FROM k UNION ALL SELECT 'edifact', count(*) FROM k
      UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'hl7v2' END, count(*) FROM customer GROUP BY 1
      UNION ALL SELECT 'html', count(*) FROM pages UNION ALL SELECT 'fhir-json', count(*) FROM events""",
    "template_conversations": """
      SELECT conv_id, md5(string_agg('<li>' || role || ': ' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</li>', '' ORDER BY turn)) AS list_md5
      FROM conversations GROUP BY conv_id""",
    "csv_ragged_records": """SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_values, n_name AS first_value, n_name || ', "' || n_regionkey || '"' AS second_value FROM nation""",
    "sheet_columns": "SELECT r_name, CAST((ascii(r_name[1]) - 64) * 676 + (ascii(r_name[2]) - 64) * 26 + ascii(r_name[3]) - 64 AS INTEGER) AS column_index FROM region",
}
