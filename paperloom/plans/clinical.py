"""Queries over FHIR that loses nothing and over its refusals, rule tables that are loaded at run time and changes in order, and the SQL
that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import sql
from paperloom.functions.fields import component, field, first_segment, json_pointer_escape, repetition
from paperloom.operators import comparison, fhir, invoices, markup, writers
from paperloom.operators import messages as ops
from paperloom.plans import exchange
from paperloom.plans import messages as make
from paperloom.sources import html
from paperloom.sources.segments import bound, hl7_delimiters, hl7_segments, spread, x12_segments


def _price() -> Column:
    """The total as a decimal with a zero more than it needs."""
    return F.concat(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("0"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, text): results as JSON with names in no order, digits inside strings and members that no column has."""
    key = F.col("o_orderkey").cast("string")
    note = r'"note":[{"text":"took 5.40, \"twice\" \\ 1.0","n":[1.0,-0.50,2e3]}]'
    extension = '"extension":[{"valueDecimal":1.10,"url":"urn:x"}]'
    text = F.concat(
        F.lit('{"status":"final","resourceType":"Observation",' + note + ',"valueQuantity":{"value":'), _price(), F.lit(',"unit":"mg",' + extension + '},"id":"o'), key, F.lit('","meta":{"versionId":"3"}}')
    )
    return spread(make.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", text.alias("text"))


def fhir_exact_resources(spark: SparkSession, d: str) -> DataFrame:
    """Results read and written again: the value's digits, the members without a column, the whole."""
    found = fhir.resources(_observations(spark, d), F.col("text"), "o_orderkey")
    return found.select(F.col("o_orderkey").alias("order_key"), "n", F.col("r.id").alias("id"), F.col("r.valueQuantity.digits").alias("value"), fhir.unmodelled(F.col("whole")).alias("rest"), fhir.resource_json(F.col("whole")).alias("json"))


def fhir_refused_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Bundles of an order and its results: those of keys that divide by 3 hold a device, by 5 a resource without a type, by 7 a result
    without a status, by 11 aren't JSON."""
    key = F.col("o_orderkey")
    entry = lambda x: F.concat(F.lit('{"resource":'), x, F.lit("}"))
    result = F.when(key % 7 == 0, F.regexp_replace("text", '"status":"final",', "")).otherwise(F.col("text"))
    more = F.array(entry(F.lit('{"resourceType":"Patient"}')), F.when(key % 5 == 0, entry(F.lit('{"id":"x"}'))), entry(result), F.when(key % 3 == 0, entry(F.lit('{"resourceType":"Device"}'))))
    text = F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.array_join(F.array_compact(more), ","), F.when(key % 11 == 0, "]").otherwise("]}"))
    return fhir.bundle_errors(_observations(spark, d), text, "o_orderkey").withColumnRenamed("o_orderkey", "order_key")


def fhir_exact_xml(spark: SparkSession, d: str) -> DataFrame:
    """Results as XML, read and written again: no status for keys that divide by 7, another type for 5."""
    key = F.col("o_orderkey")
    part = lambda name, value: F.concat(F.lit(f'<{name} value="'), value, F.lit('"/>'))
    kind = F.when(key % 5 == 0, "Device").otherwise("Observation")
    text = F.concat(
        F.lit("<"), kind, F.lit(' xmlns="http://hl7.org/fhir">'), part("id", F.concat(F.lit("o"), key.cast("string"))), F.when(key % 7 == 0, "").otherwise(part("status", F.lit("final"))),
        F.lit("<code>"), part("text", F.lit("weight")), F.lit("</code><valueQuantity>"), part("value", _price()), part("unit", F.lit("kg")), F.lit("</valueQuantity></"), kind, F.lit(">"),
    )
    read = bound(make.table(spark, d, "orders").select("o_orderkey", text.alias("xml")), r=writers.read_resource_xml(F.col("xml")))
    error = writers.resource_error(F.col("r"))
    return read.select(key.alias("order_key"), error.alias("error"), F.when(error.isNull(), writers.observation_again(F.col("r"))).alias("xml"))


def _rule_lines(spark: SparkSession, d: str, odd: bool) -> DataFrame:
    """(n, line): element rules made of the parts: part p asks that element 2 of a PO1 is p % 3 + 2 to 4 long; with ``odd``, every third
    line has another fault."""
    n, p = F.col("p_partkey") + 1, F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("PO"), (p % 2).cast("string")), F.lit("2"), F.lit("r"), (p % 3 + 2).cast("string"), F.lit("4"), F.when(p % 2 == 0, "M").otherwise("O"))
    if odd:
        faults = F.when(p % 9 == 0, F.regexp_replace(line, "\tr\t", "\tq\t")).when(p % 9 == 3, F.regexp_replace(line, "[MO]$", "X")).otherwise(F.regexp_replace(line, "\t2\tr", "\tfour\tr"))
        line = F.when(p % 3 == 0, faults).otherwise(line)
    return make.table(spark, d, "part").select(n.cast("long").alias("n"), F.when(p % 10 == 9, F.lit("# a comment")).otherwise(line).alias("line"))


def rule_line_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every line at fault of a table of rules, with why."""
    return rules.loaded(_rule_lines(spark, d, True), "elements").where("error is not null").select("n", "error")


def rule_table_refused(spark: SparkSession, d: str) -> DataFrame:
    """The first line for which a table of rules is refused."""
    return rules.refused(rules.loaded(_rule_lines(spark, d, True), "elements"))


def x12_issues_by_loaded_rules(spark: SparkSession, d: str) -> DataFrame:
    """Purchase orders against distinct rules that were loaded from lines: how often each message stands in an order."""
    table = rules.loaded(_rule_lines(spark, d, False), "elements").drop("n", "error").distinct()
    found = ops.element_issues(make.x12_850(make.order_lines(spark, d)), x12_segments(F.col("message")), "o_orderkey", table)
    told = F.regexp_extract("message", "(missing mandatory|shorter than [0-9]|longer than [0-9]|violates type)", 1)
    return found.groupBy(F.col("o_orderkey").alias("order_key"), told.alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def hl7_ordered_changes(spark: SparkSession, d: str) -> DataFrame:
    """Admissions against corrected ones, in the order a reader would meet the changes: another gender for keys that divide by 2, no
    class for 3, an NTE that is gone for 5, another one that is new for 7; EVN is left out."""
    m, key, bar = F.col("message"), F.col("c_custkey"), F.substring("message", 4, 1)
    left = make.hl7_adt(spark, d)
    left = left.withColumn("message", F.when(key % 5 == 0, F.concat(m, F.lit("ZZ1"), bar, F.lit("gone\r"))).otherwise(m))
    right = F.when(key % 5 == 0, F.regexp_replace("message", "ZZ1.gone\r", "")).otherwise(m)
    right = F.when(key % 2 == 0, F.regexp_replace(right, r"\|F\r", "|M\r")).otherwise(right)
    right = F.when(key % 3 == 0, F.regexp_replace(right, r"PV1(.)1.[I ](?=[|!])", "PV1$11$1")).otherwise(right)
    right = F.when(key % 7 == 0, F.regexp_replace(right, "EVN(?=[|!])", F.concat(F.lit("ZZ2"), bar, F.lit("new\rEVN")))).otherwise(right)
    right = left.withColumn("message", F.regexp_replace(right, "EVN(.)A01", "EVN$1A08"))
    left, right = (x.withColumn("d", hl7_delimiters(m)) for x in (left, right))
    found = comparison.compared_segments(left, right, hl7_segments(m), "c_custkey", F.col("d.field"), "d", ignore=["EVN", "MSH"], numbered=True)
    return found.select(key.alias("cust_key"), "n", "path", "kind", F.col("left").alias("old"), F.col("right").alias("new"))


def hl7_given_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """Segments without a header, scanned by delimiters that the caller gives: the second repetition, blank for keys that divide by 3,
    absent for 5, and its second component."""
    key = F.col("p_partkey")
    own = F.struct(*[F.lit(x).alias(n) for n, x in (("field", ";"), ("component", "*"), ("repeat", "+"), ("escape", "!"), ("subcomponent", "%"))])
    second = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("+"), F.when(key % 3 == 0, "").otherwise(F.concat("p_brand", F.lit("*"), "p_type"))))
    text = F.concat(F.lit("ZPT;"), key.cast("string"), F.lit(";"), "p_name", second, F.lit("\nZPX;|^~\\&\n"))
    rows = bound(make.table(spark, d, "part").select("p_partkey", "p_brand", "p_type", text.alias("text")), s=hl7_segments(F.col("text"), own))
    value = field(first_segment(F.col("s"), "ZPT"), 2)
    return rows.select(key.alias("part_key"), F.size("s").alias("segments"), repetition(value, 2, "+").alias("second"), component(repetition(value, 2, "+"), 2, "*").alias("part"), field(first_segment(F.col("s"), "ZPX"), 1).alias("plain"))


def escaped_paths(spark: SparkSession, d: str) -> DataFrame:
    """JSON pointers of names with slashes and tildes, and titles with runs of white space."""
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit("~"), F.lit("1"))
    title = F.concat(F.lit(" \t"), "p_name", F.lit("\u00a0\n "), "p_brand", F.lit("\r\n"))
    return make.table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), json_pointer_escape(name).alias("pointer"), markup.collapsed(title).alias("title"))


def html_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of start tags: quoted in either way, without quotes, in capitals, absent, of a like name."""
    key = F.col("s_suppkey")
    told = F.when(key % 5 == 0, F.concat(F.lit("HREF='/s/"), key.cast("string"), F.lit("'"))).when(key % 5 == 1, F.concat(F.lit('href = "/s/'), key.cast("string"), F.lit('"'))).when(key % 5 == 2, F.concat(F.lit("href=/s/"), key.cast("string"))).when(key % 5 == 3, "data-href='/x'").otherwise("")
    return make.table(spark, d, "supplier").select(key.alias("supp_key"), html.html_attribute(F.concat(F.lit("<a class='x' "), told, F.lit(">")), "href").alias("href"))


def ubl_party_issues(spark: SparkSession, d: str) -> DataFrame:
    """Invoices whose supplier has no name for keys that divide by 3, no country for 4, no address for 5, no endpoint for 7 and an
    endpoint without its scheme for 11."""
    i, key = F.col("i"), F.col("o_orderkey")
    s = i["supplier"]
    own = s.withField("name", F.when(key % 3 != 0, s["name"])).withField("has_address", key % 5 != 0).withField("country", F.when(key % 4 != 0, s["country"]))
    own = own.withField("endpoint_id", F.when(key % 7 != 0, F.lit("E1"))).withField("endpoint_scheme", F.when(key % 11 != 0, F.lit("0088")))
    found = exchange._read_invoices(spark, d).select(key, F.explode(invoices.ubl_issues(i.withField("supplier", own))).alias("x"))
    named = ["BR-06", "BR-08", "BR-09", "PEPPOL-EN16931-R020", "BR-62"]  # the rules of the supplier
    return found.where(F.col("x.rule").isin(named)).select(key.alias("order_key"), "x.rule", "x.path")


def _in_sql(spark: SparkSession, d: str) -> None:
    """The views and functions that the queries in SQL use."""
    sql.register(spark)
    make.hl7_adt(spark, d).createOrReplaceTempView("admissions")
    make.x12_850(make.order_lines(spark, d)).createOrReplaceTempView("purchase_orders")


def sql_message_formats(spark: SparkSession, d: str) -> DataFrame:
    _in_sql(spark, d)
    make.table(spark, d, "pages").createOrReplaceTempView("web_pages")
    return spark.sql("""
      SELECT format, count(*) AS n FROM (SELECT sniff_format(message) AS format FROM (
        SELECT message FROM admissions UNION ALL SELECT message FROM purchase_orders UNION ALL SELECT html FROM web_pages)) GROUP BY format""")


def sql_patient_fields(spark: SparkSession, d: str) -> DataFrame:
    _in_sql(spark, d)
    return spark.sql("SELECT c_custkey AS cust_key, hl7_component(message, 'PID', 3, 1) AS number, hl7_component(message, 'PID', 3, 4) AS authority, hl7_field(message, 'MSH', 10) AS control FROM admissions")


def sql_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    _in_sql(spark, d)
    return spark.sql("SELECT c_custkey AS cust_key, x.tag, x.field, x.message FROM admissions, LATERAL hl7_missing(message) x")


def sql_redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    _in_sql(spark, d)
    return spark.sql("SELECT c_custkey AS cust_key, hl7_field(safe, 'PID', 5) AS name, hl7_field(safe, 'PID', 7) AS born, hl7_field(safe, 'PID', 8) AS gender FROM (SELECT c_custkey, hl7_redact(message) AS safe FROM admissions)")


def sql_purchase_orders(spark: SparkSession, d: str) -> DataFrame:
    _in_sql(spark, d)
    return spark.sql("SELECT o_orderkey AS order_key, x12_element(message, 'BEG', 5) AS date, x12_element(message, 'N1', 2) AS buyer, size(filter(x12_segments(message), s -> s.tag = 'PO1')) AS n_lines FROM purchase_orders")


QUERIES = {f.__name__: f for f in (fhir_exact_resources, fhir_refused_bundles, fhir_exact_xml, rule_line_errors, rule_table_refused, x12_issues_by_loaded_rules, hl7_ordered_changes, hl7_given_delimiters, escaped_paths, html_attributes, ubl_party_issues, sql_message_formats, sql_patient_fields, sql_missing_fields, sql_redacted_messages, sql_purchase_orders)}

_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || '0'"
_NOTE = r'"note":[{"n":[1.0,-0.50,2e3],"text":"took 5.40, \"twice\" \\ 1.0"}]'

_FAULTS = """SELECT p_partkey + 1 AS n, CASE WHEN p_partkey % 9 = 0 THEN 'unknown element type `q`' WHEN p_partkey % 9 = 3 THEN 'requirement must be M, C or O, found `X`'
        ELSE 'position must be a number, found `four`' END AS error FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 9"""

ORACLE_SQL = {
    "rule_line_errors": _FAULTS,
    "x12_issues_by_loaded_rules": """
      SELECT o_orderkey AS order_key, 'longer than 4' AS issue, 3 * count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      WHERE length(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)) > 4 GROUP BY 1""",
    "hl7_ordered_changes": """
      WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '|' ELSE '!' END AS bar FROM customer),
      x AS (
        SELECT k, 0 AS part, 'PID[0]-8' AS path, 'changed' AS kind, 'F' AS old, 'M' AS new FROM c WHERE k % 2 = 0
        UNION ALL SELECT k, 1, 'PV1[0]-2', 'removed', CASE WHEN k % 7 = 0 THEN ' ' ELSE 'I' END, NULL FROM c WHERE k % 3 = 0
        UNION ALL SELECT k, 2, 'ZZ1[0]', 'removed', 'ZZ1' || bar || 'gone', NULL FROM c WHERE k % 5 = 0
        UNION ALL SELECT k, 3, 'ZZ2[0]', 'added', NULL, 'ZZ2' || bar || 'new' FROM c WHERE k % 7 = 0)
      SELECT k AS cust_key, CAST(row_number() OVER (PARTITION BY k ORDER BY part) - 1 AS INTEGER) AS n, path, kind, old, new FROM x""",
    "sql_message_formats": """
      SELECT CASE WHEN c_custkey % 2 = 0 THEN 'hl7v2' END AS format, count(*) AS n FROM customer GROUP BY 1
      UNION ALL SELECT 'x12', count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'html', count(*) FROM pages""",
    "sql_patient_fields": "SELECT c_custkey AS cust_key, CAST(c_custkey AS VARCHAR) AS number, n_name AS authority, 'M' || c_custkey AS control FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sql_missing_fields": """
      SELECT c_custkey AS cust_key, 'PID' AS tag, 5 AS field, 'missing mandatory field PID-5 (Patient Name)' AS message FROM customer WHERE c_custkey % 5 = 0
      UNION ALL SELECT c_custkey, 'PV1', 2, 'missing mandatory field PV1-2 (Patient Class)' FROM customer WHERE c_custkey % 7 = 0""",
    "sql_redacted_messages": "SELECT c_custkey AS cust_key, '' AS name, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS born, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer",
    "sql_purchase_orders": """
      SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y%m%d') AS date, 'C' || o_custkey AS buyer, CAST(count(*) AS INTEGER) AS n_lines
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "hl7_given_delimiters": r"""
      SELECT p_partkey AS part_key, 2 AS segments, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || '*' || p_type END AS second,
        CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN p_type END AS part, '|^~\&' AS plain FROM part""",
    "escaped_paths": "SELECT p_partkey AS part_key, p_name || '~1' || p_brand || '~01' AS pointer, p_name || ' ' || p_brand AS title FROM part",
    "html_attributes": "SELECT s_suppkey AS supp_key, CASE WHEN s_suppkey % 5 < 3 THEN '/s/' || s_suppkey END AS href FROM supplier",
    "ubl_party_issues": """
      WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
      SELECT k AS order_key, 'BR-06' AS rule, 'cac:PartyName/cbc:Name' AS path FROM k WHERE k % 3 = 0
      UNION ALL SELECT k, 'BR-08', 'cac:PostalAddress' FROM k WHERE k % 5 = 0
      UNION ALL SELECT k, 'BR-09', 'cac:PostalAddress/cac:Country/cbc:IdentificationCode' FROM k WHERE k % 4 = 0 AND k % 5 <> 0
      UNION ALL SELECT k, 'PEPPOL-EN16931-R020', 'cbc:EndpointID' FROM k WHERE k % 7 = 0
      UNION ALL SELECT k, 'BR-62', 'cbc:EndpointID/@schemeID' FROM k WHERE k % 11 = 0 AND k % 7 <> 0""",
    "rule_table_refused": f"SELECT min(n) AS n, arg_min(error, n) AS error FROM ({_FAULTS}) f",
    "fhir_exact_resources": f"""
      SELECT o_orderkey AS order_key, 0 AS n, 'o' || o_orderkey AS id, {_PRICE} AS value, '{{"meta":{{"versionId":"3"}},{_NOTE}}}' AS rest,
        '{{"id":"o' || o_orderkey || '","meta":{{"versionId":"3"}},{_NOTE},"resourceType":"Observation","status":"final","valueQuantity":{{"extension":[{{"url":"urn:x","valueDecimal":1.10}}],"unit":"mg","value":' || {_PRICE} || '}}}}' AS json
      FROM orders""",
    "fhir_refused_bundles": """
      SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 11 = 0 THEN 'not JSON' WHEN o_orderkey % 5 = 0 THEN 'missing `resourceType`'
        WHEN o_orderkey % 7 = 0 THEN 'missing mandatory element `status`' WHEN o_orderkey % 3 = 0 THEN 'unsupported resource type `Device`' END AS error FROM orders""",
    "fhir_exact_xml": f"""
      SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 5 = 0 THEN 'no known resource type' WHEN o_orderkey % 7 = 0 THEN 'missing mandatory element `status`' END AS error,
        CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN '<?xml version="1.0" encoding="UTF-8"?><Observation xmlns="http://hl7.org/fhir"><id value="o' || o_orderkey || '"/><status value="final"/><code><text value="weight"/></code><valueQuantity><value value="'
          || {_PRICE} || '"/><unit value="kg"/></valueQuantity></Observation>' END AS xml FROM orders""",
}
