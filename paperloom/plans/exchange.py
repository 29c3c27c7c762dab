"""Queries over replies, batches, redaction and invoices, and the SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import bundles, invoices, redaction, replies
from paperloom.plans import messages as make
from paperloom.sources.segments import bound, edifact_segments, hl7_delimiters, hl7_segments, x12_segments


def _adt(spark: SparkSession, d: str) -> DataFrame:
    return bound(make.hl7_adt(spark, d), s=hl7_segments(F.col("message")), d=hl7_delimiters(F.col("message")))


def hl7_acknowledgements(spark: SparkSession, d: str) -> DataFrame:
    """The answer to each admission; keys that divide by 10 are refused with a reason."""
    key = F.col("c_custkey")
    refused = key % 10 == 0
    control, at = F.concat(F.lit("A"), key.cast("string")), F.lit("20261001130000")
    plain = replies.hl7_ack(F.col("s"), F.col("d"), F.lit("AA"), control, at)
    reason = replies.hl7_ack(F.col("s"), F.col("d"), F.lit("AE"), control, at, F.lit("no|such\nward"))
    return _adt(spark, d).select(key.alias("cust_key"), F.when(refused, reason).otherwise(plain).alias("ack"))


def hl7_redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    out = bound(_adt(spark, d), r=redaction.hl7_redacted(F.col("s"), F.col("d"), rules.safe_harbor()))
    return out.select(F.col("c_custkey").alias("cust_key"), F.col("r.message").alias("message"), F.size("r.changes").alias("n_changes"))


def _hundreds(spark: SparkSession, d: str) -> DataFrame:
    """(batch, messages): at most a hundred admissions by key, so that a batch is bounded."""
    key = F.col("c_custkey")
    own = make.hl7_adt(spark, d).select("c_custkey", F.regexp_replace("message", "\r\n", "\r").alias("m"))
    return own.groupBy(F.floor(key / 100).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "m"))), lambda x: x["m"]).alias("messages"))


def _digest(batches: DataFrame) -> DataFrame:
    return batches.select("batch", F.size("read").alias("n"), F.md5(F.array_join("read", "").cast("binary")).alias("messages_md5"))


def hl7_batch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    header = [F.lit(x) for x in ("HIS", "ACME", "RIS", "ACME", "20261001120000")]
    batches = bound(_hundreds(spark, d), text=replies.hl7_batch(F.col("messages"), [*header, F.col("batch").cast("string")]))
    return _digest(batches.withColumn("read", replies.hl7_batch_messages(F.col("text"))))


def hl7_frames_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    streams = bound(_hundreds(spark, d), text=F.array_join(F.transform("messages", replies.mllp_framed), ""))
    return _digest(streams.withColumn("read", replies.mllp_messages(F.col("text"))))


def _answers(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(o_orderkey, message): acknowledgements of the purchase orders; keys that divide by 4 are rejected."""
    key = F.col("o_orderkey")
    orders = bound(make.x12_850(make.order_lines(spark, d)), s=x12_segments(F.col("message")))
    return bound(orders, ack=replies.x12_ack(F.col("s"), key % 4 != 0, key.cast("string"), "260102", "0900", kind)).select("o_orderkey", F.col("ack").alias("message"))


def x12_acknowledgements(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, "997").select(F.col("o_orderkey").alias("order_key"), F.col("message").alias("ack"))


def x12_acknowledged_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = replies.acknowledged_sets(_answers(spark, d, "999"), x12_segments(F.col("message")), "o_orderkey", "IK5")
    return sets.withColumnRenamed("o_orderkey", "order_key")


def x12_acknowledgement_errors(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements that lost their AK9 (keys that divide by 6) or state another count (by 5)."""
    key = F.col("o_orderkey")
    edited = F.when(key % 6 == 0, F.regexp_replace("message", r"AK9\*[^~]*~", "")).when(key % 5 == 0, F.regexp_replace("message", r"(AK9\*.)\*1", r"$1*3")).otherwise(F.col("message"))
    answers = bound(_answers(spark, d, "997"), edited=edited)
    return replies.acknowledgement_errors(answers, x12_segments(F.col("edited")), "o_orderkey").select(key.alias("order_key"), "error")


def edifact_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer to each interchange, and what is read from it again."""
    key = F.col("o_orderkey")
    orders = bound(make.edifact_orders(make.order_lines(spark, d)), s=edifact_segments(F.col("message")))
    answers = bound(orders, answer=replies.contrl(F.col("s"), key % 4 != 0, key.cast("string"), "260102", "0900"))
    back = bound(answers, r=replies.read_contrl(edifact_segments(F.col("answer"))))
    return back.select(key.alias("order_key"), "answer", "r.reference", "r.accepted")


def edifact_interchange_issues(spark: SparkSession, d: str) -> DataFrame:
    """Interchanges, half of them with separators of their own: without UNH for keys that divide by 11, another UNZ count for 7, one that is no
    number (which is skipped) for 5, another UNT count for 3."""
    key, m = F.col("o_orderkey"), F.col("message")
    edited = (
        F.when(key % 11 == 0, F.regexp_replace(m, "UNH[^'~]*['~]", "")).when(key % 7 == 0, F.regexp_replace(m, r"(?<=UNZ[+|])1", "4"))
        .when(key % 5 == 0, F.regexp_replace(m, r"(?<=UNZ[+|])1", "x")).when(key % 3 == 0, F.regexp_replace(m, r"(?<=UNT[+|])[0-9]+", "99")).otherwise(m)
    )
    own = bound(make.edifact_orders(make.order_lines(spark, d)), edited=edited)
    return replies.edifact_interchange_issues(own, edifact_segments(F.col("edited")), "o_orderkey").select(key.alias("order_key"), "tag", "message")


def _invoices(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, xml): an invoice of each order. Keys that divide by 3 are exempt from tax and don't say why, by 5 ask
    for a cent more, by 7 lack the buyer's reference, by 11 declare another net, by 13 lack a unit, by 17 a tax breakdown,
    by 19 are credit notes."""
    key = F.col("o_orderkey")
    amount = "decimal(18,2)"
    exempt = key % 3 == 0
    category, rate = F.when(exempt, "E").otherwise("S"), F.when(exempt, F.lit(0)).otherwise(F.lit(15)).cast("decimal(9,2)")
    lines = F.transform("lines", lambda x, k: F.struct(
        x["l_linenumber"].cast("string").alias("id"), x["quantity"].alias("quantity"), F.when((key % 13 == 0) & (k == 0), "").otherwise("EA").alias("unit"), F.round(x["quantity"] * x["price"], 2).cast(amount).alias("amount"),
        F.concat(F.lit("Part & <"), x["l_partkey"].cast("string"), F.lit(">")).alias("name"), category.alias("category"), rate.alias("rate"), x["price"].alias("price"),
    ))
    rows = bound(make.order_lines(spark, d), own=lines)
    rows = bound(rows, net=invoices.total(F.col("own"), "amount"))
    rows = bound(rows, tax=F.when(exempt, F.lit(0)).otherwise(F.round(F.col("net").cast("decimal(26,2)") * 15 / 100, 2)).cast(amount))
    subtotal = F.struct(F.col("net").alias("taxable"), F.col("tax").alias("tax"), category.alias("category"), rate.alias("rate"), F.lit(None).cast("string").alias("reason"))
    gross = (F.col("net") + F.col("tax")).cast(amount)
    party = lambda name, tax_id: F.struct(
        F.lit(name).alias("name"), F.lit("DE").alias("country"), F.lit(True).alias("has_address"), F.lit("88").alias("endpoint_id"), F.lit("0088").alias("endpoint_scheme"), F.lit(tax_id).cast("string").alias("tax_id"),
        F.lit(None).cast("string").alias("legal_id"),
    )
    invoice = F.struct(
        F.lit("urn:cen.eu:en16931:2017").alias("customization_id"), F.lit("urn:profile").alias("profile_id"), F.concat(F.lit("I"), key.cast("string")).alias("id"), F.lit("2026-01-01").alias("issue_date"), F.lit("2026-02-01").alias("due_date"),
        F.when(key % 19 == 0, "381").otherwise("380").alias("type_code"), F.lit("EUR").alias("currency"), F.when(key % 7 != 0, "ref").alias("buyer_reference"), party("S & Sons", "DE1").alias("supplier"), party("B", None).alias("customer"),
        F.lit("30").alias("payment_code"), F.when(key % 17 == 0, F.slice(F.array(subtotal), 1, 0)).otherwise(F.array(subtotal)).alias("subtotals"),
        F.struct(
            (F.col("net") + F.when(key % 11 == 0, 1).otherwise(0)).cast(amount).alias("line_extension"), F.col("net").alias("exclusive"), gross.alias("inclusive"),
            (gross + F.when(key % 5 == 0, F.lit("0.01").cast(amount)).otherwise(F.lit(0).cast(amount))).cast(amount).alias("payable"),
        ).alias("totals"),
        F.col("own").alias("lines"),
    )
    return bound(bound(rows, invoice=invoice), xml=invoices.ubl_xml(F.col("invoice"))).select("o_orderkey", "xml")


def _read_invoices(spark: SparkSession, d: str, read=invoices.read_ubl) -> DataFrame:
    return bound(_invoices(spark, d), i=read(F.col("xml"))).drop("xml")


def ubl_invoice_issues(spark: SparkSession, d: str) -> DataFrame:
    found = _read_invoices(spark, d).select(F.col("o_orderkey").alias("order_key"), F.explode(invoices.ubl_issues(F.col("i"))).alias("x"))
    return found.select("order_key", "x.rule", "x.path")


def ubl_line_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the lines, the tax breakdown and the payable amount of each invoice come to, read from its XML."""
    rows, i = _read_invoices(spark, d, invoices.read_amounts), F.col("i")
    whole = lambda x: x.cast("decimal(38,2)")
    return rows.select(F.col("o_orderkey").alias("order_key"), whole(invoices.total(i["lines"], "amount")).alias("line_extension"), whole(invoices.total(i["subtotals"], "tax")).alias("tax"), whole(i["totals"]["payable"]).alias("payable"))


def ubl_categories_without_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Categories that occur on lines of an invoice without a subtotal."""
    of = lambda x: F.array_distinct(F.transform(F.col(x), lambda y: y["category"]))
    return _read_invoices(spark, d, invoices.read_categories).select(F.col("o_orderkey").alias("order_key"), F.explode(F.array_except(of("i.lines"), of("i.subtotals"))).alias("category"))


def ubl_invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _read_invoices(spark, d, invoices.read_lines).select("i.id", "i.type_code", F.explode("i.lines").alias("l"))
    return rows.select("id", "type_code", F.col("l.id").cast("int").alias("line"), F.col("l.name").alias("name"), F.col("l.amount").alias("amount"))


def hl7_encounters(spark: SparkSession, d: str) -> DataFrame:
    """The encounter of each admission; a blank patient class gives none."""
    rows = bound(_adt(spark, d), e=bundles.hl7_encounter(F.col("s"), F.col("d"))).where("e is not null")
    return rows.select(F.col("e.id").alias("id"), "e.status", F.col("e.class").alias("class"), F.col("e.start").alias("start_date"))


def hl7_observations(spark: SparkSession, d: str) -> DataFrame:
    """Results made of the order lines, one OBX a line; every third has no code."""
    key = F.col("o_orderkey").cast("string")
    obx = F.transform("lines", lambda x: make._text(
        "OBX|", x["l_linenumber"].cast("string"), "|NM|", F.when(x["l_linenumber"] % 3 == 0, "").otherwise(F.concat(F.lit("P"), x["l_partkey"].cast("string"))), "^Part^L||", x["quantity"].cast("string"), "|EA|||||",
        F.when(x["l_linenumber"] % 2 == 0, "F").otherwise("?"), "\r",
    ))
    message = make._text("MSH|^~\\&|LAB|A|HIS|A|20260101||ORU^R01|M", key, "|P|2.5.1\rOBR|1|||X|||", F.col("day"), "1030+0130\r", F.array_join(obx, ""))
    rows = bound(make.order_lines(spark, d), message=message)
    rows = bound(rows, s=hl7_segments(F.col("message")), d=hl7_delimiters(F.col("message")))
    return bound(rows, all=bundles.hl7_observations(F.col("s"), F.col("d"))).select(F.explode("all").alias("o")).select("o.*")


QUERIES = {f.__name__: f for f in (
    hl7_acknowledgements, hl7_redacted_messages, hl7_batch_roundtrip, hl7_frames_roundtrip, x12_acknowledgements, x12_acknowledged_sets, x12_acknowledgement_errors, edifact_answers, edifact_interchange_issues, ubl_line_totals, ubl_categories_without_breakdown, ubl_invoice_issues,
    ubl_invoice_lines, hl7_encounters, hl7_observations,
)}

_K = "WITH k AS (SELECT o_orderkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"
_ADT = r"""
  SELECT c_custkey AS k, 'MSH|^~\&|HIS|ACME|RIS|ACME|20261001120000||ADT^A01|M' || c_custkey || '|P|2.5.1' || chr(13) || 'EVN|A01|20261001120000' || chr(13) || 'PID|1||' AS a, c_custkey || '^^^' AS id, n_name || '^MR||' AS b,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || '^' || c_mktsegment END AS name, '||19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS born, '0' || (c_custkey % 9 + 1) || '15' AS day,
         '|' || CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END || chr(13) || 'PV1|1|' || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'I' END || '|W4^101' || chr(13) AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_BATCHES = f"WITH a AS ({_ADT}), t AS (SELECT k, a || id || b || name || born || day || c AS m FROM a) SELECT k // 100 AS batch, CAST(count(*) AS INTEGER) AS n, md5(string_agg(CASE WHEN k % 2 = 1 THEN translate(m, '|^', '!*') ELSE m END, '' ORDER BY k)) AS messages_md5 FROM t GROUP BY 1"
_ISA = "'ISA*00*          *00*          *ZZ*SELLER         *ZZ*BUYER          *260102*0900*^*00501*' || lpad(CAST(k AS VARCHAR), 9, '0') || '*0*P*:~GS*FA*SELLER         *BUYER          *260102*0900*1*X*005010X231A1~'"
_CODE = "CASE WHEN k % 4 <> 0 THEN 'A' ELSE 'R' END"

ORACLE_SQL = {
    "hl7_acknowledgements": r"""
      SELECT c_custkey AS cust_key, 'MSH|^~\&|RIS|ACME|HIS|ACME|20261001130000||ACK^A01|A' || c_custkey || '|P|2.5.1' || chr(13) || 'MSA|'
             || CASE WHEN c_custkey % 10 = 0 THEN 'AE|M' || c_custkey || '|no\F\such ward' ELSE 'AA|M' || c_custkey END || chr(13) AS ack FROM customer""",
    "hl7_redacted_messages": f"""
      WITH a AS ({_ADT}), t AS (SELECT k, a || 'PATIENT-1^^^' || b || born || c AS m FROM a)
      SELECT k AS cust_key, CASE WHEN k % 2 = 1 THEN translate(m, '|^', '!*') ELSE m END AS message, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_changes FROM t""",
    "hl7_batch_roundtrip": _BATCHES,
    "hl7_frames_roundtrip": _BATCHES,
    "x12_acknowledgements": f"""
      {_K} SELECT k AS order_key, {_ISA} || 'ST*997*0001~AK1*PO*1~AK2*850*0001~AK5*' || {_CODE} || '~AK9*' || {_CODE} || '*1*1*' || CASE WHEN k % 4 <> 0 THEN '1' ELSE '0' END
             || '~SE*6*0001~GE*1*1~IEA*1*' || lpad(CAST(k AS VARCHAR), 9, '0') || '~' AS ack FROM k""",
    "x12_acknowledged_sets": f"{_K} SELECT k AS order_key, 'PO' AS functional_id, '1' AS group_control, '850' AS set_id, '0001' AS set_control, {_CODE} AS code, k % 4 <> 0 AS accepted, {_CODE} AS group_code FROM k",
    "x12_acknowledgement_errors": f"{_K} SELECT k AS order_key, 'group without AK9' AS error FROM k WHERE k % 6 = 0 UNION ALL SELECT k, 'AK9 count' FROM k WHERE k % 5 = 0 AND k % 6 <> 0",
    "edifact_answers": f"""
      {_K} SELECT k AS order_key, 'UNB+UNOA:1+S+B+260102:0900+' || k || '''UNH+1+CONTRL:0:3:UN''UCI+1+B+S+' || CASE WHEN k % 4 <> 0 THEN '7' ELSE '4' END || '''UNT+3+1''UNZ+1+' || k || '''' AS answer, '1' AS reference, k % 4 <> 0 AS accepted FROM k""",
    "edifact_interchange_issues": f"""
      {_K}, e AS (SELECT * FROM k)
      SELECT k AS order_key, 'UNT' AS tag, 'UNT without a matching UNH' AS message FROM e WHERE k % 11 = 0
      UNION ALL SELECT k, 'UNZ', 'UNZ count 1 does not match 0 messages' FROM e WHERE k % 11 = 0
      UNION ALL SELECT k, 'UNZ', 'UNZ count 4 does not match 1 messages' FROM e WHERE k % 7 = 0 AND k % 11 <> 0
      UNION ALL SELECT k, 'UNT', 'UNT count Some(99) does not match ' || (2 * n + 4) || ' segments' FROM e WHERE k % 3 = 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0""",
    "ubl_line_totals": """
      WITH t AS (SELECT o_orderkey AS k, CAST(sum(CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS net FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
      u AS (SELECT *, CASE WHEN k % 3 = 0 THEN CAST(0 AS DECIMAL(38,2)) ELSE CAST(round(CAST(net * 15 AS DECIMAL(38,4)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(38,2)) END AS tax FROM t)
      SELECT k AS order_key, net AS line_extension, CASE WHEN k % 17 = 0 THEN CAST(0 AS DECIMAL(38,2)) ELSE tax END AS tax, CAST(net + tax + CASE WHEN k % 5 = 0 THEN CAST(0.01 AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(38,2)) AS payable FROM u""",
    "ubl_categories_without_breakdown": "SELECT DISTINCT o_orderkey AS order_key, CASE WHEN o_orderkey % 3 = 0 THEN 'E' ELSE 'S' END AS category FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 17 = 0",
    "ubl_invoice_issues": f"""
      {_K}
      SELECT k AS order_key, 'PEPPOL-EN16931-R003' AS rule, 'cbc:BuyerReference' AS path FROM k WHERE k % 7 = 0
      UNION ALL SELECT k, 'BR-23', 'cbc:InvoicedQuantity/@unitCode' FROM k WHERE k % 13 = 0
      UNION ALL SELECT k, 'BR-CO-10', 'cac:LegalMonetaryTotal/cbc:LineExtensionAmount' FROM k WHERE k % 11 = 0
      UNION ALL SELECT k, 'BR-CO-13', 'cac:LegalMonetaryTotal/cbc:TaxExclusiveAmount' FROM k WHERE k % 11 = 0
      UNION ALL SELECT k, 'BR-CO-15', 'cac:LegalMonetaryTotal/cbc:TaxInclusiveAmount' FROM k WHERE k % 17 = 0 AND k % 3 <> 0
      UNION ALL SELECT k, 'BR-CO-16', 'cac:LegalMonetaryTotal/cbc:PayableAmount' FROM k WHERE k % 5 = 0
      UNION ALL SELECT k, 'BR-CO-18', 'cac:TaxTotal/cac:TaxSubtotal' FROM k WHERE k % 17 = 0
      UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 'BR-E-01' ELSE 'BR-S-01' END, 'cac:TaxTotal/cac:TaxSubtotal/cac:TaxCategory/cbc:ID' FROM k WHERE k % 17 = 0
      UNION ALL SELECT k, 'BR-E-10', 'cac:TaxCategory/cbc:TaxExemptionReason' FROM k WHERE k % 3 = 0 AND k % 17 <> 0""",
    "ubl_invoice_lines": """
      SELECT 'I' || o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN '381' ELSE '380' END AS type_code, CAST(l_linenumber AS INTEGER) AS line, 'Part & <' || l_partkey || '>' AS name,
             CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "hl7_encounters": "SELECT 'M' || c_custkey || '-enc' AS id, 'in-progress' AS status, 'IMP' AS class, '2026-10-01' AS start_date FROM customer WHERE c_custkey % 7 <> 0",
    "hl7_observations": """
      SELECT 'M' || o_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'final' ELSE 'unknown' END AS status, 'urn:hl7v2:L' AS system, 'P' || l_partkey AS code, 'Part' AS display,
             CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS value, 'EA' AS unit, strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00+01:30' AS effective
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber % 3 <> 0""",
}
