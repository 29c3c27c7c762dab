"""Work that must not grow faster than the tables: what is parsed once, and what is dealt out to many tasks."""

import io
import zipfile

import __spark_entry__ as entry
import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions.fields import sniffed
from paperloom.operators import comparison, invoices
from paperloom.plans import messages as make
from paperloom.sources import office
from paperloom.sources.segments import edifact_segments, hl7_delimiters, hl7_segments


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patients_are_parsed_once_and_dealt_out(spark):
    plan = plan_of(entry.queries()["fhir_patient_xml"](spark, entry.DATA))
    assert plan.count("split(translate(message") == 1
    assert make.hl7_adt(spark, entry.DATA).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_orders_are_dealt_out(spark):
    assert make.order_lines(spark, entry.DATA).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_messages_meet_whole(spark):
    """Messages are joined by key, not segment by segment, and a segment put before all others changes no other."""
    join = next(x for x in plan_of(entry.queries()["x12_changes"](spark, entry.DATA)).splitlines() if "FullOuter" in x)
    assert "__seg" not in join
    head = "MSH|^~\\&|A|B|C|D|1||ADT^A01|M|P|2.5\r"
    texts = [(0, head + "PID|1\rZZ1|x\r", head + "NTE|n\rPID|1\rZZ1|x\r"), (1, head, head), (2, head, None), (3, "no message", head), (4, head + "PID|1\r", head.replace("|", "!") + "PID!1\r")]
    left, right = (spark.createDataFrame([(t[0], t[n]) for t in texts], "k int, m string").withColumn("d", hl7_delimiters(F.col("m"))) for n in (1, 2))
    got = sorted(tuple(r)[:3] for r in comparison.compared_segments(left, right, hl7_segments(F.col("m")), "k", F.col("d.field"), "d").collect())
    assert got == [(0, "NTE[0]", "added"), (2, "MSH[0]", "removed"), (3, "MSH[0]", "added")]


def test_documents_pass_a_worker_once(spark):
    """Writing and reading happen in one pass, and what is read by hand is what the general readers read."""
    assert plan_of(entry.queries()["docx_text"](spark, entry.DATA)).count("ArrowEvalPython") == 1
    content = office.docx_file.func(pd.Series([["a & <b>", None, "\x00c"]]))[0]
    assert office._plain_part(content, b"word/document.xml") == zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")
    assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None
    body = "<d><p><t>a<!-- c -->b<t>in</t>c</t><tab/><p><t>&lt;</t></p></p></d>"
    deep = f"<d>{'<p><t>a' * 3000}{'</t></p>' * 3000}</d>"
    for text, wanted in ((body, "inab\t<"), (deep, "a" + "\na" * 2999), ('<!DOCTYPE d [<!ENTITY e "q">]><d><t>&e;</t></d>', "q")):
        for comment in (b"", b"remark"):
            file = io.BytesIO()
            with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("word/document.xml", text)
                archive.comment = comment
            assert office._document(file.getvalue()) == wanted
    damaged = bytearray(content)
    damaged[content.index(b"word/document.xml") + 20] ^= 255
    assert office.docx_text.func(pd.Series([bytes(damaged), None])).values.tolist()[1] == [None, None]
    assert office.docx_text.func(pd.Series([bytes(damaged)]))["text"][0] is None


def test_separators_are_found_once_a_message(spark):
    """A message's own separators are worked out for the message, not for each of its segments."""
    rows = spark.createDataFrame([("UNA:|.? ~\nUNB|a?|b~\r\nQTY|?~",), ("UNB+a?+b??+c'\nUNT+1'",), (None,)], "m string")
    found = rows.select(edifact_segments(F.col("m")).alias("s"))
    assert plan_of(found).count("UNA") == 6  # five separators and where the body starts
    got = [r.s and [(x.tag, x.fields) for x in r.s] for r in found.collect()]
    assert got == [[("UNB", ["a?|b"]), ("QTY", ["?"])], [("UNB", ["a?+b??", "c"]), ("UNT", ["1"])], None]


def test_categories_are_read_alone(spark):
    """A query over categories makes values of categories, not of the whole invoice, and finds those that the whole reader finds."""
    plan = plan_of(entry.queries()["ubl_categories_without_breakdown"](spark, entry.DATA))
    assert "StructField(cac:InvoiceLine" in plan and "StructField(cbc:CustomizationID" not in plan
    item = lambda c: f"<cac:Item><cac:ClassifiedTaxCategory><cbc:ID>{c}</cbc:ID></cac:ClassifiedTaxCategory></cac:Item>"
    spaces = "xmlns:cac='a' xmlns:cbc='b'"
    texts = [
        f"<Invoice {spaces}><cac:InvoiceLine>{item('S')}</cac:InvoiceLine><cac:InvoiceLine><cbc:ID>1</cbc:ID></cac:InvoiceLine></Invoice>",
        f"<CreditNote {spaces}><cac:TaxTotal><cac:TaxSubtotal><cac:TaxCategory><cbc:ID>E</cbc:ID></cac:TaxCategory></cac:TaxSubtotal></cac:TaxTotal><cac:CreditNoteLine>{item('Z')}</cac:CreditNoteLine></CreditNote>",
        "<broken", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, x string")
    for read in (invoices.read_ubl, invoices.read_categories):
        own = rows.select("k", read(F.col("x")).alias("i")).select("k", F.transform("i.lines", lambda x: x["category"]), F.transform("i.subtotals", lambda x: x["category"]))
        assert sorted(tuple(r) for r in own.collect()) == [(0, ["S", None], []), (1, ["Z"], ["E"]), (2, [], []), (3, [], [])]


def test_texts_of_reports_are_dealt_out(spark):
    """All three kinds of texts are dealt out by key, and neither a format nor a blank value is found by a regular expression over the text."""
    plan = plan_of(entry.queries()["report_documents"](spark, entry.DATA))
    assert plan.count("RepartitionByExpression [o_orderkey") == 3
    rows = spark.createDataFrame([("\ufeff \t\x0b{",), ("\ufeff\ufeff{",), (" \ufeff{",), ("\r\n\fISA",), ("",), (None,)], "t string")
    found = rows.select(sniffed(F.col("t")).alias("f"), invoices.blank(F.col("t")).alias("b"))
    assert [tuple(r) for r in found.collect()] == [("fhir-json", False), (None, False), (None, False), ("x12", False), (None, True), (None, True)]
    assert "regexp_replace" not in plan_of(found) and "\\S" not in plan_of(found)
    blanks = spark.createDataFrame([(" \t\n\x0b\f\r",), ("\xa0",), ("\x1c",), (" a ",)], "t string")
    assert [r.b for r in blanks.select(invoices.blank(F.col("t")).alias("b")).collect()] == [True, False, False, False]
