"""Literal documents: those that can't be read, nulls, and the corners of templates and comparison."""

import json

from pyspark.sql import functions as F

from paperloom.operators import comparison, fhir, interchanges, markup
from paperloom.sources import office
from paperloom.sources.segments import edifact_segments, hl7_delimiters, hl7_segments, x12_segments


def test_edifact_errors(spark):
    texts = ["UNH+1+ORDERS:D'LIN+1++A'QTY+21:'QTY+21:3'UNT+5+1'", "UNB+1'", "UNH+1+ORDERS:D'BGM+1'", "UNH+1+ORDERS:D'UNT+x+1'", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, m string")
    got = {r.k: r for r in interchanges.edifact_documents(rows, edifact_segments(F.col("m")), "k").collect()}
    assert [tuple(x) for x in got[0].lines] == [("1", "A", "3")] and got[0].number == "" and got[0].buyer is None
    assert [got[i].error for i in range(5)] == [None, "interchange has no UNH", "message has no UNT trailer", "UNT counts x segments but the message has 2", None]
    assert got[4].kind is None and got[3].lines is None


def test_remittance(spark):
    isa = f"ISA*00*{'':10}*00*{'':10}*ZZ*{'PAPER':15}*ZZ*{'LOOM':15}*270315*2145*^*00501*000000077*0*P*:~"
    m = isa + "ST*835*0042~BPR*I*77.25*C~CLP*K-9*2*80*77.25~SVC*HC:T100*80~SE*5*0042~"
    row = spark.createDataFrame([(m,)], "m string").select(interchanges.remittance_summary(x12_segments(F.col("m"))).alias("t")).first()
    assert row.t == "total payment 77.25\nclaim K-9 status 2 billed 80 paid 77.25\n  service HC:T100\n"


def test_flats_align(spark):
    left = spark.createDataFrame([(1, "a-5", "x"), (1, "b", "y"), (1, "c.1", "z")], "k int, path string, value string")
    right = spark.createDataFrame([(1, "a-5~1", "x"), (1, "a-5~2", "w"), (1, "c", "q")], "k int, path string, value string")
    got = sorted(tuple(r) for r in comparison.compared_flats(left, right, "k").collect())
    assert got == [(1, "a-5~2", "added", None, "w"), (1, "b", "removed", "y", None), (1, "c.1", "changed", "z", "q")]
    assert comparison.compared_flats(left, right, "k", ["a", "b", "c"]).count() == 0
    assert comparison.compared_flats(left.limit(0), right.limit(0), "k").count() == 0


def test_json_changes(spark):
    pairs = [('{"a":1}', '{"a":1.0}'), ("[1,2]", "[1]"), ("1", "{}"), ("{", "1"), (None, "1"), ('{"b":true}', '{"b":1}')]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, l string, r string")
    got = {r.k: r.c and [tuple(x) for x in r.c] for r in rows.select("k", comparison.json_changes("l", "r").alias("c")).collect()}
    assert got == {0: [("/a", "changed", "1", "1.0")], 1: [("/1", "removed", "2", None)], 2: [("/", "changed", "1", "{}")], 3: None, 4: None, 5: [("/b", "changed", "true", "1")]}


def test_bundles(spark):
    oru = "MSH|^~\\&|WEFT|P|WARP|L|20270315214500||ORU^R01|LOOM77|P|2.5.1\rPID|1||90017^^^XX^MR~44||Quill^Ada~^Bo||18009901|F\rOBX|1|NM|SOD^Sodium|1|139.5|mmol/L|||||F\r"
    other = "MSH|^~\\&|WEFT|P|WARP|L|20270315214500||SIU^S12|M|P|2.5.1\r"
    rows = spark.createDataFrame([(0, oru), (1, other), (2, "no message"), (3, None)], "k int, m string")
    got = {r.k: r for r in fhir.bundles(rows, hl7_segments(F.col("m")), hl7_delimiters(F.col("m")), "k").collect()}
    patient, result = (e["resource"] for e in json.loads(got[0].bundle)["entry"])
    assert patient["identifier"] == [{"system": "urn:hl7v2:XX", "value": "90017"}, {"value": "44"}] and patient["name"] == [{"family": "Quill", "given": ["Ada"]}, {"given": ["Bo"]}] and "birthDate" not in patient
    assert result["valueQuantity"] == {"unit": "mmol/L", "value": 139.5} and result["status"] == "final" and result["subject"] == {"reference": "Patient/90017"}
    assert [got[i].error for i in (1, 2, 3)] == ["unsupported HL7 message type `SIU`", "not an HL7 message", "not an HL7 message"]
    assert got[1].bundle is None


def test_redaction(spark):
    text = json.dumps({"resourceType": "Bundle", "entry": [
        {"fullUrl": "http://x/Patient/p1", "resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1970-01-01", "contained": [{"resourceType": "Patient", "id": "p9"}]}},
        {"resource": {"resourceType": "Observation", "subject": {"reference": "Patient/p1", "display": "S"}, "note": ["n"], "code": {"text": "kept"}}},
    ]})
    rows = spark.createDataFrame([(text,), ("[]",), ("{}",), (None,)], "t string").select(fhir.redacted()(F.col("t")).alias("r"))
    done = [r.r for r in rows.collect()]
    a, b = json.loads(done[0].json)["entry"]
    assert a["fullUrl"] == "http://x/Patient/PATIENT-1" and a["resource"]["id"] == "PATIENT-1" and a["resource"]["birthDate"] == "1970" and a["resource"]["contained"][0]["id"] == "PATIENT-2"
    assert b["resource"] == {"resourceType": "Observation", "subject": {"reference": "Patient/PATIENT-1"}, "code": {"text": "kept"}}
    assert all(x.json is None for x in done[1:])


def test_templates(spark):
    cases = [
        ("<p>{{name}} &amp; {{a.b}}</p>", '{"name":"<Bob>","a":{"b":3}}', "<p>&lt;Bob&gt; &amp; 3</p>", None),
        ("{{#each x}}{{@index}}{{.}}{{/each}}", '{"x":{"b":"2","a":"1"}}', "0112", None),
        ("{{#if x}}a{{else}}b{{/if}}", '{"x":[]}', "b", None),
        ("{{x}}", "{}", None, "missing field `x`"),
        ("{{#if x}}a", '{"x":1}', None, "`#if` is never closed"),
        ("{{x}}", '{"x":[]}', None, "field `x` is an array or object, not text"),
        ("{{x", '{"x":1}', None, "unterminated `{{` tag"),
        ("t", None, None, "data isn't JSON"),
    ]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _, _) in enumerate(cases)], "k int, t string, d string").select("k", markup.merged("t", "d").alias("m"))
    assert {r.k: tuple(r.m) for r in rows.collect()} == {i: c[2:] for i, c in enumerate(cases)}


def test_references_and_styles(spark):
    row = spark.createDataFrame([("&amp;lt; &#65;&#x42; &nope; & &#xD800; &nbsp;|",)], "t string").select(markup.decoded("t").alias("d"), markup.collapsed(F.lit(" a \n\t b ")).alias("c")).first()
    assert (row.d, row.c) == ("&lt; AB &nope; & &#xD800;  |", "a b")
    s = spark.createDataFrame([("margin:1pt 2px 3pt;padding:1pt 2;font-weight:x;junk",)], "s string").select(markup.inline_style(F.col("s")).alias("x")).first().x
    assert s.margin == [1.0, 1.5, 3.0, 1.5] and s.padding is None and s.font_weight is None and s.page_break_after is False


def test_damaged_files(spark):
    rows = spark.createDataFrame([("a", bytearray(b"no archive"))], "path string, content binary")
    assert office.xlsx_cells(rows).first().error.startswith("BadZipFile")
    text = rows.select(office.docx_text("content").alias("t")).first().t
    assert text.text is None and text.error.startswith("BadZipFile")
