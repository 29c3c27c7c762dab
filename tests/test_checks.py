"""Literal documents for the writers, reports, grammars and CSV."""

from pyspark.sql import functions as F

from paperloom.functions.fields import hl7_escape_value, hl7_unescape, is_fhir_datetime, is_instant
from paperloom.operators import messages, reports, writers
from paperloom.sources import office
from paperloom.sources.segments import hl7_delimiters, hl7_segments, x12_segments


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_escapes_without_a_partner(spark):
    for raw, want in (("a\\b", "a\\b"), ("x\\", "x\\"), ("\\F\\", "|"), ("\\F\\\\S", "|\\S"), ("\\.br\\\\T\\", "\\.br\\&"), ("", ""), ("\\\\", "\\\\")):
        assert one(spark, hl7_unescape(F.col("v")), v=raw) == want
    own = "MSH#*+!%#A"
    assert one(spark, hl7_unescape(F.col("v"), hl7_delimiters(F.col("m"))), v="!F!!S!!R!!T!!E!!q", m=own) == "#*+%!!q"
    assert one(spark, hl7_escape_value(F.col("v"), hl7_delimiters(F.col("m"))), v="a!b#c|\r", m=own) == "a!E!b!F!c|!X0D!"


def test_written_messages_read_back(spark):
    segments = F.array(writers.hl7_header(("A", "B"), ("C", "D"), F.lit("2027"), F.lit("ADT^A01"), F.lit("9")), writers.hl7_written_segment("PID", F.lit("x|y\\z"), F.lit("p^q")))
    text = writers.hl7_message(writers.hl7_with_segment(segments, writers.hl7_written_segment("NTE", F.lit("\\S\\"), escaped=True)))
    rows = spark.range(1).select(text.alias("m"))
    assert rows.first().m == "MSH|^~\\&|A|B|C|D|2027||ADT^A01|9|P|2.5.1\rPID|x\\F\\y\\E\\z|p^q\rNTE|\\S\\\r"
    read = rows.select(hl7_segments(F.col("m")).alias("s")).first().s
    assert [x.tag for x in read] == ["MSH", "PID", "NTE"] and read[1].fields[1] == "p^q"


def test_times(spark):
    good = ["2024", "2024-02", "2024-02-29", "2024-02-29T10:00", "2024-02-29T10:00:60Z", "2024-02-29T23:59:59.123+14:59"]
    bad = ["2023-02-29", "2024-13", "2024-02-29T", "2024-02-29T24:00", "2024-02-29T10:60", "2024-02-29T10:00+15:00", "x", ""]
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", is_fhir_datetime(F.col("t")).alias("ok"), is_instant(F.col("t")).alias("at")).collect()
    assert [r.t for r in rows if r.ok] == good
    assert [r.t for r in rows if r.at] == ["2024-02-29T10:00:60Z", "2024-02-29T23:59:59.123+14:59"]


def test_headers_never_closed(spark):
    isa = f"ISA*00*{'':10}*00*{'':10}*ZZ*{'P':15}*ZZ*{'L':15}*270315*2145*^*00501*000000001*0*P*:~"
    m = isa + "GS*PO*A*B*2*3*7*X*1~ST*850*1~ST*850*2~SE*2*2~"
    found = messages.x12_envelope_issues(spark.createDataFrame([(1, m), (2, None)], "k int, m string"), x12_segments(F.col("m")), "k")
    assert sorted((r.k, r.idx, r.rule) for r in found.collect()) == [(1, 0, "ISA never closed"), (1, 1, "GS never closed"), (1, 2, "ST never closed")]


def test_resources_in_xml(spark):
    text = '<?xml version="1.0"?>\n<Observation xmlns="http://hl7.org/fhir"><id value="o"/><status value="final"/><code><coding><code value="c"/></coding><text value="t"/></code><valueQuantity><value value="1.5"/></valueQuantity></Observation>'
    rows = spark.createDataFrame([(1, text), (2, "<Device/>"), (3, None)], "k int, t string").select("k", writers.read_resource_xml(F.col("t")).alias("r"))
    got = {r.k: r.r for r in rows.collect()}
    assert got[2] is None and got[3] is None
    assert (got[1].resourceType, got[1].id, got[1].code.text, got[1].code.coding[0].code, got[1].valueQuantity.value, got[1].subject) == ("Observation", "o", "t", "c", 1.5, None)


def test_reports(spark):
    texts = spark.createDataFrame([(1, "MSH|^~\\&|A|B|C|D|2027||ADT^A01|9|P|2.5.1\rEVN|A01\r"), (2, "MSH|^~"), (3, "nothing"), (4, '{"resourceType":"Patient","birthDate":"x"}'), (5, None)], "k int, t string")
    issues = reports.report(texts, F.col("t"), "k")
    got = sorted((r.k, r.format, r.place, r.rule) for r in issues.collect())
    assert got == [(1, "hl7v2", "EVN[1]-2", "required"), (2, "hl7v2", "", "unreadable"), (3, "", "", "format"), (4, "fhir-json", "/0/birthDate", "value"), (5, "", "", "format")]
    said = {r.k: r for r in reports.report_texts(texts, issues, F.col("t"), "k").collect()}
    assert not said[1].valid and said[1].report.endswith("hl7v2: 1 error(s)\n")
    assert {r.k for r in reports.inspected(texts, F.col("t"), "k").where("summary is not null").collect()} >= {1, 3, 4}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n1,2,3,"x ""y"", z"\n5\n')
    got = [tuple(r) for r in office.csv_rows(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("1", "2", []), ("1", "2", ["3", 'x "y", z']), ("5", None, [])], key=str)
    values = [["a", 'q"', "x,y", "", "l\nm"], [None, "b"]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<string>").select(office.csv_line(F.col("v")).alias("line"))
    assert [r.line for r in rows.collect()] == ['a,"q""","x,y",,"l\nm"', ",b"]
    assert rows.select(office.csv_values(F.col("line")).alias("v")).first().v == values[0]
    office.csv_files(spark.createDataFrame([(1, 'a "b"')], "k int, t string"), str(tmp_path / "out"))
    assert [tuple(r) for r in office.csv_rows(spark, str(tmp_path / "out")).collect()] == [("1", 'a "b"', [])]
