"""The queries against their SQL on the smallest tables, and literal messages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions.fields import component, edifact_unescape, field, first_segment, hl7_escape_text, hl7_unescape, is_fhir_date, sniffed
from paperloom.operators import messages as ops
from paperloom.operators import bundles, comparison, fhir, redaction, replies
from paperloom.plans import checks, clinical, exchange, queries, records
from paperloom.sources.segments import edifact_segments, hl7_delimiters, hl7_error, hl7_segments, x12_error, x12_segments

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


QUERIES = queries.QUERIES | exchange.QUERIES | records.QUERIES | checks.QUERIES | clinical.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | exchange.ORACLE_SQL | records.ORACLE_SQL | checks.ORACLE_SQL | clinical.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    tables.execute(ORACLE_SQL[name])
    columns = [x[0] for x in tables.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(str, tables.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "m string").select(*columns).first()


def test_hl7_scan(spark):
    m = F.col("m")
    s = hl7_segments(m)
    row = one(spark, "MSH!^*?,!HIS!ACME\r\n\nPID!1!!A^B!C*D\r", F.transform(s, lambda x: x["tag"]), field(first_segment(s, "MSH"), 1), component(field(first_segment(s, "PID"), 3), 2))
    assert row[0] == ["MSH", "PID"] and row[1] == "!" and row[2] == "B"
    assert one(spark, "PID|1", hl7_error(m))[0] == "message does not start with MSH"
    assert one(spark, "MSH|^^\\&|x", hl7_error(m))[0] == "delimiters are not distinct"
    assert one(spark, None, hl7_segments(m))[0] is None


def test_hl7_escapes(spark):
    text = "a|b^c~d&e\\f\\F\\"
    assert one(spark, text, hl7_unescape(hl7_escape_text(F.col("m"))))[0] == text


def test_x12_and_edifact_scans(spark):
    m = F.col("m")
    assert one(spark, "ISA*00", x12_error(m))[0] is not None
    assert one(spark, "ISA*00", x12_segments(m))[0] is None
    fields = one(spark, "UNB+a?+b+c'QTY+21:10'", F.transform(edifact_segments(m), lambda s: F.transform(s["fields"], lambda x: edifact_unescape(x))))[0]
    assert fields == [["a+b", "c"], ["21:10"]]


def test_grammar_and_sniffing(spark):
    for text, good in (("2026", True), ("2026-13", False), ("2026-02-29", False), ("2024-02-29", True), ("", False)):
        assert one(spark, text, is_fhir_date(F.col("m")))[0] is good
    for text, kind in ((" MSH|x", "hl7v2"), ("ISA*", "x12"), ("<x><Invoice/>", "ubl"), ("<PRE>", "html"), ("{", "fhir-json"), ("x", None)):
        assert one(spark, text, sniffed(F.col("m")))[0] == kind


def test_any_edit_breaks_a_chain(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}", "e", "p") for i in range(4)], "log long, seq long, at string, event string, payload_sha256 string")
    chain = ops.chained(rows, "log").select("log", F.explode("entries").alias("e")).select("log", "e.*")
    assert ops.broken(chain, "log").count() == 0
    for column in ("at", "event", "payload_sha256", "prev", "hash"):
        edited = chain.withColumn(column, F.when(F.col("seq") == 2, F.concat(column, F.lit("x"))).otherwise(F.col(column)))
        assert ops.broken(edited, "log").first()["seq"] == 2


def test_redaction_by_rules(spark):
    text = "MSH|^~\\&|A\rPID|1||5^^X~7^^Y~5||N^M~~O\rOBX|1|NM|C||12\rOBX|2|TX|C||free\rZZZ\r"
    m = F.col("m")
    profile = [("PID", 3, 1, "pseudonym", "P-"), ("PID", 5, 2, "replace", "x"), ("PID", 5, 0, "year", ""), ("OBX", 5, 0, "clear", ""), ("PID", 30, 0, "clear", "")]
    out = one(spark, text, redaction.hl7_redacted(hl7_segments(m), hl7_delimiters(m), profile).alias("r"))[0]
    assert out["message"] == "MSH|^~\\&|A\rPID|1||P-1^^X~P-2^^Y~P-1||N^x~~O\rOBX|1|NM|C||12\rOBX|2|TX|C||\rZZZ|\r"
    assert [tuple(c) for c in out["changes"]] == [(1, "PID", 3, 1), (1, "PID", 5, 2), (1, "PID", 5, None), (3, "OBX", 5, None)]
    for rule in (("MSH", 3, 0, "clear", ""), ("PID", 0, 0, "clear", "")):
        with pytest.raises(ValueError):
            redaction.hl7_redacted(m, m, [rule])
    assert one(spark, "PID|1", redaction.hl7_redacted(hl7_segments(m), hl7_delimiters(m), profile).alias("r"))[0] is None


def test_frames_and_batches_refuse_what_is_cut(spark):
    m = F.col("m")
    for text, messages in (("\x0ba\x1c\r\x0bb\x1c\r", ["a", "b"]), ("", []), ("\x0ba\x1c\r\x0bb", None), ("a\x1c\r", None), ("\x0ba\x1c\rb", None)):
        assert one(spark, text, replies.mllp_messages(m))[0] == messages
    for text, error in (("BHS|^~\\&\rMSH|a\rPID\rBTS|1\r", None), ("BHS|\rMSH|a\r", "batch has no BTS"), ("BHS|\rMSH|a\rBTS|2\r", "BTS count does not match"), ("MSH|a\r", "a batch must start with BHS or FHS"), ("FHS|\rPID|\rBTS|0\r", "a segment appears outside any message")):
        assert one(spark, text, replies.hl7_batch_error(m))[0] == error
    assert one(spark, "BHS|^~\\&\rMSH|aMSH\rPID\rMSH|b\rBTS|2\r", replies.hl7_batch_messages(m))[0] == ["MSH|aMSH\rPID\r", "MSH|b\r"]


def test_nested_and_open_edifact_messages(spark):
    rows = spark.createDataFrame([(1, "UNH+1'UNH+2'UNT+2+3'X'"), (2, ""), (3, "UNB+a'UNH+1'UNZ+1'")], "k int, m string")
    got = {(r["k"], r["idx"], r["message"]) for r in replies.edifact_interchange_issues(rows, edifact_segments(F.col("m")), "k").collect()}
    assert got == {
        (1, 0, "interchange must start with UNB"), (1, 3, "interchange must end with UNZ"), (1, 1, "nested UNH inside an open message"), (1, 2, "UNT reference `3` does not match UNH reference `2`"),
        (2, 0, "interchange must start with UNB"), (3, 1, "UNH without a matching UNT"),
    }


def test_timestamps(spark):
    m = F.col("m")
    for text, value in (("2026", ("2026", False)), ("202613", None), ("20260131", ("2026-01-31", False)), ("202601311030", ("2026-01-31", True)), ("20260131103015.25-0500", ("2026-01-31T10:30:15-05:00", False)), ("2026013125Z", None), ("2026013110Z", ("2026-01-31T10:00:00Z", False)), ("x", None), (None, None)):
        got = one(spark, text, bundles.fhir_datetime(m).alias("t"))[0]
        assert (None if got is None else tuple(got)) == value


def test_patients_of_all_delimiters(spark):
    names = {r["c_custkey"]: r for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    got = queries.hl7_patients(spark, DATA).collect()
    assert len(got) == len(names) and any(int(r["id"]) % 2 for r in got)
    for r in got:
        k = int(r["id"])
        name = (names[k]["c_name"], names[k]["c_mktsegment"]) if k % 5 else (None, None)
        assert tuple(r) == (str(k), *name, "male" if k % 2 else "female", f"19{k % 100:02d}-0{k % 9 + 1}-15")
    text = "MSH!*?\\&!A\rPID!1!!7*X?8!!A*B?C*D\r"
    p = one(spark, text, fhir.patient(hl7_segments(F.col("m")), hl7_delimiters(F.col("m"))).alias("p"))[0]
    assert (p.id, p.name[0].family, p.name[0].given, p.name[1].family) == ("7", "A", ["B"], "C")


def test_changes_of_other_delimiters(spark):
    left = spark.createDataFrame([(1, "MSH!*?\\&!A\rPID!1!!7*X!!A*B\r"), (2, "MSH|^~\\&|A\rPID|1||7^X||A^B\r")], "k int, m string")
    right = left.withColumn("m", F.regexp_replace("m", "7", "8"))
    left, right = (x.withColumn("d", hl7_delimiters(F.col("m"))) for x in (left, right))
    found = comparison.compared_segments(left, right, hl7_segments(F.col("m")), "k", F.col("d.field"), "d").collect()
    assert sorted(tuple(r) for r in found) == [(k, "PID[0]-3.1", "changed", "7", "8") for k in (1, 2)]


def test_transaction_sets(spark):
    isa = f"ISA*00*{'':10}*00*{'':10}*ZZ*{'P':15}*ZZ*{'L':15}*270315*2145*^*00501*000000001*0*P*:~"
    rows = spark.createDataFrame([(1, isa + "ST*835*1~BPR*I~N1*A~CLP*1~SE*5*1~"), (2, isa + "ST*835*1~BPR*I~N1*A~"), (3, isa + "GS*X~"), (4, None)], "k int, m string")
    found = ops.transaction_set_issues(rows, x12_segments(F.col("m")), "k").collect()
    assert sorted(tuple(r) for r in found) == [(2, "835", "CLP", "the set lacks CLP"), (2, "835", "SE", "the set does not end with SE"), (3, "", "ST", "no transaction set")]
    order = rows.limit(1).select(ops.order_error(ops.read_850(ops.body(x12_segments(F.lit(isa + "ST*850*1~PO1*1*2~CTT*3~SE*4*1~"))))).alias("e")).first()
    assert order.e == "CTT counts 3 lines, there are 1"


def test_element_issues_of_other_tags(spark):
    head = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *260101*1200*^*00501*000000001*0*P*:~"
    rows = spark.createDataFrame([(1, head + "GS*IN*A*B*20260101*1200*1*X*005010~ST**0001~BIG*20260101*I1~N1**X~SE*x*0001~GE*1*1~IEA*1*000000001~")], "k int, m string")
    from paperloom import rules

    got = {(r["tag"], r["position"]) for r in ops.element_issues(rows, x12_segments(F.col("m")), "k", rules.X12_ELEMENTS).collect()}
    assert {("ST", 1), ("N1", 1), ("SE", 1)} <= got


def test_long_chains_are_read_in_batches(spark):
    import hashlib

    n, last = 25_000, "0" * 64
    rows = spark.range(n).select(F.lit(1).alias("log"), F.col("id").alias("seq"), F.concat(F.lit("é"), "id").alias("at"), F.lit("e").alias("event"), F.lit("p").alias("payload_sha256"))
    rows = rows.unionByName(rows.where("seq < 3").withColumn("log", F.lit(2)))
    sized = lambda x: len(x.encode()).to_bytes(8, "big") + x.encode()
    heads = {}
    for k in range(n):
        last = hashlib.sha256(k.to_bytes(8, "big") + b"".join(map(sized, (f"é{k}", "e", "p", last)))).hexdigest()
        heads[k] = last
    assert {tuple(r) for r in ops.chain_heads(rows, "log").collect()} == {(1, n, heads[n - 1]), (2, 3, heads[2])}
    entries = ops.chain_entries(rows, "log")
    assert {r["seq"]: r["hash"] for r in entries.where("log = 1").collect()} == heads
    assert entries.count() == n + 3 and ops.broken(entries, "log").count() == 0
