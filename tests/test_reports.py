"""Reports in one pass, and chains that are checked in runs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import messages as ops
from paperloom.operators import reports, writers


def test_first_issue_is_that_of_the_first_segment(spark):
    isa = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *260101*1200*^*00501*000000001*0*P*:~"
    lines = "".join(f"N1*BY*C{k}~" for k in range(6))
    x12 = f"{isa}GS*PO*AA*BB*20260101*1200*1*X*005010~ST*850*0001~{lines}SE*9*0001~GE*1*2~IEA*1*000000001~"
    edifact = "UNB+UNOA:1+B+S+260101:1200+1'UNH+1+ORDERS:D:96A:UN'BGM+220+1+9'UNT+3+1'UNZ+1+1"
    rows = spark.createDataFrame([("x", x12), ("e", edifact), ("n", None), ("b", ""), ("m", "MSH|^")], "k string, t string")
    first = {r["k"]: r for r in reports.first_issues(rows, F.col("t"), "k").collect()}
    assert (first["x"]["place"], first["x"]["idx"], first["x"]["message"]) == ("SE[9]", 9, "SE count")
    assert first["e"]["message"] == "the last segment has no terminator"
    assert {first[k]["rule"] for k in "nb"} == {"format"} and first["m"]["rule"] == "unreadable"
    every = reports.issues_of(rows, F.col("t"), "k").where("k = 'x'").first()["issues"]
    assert [i["idx"] for i in every] == sorted(i["idx"] for i in every) and len(every) > 1


def test_report_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([("a", "MSH|^~\\&|A")], "k string, t string").write.parquet(f"{tmp_path}/t")
    plan = reports.report(spark.read.parquet(f"{tmp_path}/t"), F.col("t"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def plain_broken(rows):
    """The first entry of each log that is wrong, by reading them in order."""
    out, logs = {}, {}
    for row in rows:
        logs.setdefault(row[0], []).append(row)
    for log, own in logs.items():
        before, bad = "0" * 64, []
        for n, (_, seq, at, event, payload, prev, digest) in enumerate(sorted(own, key=lambda r: r[1])):
            raw = seq.to_bytes(8, "big", signed=True) + b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in (at, event, payload, prev))
            if seq != n or prev != before or digest != hashlib.sha256(raw).hexdigest():
                bad.append(seq)
            before = digest
        if bad:
            out[log] = min(bad)
    return out


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_chains_in_runs(spark, monkeypatch, run):
    monkeypatch.setattr(ops, "RUN", run)
    rng = random.Random(run)
    logs = spark.createDataFrame([(log, n, f"t{n}", "e", "p") for log in range(12) for n in range(rng.randint(1, 14))], "log long, seq long, at string, event string, payload_sha256 string")
    rows = [tuple(r) for r in ops.chain_entries(logs, "log").collect()]
    kind = "log long, seq long, at string, event string, payload_sha256 string, prev string, hash string"
    assert ops.broken(spark.createDataFrame(rows, kind), "log").count() == 0
    changed = [list(r) for r in rows]
    for r in changed:
        if rng.random() < 0.1:
            r[3] += "!"
        elif rng.random() < 0.05:
            r[6] = "0" * 64
    kept = [tuple(r) for r in changed if rng.random() > 0.05]
    got = {r["log"]: r["seq"] for r in ops.broken(spark.createDataFrame(kept, kind), "log").collect()}
    assert got == plain_broken(kept)


def test_lines_of_logs_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(ops, "RUN", 2)
    lines = spark.createDataFrame([(log, n, f"{log}-{n}") for log in range(3) for n in (0, 1, 5, 9, 10)], "log int, seq long, line string")
    assert sorted(tuple(r) for r in writers.log_files(lines, "log").collect()) == [(log, k, f"{log}-{n}") for log in range(3) for k, n in enumerate((0, 1, 5, 9, 10))]
