"""The streaming forms over files that arrive one by one."""

import datetime as dt

from paperloom.operators import messages as ops
from paperloom.streaming import audit
from paperloom.streaming import messages as stream

SCHEMA = "id long, at timestamp, message string"


def run(spark, path, transform, name):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    at = dt.datetime(2026, 1, 1, 12)
    first = [(1, at, "MSH|^~\\&|A\rPID|1\r"), (2, at, "ISA*"), (1, at, "MSH|^~\\&|A\rPID|1\r")]
    later = [(1, at, "MSH|^~\\&|A\rPID|1\r"), (3, at + dt.timedelta(hours=5), None)]
    for rows in (first, later):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    tags = [(r["id"], r["tag"]) for r in run(spark, path, stream.segments, "s")]
    assert sorted(tags) == sorted([(1, "MSH"), (1, "PID")] * 3)
    assert sorted(r["id"] for r in run(spark, path, lambda x: stream.first_arrivals(x, "id", "at"), "f")) == [1, 2, 3]
    counts = {(r["format"], r["n"]) for r in run(spark, path, lambda x: stream.format_counts(x, "at"), "c")}
    assert counts == {("hl7v2", 3), ("x12", 1)}  # the window of the last message is still open


def test_chains_go_on_after_a_restart(spark, tmp_path):
    """Streamed chains equal those of the batch form, over batches of one file and a restart of the stream."""
    path, kind = str(tmp_path / "in"), "log string, k long, at string, event string, payload_sha256 string"
    rows = [(f"log{k % 3}", k, f"t{k}", "é" * (k % 4), "p") for k in range(40)]
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    for low in (0, 17, 29):  # a file each, the stream started anew for each
        spark.createDataFrame(rows[low : {0: 17, 17: 29, 29: 40}[low]], kind).coalesce(1).write.mode("append").parquet(path)
        query = audit.chained(source(), "log", "k").writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    numbered = ops.numbered(spark.createDataFrame(rows, kind), "log", "k")
    want = {tuple(r) for r in ops.chain_entries(numbered.drop("k"), "log").collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{path}-out").collect()} == want and len(want) == 40
    assert ops.broken(spark.read.parquet(f"{path}-out"), "log").count() == 0
