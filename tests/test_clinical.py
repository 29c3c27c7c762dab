"""FHIR resources that lose nothing: digits, members without a column, refusals."""

import json

from pyspark.sql import functions as F

from paperloom.functions.exact_json import exact_json, json_text
from paperloom.operators import fhir, writers


def test_json_with_exact_numbers(spark):
    texts = [
        '{"b":5.40,"a":[1e3,-0.0,{"x":"1.0 \\" 2.0 \\\\","y":true}],"c":null,"d":"\\\\"}', '{"n":12345678901234567890.1234500}', "[]", '"1.50"', "1.50",
        "", "{", None, '{"a":"﷐"}', '{"a":1', json.dumps({f"k{i}": ["x" * i, i / 4, '"\\' * i] for i in range(300)}),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", json_text(exact_json(F.col("t"))).alias("x")).collect()
    got = {r["k"]: r["x"] for r in rows}
    assert got[0] == '{"a":[1e3,-0.0,{"x":"1.0 \\" 2.0 \\\\","y":true}],"b":5.40,"c":null,"d":"\\\\"}'
    assert [got[k] for k in (1, 2, 3, 4)] == [texts[k] for k in (1, 2, 3, 4)]
    assert [got[k] for k in (5, 6, 7, 8, 9)] == [None] * 5
    assert json.loads(got[10]) == json.loads(texts[10])


def test_members_without_a_column(spark):
    texts = [
        ("Patient", '{"resourceType":"Patient","id":"p1","meta":{"versionId":"3"},"extension":[{"url":"urn:example:flag","valueBoolean":true}]}'),
        ("Organization", '{"name":"Acme","resourceType":"Organization","telecom":[{"value":"555","system":"phone"}]}'),
        ("Encounter", '{"resourceType":"Encounter","class":{"code":"AMB"},"serviceProvider":{"display":"Ward 3"}}'),
        ("bare", '{"resourceType":"Patient","id":"p1"}'),
    ]
    found = fhir.resources(spark.createDataFrame(texts, "k string, t string"), F.col("t"), "k")
    rest = {r["k"]: r["x"] for r in found.select("k", fhir.unmodelled(F.col("whole")).alias("x")).collect()}
    assert rest == {
        "Patient": '{"extension":[{"url":"urn:example:flag","valueBoolean":true}],"meta":{"versionId":"3"}}',
        "Organization": '{"telecom":[{"system":"phone","value":"555"}]}', "Encounter": '{"serviceProvider":{"display":"Ward 3"}}', "bare": None,
    }
    again = {r["k"]: r["x"] for r in found.select("k", fhir.resource_json(F.col("whole")).alias("x")).collect()}
    assert all(json.loads(again[k]) == json.loads(t) for k, t in texts)


def test_quantities_differ_by_their_digits(spark):
    texts = [(x, '{"resourceType":"Observation","valueQuantity":{"value":%s}}' % x) for x in ("5.40", "5.4", "5", "1e2")]
    found = fhir.resources(spark.createDataFrame(texts, "k string, t string"), F.col("t"), "k")
    assert all(r["k"] == r["v"] for r in found.select("k", F.col("r.valueQuantity.digits").alias("v")).collect())


def test_what_xml_cannot_hold(spark):
    xml = '<Observation xmlns="http://hl7.org/fhir"><status value="final"/><valueQuantity><value value="72.50"/><unit value="kg"/></valueQuantity></Observation>'
    read = spark.createDataFrame([(xml,)], "x string").select(writers.read_resource_xml(F.col("x")).alias("r"))
    strange = read.withColumn("r", F.col("r").withField("valueQuantity", F.col("r.valueQuantity").withField("unit", F.lit("k\x01"))))
    error = writers.resource_error(F.col("r"))
    assert read.select(error).first()[0] is None and "XML" in strange.select(error).first()[0]
    assert '<value value="72.50"/>' in read.select(writers.observation_again(F.col("r"))).first()[0]
