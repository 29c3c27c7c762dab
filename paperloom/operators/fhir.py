"""FHIR resources: bundles of HL7 messages, reading, counts, rules, XML and removal of identifying elements."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.exact_json import digits, exact_json, json_text
from paperloom.functions.fields import component, field, first_segment, hl7_unescape, repetitions, xml_escape
from paperloom.operators.bundles import CLASSES, STATES, fhir_datetime, hl7_encounter, hl7_observations
from paperloom.sources.segments import bound, once

#: The resource types, in the order they are counted; class names; genders; the namespace.
TYPES = ["Patient", "Observation", "Encounter", "Organization"]
CLASS_NAMES = {"IMP": "inpatient encounter", "AMB": "ambulatory", "EMER": "emergency", "PRENC": "pre-admission"}
GENDERS = {"M": "male", "F": "female", "O": "other", "U": "unknown"}
NAMESPACE = "http://hl7.org/fhir"


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def _filled(value: Column) -> Column:
    return once(value, lambda x: F.when(x != "", x))


def _own(value: Column, m: int, d: Column) -> Column:
    """A component, without its subcomponents and unescaped; blank if absent."""
    return F.coalesce(hl7_unescape(component(component(value, m, d["component"]), 1, d["subcomponent"]), d), F.lit(""))


def _identifier(value: Column, otherwise: Column) -> Column:
    return once(F.left(F.regexp_replace(value, "[^A-Za-z0-9.-]", "-"), F.lit(64)), lambda own: F.when(own.rlike("^-*$"), otherwise).otherwise(own))


def patient(segments: Column, d: Column) -> Column:
    """(birthDate, gender, id, identifier, name, resourceType) of the first PID; null without one. Dates and genders that
    FHIR doesn't have are dropped."""
    return once(F.struct(first_segment(segments, "PID").alias("pid"), field(F.get(segments, 0), 10).alias("control")), lambda x: F.when(x["pid"].isNotNull(), _patient(x["pid"], x["control"], d)))


def _patient(pid: Column, control: Column, d: Column) -> Column:
    blank = F.lit("")
    found = F.filter(F.transform(repetitions(F.coalesce(field(pid, 3), blank), d["repeat"]), lambda x: F.struct(_own(x, 1, d).alias("value"), _filled(_own(x, 4, d)).alias("authority"))), lambda x: x["value"] != "")
    identifiers = lambda numbers: F.transform(numbers, lambda x: F.struct(F.concat(F.lit("urn:hl7v2:"), x["authority"]).alias("system"), x["value"].alias("value")))
    names = F.transform(repetitions(F.coalesce(field(pid, 5), blank), d["repeat"]), lambda x: F.struct(_filled(_own(x, 1, d)).alias("family"), _own(x, 2, d).alias("given")))
    names = F.transform(F.filter(names, lambda x: x["family"].isNotNull() | (x["given"] != "")), lambda x: F.struct(x["family"].alias("family"), F.when(x["given"] != "", F.array(x["given"])).alias("given")))
    made = F.concat(_identifier(F.coalesce(control, blank), F.lit("msg")), F.lit("-patient"))
    own = lambda first: F.when(first.isNull(), made).otherwise(_identifier(first, F.lit("patient")))
    born = once(
        F.regexp_extract(F.coalesce(field(pid, 7), blank), "^[0-9]*", 0),
        lambda digits: F.when((F.length(digits) == 4) | (F.length(digits) == 6) | (F.length(digits) >= 8), fhir_datetime(F.left(digits, F.lit(8)))["value"]),
    )
    some = lambda values: F.when(F.size(values) > 0, values)
    return once(found, lambda numbers: F.struct(
        born.alias("birthDate"), _lookup(F.trim(F.coalesce(field(pid, 8), blank)), GENDERS).alias("gender"), own(F.get(numbers, 0)["value"]).alias("id"), some(identifiers(numbers)).alias("identifier"),
        once(names, some).alias("name"), F.lit("Patient").alias("resourceType"),
    ))


def bundles(messages: DataFrame, segments: Column, d: Column, *keys: str) -> DataFrame:
    """(keys, error, bundle): the JSON of an ADT or ORU message's bundle, names in order; an encounter's or observation's
    subject is the patient. Other messages have an error and no bundle."""
    rows = bound(messages.select(*keys, segments.alias("__s"), d.alias("__d")), __p=patient(F.col("__s"), F.col("__d")))
    kind = F.coalesce(component(field(F.get("__s", 0), 9), 1, F.col("__d.component")), F.lit(""))
    rows = bound(rows, __kind=kind)
    rows = bound(rows, __e=F.when(F.col("__kind") == "ADT", hl7_encounter(F.col("__s"), F.col("__d"))), __o=F.when(F.col("__kind") == "ORU", hl7_observations(F.col("__s"), F.col("__d"))))
    subject = F.when(F.col("__p").isNotNull(), F.struct(F.concat(F.lit("Patient/"), F.col("__p.id")).alias("reference")))
    e = F.col("__e")
    period = F.when(e["start"].isNotNull() | e["end"].isNotNull(), F.struct(e["end"].alias("end"), e["start"].alias("start")))
    coded = F.struct(e["class"].alias("code"), _lookup(e["class"], CLASS_NAMES).alias("display"), F.lit("http://terminology.hl7.org/CodeSystem/v3-ActCode").alias("system"))
    state = F.call_function("replace", e["status"], F.lit("-"), F.lit(""))  # as JSON spells it; XML keeps the dash
    encounter = F.when(e.isNotNull(), F.struct(coded.alias("class"), e["id"].alias("id"), period.alias("period"), F.lit("Encounter").alias("resourceType"), state.alias("status"), subject.alias("subject")))

    def observation(o: Column) -> Column:
        coding = F.struct(o["code"].alias("code"), o["display"].alias("display"), o["system"].alias("system"))
        quantity = F.when(o["value"].isNotNull(), F.struct(o["unit"].alias("unit"), o["value"].alias("value")))
        return F.struct(
            F.struct(F.array(coding).alias("coding")).alias("code"), o["effective"].alias("effectiveDateTime"), o["id"].alias("id"), F.lit("Observation").alias("resourceType"),
            F.call_function("replace", o["status"], F.lit("-"), F.lit("")).alias("status"), subject.alias("subject"), quantity.alias("valueQuantity"),
        )

    # resources of different types have no common row type, so each is text before the bundle is put together
    entry = lambda text: F.concat(F.lit('{"resource":'), text, F.lit("}"))
    entries = F.concat(F.array(entry(F.to_json("__p")), entry(F.to_json(encounter))), F.coalesce(F.transform("__o", lambda o: entry(F.to_json(observation(o)))), F.expr("cast(array() as array<string>)")))
    bundle = F.concat(F.lit('{"entry":['), F.array_join(F.array_compact(entries), ","), F.lit('],"resourceType":"Bundle","type":"collection"}'))
    error = F.when(F.col("__s").isNull(), "not an HL7 message").when(~F.col("__kind").isin("ADT", "ORU"), F.concat(F.lit("unsupported HL7 message type `"), F.col("__kind"), F.lit("`")))
    return rows.select(*keys, error.alias("error"), F.when(error.isNull(), bundle).alias("bundle"))


def conversion_notes(messages: DataFrame, segments: Column, d: Column, key: str) -> DataFrame:
    """(key, place, note): what a conversion to FHIR leaves out or changes: identifiers and codes that are missing, genders, classes
    and states that FHIR doesn't have, timestamps that are none or lack an offset, values that are no numbers."""
    rows = bound(messages.select(key, segments.alias("__s"), d.alias("__d")), __kind=F.coalesce(component(field(F.get("__s", 0), 9), 1, F.col("__d.component")), F.lit("")))
    s, own, blank = F.col("__s"), F.col("__d"), F.lit("")
    pid, pv1 = first_segment(s, "PID"), first_segment(s, "PV1")
    quoted = lambda x, rest: F.concat(F.lit("`"), x, F.lit(f"` {rest}"))
    told = lambda place, note: F.struct((F.lit(place) if isinstance(place, str) else place).alias("place"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    of = lambda seg, n: F.trim(F.coalesce(field(seg, n), blank))

    def time(place, raw: Column) -> Column:
        t = fhir_datetime(raw)
        return F.when(raw != "", F.when(t.isNull(), told(place, quoted(raw, "is no timestamp and is left out"))).when(t["lossy"], told(place, quoted(raw, "has no offset, so only its date is kept"))))

    first = F.get(F.filter(F.transform(repetitions(F.coalesce(field(pid, 3), blank), own["repeat"]), lambda x: _own(x, 1, own)), lambda x: x != ""), 0)
    notes = [
        F.when(pid.isNotNull() & first.isNull(), told("PID-3", "no identifier; the patient's id is made up")),
        F.when((of(pid, 7) != "") & ~of(pid, 7).rlike("^[0-9]{4}([0-9]{2}){0,2}"), told("PID-7", quoted(of(pid, 7), "is no date and is left out"))),
        F.when((of(pid, 8) != "") & _lookup(of(pid, 8), GENDERS).isNull(), told("PID-8", quoted(of(pid, 8), "is no gender that FHIR has and is left out"))),
        F.when((F.col("__kind") == "ADT") & pv1.isNotNull() & _lookup(of(pv1, 2), CLASSES).isNull(), told("PV1-2", quoted(of(pv1, 2), "is no class that FHIR has; there is no encounter"))),
        F.when((F.col("__kind") == "ADT") & _lookup(of(pv1, 2), CLASSES).isNotNull(), time("PV1-44", F.coalesce(F.nullif(of(pv1, 44), blank), of(first_segment(s, "EVN"), 2)))),
        F.when((F.col("__kind") == "ADT") & _lookup(of(pv1, 2), CLASSES).isNotNull(), time("PV1-45", of(pv1, 45))),
    ]

    def result(x: Column) -> Column:
        at = lambda n: F.concat(F.lit("OBX["), of(x, 1), F.lit(f"]-{n}"))
        kind, value, state = of(x, 2), of(x, 5), of(x, 11)
        found = [
            F.when((state != "") & _lookup(state, STATES).isNull(), told(at(11), quoted(state, "is no known state"))),
            F.when((kind == "NM") & (value != "") & value.try_cast("double").isNull(), told(at(5), quoted(value, "is no number and is left out"))),
            F.when(~kind.isin("", "NM") & (value != ""), told(at(5), quoted(kind, "values are left out"))),
            time(at(14), F.coalesce(F.nullif(of(x, 14), blank), of(first_segment(s, "OBR"), 7))),
        ]
        nameless = _own(F.coalesce(field(x, 3), blank), 1, own) == ""
        return F.when(nameless, F.array(told(at(3), "no code; the result is left out"))).otherwise(F.array_compact(F.array(*found)))

    results = F.flatten(F.transform(F.filter(s, lambda x: x["tag"] == "OBX"), result))
    every = F.when(F.col("__kind") == "ORU", F.concat(F.array_compact(F.array(*notes)), results)).otherwise(F.array_compact(F.array(*notes)))
    return rows.where(s.isNotNull()).select(key, F.explode(every).alias("x")).select(key, "x.*")


#: What is read of a resource, whatever its type.
RESOURCE = (
    "resourceType string, id string, status string, gender string, birthDate string, effectiveDateTime string, identifier array<struct<system string,value string>>,"
    "code struct<coding array<struct<system string,code string,display string>>,text string>, subject struct<reference string,display string>, valueQuantity struct<value string,unit string,system string,code string>,"
    "period struct<start string,end string>"
)


#: Members of a resource that are read into columns; all others are its remainder.
MODELLED = {
    "Patient": ["birthDate", "gender", "id", "identifier", "name", "resourceType"], "Observation": ["code", "effectiveDateTime", "id", "resourceType", "status", "subject", "valueQuantity"],
    "Encounter": ["class", "id", "period", "resourceType", "status", "subject"], "Organization": ["id", "identifier", "name", "resourceType"],
}


def resources(texts: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, n, r, whole): every resource of bundles or single resources, numbered from 0: what is modelled as columns (a quantity's
    digits beside its value), and the whole as VARIANT with exact numbers. A text that isn't JSON gives none."""
    rows = bound(texts.select(*keys, text.alias("__t")), __v=exact_json(F.col("__t")))
    return bound(rows.select(*keys, F.posexplode(wholes(F.col("__v"))).alias("n", "whole")), r=modelled(F.col("whole"))).select(*keys, "n", "r", "whole")


def wholes(v: Column) -> Column:
    """The resources of a bundle, or the single one of another text, as VARIANTs."""
    kind = F.try_variant_get(v, "$.resourceType", "string")
    inside = F.transform(F.try_variant_get(v, "$.entry", "array<variant>"), lambda e: F.try_variant_get(e, "$.resource", "variant"))
    return F.filter(F.when(kind == "Bundle", inside).when(kind.isNotNull(), F.array(v)), lambda r: r.isNotNull())


def modelled(whole: Column) -> Column:
    """What is modelled of a resource, as columns; a quantity's ``value`` is a number, its ``digits`` are what was written."""
    quantity = lambda q, own: q.withField("value", own.try_cast("double")).withField("digits", own)
    whole_quantity = lambda q: F.when(q.isNotNull(), once(digits(q["value"]), lambda own: quantity(q, own)))
    return once(F.from_json(F.to_json(whole), RESOURCE), lambda r: r.withField("valueQuantity", whole_quantity(r["valueQuantity"])))


def unmodelled(whole: Column) -> Column:
    """The members of a resource that no column has, as JSON, names in order; null if there are none."""
    members = F.from_json(F.to_json(whole), "map<string, variant>")
    kind = F.try_variant_get(whole, "$.resourceType", "string")
    known = F.create_map(*[x for k, names in MODELLED.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    rest = F.map_filter(members, lambda name, _: ~F.coalesce(F.array_contains(F.try_element_at(known, kind), name), F.lit(False)))
    return F.when(F.size(rest) > 0, json_text(F.to_variant_object(rest)))


def resource_json(whole: Column) -> Column:
    """A resource written again, nothing lost: names in order, unmodelled members and the digits of numbers as they were read."""
    return json_text(whole)


def bundle_errors(texts: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, error): why a text is refused as a whole, or null: it isn't JSON, has no resourceType, or is a bundle of which an entry's
    resource, the first one that does so, has none or one that isn't known, or is a result without a status."""
    rows = bound(texts.select(*keys, text.alias("__t")), __v=exact_json(F.col("__t")))
    v = F.col("__v")
    of = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    quoted = lambda x: F.concat(F.lit("unsupported resource type `"), x, F.lit("`"))

    def wrong(x: Column) -> Column:
        kind = of(x, "resourceType")
        return (
            F.when(kind.isNull(), "missing `resourceType`").when(~kind.isin(TYPES), quoted(kind))
            .when((kind == "Observation") & of(x, "status").isNull(), "missing mandatory element `status`")
        )

    inside = F.transform(F.try_variant_get(v, "$.entry", "array<variant>"), lambda e: F.try_variant_get(e, "$.resource", "variant"))
    first = F.get(F.array_compact(F.transform(F.filter(inside, lambda x: x.isNotNull()), wrong)), 0)
    error = F.when(v.isNull(), "not JSON").when(of(v, "resourceType") == "Bundle", first).otherwise(wrong(v))
    return rows.select(*keys, error.alias("error"))


def counts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, n): resources of each known type, zeros included."""
    wide = found.groupBy(*keys).agg(*[F.count(F.when(F.col("r.resourceType") == t, True)).alias(t) for t in TYPES])
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).alias("n")) for t in TYPES])).alias("x")).select(*keys, "x.*")


def issues(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, rule, path, message): a verified result needs a value or a time; a period can't end before it starts
    (days only are compared), and one that is finished needs its end."""
    return found.select(*keys, "n", F.explode(issues_found(F.col("r"))).alias("i")).select(*keys, "n", "i.*")


def issues_found(r: Column) -> Column:
    """The issues (rule, path, message) of a resource, as one array."""
    start, end = (F.when(r["period"][x].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(r["period"][x], "yyyy-MM-dd")) for x in ("start", "end"))
    issue = lambda rule, path, message: F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path"), message.alias("message"))
    result = (r["resourceType"] == "Observation") & r["status"].isin("final", "amended", "corrected") & r["valueQuantity"].isNull() & r["effectiveDateTime"].isNull()
    visit = r["resourceType"] == "Encounter"
    backward = F.concat(F.lit("period end `"), r["period"]["end"], F.lit("` is before period start `"), r["period"]["start"], F.lit("`"))
    rules = [
        F.when(result, issue("obs-7", "/valueQuantity", F.concat(F.lit("a `"), r["status"], F.lit("` observation must have a value or an effective time")))),
        F.when(visit & (end < start), issue("enc-3", "/period/end", backward)),
        F.when(visit & (r["status"] == "finished") & r["period"]["end"].isNull(), issue("enc-1", "/period/end", F.lit("a `finished` encounter must have a period end"))),
    ]
    return F.array_compact(F.array(*rules))


def _xml_value(name: str, value: Column) -> Column:
    """An element with its value, or nothing if that is null."""
    return F.coalesce(F.concat(F.lit(f'<{name} value="'), xml_escape(value), F.lit('"/>')), F.lit(""))


def _xml_each(values: Column, one: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_join(F.transform(values, one), ""), F.lit(""))


def patient_xml(p: Column) -> Column:
    """The XML of a patient as ``patient`` gives it."""
    identifiers = _xml_each(p["identifier"], lambda x: F.concat(F.lit("<identifier>"), _xml_value("system", x["system"]), _xml_value("value", x["value"]), F.lit("</identifier>")))
    names = _xml_each(p["name"], lambda x: F.concat(F.lit("<name>"), _xml_value("family", x["family"]), _xml_each(x["given"], lambda g: _xml_value("given", g)), F.lit("</name>")))
    head = f'<?xml version="1.0" encoding="UTF-8"?><Patient xmlns="{NAMESPACE}">'
    return F.concat(F.lit(head), _xml_value("id", p["id"]), identifiers, names, _xml_value("gender", p["gender"]), _xml_value("birthDate", p["birthDate"]), F.lit("</Patient>"))


#: What Safe Harbor asks of a resource (path, action, prefix), in the order it is applied.
SAFE_HARBOR = [
    ("Patient.id", "pseudonym", "PATIENT-"), ("Patient.identifier.value", "pseudonym", "ID-"), ("Patient.name", "remove", ""), ("Patient.telecom", "remove", ""), ("Patient.address", "remove", ""),
    ("Patient.photo", "remove", ""), ("Patient.contact", "remove", ""), ("Patient.birthDate", "year", ""), ("Patient.deceasedDateTime", "year", ""), ("Patient.generalPractitioner", "remove", ""),
    ("Patient.managingOrganization", "remove", ""), ("Observation.effectiveDateTime", "year", ""), ("Observation.issued", "year", ""), ("Encounter.period.start", "year", ""), ("Encounter.period.end", "year", ""),
    ("*.text", "remove", ""), ("*.note", "remove", ""), ("Observation.valueString", "remove", ""), ("*.subject.display", "remove", ""), ("*.performer.display", "remove", ""),
    ("*.participant.individual", "remove", ""), ("*.recorder.display", "remove", ""), ("*.author.display", "remove", ""), ("*.subject.reference", "patient", "PATIENT-"), ("Bundle.entry.fullUrl", "patient", "PATIENT-"),
]


def _places(value, names: list[str]):
    """The objects that hold the last name of a path; lists on the way stand for their members."""
    if isinstance(value, list):
        for x in value:
            yield from _places(x, names)
    elif isinstance(value, dict) and names[0] in value:
        if len(names) == 1:
            yield value
        else:
            yield from _places(value[names[0]], names[1:])


def redacted(rules: list[tuple[str, str, str]] = SAFE_HARBOR) -> Callable[[Column], Column]:
    """A function of JSON texts: (json, changes) with every rule's elements removed or rewritten, names in order.

    Pseudonyms are numbered in a document's own order. A change is (resource, path, count), never a value. Text that
    isn't JSON, or an object without resourceType, gives null: nothing unknown passes.
    """

    def document(text):
        try:
            root = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        if not isinstance(root, dict) or not isinstance(root.get("resourceType"), str):
            return None
        numbers: dict[str, dict[str, int]] = {}
        changes = []

        def pseudonym(prefix: str, value: str) -> str:
            known = numbers.setdefault(prefix, {})
            return f"{prefix}{known.setdefault(value, len(known) + 1)}"

        def rewritten(value, action: str, prefix: str):
            """(new value, how many strings changed)"""
            if isinstance(value, list):
                done = [rewritten(x, action, prefix) for x in value]
                return [x for x, _ in done], sum(n for _, n in done)
            if not isinstance(value, str):
                return value, 0
            new = value
            if action == "pseudonym":
                new = pseudonym(prefix, value)
            elif action == "year":
                new = value[:4]
            else:
                base, found, rest = value.partition("Patient/")
                own = rest.split("/")[0]
                if found and own and (not base or base.endswith("/")):
                    new = f"{base}Patient/{pseudonym(prefix, own)}"
            return new, int(new != value)

        def resource(x) -> None:
            kind = x.get("resourceType") if isinstance(x, dict) else None
            if not isinstance(kind, str):
                return
            for path, action, prefix in rules:
                head, *names = path.split(".")
                if head not in ("*", kind):
                    continue
                count = 0
                for place in list(_places(x, names)):
                    if action == "remove":
                        del place[names[-1]]
                        count += 1
                    else:
                        place[names[-1]], n = rewritten(place[names[-1]], action, prefix)
                        count += n
                if count:
                    changes.append({"resource": kind, "path": path, "count": count})
            entries, contained = x.get("entry"), x.get("contained")
            for inner in [*[e.get("resource") for e in entries if isinstance(e, dict)]] if isinstance(entries, list) else []:
                resource(inner)
            for inner in contained if isinstance(contained, list) else []:
                resource(inner)

        resource(root)
        return {"json": json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False), "changes": changes}

    @F.pandas_udf("json string, changes array<struct<resource:string,path:string,count:long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [document(t) or {"json": None, "changes": None} for t in texts]
        return pd.DataFrame({"json": pd.Series([x["json"] for x in done], dtype=object), "changes": pd.Series([x["changes"] for x in done], dtype=object)})

    return run
