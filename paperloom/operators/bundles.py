"""HL7 v2 to FHIR beyond the patient: encounters, observations, timestamps and the bundle, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.fields import component, field, first_segment, hl7_unescape
from paperloom.sources.segments import once

#: Patient classes, and result states, with the FHIR codes they stand for.
CLASSES = {"I": "IMP", "O": "AMB", "E": "EMER", "P": "PRENC"}
STATES = {"F": "final", "P": "preliminary", "R": "preliminary", "I": "preliminary", "S": "preliminary", "O": "registered", "C": "corrected", "X": "cancelled", "D": "entered-in-error", "W": "entered-in-error"}


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.trim(F.coalesce(value, F.lit(""))))


def _part(value: Column, m: int, d: Column) -> Column:
    """A component without its subcomponents, unescaped; blank if absent."""
    own = component(F.coalesce(value, F.lit("")), m, d["component"])
    return F.coalesce(hl7_unescape(component(own, 1, d["subcomponent"]), d), F.lit(""))


def _identifier(value: Column, otherwise: str) -> Column:
    own = F.left(F.regexp_replace(value, "[^A-Za-z0-9.-]", "-"), F.lit(64))
    return F.when(value == "", otherwise).otherwise(own)


def fhir_datetime(raw: Column) -> Column:
    """(value, lossy) of a timestamp; null if it is none. A time without an offset keeps the date only, and is lossy."""
    offset = lambda t: F.regexp_extract(t, r"^[0-9]+[.0-9]*([+-][0-9]{4}|Z)$", 1)
    return once(F.trim(raw), lambda t: once(F.struct(F.regexp_extract(t, "^[0-9]*", 0).alias("digits"), offset(t).alias("offset")), lambda x: _datetime(x["digits"], x["offset"])))


def _datetime(digits: Column, offset: Column) -> Column:
    n = F.length(digits)
    year, month, day = F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    good = (n >= 4) & ((n < 6) | month.try_cast("int").between(1, 12)) & ((n < 8) | day.try_cast("int").between(1, 31))
    date = F.concat_ws("-", year, F.when(n >= 6, month), F.when(n >= 8, day))
    hour, minute, second = (F.when(n >= k + 1, F.substring(digits, k, 2)).otherwise("00") for k in (9, 11, 13))
    zone = F.when(offset == "Z", offset).otherwise(F.concat(F.left(offset, F.lit(3)), F.lit(":"), F.right(offset, F.lit(2))))
    timed = n >= 10
    fits = ~timed | ((hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59) & (second.try_cast("int") <= 59))
    value = F.when(timed & (offset != ""), F.concat(date, F.lit("T"), F.concat_ws(":", hour, minute, second), zone)).otherwise(date)
    return F.when(good & fits, F.struct(value.alias("value"), (timed & (offset == "")).alias("lossy")))


def _filled(*values: Column) -> Column:
    return F.coalesce(*[once(v, lambda x: F.when(x != "", x)) for v in values])


def hl7_encounter(segments: Column, d: Column) -> Column:
    """(id, status, class, start, end) of the first PV1; null without one or for a class that FHIR doesn't have."""
    return once(F.struct(F.get(segments, 0).alias("msh"), first_segment(segments, "PV1").alias("pv1")), lambda x: _encounter(segments, x["msh"], x["pv1"], d))


def _encounter(segments: Column, msh: Column, pv1: Column, d: Column) -> Column:
    trigger = component(field(msh, 9), 2, d["component"])
    status = lambda trigger: F.when(trigger == "A03", "finished").when(trigger.isin("A11", "A13"), "cancelled").when(trigger.isin("A05", "A14", "A15"), "planned").otherwise("in-progress")
    own = once(_part(field(pv1, 19), 1, d), lambda visit: F.when(visit == "", F.concat(F.coalesce(field(msh, 10), F.lit("")), F.lit("-enc"))).otherwise(_identifier(visit, "enc")))
    kind = _mapped(field(pv1, 2), CLASSES)
    start = fhir_datetime(_filled(field(pv1, 44), field(first_segment(segments, "EVN"), 2)))
    end = fhir_datetime(_filled(field(pv1, 45)))
    return F.when(kind.isNotNull(), F.struct(own.alias("id"), once(trigger, status).alias("status"), kind.alias("class"), start["value"].alias("start"), end["value"].alias("end")))


def hl7_observations(segments: Column, d: Column) -> Column:
    """Each OBX with a code: (id, status, system, code, display, value, unit, effective). Only NM has a value; every one
    without a time of its own takes that of the first OBR."""
    results = F.filter(segments, lambda s: s["tag"] == "OBX")
    shared = F.struct(F.coalesce(field(F.get(segments, 0), 10), F.lit("")).alias("control"), field(first_segment(segments, "OBR"), 7).alias("time"))
    return once(shared, lambda x: _observations(results, x["control"], x["time"], d))


def _observations(results: Column, control: Column, time: Column, d: Column) -> Column:
    def read(s: Column) -> Column:
        code, text, system = (_part(field(s, 3), m, d) for m in (1, 2, 3))
        number = F.when(F.trim(F.coalesce(field(s, 2), F.lit(""))) == "NM", F.trim(field(s, 5)).try_cast("double"))
        return F.struct(s.alias("s"), code.alias("code"), text.alias("text"), system.alias("system"), once(number, lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)).alias("number"))

    def one(x: Column) -> Column:
        s, code, text, system, number = (x[n] for n in ("s", "code", "text", "system", "number"))
        effective = fhir_datetime(_filled(field(s, 14), time))
        return F.struct(
            F.concat(control, F.lit("-"), _identifier(F.coalesce(field(s, 1), F.lit("")), "obx")).alias("id"), F.coalesce(_mapped(field(s, 11), STATES), F.lit("unknown")).alias("status"),
            F.when(system == "", "urn:hl7v2:local").otherwise(F.concat(F.lit("urn:hl7v2:"), system)).alias("system"), code.alias("code"), F.nullif(text, F.lit("")).alias("display"), number.alias("value"),
            F.when(number.isNotNull(), _part(field(s, 6), 1, d)).alias("unit"), effective["value"].alias("effective"),
        )

    return F.transform(F.filter(F.transform(results, read), lambda x: x["code"] != ""), one)
