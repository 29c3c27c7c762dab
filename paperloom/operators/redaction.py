"""HL7 v2 de-identification by rules, inside one projection: no shuffle, no state beyond a message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.fields import field
from paperloom.sources.segments import cut

Rule = tuple[str, int, int, str, str]
ACTIONS = ("clear", "replace", "pseudonym", "year")


def _checked(rules: Sequence[Rule]) -> None:
    for segment, n, m, action, _ in rules:
        if segment == "MSH" or n < 1 or m < 0 or action not in ACTIONS:
            raise ValueError(f"no such rule: {segment}-{n}.{m} {action}")


def _pseudonymised(segments: Column, d: Column, rules: Sequence[Rule], prefix: str) -> Column:
    """The distinct values that get a pseudonym with this prefix, in the order in which they are met."""
    own = [r for r in rules if r[3] == "pseudonym" and r[4] == prefix]

    def values(s: Column) -> Column:
        def of(r: Rule) -> Column:
            repeats = cut(F.coalesce(field(s, r[1]), F.lit("")), d["repeat"])
            met = F.transform(repeats, lambda x: F.get(cut(x, d["component"]), r[2] - 1)) if r[2] else repeats
            return F.when(s["tag"] == r[0], met).otherwise(F.expr("cast(array() as array<string>)"))

        return F.concat(*[of(r) for r in own])

    return F.array_distinct(F.filter(F.flatten(F.transform(segments, values)), lambda x: x.isNotNull() & (x != "")))


def _rounds(rules: Sequence[Rule]) -> list[dict[str, Rule]]:
    """Rules by place; a place that has several of them is rewritten once for each, in their order."""
    rounds: list[dict[str, Rule]] = []
    for r in rules:
        place = f"{r[0]}-{r[1]}"
        n = sum(place in x for x in rounds)
        if n == len(rounds):
            rounds.append({})
        rounds[n][place] = r
    return rounds


def hl7_redacted(segments: Column, d: Column, rules: Sequence[Rule]) -> Column:
    """(message, changes) of a scanned message; changes have index, segment, field and component, never a value.

    Rules are (segment, field, component or 0, action, text). OBX-5 stays where OBX-2 is NM or SN. Empty repetitions and
    components stay empty. Pseudonyms number a message's distinct values for each prefix, as the message has them.
    Null for messages that can't be scanned or don't start with MSH. Rules of MSH and of a field 0 raise ValueError.
    """
    _checked(rules)
    names = {p: _pseudonymised(segments, d, rules, p) for p in dict.fromkeys(r[4] for r in rules if r[3] == "pseudonym")}
    rounds = _rounds(rules)

    def act(r: Column, value: Column) -> Column:
        out = F.when(r["action"] == "year", F.left(value, F.lit(4))).when(r["action"] == "replace", r["text"])
        for prefix, met in names.items():
            out = out.when((r["action"] == "pseudonym") & (r["text"] == prefix), F.concat(F.lit(prefix), F.array_position(met, value).cast("string")))
        return out.otherwise("")

    def rewritten(value: Column, r: Column) -> Column:
        def parts(x: Column) -> Column:
            own = F.transform(cut(x, d["component"]), lambda p, k: F.when((k == r["component"] - 1) & (p != ""), act(r, p)).otherwise(p))
            return F.call_function("array_join", own, d["component"])

        def one(x: Column) -> Column:
            return F.when(r["component"] > 0, parts(x)).when(x == "", x).otherwise(act(r, x))

        return F.call_function("array_join", F.transform(cut(value, d["repeat"]), one), d["repeat"])

    def touched(value: Column, r: Column) -> Column:
        return F.exists(cut(value, d["repeat"]), lambda x: F.coalesce(F.when(r["component"] > 0, F.get(cut(x, d["component"]), r["component"] - 1)).otherwise(x), F.lit("")) != "")

    def table(own: dict[str, Rule]) -> Column:
        return F.create_map(*[c for place, r in own.items() for c in (F.lit(place), F.struct(F.lit(r[2]).alias("component"), F.lit(r[3]).alias("action"), F.lit(r[4]).alias("text")))])

    def slots(s: Column) -> Column:
        """Each field's new value and the components of the rules that changed it."""
        start = F.transform(s["fields"], lambda v: F.struct(v.alias("value"), F.expr("cast(array() as array<int>)").alias("by")))
        kept = (s["tag"] == "OBX") & F.coalesce(field(s, 2).isin("NM", "SN"), F.lit(False))

        def step(rules_here: Column):
            def one(x: Column, i: Column) -> Column:
                r = F.try_element_at(rules_here, F.concat(s["tag"], F.lit("-"), (i + 1).cast("string")))
                hit = r.isNotNull() & ~(kept & (i == 4)) & touched(x["value"], r)
                new = F.struct(rewritten(x["value"], r).alias("value"), F.concat(x["by"], F.array(r["component"])).alias("by"))
                return F.when(hit, new).otherwise(x)

            return one

        for own in rounds:
            start = F.transform(start, step(table(own)))
        return F.struct(s["idx"].alias("idx"), s["tag"].alias("tag"), start.alias("slots"))

    def line(s: Column) -> Column:
        values = F.transform(s["slots"], lambda x: x["value"])
        joined = F.call_function("array_join", values, d["field"])
        header = F.concat(F.get(values, 0), F.call_function("array_join", F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), d["field"]))
        return F.concat(s["tag"], F.when(s["tag"] == "MSH", header).otherwise(F.concat(d["field"], joined)), F.lit("\r"))

    def changed(s: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            return F.transform(x["by"], lambda m: F.struct(s["idx"].alias("idx"), s["tag"].alias("segment"), (i + 1).alias("field"), F.when(m > 0, m).alias("component")))

        return F.flatten(F.transform(s["slots"], place))

    new = F.transform(segments, slots)
    out = F.struct(F.array_join(F.transform(new, line), "").alias("message"), F.flatten(F.transform(new, changed)).alias("changes"))
    return F.when(F.get(segments, 0)["tag"] == "MSH", out)
