"""EDIFACT orders, invoices and despatch advices as one record, and X12 remittances as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fields import component
from paperloom.sources.segments import bound

#: The message types that are read.
KINDS = ["ORDERS", "INVOIC", "DESADV"]


def _element(segment: Column, n: int) -> Column:
    """Element n, from 0; blank if absent."""
    return F.coalesce(F.get(segment["fields"], n), F.lit(""))


def _part(segment: Column, n: int, m: int) -> Column:
    return F.coalesce(component(_element(segment, n), m + 1, ":"), F.lit(""))


def _last(segments: Column, own, value) -> Column:
    return F.try_element_at(F.transform(F.filter(segments, own), value), F.lit(-1))


def edifact_documents(messages: DataFrame, segments: Column, *keys: str) -> DataFrame:
    """(keys, error, kind, number, date, buyer, amount_due, lines) of each interchange's first message.

    Of repeated headers the last counts. A line is (line, item, quantity), its quantity the last QTY before the next
    line. A message that can't be read has its error and nothing else; a null message has neither.
    """
    rows = bound(messages.select(*keys, segments.alias("__s")), __tags=F.transform("__s", lambda s: s["tag"]))
    first = F.array_position("__tags", "UNH").cast("int")
    rows = bound(rows, __own=F.when(first > 0, F.slice("__s", F.greatest(first, F.lit(1)), F.size("__s"))))
    last = F.array_position(F.transform("__own", lambda s: s["tag"]), "UNT").cast("int")
    rows = bound(rows, __end=last)
    own = F.col("__own")
    rows = bound(rows, __own2=F.when(F.col("__end") > 0, F.slice(own, 1, F.greatest(F.col("__end"), F.lit(0)))))
    own = F.col("__own2")
    n = F.size(own)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(own, i)["tag"] == "LIN")
    rows = bound(rows, __at=at)

    def line(i: Column, k: Column) -> Column:
        after = F.coalesce(F.get("__at", k + 1), n)
        quantity = _last(F.slice(own, i + 2, after - i - 1), lambda s: (s["tag"] == "QTY") & (_part(s, 0, 1) != ""), lambda s: _part(s, 0, 1))
        head = F.get(own, i)
        return F.struct(_element(head, 0).alias("line"), _part(head, 2, 0).alias("item"), quantity.alias("quantity"))

    rows = bound(rows, __lines=F.transform("__at", line))
    kind, declared = _part(F.get("__own", 0), 1, 0), _element(F.try_element_at(own, F.lit(-1)), 0)
    nameless = F.get(F.filter("__lines", lambda x: x["item"] == ""), 0)["line"]
    error = (
        F.when(F.col("__s").isNull(), None)
        .when(F.col("__own").isNull(), "interchange has no UNH")
        .when(~kind.isin(KINDS), F.concat(F.lit("message type `"), kind, F.lit("` is not one that is read")))
        .when(own.isNull(), "message has no UNT trailer")
        .when(~declared.try_cast("int").eqNullSafe(n), F.concat(F.lit("UNT counts "), declared, F.lit(" segments but the message has "), n.cast("string")))
        .when(nameless.isNotNull(), F.concat(F.lit("LIN "), nameless, F.lit(" has no item number")))
    )
    rows = bound(rows, error=error)
    good = F.col("error").isNull() & own.isNotNull()
    values = {
        "kind": kind,
        "number": F.coalesce(_last(own, lambda s: s["tag"] == "BGM", lambda s: _element(s, 1)), F.lit("")),
        "date": F.coalesce(_last(own, lambda s: (s["tag"] == "DTM") & (_part(s, 0, 0) == "137"), lambda s: _part(s, 0, 1)), F.lit("")),
        "buyer": F.nullif(_last(own, lambda s: (s["tag"] == "NAD") & (_element(s, 0) == "BY"), lambda s: _part(s, 1, 0)), F.lit("")),
        "amount_due": _last(own, lambda s: (s["tag"] == "MOA") & (_part(s, 0, 0) == "9"), lambda s: _part(s, 0, 1)),
        "lines": F.col("__lines"),
    }
    return rows.select(*keys, "error", *[F.when(good, v).alias(k) for k, v in values.items()])


def remittance_summary(segments: Column) -> Column:
    """A claim payment as text, one line each for the payment, every claim and every service."""

    def told(s: Column) -> Column:
        e = lambda n: _element(s, n)
        claim = F.concat(F.lit("claim "), e(0), F.lit(" status "), e(1), F.lit(" billed "), e(2), F.lit(" paid "), e(3), F.lit("\n"))
        return F.when(s["tag"] == "BPR", F.concat(F.lit("total payment "), e(1), F.lit("\n"))).when(s["tag"] == "CLP", claim).when(s["tag"] == "SVC", F.concat(F.lit("  service "), e(0), F.lit("\n"))).otherwise("")

    return F.array_join(F.transform(segments, told), "")
