"""Readers, checks, conversion, redaction, comparison and audit chains over columns of messages.

Each operator takes a DataFrame of messages, one a row, and keeps a message's segments nested where it can, so
that nothing is shuffled; windows and joins are partitioned by the message's id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.fields import component, element_kind_ok, field, first_segment
from paperloom.sources.segments import WHITE, bound


def exploded(messages: DataFrame, segments: Column, *keys: str) -> DataFrame:
    """One row for each segment: the keys, idx, tag, fields."""
    return messages.select(*keys, F.explode(segments).alias("s")).select(*keys, "s.idx", "s.tag", "s.fields")


def body(segments: Column) -> Column:
    """The first transaction set, from ST to SE."""
    tags = F.transform(segments, lambda s: s["tag"])
    first = F.array_position(tags, "ST").cast("int")
    rest = F.slice(segments, F.greatest(first, F.lit(1)), F.size(segments))
    last = F.array_position(F.transform(rest, lambda s: s["tag"]), "SE").cast("int")
    return F.when(first > 0, F.slice(rest, 1, F.when(last > 0, last).otherwise(F.size(rest))))


def _pairs(fields: Column, start: int) -> Column:
    """Qualifier and value pairs from a field on; empty values and an odd tail are dropped."""
    n = F.floor((F.size(fields) - start + 1) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    pairs = F.transform(at, lambda k: F.struct(F.get(fields, start - 1 + 2 * k).alias("qualifier"), F.get(fields, start + 2 * k).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def read_850(own: Column) -> Column:
    """A purchase order, from its body: number, date, buyer, lines, ctt."""
    lines = F.transform(
        F.filter(own, lambda s: s["tag"] == "PO1"),
        lambda s: F.struct(*[field(s, n).alias(x) for n, x in ((1, "line"), (2, "quantity"), (3, "unit"), (4, "price"))], _pairs(s["fields"], 6).alias("products")),
    )
    buyer = F.get(F.filter(own, lambda s: (s["tag"] == "N1") & (F.get(s["fields"], 0) == "BY")), 0)
    beg = first_segment(own, "BEG")
    return F.struct(field(beg, 3).alias("number"), field(beg, 5).alias("date"), field(buyer, 2).alias("buyer"), lines.alias("lines"), field(first_segment(own, "CTT"), 1).try_cast("int").alias("ctt"))


def read_810(own: Column) -> Column:
    """An invoice, from its body: number, date, order, total in cents, lines."""
    lines = F.transform(F.filter(own, lambda s: s["tag"] == "IT1"), lambda s: F.struct(*[field(s, n).alias(x) for n, x in ((1, "line"), (2, "quantity"), (3, "unit"), (4, "price"))]))
    big = first_segment(own, "BIG")
    return F.struct(field(big, 2).alias("number"), field(big, 1).alias("date"), field(big, 4).alias("order"), field(first_segment(own, "TDS"), 1).try_cast("decimal(20,0)").alias("total_cents"), lines.alias("lines"))


def _led(segments: Column, tag: str) -> Column:
    """The segments in runs that each start with one of that tag; what stands before the first is left out."""
    at = F.array_compact(F.transform(segments, lambda s, i: F.when(s["tag"] == tag, i + 1)))
    ends = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(segments) + 1))
    return F.when(F.size(at) > 0, F.zip_with(at, ends, lambda low, high: F.slice(segments, low, high - low)))


def shipped_items(messages: DataFrame, segments: Column, key: str) -> DataFrame:
    """(key, item, level, product, quantity) of a ship notice: LIN and SN1 belong to the HL before them."""
    rows = bound(bound(messages.select(key, segments.alias("__s")), __own=body(F.col("__s"))).drop("__s"), __runs=_led(F.col("__own"), "HL"))
    each = rows.select(key, F.posexplode("__runs").alias("n", "run"))
    least = lambda tag, n: F.array_min(F.transform(F.filter("run", lambda s: s["tag"] == tag), lambda s: F.get(s["fields"], n)))
    named = [least(tag, n).alias(x) for tag, n, x in (("HL", 2, "level"), ("LIN", 2, "product"), ("SN1", 1, "quantity"))]
    return each.select(key, (F.col("n") + 1).cast("long").alias("item"), *named).where("level = 'I'")


def edifact_lines(messages: DataFrame, segments: Column, key: str, kind: str = "21") -> DataFrame:
    """(key, line, item, quantity): a quantity belongs to the line item before it."""
    rows = bound(messages.select(key, segments.alias("__s")), __runs=_led(F.col("__s"), "LIN")).select(key, F.explode("__runs").alias("run"))
    line = F.get("run", 0)["fields"]
    stated = F.filter("run", lambda s: (s["tag"] == "QTY") & (component(F.get(s["fields"], 0), 1, ":") == kind))
    quantity = F.array_max(F.transform(stated, lambda s: component(F.get(s["fields"], 0), 2, ":")))
    return rows.select(key, F.get(line, 0).alias("line"), component(F.get(line, 2), 1, ":").alias("item"), quantity.alias("quantity"))


def element_message(fields: Column, tag: Column, position: Column, kind: Column, least: Column, most: Column, mandatory: Column) -> Column:
    """What is wrong with a segment's element by its rule, or null."""
    value = F.get(fields, position - 1)
    size = F.octet_length(value)
    where = F.concat(F.lit("element "), position.cast("string"), F.lit(" of "), tag)
    blank = F.btrim(value, F.lit(WHITE)) == ""
    return (
        F.when(value.isNull(), F.when(mandatory, F.concat(F.lit("missing mandatory "), where)))
        .when(blank, F.when(mandatory, F.concat(F.lit("empty mandatory "), where)))
        .when(size < least, F.concat(where, F.lit(" shorter than "), least.cast("string"), F.lit(": `"), value, F.lit("`")))
        .when(size > most, F.concat(where, F.lit(" longer than "), most.cast("string"), F.lit(": `"), value, F.lit("`")))
        .when(~element_kind_ok(kind, value), F.concat(where, F.lit(" violates type `"), F.initcap(kind), F.lit("`: `"), value, F.lit("`")))
    )


def elements_found(segments: Column, table: str) -> Column:
    """The issues (idx, tag, position, message) of a message's elements, in order, as one array; the rules are literals of the plan."""

    def one(s: Column) -> Column:
        own = F.try_element_at(rules.element_map(table), s["tag"])
        told = F.transform(own, lambda r: F.struct(s["idx"].alias("idx"), s["tag"].alias("tag"), r["position"].alias("position"), element_message(s["fields"], s["tag"], *[r[c] for c in ("position", "kind", "least", "most", "mandatory")]).alias("message")))
        return F.filter(told, lambda x: x["message"].isNotNull())

    return F.flatten(F.filter(F.transform(segments, one), lambda x: F.size(x) > 0))


def required_found(segments: Column) -> Column:
    """The issues (idx, tag, position, message) of mandatory HL7 fields that are missing or blank, in order, as one array."""

    def one(s: Column) -> Column:
        own = F.try_element_at(rules.hl7_required_map(), s["tag"])
        text = lambda r: F.concat(F.lit("missing mandatory field "), s["tag"], F.lit("-"), r["field"].cast("string"), F.lit(" ("), r["name"], F.lit(")"))
        missing = F.filter(own, lambda r: ~F.coalesce(F.get(s["fields"], r["field"] - 1), F.lit("")).rlike(r"\S"))
        return F.transform(missing, lambda r: F.struct(s["idx"].alias("idx"), s["tag"].alias("tag"), r["field"].alias("position"), text(r).alias("message")))

    return F.flatten(F.filter(F.transform(segments, one), lambda x: F.size(x) > 0))


def element_issues(messages: DataFrame, segments: Column, key: str, table: str | DataFrame) -> DataFrame:
    """(key, idx, tag, position, message): the first failure of each rule. The rules are one of the fixed, small tables, or a table of
    the caller's (tag, position, kind, least, most, mandatory), as :func:`rules.loaded` gives it."""
    own = rules.elements(messages.sparkSession, table) if isinstance(table, str) else table.select("tag", "position", "kind", "least", "most", "mandatory")
    rows = rules.beside(exploded(messages, segments, key), own, "tag")
    message = element_message(F.col("fields"), F.col("tag"), *[F.col(c) for c in ("position", "kind", "least", "most", "mandatory")])
    return rows.withColumn("message", message).where("message is not null").select(key, "idx", "tag", "position", "message")


def missing_segments(messages: DataFrame, segments: Column, key: str, table: DataFrame | None = None) -> DataFrame:
    """(key, set_id, tag): required segments that a transaction set lacks, by the fixed table or by a loaded one."""
    needed = rules.required_segments(messages.sparkSession) if table is None else table.where("mandatory").select("set_id", "tag")
    own = F.col("__own")
    sets = bound(bound(messages, __s=segments), __own=body(F.col("__s"))).select(key, field(first_segment(own, "ST"), 1).alias("set_id"), F.transform(own, lambda s: s["tag"]).alias("tags"))
    return rules.beside(sets, needed, "set_id").where(~F.array_contains("tags", F.col("tag"))).select(key, "set_id", "tag")


def transaction_set_issues(messages: DataFrame, segments: Column, key: str) -> DataFrame:
    """(key, set_id, tag, message): required segments that a transaction set lacks, and sets that don't end with SE or have no ST."""
    own = F.col("__own")
    rows = bound(bound(messages.select(key, segments.alias("__s")), __own=body(F.col("__s"))), __set=F.coalesce(field(first_segment(own, "ST"), 1), F.lit("")))
    last = F.try_element_at(own, F.lit(-1))["tag"]
    told = lambda tag, text: F.struct(F.lit(tag).alias("tag"), F.lit(text).alias("message"))
    ends = F.array_compact(F.array(F.when(own.isNull() & F.col("__s").isNotNull(), told("ST", "no transaction set")), F.when(last != "SE", told("SE", "the set does not end with SE"))))
    order = rows.select(key, F.col("__set").alias("set_id"), F.explode(ends).alias("x")).select(key, "set_id", "x.*")
    lacking = missing_segments(messages, segments, key).where("tag <> 'SE'").select(key, "set_id", "tag", F.concat(F.lit("the set lacks "), F.col("tag")).alias("message"))
    return order.unionByName(lacking)


def order_error(p: Column) -> Column:
    """Why a purchase order as :func:`read_850` gives it is refused: its CTT counts other lines than there are. Null if it isn't."""
    return F.when(p["ctt"] != F.size(p["lines"]), F.concat(F.lit("CTT counts "), p["ctt"].cast("string"), F.lit(" lines, there are "), F.size(p["lines"]).cast("string")))


def x12_envelope_issues(messages: DataFrame, segments: Column, key: str) -> DataFrame:
    """(key, idx, tag, rule): counts and control numbers of SE, GE and IEA against what they close, and headers that are
    never closed.

    A count that isn't a number is not compared; a trailer without its header is told as such. Each message is folded over its
    envelope segments where it stands.
    """
    rows = bound(messages.select(key, segments.alias("__s")), __e=envelope_part(F.col("__s")))
    return rows.select(key, F.explode(envelope_found(F.col("__e"))).alias("i")).select(key, "i.idx", "i.tag", "i.rule")


def envelope_part(segments: Column) -> Column:
    return F.filter(segments, lambda s: s["tag"].isin("ISA", "GS", "ST", "SE", "GE", "IEA"))


def envelope_found(own: Column) -> Column:
    """The issues (idx, tag, rule) of a message's envelope segments, as one array."""
    none = F.lit(None).cast("string")
    issue = "struct<idx:int,tag:string,rule:string>"
    start = F.struct(
        *[x for h in ("isa", "gs", "st") for x in (F.lit(-1).alias(h), none.alias(f"{h}_control"), F.lit(True).alias(f"{h}_closed"))], F.lit(0).cast("long").alias("groups"), F.lit(0).cast("long").alias("sets"),
        F.expr(f"cast(array() as array<{issue}>)").alias("issues"),
    )
    control_at = {"ISA": 12, "GS": 5, "ST": 1}

    def step(done: Column, s: Column) -> Column:
        tag, idx = s["tag"], s["idx"]
        found = []
        told = lambda rule: F.struct(idx.alias("idx"), tag.alias("tag"), F.lit(rule).alias("rule"))
        for trailer, header, number in (("SE", "ST", idx - done["st"] + 1), ("GE", "GS", done["sets"]), ("IEA", "ISA", done["groups"])):
            here, missing = tag == trailer, done[header.lower()] < 0
            stated, control = F.get(s["fields"], 0).try_cast("long"), F.get(s["fields"], 1)
            found += [
                F.when(here & missing, told(f"{trailer} without {header}")),
                F.when(here & ~missing & (stated != number), told(f"{trailer} count")),
                F.when(here & ~missing & ~control.eqNullSafe(done[f"{header.lower()}_control"]), told(f"{trailer} control number")),
            ]
        for header in ("ISA", "GS", "ST"):
            open_one = F.struct(done[header.lower()].alias("idx"), F.lit(header).alias("tag"), F.lit(f"{header} never closed").alias("rule"))
            found.append(F.when((tag == header) & ~done[f"{header.lower()}_closed"], open_one))
        state = []
        for header, trailer in (("ISA", "IEA"), ("GS", "GE"), ("ST", "SE")):
            h, here = header.lower(), tag == header
            state += [
                F.when(here, idx).otherwise(done[h]).alias(h), F.when(here, F.get(s["fields"], control_at[header])).otherwise(done[f"{h}_control"]).alias(f"{h}_control"),
                F.when(here, False).when(tag == trailer, True).otherwise(done[f"{h}_closed"]).alias(f"{h}_closed"),
            ]
        sets = F.when(tag == "GS", F.lit(0).cast("long")).when(tag == "ST", done["sets"] + 1).otherwise(done["sets"])
        groups = F.when(tag == "GS", done["groups"] + 1).otherwise(done["groups"])
        return F.struct(*state, groups.alias("groups"), sets.alias("sets"), F.concat(done["issues"], F.array_compact(F.array(*found))).alias("issues"))

    def finish(done: Column) -> Column:
        left = [F.when(~done[f"{h}_closed"], F.struct(done[h].alias("idx"), F.lit(h.upper()).alias("tag"), F.lit(f"{h.upper()} never closed").alias("rule"))) for h in ("isa", "gs", "st")]
        return F.concat(done["issues"], F.array_compact(F.array(*left)))

    return F.aggregate(own, start, step, finish)


def hl7_required_issues(messages: DataFrame, segments: Column, key: str, table: DataFrame | None = None) -> DataFrame:
    """(key, idx, tag, field, message): mandatory fields that are missing or blank, by the fixed table or by a loaded one."""
    own = rules.hl7_required(messages.sparkSession) if table is None else table.where("mandatory").select("tag", "field", "name")
    rows = rules.beside(exploded(messages, segments, key), own, "tag")
    blank = F.regexp_replace(F.coalesce(F.get("fields", F.col("field") - 1), F.lit("")), r"^\s+|\s+$", "") == ""
    text = F.concat(F.lit("missing mandatory field "), F.col("tag"), F.lit("-"), F.col("field").cast("string"), F.lit(" ("), F.col("name"), F.lit(")"))
    return rows.where(blank).select(key, "idx", "tag", "field", text.alias("message"))


def pseudonyms(values: DataFrame, key: str, value: str, position: str, prefix: str) -> DataFrame:
    """The rows with ``pseudonym``: distinct values numbered by their first place within each message."""
    first = F.min(position).over(Window.partitionBy(key, value))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("__first", value))
    return values.withColumn("__first", first).withColumn("pseudonym", F.concat(F.lit(prefix), rank.cast("string"))).drop("__first")


def _sized(value: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0")), value.cast("binary"))


GENESIS = "0" * 64


def entry_hash(seq: Column, at: Column, event: Column, payload: Column, prev: Column) -> Column:
    """SHA-256 of an audit entry: the number, then each value after its length, big-endian."""
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(seq.cast("long")), 16, "0")), _sized(at), _sized(event), _sized(payload), _sized(prev)), 256)


def _walked(entries: DataFrame, key: str, heads: bool) -> DataFrame:
    """Each log is read in order of ``seq`` by one task, which holds no more of it than a batch, its last hash and its count."""
    kind = dict(entries.dtypes)[key]
    names = ("seq", "at", "event", "payload_sha256")
    rows = entries.select(key, F.col("seq").cast("long").alias("seq"), *[F.col(x).cast("string").alias(x) for x in names[1:]])
    schema = f"`{key}` {kind}, n long, head string" if heads else f"`{key}` {kind}, seq long, at string, event string, payload_sha256 string, prev string, hash string"

    def sized(value: str) -> bytes:
        raw = value.encode("utf-8", "surrogatepass")
        return len(raw).to_bytes(8, "big") + raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, last, any_log = None, 0, GENESIS, None
        for batch in batches:
            logs = batch.column(key).to_pylist()
            prev, new, ended = [], [], []
            for k, (log, *values) in enumerate(zip(logs, *[batch.column(x).to_pylist() for x in names], strict=True)):
                if any_log is None or log != own:
                    if any_log is not None:
                        ended.append((any_log, n, last))
                    own, n, last, any_log = log, 0, GENESIS, batch.column(key).slice(k, 1)
                prev.append(last)
                if None in values or last is None:
                    last = None
                else:
                    raw = values[0].to_bytes(8, "big", signed=True) + b"".join(sized(x) for x in (*values[1:], last))
                    last = hashlib.sha256(raw).hexdigest()
                new.append(last)
                n += 1
            if heads:
                yield from told(ended)
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prev, pa.string()), pa.array(new, pa.string())], [key, *names, "prev", "hash"])
        if heads and any_log is not None:
            yield from told([(any_log, n, last)])

    def told(ended: list[tuple]) -> Iterator[pa.RecordBatch]:
        if ended:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x for x, _, _ in ended]), pa.array([x for _, x, _ in ended], pa.int64()), pa.array([x for *_, x in ended], pa.string())], [key, "n", "head"])

    return rows.repartition(key).sortWithinPartitions(key, *names).mapInArrow(run, schema)


def chain_entries(entries: DataFrame, key: str) -> DataFrame:
    """(key, seq, at, event, payload_sha256, prev, hash): one row for each entry of each log."""
    return _walked(entries, key, False)


def chain_heads(entries: DataFrame, key: str) -> DataFrame:
    """(key, n, head): the number of entries and the last hash of each log."""
    return _walked(entries, key, True)


def chained(entries: DataFrame, key: str) -> DataFrame:
    """(key, entries): each log's entries as one array, for short logs; see :func:`chain_entries` for logs of any length."""
    row = F.struct("seq", "at", "event", "payload_sha256", "prev", "hash")
    return chain_entries(entries, key).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("entries"))


#: Entries of a log that are checked together; a longer log is dealt out in runs of so many numbers.
RUN = 4096


def in_runs(entries: DataFrame, key: str) -> DataFrame:
    """The entries (key, seq, hash, ...) with ``n``, their place in their log by seq, and ``before``, the hash before theirs (null at the
    start). A log is dealt out by the run its numbers fall into; runs exchange a row each, their size and last hash, so that no task
    holds a whole log. Entries of one number stay together."""
    runs = entries.withColumn("__run", F.floor(F.col("seq") / RUN))
    ends = runs.groupBy(key, "__run").agg(F.count(F.lit(1)).alias("__many"), F.max_by("hash", F.struct("seq", "hash")).alias("__last"))
    log = Window.partitionBy(key).orderBy("__run")
    starts = ends.select(F.col(key).alias("__key"), F.col("__run").alias("__of"), F.coalesce(F.sum("__many").over(log.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.lag("__last").over(log).alias("__before"))
    rows = runs.join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__run").eqNullSafe(F.col("__of")))
    own = Window.partitionBy(key, "__run").orderBy("seq", "hash")
    return rows.withColumns({"n": F.col("__start") + F.row_number().over(own) - 1, "before": F.coalesce(F.lag("hash").over(own), F.col("__before"))}).drop("__run", "__key", "__of", "__start", "__before")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with ``seq``, their place in their log by a number; long logs are numbered by many tasks."""
    return in_runs(rows.withColumns({"seq": F.col(order), "hash": F.lit("")}), key).drop("seq", "hash", "before").withColumnRenamed("n", "seq")


def broken(entries: DataFrame, key: str) -> DataFrame:
    """(key, seq): the first entry of each log whose number, link or hash is wrong; all entries are checked at once, long logs by many tasks."""
    rows = in_runs(entries, key).withColumn("before", F.coalesce("before", F.lit(GENESIS)))
    good = (F.col("seq") == F.col("n")) & (F.col("prev") == F.col("before")) & (F.col("hash") == entry_hash(F.col("seq"), F.col("at"), F.col("event"), F.col("payload_sha256"), F.col("prev")))
    return rows.where(~good).groupBy(key).agg(F.min("seq").alias("seq"))
