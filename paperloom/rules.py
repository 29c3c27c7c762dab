"""Rule tables of the message standards, and the DataFrames made of them.

Fixed values: the requirement tables of HL7 v2.5.1, X12 and EDIFACT D.96A that the checks apply. A rule of the
EDI tables is position, type (an, n, r, dt, id), least and greatest length, and M for mandatory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HL7_REQUIRED = """
MSH 9 Message Type
MSH 10 Message Control ID
MSH 11 Processing ID
MSH 12 Version ID
EVN 2 Recorded Date/Time
PID 3 Patient Identifier List
PID 5 Patient Name
PV1 2 Patient Class
OBR 4 Universal Service Identifier
OBX 2 Value Type
OBX 3 Observation Identifier
NTE 3 Comment
AL1 2 Allergen Type Code
AL1 3 Allergen Code/Mnemonic/Description
DG1 3 Diagnosis Code
"""

X12_ELEMENTS = """
ISA 1 id 2 2 M
ISA 2 an 10 10 C
ISA 3 id 2 2 M
ISA 4 an 10 10 C
ISA 5 id 2 2 M
ISA 6 an 15 15 M
ISA 15 id 1 1 M
ISA 16 an 1 1 M
GS 1 id 1 12 M
GS 2 an 2 15 M
GS 3 an 1 9 M
GS 6 an 1 9 M
ST 1 id 3 9 M
ST 2 an 4 9 M
BPR 1 id 1 2 M
BPR 2 r 1 18 M
N1 1 id 2 3 M
N1 2 an 1 60 C
CLP 1 an 1 38 M
CLP 2 id 1 2 M
CLP 3 r 1 18 M
SVC 1 an 1 48 M
SVC 2 r 1 18 M
SE 1 n 1 10 M
SE 2 an 4 9 M
GE 1 n 1 6 M
GE 2 an 1 9 M
IEA 1 n 1 5 M
IEA 2 n 5 13 M
"""

EDIFACT_ELEMENTS = """
UNB 1 an 1 35 M
UNB 2 an 1 35 M
UNB 3 an 1 35 M
UNB 4 an 1 35 M
UNB 5 an 1 35 M
UNB 6 an 1 35 C
UNH 1 an 1 14 M
UNH 2 an 1 64 M
UNH 3 an 1 35 C
BGM 1 an 1 35 M
BGM 2 an 1 35 M
DTM 1 an 1 35 M
NAD 1 an 1 3 M
NAD 2 an 1 35 C
LIN 1 an 1 6 M
LIN 2 an 1 35 C
QTY 1 an 1 35 M
MOA 1 an 1 35 M
UNT 1 n 1 6 M
UNT 2 an 1 14 M
UNZ 1 n 1 6 M
UNZ 2 an 1 14 M
"""

TRANSACTION_SETS = """
835 ST BPR N1 CLP SE
837 ST BHT N1 CLM SE
270 ST BHT HL SE
271 ST BHT HL EB SE
"""


#: Kinds of rule tables: their columns (name, type) in a file of tab-separated values, and what the requirement may be.
TABLES = {
    "elements": ([("tag", "string"), ("position", "int"), ("kind", "string"), ("least", "int"), ("most", "int"), ("need", "string")], ["M", "C", "O"]),
    "hl7": ([("tag", "string"), ("field", "int"), ("need", "string"), ("name", "string")], ["M", "O"]),
    "sets": ([("set_id", "string"), ("tag", "string"), ("need", "string")], ["M", "O"]),
}
KINDS = ["an", "n", "r", "dt", "id"]


def loaded(lines: DataFrame, kind: str) -> DataFrame:
    """The rules of a table's lines (n, line), n from 1, with ``error``: why a line is refused, or null. Blank lines and those that start
    with # are left out. A table is taken whole or not at all: see :func:`refused`."""
    columns, needs = TABLES[kind]
    own = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("c", F.split(F.regexp_replace("line", "\r$", ""), "\t"))
    text = {name: F.get("c", k) for k, (name, _) in enumerate(columns)}
    checks = [F.when(F.size("c") != len(columns), F.concat(F.lit(f"expected {len(columns)} columns, found "), F.size("c").cast("string")))]
    for name, of in columns:
        if of == "int":
            checks.append(F.when(~text[name].rlike("^[0-9]{1,5}$") | (text[name].try_cast("int") > 65535), F.concat(F.lit(f"{name} must be a number, found `"), text[name], F.lit("`"))))
    if "kind" in text:
        checks.append(F.when(~text["kind"].isin(KINDS), F.concat(F.lit("unknown element type `"), text["kind"], F.lit("`"))))
    told = f"requirement must be {', '.join(needs[:-1])} or {needs[-1]}, found `"
    checks.append(F.when(~text["need"].isin(needs), F.concat(F.lit(told), text["need"], F.lit("`"))))
    values = [text[name].try_cast(of).alias(name) for name, of in columns if name != "need"]
    return own.select("n", *values, (text["need"] == "M").alias("mandatory"), F.coalesce(*checks).alias("error"))


def refused(rules_: DataFrame) -> DataFrame:
    """(n, error): the first line at fault of a loaded table; no row where it is good."""
    return rules_.where("error is not null").agg(F.min_by("error", "n").alias("error"), F.min("n").alias("n")).where("n is not null").select("n", "error")


#: Rules up to which a table is broadcast; a larger one is joined by shuffling.
BROADCAST_RULES = 20_000


def beside(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """The rows with their rules, by a broadcast of a table whose size was counted, or else by shuffling."""
    small = table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    return rows.join(F.broadcast(table) if small else table.hint("shuffle_hash"), on)


def hl7_required(spark: SparkSession) -> DataFrame:
    rows = [line.split(" ", 2) for line in HL7_REQUIRED.strip().splitlines()]
    return spark.createDataFrame([(tag, int(n), name) for tag, n, name in rows], "tag string, field int, name string")


def elements(spark: SparkSession, table: str) -> DataFrame:
    rules = [line.split() for line in table.strip().splitlines()]
    return spark.createDataFrame([(t, int(p), k, int(a), int(b), need == "M") for t, p, k, a, b, need in rules], "tag string, position int, kind string, least int, most int, mandatory boolean")


def element_map(table: str) -> Column:
    """The element rules of each tag, as a literal."""
    by_tag: dict[str, list[Column]] = {}
    for t, p, k, a, b, need in (line.split() for line in table.strip().splitlines()):
        rule = F.struct(F.lit(int(p)).alias("position"), F.lit(k).alias("kind"), F.lit(int(a)).alias("least"), F.lit(int(b)).alias("most"), F.lit(need == "M").alias("mandatory"))
        by_tag.setdefault(t, []).append(rule)
    return F.create_map(*[x for t, own in by_tag.items() for x in (F.lit(t), F.array(*own))])


def hl7_required_map() -> Column:
    """The mandatory fields of each segment, as a literal."""
    by_tag: dict[str, list[Column]] = {}
    for tag, n, name in (line.split(" ", 2) for line in HL7_REQUIRED.strip().splitlines()):
        by_tag.setdefault(tag, []).append(F.struct(F.lit(int(n)).alias("field"), F.lit(name).alias("name")))
    return F.create_map(*[x for t, own in by_tag.items() for x in (F.lit(t), F.array(*own))])


def required_segments(spark: SparkSession) -> DataFrame:
    rows = [line.split() for line in TRANSACTION_SETS.strip().splitlines()]
    return spark.createDataFrame([(s, tag) for s, *tags in rows for tag in tags], "set_id string, tag string")


#: Segment, field, component (0: the whole field), action, and the prefix of pseudonyms.
SAFE_HARBOR = """
PID 3 1 pseudonym PATIENT-
PID 2 0 clear
PID 4 0 clear
PID 5 0 clear
PID 6 0 clear
PID 7 0 year
PID 9 0 clear
PID 11 0 clear
PID 12 0 clear
PID 13 0 clear
PID 14 0 clear
PID 18 0 clear
PID 19 0 clear
PID 20 0 clear
PID 29 0 year
PV1 7 0 clear
PV1 8 0 clear
PV1 9 0 clear
PV1 17 0 clear
PV1 19 1 pseudonym VISIT-
PV1 44 0 year
PV1 45 0 year
NK1 2 0 clear
NK1 4 0 clear
NK1 5 0 clear
NK1 6 0 clear
GT1 3 0 clear
GT1 5 0 clear
GT1 6 0 clear
IN1 16 0 clear
IN1 19 0 clear
IN1 36 0 clear
NTE 3 0 clear
OBR 7 0 year
OBR 14 0 year
OBR 16 0 clear
OBX 14 0 year
OBX 16 0 clear
OBX 5 0 clear
"""


def safe_harbor() -> list[tuple[str, int, int, str, str]]:
    """The direct identifiers of admissions and results: (segment, field, component, action, text)."""
    rules = [line.split() for line in SAFE_HARBOR.strip().splitlines()]
    return [(r[0], int(r[1]), int(r[2]), r[3], r[4] if len(r) > 4 else "") for r in rules]
