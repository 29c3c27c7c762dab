"""Messages made of the driver's tables, so that readers and checks have whole columns to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fields import edifact_release, hl7_escape_text
from paperloom.sources.segments import bound, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def x12_header(control: str, kind: str) -> Column:
    isa = f"ISA*00*          *00*          *ZZ*BUYER          *ZZ*SELLER         *260101*1200*^*00501*{control}*0*P*:~"
    return F.lit(f"{isa}GS*{kind}*BUYER*SELLER*20260101*1200*1*X*005010~")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, day, lines): an order with its lines by number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))
    by_order = spread(lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "quantity", "price"))).alias("lines"))  # an order's lines
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return spread(orders, "o_orderkey").join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def x12_850(orders: DataFrame) -> DataFrame:
    """(o_orderkey, message): a purchase order in an interchange. Orders whose key divides by 7 state a wrong SE count,
    by 11 a wrong GE control number, by 13 a wrong IEA count."""
    key = F.col("o_orderkey")
    lines = F.array_join(F.transform("lines", lambda x: _text("PO1*", x["l_linenumber"].cast("string"), "*", x["quantity"].cast("string"), "*EA*", x["price"].cast("string"), "**VP*P", x["l_partkey"].cast("string"), "~")), "")
    n = F.size("lines")
    count = n + 5 + F.when(key % 7 == 0, 1).otherwise(0)
    message = _text(
        x12_header("000000001", "PO"), "ST*850*0001~BEG*00*SA*", key.cast("string"), "**", F.col("day"), "~N1*BY*C", F.col("o_custkey").cast("string"), "~", lines, "CTT*", n.cast("string"), "~SE*", count.cast("string"),
        "*0001~GE*1*", F.when(key % 11 == 0, "2").otherwise("1"), "~IEA*", F.when(key % 13 == 0, "3").otherwise("1"), "*000000001~",
    )
    return bound(orders.select("o_orderkey", "lines", "day", "o_custkey"), message=message).select("o_orderkey", "message")


def x12_810(orders: DataFrame) -> DataFrame:
    """(o_orderkey, message): an invoice whose TDS is the total in cents. N1 of orders that divide by 5 is blank."""
    total = F.aggregate("lines", F.lit(0).cast("decimal(20,0)"), lambda s, x: (s + F.round(x["quantity"] * x["price"] * 100, 0)).cast("decimal(20,0)"))
    key, n = F.col("o_orderkey").cast("string"), F.size("lines")
    lines = F.array_join(F.transform("lines", lambda x: _text("IT1*", x["l_linenumber"].cast("string"), "*", x["quantity"].cast("string"), "*EA*", x["price"].cast("string"), "~")), "")
    message = _text(
        x12_header("000000001", "IN"), "ST*810*0001~BIG*", F.col("day"), "*I", key, "**", key, "~N1*", F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise("ST"), "*C", F.col("o_custkey").cast("string"), "~", lines,
        "TDS*", total.cast("string"), "~CTT*", n.cast("string"), "~SE*", (n + 6).cast("string"), "*0001~GE*1*1~IEA*1*000000001~",
    )
    return bound(orders.select("o_orderkey", "lines", "day", "o_custkey"), message=message).select("o_orderkey", "message")


def x12_856(orders: DataFrame) -> DataFrame:
    """(o_orderkey, message): a ship notice with a shipment, an order, and an item for each line."""
    items = F.array_join(F.transform("lines", lambda x, i: _text("HL*", (i + 3).cast("string"), "*2*I~LIN**VP*P", x["l_partkey"].cast("string"), "~SN1**", x["quantity"].cast("string"), "*EA~")), "")
    n = F.size("lines")
    message = _text(
        x12_header("000000001", "SH"), "ST*856*0001~BSN*00*S", F.col("o_orderkey").cast("string"), "*", F.col("day"), "*1200~HL*1**S~HL*2*1*O~", items, "CTT*", (n + 2).cast("string"),
        "~SE*", (n * 3 + 6).cast("string"), "*0001~GE*1*1~IEA*1*000000001~",
    )
    return bound(orders.select("o_orderkey", "lines", "day", "o_custkey"), message=message).select("o_orderkey", "message")


def edifact_orders(orders: DataFrame) -> DataFrame:
    """(o_orderkey, message): an ORDERS message; odd orders choose their own separators by UNA."""
    lines = F.array_join(F.transform("lines", lambda x: _text("LIN+", x["l_linenumber"].cast("string"), "++P", x["l_partkey"].cast("string"), ":VP'QTY+21:", x["quantity"].cast("string"), "'")), "")
    key, n = F.col("o_orderkey").cast("string"), F.size("lines")
    plain = _text("UNB+UNOA:1+B+S+260101:1200+1'UNH+1+ORDERS:D:96A:UN'BGM+220+", key, "+9'NAD+BY+A?+B?:C'", lines, "UNT+", (n * 2 + 4).cast("string"), "+1'UNZ+1+1'")
    own = _text("UNA:|.? ~\n", F.translate(plain, "+'", "|~"))
    return bound(orders, message=F.when(F.col("o_orderkey") % 2 == 1, F.regexp_replace(own, r"A\?\|B", "A+B")).otherwise(plain)).select("o_orderkey", "message")


def hl7_adt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, message): an admission of each customer. Odd keys use other delimiters; keys that divide by 5 have
    no name, by 7 no patient class; line ends vary."""
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, "").otherwise(F.concat(hl7_escape_text(F.col("c_name")), F.lit("^"), hl7_escape_text(F.col("c_mktsegment"))))
    message = _text(
        "MSH|^~\\&|HIS|ACME|RIS|ACME|20261001120000||ADT^A01|M", key.cast("string"), "|P|2.5.1\rEVN|A01|20261001120000\rPID|1||", key.cast("string"), "^^^", F.col("n_name"), "^MR||", name, "||19",
        F.lpad((key % 100).cast("string"), 2, "0"), "0", ((key % 9) + 1).cast("string"), "15|", F.when(key % 2 == 0, "F").otherwise("M"), "\rPV1|1|", F.when(key % 7 == 0, " ").otherwise("I"), "|W4^101\r",
    )
    other = F.translate(message, "|^", "!*")
    ended = F.when(key % 3 == 1, F.regexp_replace(message, "\r", "\r\n")).otherwise(message)
    return bound(customers, message=F.when(key % 2 == 1, other).otherwise(ended)).select("c_custkey", "message")


def released(column: str) -> Column:
    return edifact_release(F.col(column))
