"""Messages that arrive as a stream: the scans are expressions, so they work on streams as they are; what needs state
has a watermark that bounds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fields import sniffed
from paperloom.sources.segments import hl7_segments


def segments(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """One row for each HL7 segment, with the message's other columns; stateless."""
    keys = [c for c in messages.columns if c != message_col]
    return messages.select(*keys, F.explode(hl7_segments(F.col(message_col))).alias("s")).select(*keys, "s.idx", "s.tag", "s.fields")


def first_arrivals(messages: DataFrame, id_col: str, at_col: str, late: str = "1 hour") -> DataFrame:
    """Each message id once; repeats within ``late`` are dropped, and ids older than that are forgotten."""
    return messages.withWatermark(at_col, late).dropDuplicatesWithinWatermark([id_col])


def format_counts(messages: DataFrame, at_col: str, message_col: str = "message", every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, format, n): messages by format in windows of event time; a window ends once the watermark has passed it."""
    counts = messages.withWatermark(at_col, late).groupBy(F.window(at_col, every), sniffed(F.col(message_col)).alias("format")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "format", "n")
