"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Each text becomes a SHA-256 digest of its normalised form; (id, digest) is stored once.
2. ``freqItems``, Spark's Misra-Gries counter, names every digest that holds more than ``support`` of the rows
   (with some that hold less); one map-side aggregate counts these exactly and keeps the verified ones. There are
   at most ``1 / support`` of them at any input size, so they are broadcast, and their rows are settled map-side.
3. The other digests, of which none holds more than ``support`` of the rows, go through one ordinary shuffle.

Nulls count as empty texts, empty texts are equal to one another, and of equal texts the smallest id stays.
Repeated ids each keep their row; rows equal in id and text all stay or all go. Long texts are read whole. An empty table gives an
empty table. Other columns don't take part, whatever their names; :func:`exact_dedup` passes them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, numbered, or_empty, table

#: A digest with more than this share of the rows is a heavy hitter.
SUPPORT = 1 / 1024


def normalised(text):
    """Runs of white space become one space. Only runs that aren't one space already are touched."""
    return F.regexp_replace(or_empty(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row."""
    digests = cut(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("digest")))
    named = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    total = digests.agg(F.count(F.lit(1)).alias("total"))
    winners = cut(
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("group_size") > support * F.col("total"))
        .drop("total")
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    sizes = rest.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))  # counted map-side first
    rest = rest.join(sizes, "digest").select("id", "digest", "keep_id", "group_size")
    return heavy.select("id", "digest", "keep_id", "group_size").unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id"), F.col("text_sha256").alias("__digest"))
    rows, (own_id, text) = numbered(docs, id_col, text_col)
    own = F.sha2(normalised(F.col(text)).cast("binary"), 256)  # of rows of one id, those with a text that stays
    return rows.join(kept, F.col(own_id).eqNullSafe(F.col("__kept_id")) & (own == F.col("__digest")), "left_semi").toDF(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
