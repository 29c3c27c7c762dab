"""A corpus pipeline of five training-data stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns of ``documents``, also those that
only extend them. Every stage takes nulls and empty texts, repeated rows and empty tables; what it makes of them stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup as exact
from paperloom.llm import near_dedup as near
from paperloom.llm import packing, pii, shared, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half. Null and empty texts score low and stay; equal texts have equal scores, so
    repeated rows stay or go together; without labelled rows of both kinds all stay."""
    return toxicity.without_toxic(docs, toxicity.fit_on_tables(spark, docs, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id. Null counts as empty, so one null or empty text stays; rows that are
    equal in id and text stay together."""
    return exact.exact_dedup(docs)


#: Texts are near copies from this similarity (percent) on.
NEAR = 80


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Null and empty texts are near to nothing and stay."""
    return near.near_dedup(docs, percent=NEAR)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and disclosing terms removed; n_chars follows the new text. Null texts stay
    null, with their n_chars; rows with one id but different texts are treated each on its own."""
    new = pii.sanitised(docs)
    return new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences. Null and empty texts are a piece of the end token alone; repeated rows are
    packed each; an empty table gives none."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("pii", without_private_data),
    ("packing", into_sequences),
]

#: A trained classifier and a tokenizer can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared.scratch_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
