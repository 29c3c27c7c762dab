"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of the labelled rows in Spark and sends back one number for each
language and hash bucket. The matrix of log-probabilities, whose size depends on the buckets and languages alone, is
broadcast; each Arrow batch is scored at once by gathering its n-grams' rows of the matrix and summing them by text.

Texts that are null or have no letter (Unicode's category L) get ``und`` and the score 0. With no labelled rows, every text does.
Ties go to the language that comes first in the alphabet. Whole texts are read, whatever their length; long ones in parts.
Repeated rows each keep their row; an empty table gives an empty table. Only the id, text and label columns take part, so no
other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mapped, slices, table

BUCKET_BITS, ORDERS = 16, (1, 2, 3)
#: Labelled rows that training reads at most (about: rows are drawn by a hash of their id).
TRAINING_ROWS = 20_000
#: Characters of a text whose n-grams are counted at once.
PART = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FOLD = np.arange(128, dtype=np.uint32)  # what isn't a letter is a space
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def n_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of the n-grams of all texts, and each one's text number; long texts in parts. Each text is padded with a space."""
    texts = [f" {x.lower()} " for x in texts]
    yield _n_grams("".join([x if len(x) <= PART else "" for x in texts]), np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) if len(x) <= PART else 0 for x in texts]))
    for k, x in enumerate(texts):
        for at in range(0, len(x) if len(x) > PART else 0, PART):
            part = x[at : at + PART + max(ORDERS) - 1]
            yield _n_grams(part, np.full(len(part), k, np.int32), PART)


def _n_grams(text: str, owner: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Those that start in the first ``starts`` characters and belong to one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points).astype(np.uint64)
    buckets, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for n in ORDERS:
        m = min(len(points) - n + 1, len(points) if starts is None else starts)
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + m]) * _FACTORS[k]
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        buckets.append((h * _FACTORS[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix): log P(bucket | language) + nothing else; priors are even."""
    usable = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, label_col)
    share = min(1.0, rows / max(1, usable.count()))
    # a share of the range of 64-bit hashes, so that the sample is no emptier for larger tables
    sample = usable.where(F.xxhash64(F.lit("langid"), id_col) <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                labels = np.array(part.column(label_col).to_pylist(), object)
                for buckets, owners in n_grams(part.column(text_col).to_pylist()):
                    for label in set(labels[owners]):
                        own = totals.setdefault(label, np.zeros(1 << BUCKET_BITS, np.int64))
                        own += np.bincount(buckets[(labels == label)[owners]], minlength=1 << BUCKET_BITS)
        for label, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * len(used)), "bucket": used.astype(np.int32), "n": own[used]})

    counted = sample.transform(mapped, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted.lang.unique())
    matrix = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        np.add.at(matrix[:, k], own.bucket.to_numpy(), own.n.to_numpy())
    return languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predicted(docs: DataFrame, languages: list[str], matrix: np.ndarray, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score): the likeliest language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        names = np.array([*names, "und"], object)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if len(names) > 1:
                    total = np.zeros((len(texts), len(names) - 1))
                    for buckets, owners in n_grams(texts):
                        for k in range(len(names) - 1):
                            total[:, k] += np.bincount(owners, logs[buckets, k], len(texts))
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    lettered = pc.fill_null(pc.match_substring_regex(part.column(text_col), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                    best = np.where(lettered, odds.argmax(axis=1), best)
                    score = np.where(lettered, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], [id_col, "held_out", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), text_col).transform(mapped, run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    languages, matrix = train(docs.where(~held_out))
    return predicted(docs, languages, matrix, held_out)
