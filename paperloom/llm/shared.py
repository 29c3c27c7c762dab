"""Helpers that the training-data operators share: scratch storage, columns, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: White space of the contracts, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only on one machine (tests) may it be unset; a folder is made then."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, but as a compressed columnar table; for wide or large rows."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key of fewer rows is never split.
HOT_ROWS = 1_000


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], many: str, share: float = 1 / 1024, parts: int | None = None) -> DataFrame:
    """The rows with the columns of ``groups``, which has one row for each key with the number of its rows in ``many``. Keys with
    more than that share of all rows, at most 1 / share of them, are broadcast, so that none of them meets in one task; the
    others are joined by shuffling. ``rows`` is read once more if there are such keys. ``parts``: partitions that hold the groups."""
    groups = cut(groups if parts is None else groups.coalesce(parts))
    told = groups.agg(F.sum(many), F.max(many)).first()
    bound = max(HOT_ROWS, share * (told[0] or 0))
    if (told[1] or 0) <= bound:
        return rows.join(groups, keys).drop(many)
    hot = F.broadcast(groups.where(F.col(many) > bound))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(many) <= bound), keys)
    return rows.join(hot, keys).unionByName(rest).drop(many)


#: Rows of an Arrow batch, where the session keeps Spark's default: texts are long, and a batch is held on either side.
BATCH_ROWS, BATCH_SETTING = 1_500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches that bounded memory has room for."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> int:
    """The partitions to ask for by name: those the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The rows with their columns named by place, which no name of an operator's own clashes with, and the new names of some."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(c)] for c in columns]


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


_LIBC = ctypes.CDLL(None)

# --- words of whole Arrow batches, and their hashes -----------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compact(texts: pa.Array) -> pa.Array:
    """The texts in buffers of their own, blank for null: some Arrow functions misread arrays that start inside their buffers."""
    return pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many stand before each text (one more at the end). Null: none; lower: A-Z only."""
    texts = pc.cast(compact(texts), pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    some = pc.not_equal(words, "")  # white space at either end leaves an empty one
    count = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(some), count[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]


def hashed_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and the number of words before each text (one more at the end)."""
    words, count = words_of(texts, lower)
    distinct = pc.cast(words, pa.large_binary()).dictionary_encode()
    known = np.fromiter(map(xxh3_64_intdigest, distinct.dictionary.to_pylist()), np.uint64, len(distinct.dictionary))
    return known[distinct.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), count


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    return mix(out)


def give_back() -> None:
    """Returns freed memory to the system, as a worker stays for the next stages with what it once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Parts of the batch whose texts have about most_bytes at most (one text at least), so that memory stays bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        # a copy: some Arrow functions misread arrays that start inside their buffers
        yield batch if end - at == len(sizes) else batch.take(pa.array(np.arange(at, end)))
        at = end
    give_back()
