"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are cut into pieces of at most ``capacity`` tokens, of which only the first can be shorter. All that
decides the packing is how many pieces there are of each length, so the plan is made from that histogram, which has
at most ``capacity`` rows at any input size:

* pieces above a third of the capacity are large: at most two share a sequence. From the largest down, each is
  matched with the largest other large piece that still fits beside it;
* smaller pieces, from the largest down, go to the fullest sequence that still has room for them (best fit), and to
  new sequences where there is none.

Whole runs of equal sequences are treated at once. The plan says, for the k-th piece of each length, its sequence
and its offset there; the k is counted in Spark, by bucket, so that no length's pieces meet in one task.

Ids are those of the tokenizers library: pre-tokens are merged by the vocabulary file's list of merges; texts that hold one
of its added tokens are left to the library, which finds these before it cuts words.

Null texts count as empty: a document of the end token alone. Repeated ids each keep their pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .shared import compact, mapped, slices, spread, stored, table
from .tokens import WordCoder

VOCABULARY, CAPACITY, END = "byte_bpe_50k.json", 1024, 2


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for: printable ones for themselves, the others by letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def vocabulary_of(path: str) -> Vocabulary:
    """Ids and merges of a byte-level vocabulary file. Only listed pairs merge, in the order of the list."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    known = letters.keys()
    raw = {x: bytes(map(letters.__getitem__, x)) for x in model["vocab"] if known >= set(x)}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    return Vocabulary({raw[x]: i for x, i in model["vocab"].items() if x in raw}, {(raw[x], raw[y]): k for k, (x, y) in enumerate(pairs)})


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class DocumentCoder(WordCoder):
    """Encodes texts with an added token by the tokenizer, all others piece by piece."""

    def __init__(self, path: str):
        super().__init__(vocabulary_of(path).merged)
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.added = "|".join([re.escape(x["content"]) for x in json.load(file)["added_tokens"]]) or "$^"

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = library(self.path)
        ids = [own.encode(x, add_special_tokens=False).ids for x in texts]
        return np.array([x for xs in ids for x in xs], np.uint32), np.array([len(x) for x in ids], np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = compact(texts)
        marked = pc.match_substring_regex(texts, self.added)
        rows = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        if not len(rows):
            return super().texts(texts)
        ids, first = super().texts(pc.if_else(marked, "", texts))
        own, many = self._encoded(texts.take(pa.array(rows)).to_pylist())
        ids = np.insert(ids, np.repeat(first[rows], many), own)
        size = np.diff(first)
        size[rows] = many
        return ids, np.concatenate([[0], np.cumsum(size)])


@cache
def coder(path: str) -> DocumentCoder:
    """One for each worker process, so that its cache serves all its tasks."""
    return DocumentCoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, ends = own.texts(part.column(text_col))
                size = np.diff(ends) + 1
                raw = memoryview(np.insert(ids, ends[1:], end).astype("<u4")).cast("B")
                many = -(-size // capacity)
                at = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                first = size - (many - 1) * capacity  # the first piece may be shorter
                start = np.where(piece == 0, 0, first[at] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[at], capacity)
                low = 4 * ((np.cumsum(size) - size)[at] + start)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).transform(mapped, run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first, sequence, offset): the pieces of that length from number ``first`` on (until the next
    row's) lie in the sequences from ``sequence`` on, one in each, at that offset."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, how many)
    free: list[int] = []  # the gaps in use, ascending
    sequences = 0

    def put(length: int, sequence: int, many: int, offset: int) -> None:
        rows.append((length, used[length], sequence, offset))
        used[length] += many
        left[length] -= many

    def open_gap(gap: int, sequence: int, many: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(free, gap)
            gaps[gap].append((sequence, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] - (m == n) > 0), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, sequences, many, 0)
            if mate is not None:
                put(mate, sequences, many, n)
            open_gap(capacity - n - (mate or 0), sequences, many)
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = next((g for g in free if g >= n), None)
            if gap is None:
                each = capacity // n
                many = -(-left[n] // each)
                open_gap(capacity, sequences, many)
                sequences += many
                continue
            start, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                free.remove(gap)
            fit = min(many, left[n])
            if fit < many:
                open_gap(gap, start + fit, many - fit)
            put(n, start, fit, capacity - gap)
            open_gap(gap - n, start, fit)
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64")


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. ``cut_pieces`` must be stored: it is read three times."""
    buckets = spread(cut_pieces)
    numbered = cut_pieces.withColumn("__bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    counts = numbered.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity).sort_values(["length", "first"])
    table_of = {n: g[["first", "sequence", "offset"]].to_numpy() for n, g in rows.groupby("length")}
    shared = cut_pieces.sparkSession.sparkContext.broadcast(table_of)
    within = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "start")
    ranked = numbered.withColumn("__rank", F.row_number().over(within) - 1).join(counts.drop("__n"), ["length", "__bucket"])
    ranked = ranked.select(*cut_pieces.columns, (F.col("__rank") + F.col("__before")).alias("__rank"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sequence, offset = np.zeros((2, len(part)), np.int64)
            for n, at in part.groupby("length").indices.items():
                runs, rank = shared.value[n], part["__rank"].to_numpy()[at]
                own = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
                sequence[at], offset[at] = own[:, 1] + rank - own[:, 0], own[:, 2]
            yield part.drop(columns="__rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{n}` {k}" for n, k in cut_pieces.dtypes)
    return ranked.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packed(stored(pieces(docs, path or public_tokenizers.path(VOCABULARY), capacity, END, id_col, text_col)), capacity, id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
