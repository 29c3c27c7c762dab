"""Approximate nearest neighbours by shifted space-filling curves.

A fixed random rotation projects the vectors on groups of ``DIMENSIONS`` coordinates; each group, with its own random
shift, gives one Hilbert ordering. An ordering is cut into ``CELLS`` ranges of about equally many rows. A query looks at its own range
and those around it, until they hold ``WINDOW`` of all rows, and at least ``LEAST`` times the wanted neighbours, in every
ordering; each window's best are reranked by the exact inner product and merged. Tables of up to that many rows are compared whole.

Ranges are dealt out in parts of at most ``PART`` vectors, by a hash of the id, so that tasks stay bounded at any
size and a key that many equal vectors share is split as well. Only the queries are copied, to the parts of
their windows. The ranges' ends are quantiles of all keys, ``CELLS`` for each ordering.

``WINDOW`` is a share of the rows because neighbours in nearly isotropic data lie that far apart on any curve: with
a fixed number of rows, recall would fall as the table grows.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Equal vectors are different candidates; ties in the score go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import mapped, spread, stored, table

CURVES, DIMENSIONS, BITS, CELLS, WINDOW, PART = 16, 8, 7, 64, 0.09, 8192
#: A window's rows at least, as a multiple of the wanted neighbours and the query itself.
LEAST = 4
#: Rows that the coordinates' spread is fitted on at most.
FIT_ROWS = 10_000


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling's transposition)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


class Curves:
    """Projections, scales and shifts of the orderings."""

    def __init__(self, width: int, sample: np.ndarray, curves: int = CURVES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.planes = [np.linalg.qr(rng.normal(size=(width, min(width, DIMENSIONS))))[0] for _ in range(curves)]
        shown = [sample @ p for p in self.planes]
        self.low = [s.mean(axis=0) - 3 * s.std(axis=0) for s in shown]
        self.step = [np.maximum(6 * s.std(axis=0), 1e-12) / (1 << BITS) * 2 for s in shown]  # half the range is left for the shift
        self.shift = [rng.uniform(0, 1 << (BITS - 1), size=p.shape[1]) for p in self.planes]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """[row, curve]"""
        out = []
        for p, low, step, shift in zip(self.planes, self.low, self.step, self.shift, strict=True):
            cells = np.clip((vectors @ p - low) / step, 0, (1 << (BITS - 1)) - 1) + shift
            out.append(hilbert_keys(np.floor(cells)))
        return np.stack(out, axis=1) if out else np.zeros((len(vectors), 0), np.int64)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _top(query: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's best rows: highest score, then smallest id."""
    order = np.lexsort((ids, -score, query))
    own = query[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < most]


def neighbours(vectors: DataFrame, is_query: Column, most: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", window: float = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    kind = dict(rows.dtypes)["v"]
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == width["w"])
    share = min(1.0, FIT_ROWS / width["n"])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("curves"), "id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(2 * FIT_ROWS).toPandas()
    curves = Curves(width["w"], np.array(sample.v.tolist()) if len(sample) else np.zeros((1, width["w"])))

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, "v")
            if batch.num_rows:
                keys = curves.keys(v)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["id", "v", "query", "keys"])

    keyed = stored(rows.transform(mapped, key_rows, f"id long, v {kind}, query boolean, keys array<long>"))
    quantiles = [float(k) / CELLS for k in range(1, CELLS)]
    ends = keyed.agg(*[F.percentile_approx(F.col("keys")[c], quantiles, 20_000).alias(f"c{c}") for c in range(CURVES)]).first()
    ends = [np.array(sorted(set(x)), np.int64) for x in ends]  # CELLS numbers for each curve

    def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = np.stack([np.searchsorted(e, keys[:, c], "left") for c, e in enumerate(ends)], axis=1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * CURVES), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("query"), flat], ["id", "v", "query", "cells"])

    placed = stored(keyed.transform(mapped, cell_rows, f"id long, v {kind}, query boolean, cells array<int>"))
    counts = placed.select(F.posexplode("cells").alias("curve", "cell")).groupBy("curve", "cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # CURVES * CELLS rows
    size = np.zeros((CURVES, CELLS), np.int64)
    size[counts.curve, counts.cell] = counts.n
    parts = np.maximum(1, -(-size // PART))
    spans = [(c, cell, *_window(size[c], cell, max(window * width["n"], LEAST * (most + 1)))) for c in range(CURVES) for cell in range(CELLS) if size[c, cell]]
    session = vectors.sparkSession
    part_of = session.createDataFrame(pd.DataFrame([(c, k, int(parts[c, k])) for c in range(CURVES) for k in range(CELLS)], columns=["curve", "cell", "parts"]), "curve int, cell int, parts int")
    visits = session.createDataFrame(
        pd.DataFrame([(c, cell, k, int(parts[c, k])) for c, cell, low, high in spans for k in range(low, high + 1)], columns=["curve", "cell", "visit", "parts"]), "curve int, cell int, visit int, parts int"
    )  # CURVES * CELLS * CELLS rows at most
    each = placed.select("id", "v", "query", F.posexplode("cells").alias("curve", "cell"))
    candidates = each.join(F.broadcast(part_of), ["curve", "cell"]).select("curve", F.col("cell").alias("visit"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = each.where("query").join(F.broadcast(visits), ["curve", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("curve", "visit", "part", F.lit(True).alias("asks"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come in order, each with its candidates first; of these, one part is held at a time."""
        key, held, matrix, ids = None, [], None, None
        for batch in batches:
            v = _matrix(batch, "v")
            i, asks = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            code = (batch.column("curve").to_numpy().astype(np.int64) * CELLS + batch.column("visit").to_numpy()) << 32 | batch.column("part").to_numpy()
            edges = np.flatnonzero(np.diff(code * 2 + asks)) + 1
            for low, high in zip([0, *edges], [*edges, len(code)], strict=True):
                if low == high:
                    continue
                if code[low] != key:
                    key, held, matrix = code[low], [], None
                if not asks[low]:
                    held.append((i[low:high].copy(), v[low:high].copy()))
                    continue
                if matrix is None and held:
                    ids, matrix = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                if matrix is None:
                    continue
                for at in range(low, high, 256):
                    to = min(high, at + 256)
                    score = v[at:to] @ matrix.T
                    score[i[at:to, None] == ids[None]] = -np.inf
                    few = min(most, len(ids))
                    least = np.partition(score, len(ids) - few, axis=1)[:, len(ids) - few]
                    q, c = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    best = _top(q, score[q, c], ids[c], most)
                    q, c = q[best], c[best]
                    # the exact measure, summed the same way wherever the pair meets
                    exact = np.array([np.dot(v[at + a], matrix[b]) for a, b in zip(q, c, strict=True)])
                    yield pa.RecordBatch.from_pydict({"query_id": i[at:to][q], "vec_id": ids[c], "score": exact.astype(float)})

    dealt = candidates.unionByName(asked).repartition(max(spread(vectors), int(parts.sum()) // 64 + 1), "curve", "visit", "part").sortWithinPartitions("curve", "visit", "part", "asks")
    found = dealt.select("curve", "visit", "part", "asks", "id", "v").transform(mapped, search, "query_id long, vec_id long, score double")
    # the windows' best, by query: at most `most` for each part of a window
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def _window(sizes: np.ndarray, cell: int, rows: float) -> tuple[int, int]:
    """The ranges around a cell, grown on the side with fewer rows, until they hold so many rows."""
    low = high = cell
    left = right = 0
    total = sizes[cell]
    while total < rows and (low > 0 or high < len(sizes) - 1):
        if high == len(sizes) - 1 or low > 0 and left <= right:
            low -= 1
            left += sizes[low]
            total += sizes[low]
        else:
            high += 1
            right += sizes[high]
            total += sizes[high]
    return low, high


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, F.col("vec_id") % 20 == 0)
