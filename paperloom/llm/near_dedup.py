"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Each text becomes the set of its distinct shingles of five words, as 64-bit hashes, and a SuperMinHash signature:
   in round j every shingle puts j + (a uniform draw) at place j of its own random permutation of the registers.
   Values of later rounds are larger, so a text is done as soon as all its registers are taken.
2. Texts of equal sets are one class, whose smallest id stands for it from here on.
3. Signatures are cut into bands. Classes that share a band's registers are candidates; each band bucket is told by
   one star, never by its pairs. Components of the stars are the clusters in which links can be.
4. Each cluster's texts meet once. Clusters above a size are dealt out as pairs of blocks. In a task, all pairs whose sizes
   allow for the threshold and that share one of their rarest shingles (a pair that doesn't can't reach it) and that are not
   yet connected are tested on the full sets; only the links that join two groups leave the task.
5. The components of these links, over all clusters, are the result.

Bands and their rows follow from the threshold, so that a pair of exactly its similarity is missed with a chance of at most
``MISSED``; that is the only way to miss one.

Null and empty texts have no shingles and are linked with nothing. Repeated ids are compared like other rows, and
share their component. Of equal sets the smallest id stands for all, so ties have one result. Long texts are read whole, in
parts. An empty table gives an empty table. Other columns don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import UnionFind, components
from .shared import hashed_words, hot_join, mapped, mix, numbered, slices, spread, stored, table, window_hash

WORDS, PERCENT = 5, 85
#: The chance to miss a pair at the threshold, and the most registers of a signature.
MISSED, MOST_REGISTERS = 5e-6, 256
#: Texts and characters of a block; two blocks meet in a task.
BLOCK_TEXTS, BLOCK_CHARS = 1024, 8 << 20
#: Shingles whose permutations are held at once.
PART_SHINGLES = 1 << 17
_STEP, _NONE = np.uint64(0x9E3779B97F4A7C15), np.iinfo(np.uint64).max


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold: the longest bands that keep to ``MISSED`` and ``MOST_REGISTERS``."""
    if not 50 <= percent < 100:
        raise ValueError("the threshold must be from 50 to 99 percent")
    found = None
    for rows in range(1, MOST_REGISTERS + 1):
        bands = ceil(log(MISSED) / log1p(-((percent / 100) ** rows)))
        if bands * rows <= MOST_REGISTERS:
            found = bands, rows
    return found


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text k are hashes[first[k]:first[k + 1]]."""
    hashes, count = hashed_words(texts, lower=True)
    n = len(count) - 1
    length = np.diff(count)
    windows = window_hash(hashes, words)
    owner = np.repeat(np.arange(n), length)
    inside = owner[: len(windows)] == owner[words - 1 :] if len(windows) else np.zeros(0, bool)
    all_hashes, all_owners = [windows[inside]], [owner[: len(windows)][inside]]
    for k in np.flatnonzero((length > 0) & (length < words)):
        all_hashes.append(window_hash(hashes[count[k] : count[k + 1]], int(length[k])))
        all_owners.append(np.array([k]))
    h, o = np.concatenate(all_hashes), np.concatenate(all_owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.searchsorted(o[new], np.arange(n + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """SuperMinHash of each set: round number above 32 bits of draw; all ones for an empty set. The signature of a set is the
    least of its parts', so that large sets are read in parts."""
    out = np.full((len(first) - 1, registers), _NONE)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at in range(0, len(hashes), PART_SHINGLES):
        own = owner[at : at + PART_SHINGLES]
        rows = slice(own[0], own[-1] + 1)
        out[rows] = np.minimum(out[rows], _signatures(hashes[at : at + PART_SHINGLES], own - own[0], registers))
    return out


def _signatures(own: np.ndarray, owner: np.ndarray, registers: int) -> np.ndarray:
    out = np.full((owner[-1] + 1, registers), _NONE)
    place = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (len(own), 1))
    for j in range(registers):
        if not len(own):
            break
        draw = mix(own + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        pick = j + ((draw >> np.uint64(32)) * np.uint64(registers - j) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(own))
        taken = place[row, pick]
        place[row, pick] = place[:, j]
        np.minimum.at(out.reshape(-1), owner * registers + taken, np.uint64(j << 32) | (draw & np.uint64(0xFFFFFFFF)))
        going = (out == _NONE).any(axis=1)[owner]
        if not going.all():  # early stopping: later rounds can't lower a full signature
            own, owner, place = own[going], owner[going], place[going]
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, chars, bands) of each row."""
    many, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                texts = part.column(text_col)
                hashes, first = shingle_sets(texts)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
                sign = signatures(hashes, first, many * rows)
                key = np.zeros((len(sign), many), np.uint64)
                for r in range(rows):
                    key = mix(key * _STEP + sign[:, r * many : (r + 1) * many])
                key = mix(key + np.arange(many, dtype=np.uint64) * _STEP).view(np.int64)
                size = np.diff(first)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * many), pa.array(key.reshape(-1)))
                chars = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
                set_ab = [pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(size.astype(np.int64)), *set_ab, chars, bands], [id_col, "n_shingles", "set_a", "set_b", "chars", "bands"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).transform(mapped, run, f"{id_col} long, n_shingles long, set_a long, set_b long, chars long, bands array<long>")


def shared_prefixes(hashes: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """[i, j]: how many of the rarest shingles of set i are among those of set j. Of each set, as many count as a pair of
    that similarity can't miss all of: without common ones, too few are left to reach the threshold."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    _, shingle, often = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, often[shingle], owner))
    place = np.arange(len(order)) - np.repeat(first[:-1], size)
    few = size - -(-percent * size // 100) + 1
    kept = order[(place < few[owner]) & (often[shingle[order]] > 1)]
    kept = kept[np.argsort(shingle[kept], kind="stable")]
    edges = np.flatnonzero(np.diff(shingle[kept])) + 1
    out = np.zeros((len(size), len(size)), np.int32)
    for group in np.split(owner[kept], edges):
        if len(group) > 1:
            out[np.ix_(group, group)] += 1
    return out


def linked_pairs(ids: list[int], texts: list[str], side: np.ndarray, both: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join groups of these texts; ``both``: only pairs of different sides are wanted."""
    hashes, first = shingle_sets(pa.array(texts, pa.large_string()))
    sets = [hashes[first[k] : first[k + 1]] for k in range(len(ids))]
    size = np.diff(first)
    common = np.triu(shared_prefixes(hashes, first, percent), 1)
    if both:
        common[side[:, None] == side[None]] = 0
    i, j = np.nonzero(common)
    fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[fits], j[fits]
    order = np.argsort(-common[i, j] / np.minimum(size[i], size[j]), kind="stable")  # likely links first, as pairs of one group needn't be tested
    groups, links = UnionFind(), []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if groups.find(a) == groups.find(b):
            continue
        small, large = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        same = int((large[at] == small).sum())
        if 100 * same >= percent * (len(small) + len(large) - same):
            groups.union(a, b)
            links.append((ids[a], ids[b]))
    return links


def _links(clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (cluster, low, high, side, id, text), each (cluster, low, high) a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, sides = None, [], [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                found.extend(linked_pairs(ids, texts, np.array(sides), key[1] != key[2], percent))

        for batch in batches:
            for *new, side, i, text in zip(*[batch.column(c).to_pylist() for c in ("cluster", "low", "high", "side", "id", "text")], strict=True):
                if new != key:
                    close()
                    key, ids, texts, sides = new, [], [], []
                ids.append(i)
                texts.append(text or "")
                sides.append(side)
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    dealt = clusters.repartition(spread(clusters), "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.select("cluster", "low", "high", "side", "id", "text").transform(mapped, run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row, for near copies from that similarity on. Ids are integers."""
    rows = stored(_prepared(docs, id_col, text_col, percent)).withColumnRenamed(id_col, "id")
    same = ["set_a", "set_b", "n_shingles"]
    classes = rows.where("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.max_by(F.struct("bands", "chars"), F.lit(1)).alias("of"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select(*same, "rep", "copies", "of.bands", "of.chars"))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("__n")).where("lead < last").select("band", "lead", "__n")
    candidates = hot_join(banded, stars, ["band"], "__n").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    clusters = stored(components(candidates).join(classes.select(F.col("rep").alias("node"), "chars"), "node"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    sizes = clusters.groupBy("component").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("__n"))
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = hot_join(clusters, sizes, ["component"], "__n").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(F.col("component").alias("cluster"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", F.col("node").alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = components(stored(_links(placed.join(texts, "id"), percent)))
    labels = classes.select(*same, "rep", "copies").join(found, F.col("rep") == F.col("node"), "left")
    labels = labels.select(*same, F.coalesce("component", "rep").alias("component_id"), "copies")
    named = hot_join(rows.where("n_shingles > 0").select("id", *same), labels, same, "copies").select("id", "n_shingles", "component_id")
    out = named.unionByName(rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows that stay: one document of each group, with its columns."""
    gone = near_groups(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    rows, (own_id,) = numbered(docs, id_col)
    return rows.join(gone, F.col(own_id) == F.col("__gone"), "left_anti").toDF(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT t.doc_id, count(shingle) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
), m AS (SELECT a, min(b) AS own FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, own AS component_id, doc_id = own AS kept FROM n JOIN m ON a = doc_id
"""
