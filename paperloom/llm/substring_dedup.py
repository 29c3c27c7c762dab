"""Substring deduplication over words, by prefix-partitioned suffix trees.

A suffix starts at a word; it matters as far as the window of ``SPAN`` words that must repeat. A window belongs to its anchor:
the ``PREFIX`` consecutive words in it of smallest hash (the leftmost of equal ones). Equal windows have equal anchors at
equal places, and an anchor speaks for a run of windows, so that one row carries several suffixes.

1. Anchors are counted by their words. One that occurs once holds no repeat, and its suffixes end here.
2. The suffixes of repeated anchors, as words, form groups, one for each anchor. In a task, each group's suffix tree is built
   from the root by doubling: suffixes of a node of 2, 4, 8, 16 words and of a window share their first so many words, which
   are compared as words, not as hashes. The nodes at the depth of a window with several suffixes are the deep internal nodes;
   where they follow one another they spell a maximal repeat. All of a node's occurrences but the earliest are marked.
3. An anchor with more than ``GROUP`` suffixes is too large for a task. Its suffixes are dealt out by a salt; each part's
   nodes give their earliest occurrence to a group by the longest prefix there is, the whole window's 128-bit digest, of which
   each part sends one at most.
4. Marks go back to their documents, which drop the words that marked windows cover.

The texts are written once as a table bucketed by row, so that neither of the joins with them moves them again.

Null texts have no words, and empty and short ones no window. Each row is a document of its own, also where ids repeat: occurrences
come in the order of id and start, and equal windows at the same id and start aren't earlier than one another. Equal rows have equal
results. Texts are read whole. An empty
table gives an empty table. Other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .shared import hashed_words, mapped, scratch_dir, slices, spread, stored, table, window_hash, words_of

SPAN, PREFIX, GROUP = 20, 8, 4096
#: An anchor that has more than this share of all in repeats is salted, so that its rows aren't joined in one task.
HEAVY = 1 / 1024
#: Anchors whose words leave a task at once.
ANCHORS = 1 << 15


def anchors(words: np.ndarray, count: np.ndarray, window: int = SPAN, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first, last): for each anchor its hash, text number and place there, and its windows' first and
    last start; of the words' hashes and the words before each text."""
    n = len(words) - window + 1
    grams = window_hash(words, prefix)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    owner = np.repeat(np.arange(len(count) - 1), np.diff(count))
    span = window - prefix + 1
    # the upper half of the hash, then the place: the least is the leftmost of the smallest
    least, wide = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64), 1
    while wide * 2 <= span:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    at = (np.minimum(least[:n], least[span - wide : span - wide + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    at = at[start]
    text = owner[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(at)) - 1 if len(edge) else edge
    own = text[edge]
    return grams[at[edge]], own, at[edge] - count[own], start[edge] - count[own], start[last] - count[own]


def _bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) as a table bucketed by row, in the shared folder; row: a number of its own."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.write.bucketBy(spread(docs), "row").option("path", f"{scratch_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, text, place, *_ = anchors(*hashed_words(part.column("text"), lower=False))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column("row").take(pa.array(text)), pa.array(place.astype(np.int32))], ["prefix", "row", "place"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, row, id, first, hot, words) of each repeated anchor of the text; words: those of its windows, the first at ``first``."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashed, count = hashed_words(part.column("text"), lower=False)
            hashes, text, place, first, last = anchors(hashed, count)
            if not len(hashes):
                continue
            # repeated anchors by (text, place); hot ones have the place's complement
            listed = part.column("places")
            lengths = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hot = flat < 0
            code = np.repeat(np.arange(len(lengths)), lengths) << 32 | np.where(hot, ~flat, flat)
            order = np.argsort(code)
            code, hot = code[order], hot[order]
            own = text << 32 | place
            at = np.minimum(np.searchsorted(code, own), len(code) - 1)
            kept = np.flatnonzero(code[at] == own)
            words, _ = words_of(part.column("text"))
            for low in range(0, len(kept), ANCHORS):
                keep = kept[low : low + ANCHORS]
                many = (last - first)[keep] + SPAN
                ends = np.cumsum(many)
                base = np.repeat((count[text] + first)[keep] - (ends - many), many) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pc.cast(words.take(pa.array(base)), pa.string()))
                chosen = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[keep].view(np.int64)), part.column("row").take(chosen), part.column("id").take(chosen), pa.array(first[keep].astype(np.int32)), pa.array(hot[at[keep]]), pc.binary_join(lists, " ")],
                    ["prefix", "row", "id", "first", "hot", "words"],
                )


def tree_nodes(words: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The node that each suffix of a sequence of words (as numbers) lies below at the depth of ``span`` words, by doubling."""
    node, depth = words, 1
    while depth < span:
        step = min(depth, span - depth)
        pair = node[: len(node) - step] * (int(node.max(initial=0)) + 1) + node[step:]
        node = np.unique(pair, return_inverse=True)[1]
        depth += step
    return node


def _group_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks (row, low, high), ranges of window starts, of the rows, which come by prefix and salt; whole groups are
    treated together. The nodes of a group that is one of several of its prefix come as well, with their windows' digest."""

    def marks(part: pa.RecordBatch) -> pa.RecordBatch:
        words, count = words_of(part.column("words"))
        number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        many = np.diff(count)
        prefix, salt = part.column("prefix").to_numpy(), part.column("salt").to_numpy()
        group = np.concatenate([[0], np.cumsum((prefix[1:] != prefix[:-1]) | (salt[1:] != salt[:-1]))])
        node = tree_nodes(number)
        row = np.repeat(np.arange(len(many)), many)[: len(node)]
        offset = np.arange(len(node)) - count[row]
        inside = np.flatnonzero(offset <= many[row] - SPAN)  # suffixes that are as long as a window
        node, row, offset = node[inside], row[inside], offset[inside]
        ids, start = part.column("id").to_numpy()[row], part.column("first").to_numpy()[row] + offset
        order = np.lexsort((start, ids, node, group[row]))
        g, w, i, s, r, place = group[row][order], node[order], ids[order], start[order], row[order], inside[order]
        same = np.zeros(len(order), bool)
        same[1:] = (g[1:] == g[:-1]) & (w[1:] == w[:-1])  # below the same deep node as the one before
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = same & ((i != i[head]) | (s != s[head]))
        numbers = part.column("row").to_numpy()[r]
        nodes = np.flatnonzero((s == s[head]) & (i == i[head]) & (salt[r] >= 0))  # earliest ones; of equal id and start, each row
        m, low = numbers[later], s[later]
        order = np.lexsort((low, m))
        m, low = m[order], low[order]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (low[1:] > low[:-1] + 1)
        edge = np.flatnonzero(new)
        high = low[np.append(edge[1:], len(m)) - 1] if len(edge) else low
        text = words.take(pa.array((place[nodes][:, None] + np.arange(SPAN)).reshape(-1))).to_pylist()
        digest = [xxh3_128_digest("\n".join(text[k : k + SPAN]).encode("utf-8", "surrogatepass")) for k in range(0, len(text), SPAN)]
        none = pa.nulls(len(edge), pa.int64())
        columns = [np.concatenate([m[edge], numbers[nodes]]), np.concatenate([low[edge], s[nodes]]).astype(np.int32), np.concatenate([high, s[nodes]]).astype(np.int32)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.concat_arrays([none, pa.array(i[nodes])]), pa.array([*[None] * len(edge), *digest], pa.binary())], ["row", "low", "high", "id", "window"]
        )

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        prefix, salt = batch.column("prefix").to_numpy(), batch.column("salt").to_numpy()
        other = np.flatnonzero((prefix != prefix[-1]) | (salt != salt[-1]))
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield marks(batch.slice(0, done))
        held = batch.slice(done)
    if held is not None:
        yield marks(held)


def repeat_marks(texts: DataFrame) -> DataFrame:
    """(row, low, high): ranges of the starts, in each row, of windows whose words also start earlier."""
    found = texts.select("row", "text").transform(mapped, _anchor_rows, "prefix long, row long, place int")
    sizes = stored(found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    heavy = sizes.where(F.col("n") > HEAVY * (sizes.agg(F.sum("n")).first()[0] or 0))  # at most 1 / HEAVY rows
    place = F.when(F.col("n") > GROUP, F.bitwise_not("place")).otherwise(F.col("place"))
    parts = spread(texts)
    hot = F.broadcast(heavy.select("prefix", F.lit(True).alias("hot")))
    dealt = found.join(hot, "prefix", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "place"), F.lit(parts)).cast("int")).otherwise(0)).drop("hot")
    told = sizes.join(hot, "prefix", "left").select("prefix", "n", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    by_text = dealt.join(told, ["prefix", "part"]).groupBy("row").agg(F.collect_list(place).alias("places"))  # at most one for each word of a text
    suffixes = texts.join(by_text, "row").select("row", "id", "text", "places").transform(mapped, _suffix_rows, "prefix long, row long, id long, first int, hot boolean, words string")
    salted = suffixes.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "first"), F.lit(parts)).cast("int")).otherwise(-1))
    trees = salted.repartition(parts, "prefix", "salt").sortWithinPartitions("prefix", "salt")
    marks = stored(trees.select("prefix", "row", "id", "first", "salt", "words").transform(mapped, _group_marks, "row long, low int, high int, id long, window binary"))
    nodes = marks.where("window is not null")  # of each window at most one place for each salt
    earlier = Window.partitionBy("window").orderBy("id", "low")
    more = nodes.withColumn("rank", F.rank().over(earlier)).where("rank > 1")
    return marks.where("window is null").select("row", "low", "high").unionByName(more.select("row", "low", "high"))


def _kept_words(text: str | None, marks, window: int = SPAN) -> tuple[list[bytes], int]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # ASCII white space
    if not marks:
        return words, 0
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, [x["low"] for x in marks], 1)
    np.add.at(cover, np.minimum([x["high"] + window for x in marks], len(words)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    return list(compress(words, keep.tolist())), int(len(words) - keep.sum())


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, n_removed): the kept words of each row joined by single spaces."""
    return _finished(docs, id_col, text_col, "text string", lambda kept: kept.decode("utf-8", "surrogatepass"))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row."""
    return _finished(docs, id_col, text_col, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _finished(docs: DataFrame, id_col: str, text_col: str, column: str, make) -> DataFrame:
    texts = _bucketed(docs, id_col, text_col)
    marks = repeat_marks(texts).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("marks"))  # at most one for each word
    marked = texts.join(marks, "row", "left")
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [(len(kept) + gone, gone, make(b" ".join(kept))) for kept, gone in map(_kept_words, part.column("text").to_pylist(), part.column("marks").to_pylist())]
                n, gone, made = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(made, pa.string())], [id_col, "n_words", "n_removed", name])

    return marked.select("id", "text", "marks").transform(mapped, run, f"{id_col} long, n_words long, n_removed long, {column}")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM t, unnest(range(1, greatest(len(w) - 18, 1))) AS u(i)
), g AS (
  SELECT DISTINCT doc_id, i + k AS at FROM v, unnest(range(20)) AS u(k) WHERE again
), k AS (
  SELECT t.doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) FILTER (g.at IS NULL) AS kept, count(g.at) AS gone
  FROM t, unnest(range(1, len(w) + 1)) AS u(i) LEFT JOIN g ON g.doc_id = t.doc_id AND g.at = i GROUP BY 1
)
SELECT t.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
