"""Byte-level BPE encoding and decoding with a rank queue over hierarchical bitmaps.

The queue has a bucket per merge rank; a bucket holds the positions, in a linked list of symbols, of the pairs that
merge at that rank. A bitmap of two levels marks the buckets in use, so that find-first-set gives the next rank in
constant time. Entries whose pair has changed since are skipped when they are taken out.

All new pre-tokens of a batch share one queue: no pair spans two of them, so each one's merges still come in the order
of their ranks, and a bucket is worked off at once in numpy. A pre-token of n bytes takes O(n) queue entries, so very
long pre-tokens are no special case.

Null and empty texts have no tokens and the digests of the empty string. Special tokens are ordinary text. Repeated
ids each keep their row; an empty table gives an empty table; only the id and text columns take part, so no other column
can clash. Long texts are read in parts, whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .shared import mapped, slices, table
from .tokens import WordCoder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Positions by rank. ``next`` takes out those of the smallest rank."""

    def __init__(self):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, int] = {}  # which of 256 ranks are in use
        self.top = 0  # which groups of 256 ranks are in use

    def put(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, low, high in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [positions[low:high]]
                group = rank >> 8
                self.low[group] = self.low.get(group, 0) | 1 << (rank & 255)
                self.top |= 1 << group
            else:
                bucket.append(positions[low:high])

    def next(self) -> tuple[int, np.ndarray] | None:
        """(rank, positions in order)"""
        if not self.top:
            return None
        # find-first-set on either level
        group = (self.top & -self.top).bit_length() - 1
        bits = self.low[group]
        bit = bits & -bits
        self.low[group] = bits ^ bit
        if bits == bit:
            self.top ^= 1 << group
        rank = group << 8 | bit.bit_length() - 1
        found = self.buckets.pop(rank)
        return rank, np.sort(found[0] if len(found) == 1 else np.concatenate(found))


class Vocabulary:
    """Ids of byte strings, and the rank and the id of each pair of ids that merges."""

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int]):
        by_id: list = [None] * (max(ids.values()) + 1)
        for raw, i in ids.items():
            by_id[i] = raw
        self.raws = pa.array(by_id, pa.large_binary())
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        rows = sorted((ids[x] << 32 | ids[y], rank, ids[x + y]) for (x, y), rank in pairs.items()) or [(-1, -1, -1)]
        self.keys, self.pair_rank, made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.made = np.full(self.pair_rank.max() + 1, -1)  # the id that a rank makes
        self.made[self.pair_rank] = made

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Vocabulary:
        """Of byte strings whose ids are their ranks: two merge where their joint string has a rank."""
        return cls(ranks, {(raw[:k], raw[k:]): rank for raw, rank in ranks.items() for k in range(1, len(raw)) if raw[:k] in ranks and raw[k:] in ranks})

    def singly(self, raw: bytes) -> np.ndarray:
        """The ids of one pre-token, one merge at a time: the leftmost pair of the smallest rank."""
        parts = self.single[np.frombuffer(raw, np.uint8)]
        while len(parts) > 1:
            rank = self.pairs(parts[:-1], parts[1:])
            if (rank < 0).all():
                break
            i = int(np.where(rank < 0, np.iinfo(np.int64).max, rank).argmin())
            parts = np.concatenate([parts[:i], [self.made[rank[i]]], parts[i + 2 :]])
        return parts.astype(np.uint32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.pair_rank[at], -1)

    def merged(self, raws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, end to end, and how many each has. None may be null or empty."""
        raws = pc.cast(raws, pa.large_binary())
        offset = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset : raws.offset + len(raws) + 1]
        size = np.diff(offset)
        symbol = self.single[np.frombuffer(raws.buffers()[2], np.uint8)[offset[0] : offset[-1]]]
        n = len(symbol)
        owner = np.repeat(np.arange(len(raws)), size)
        starts = np.ones(n + 1, bool)  # of pre-tokens, and the end
        starts[1:n] = owner[1:] != owner[:-1]
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        alive = np.ones(n, bool)
        due = np.full(n + 1, -1)  # the rank at which the pair that starts here is queued
        due[: n - 1] = np.where(starts[1:n], -1, self.pairs(symbol[:-1], symbol[1:]))
        queue, odd = RankQueue(), set()
        at = np.flatnonzero(due >= 0)
        if len(at):
            queue.put(due[at], at)
        while (found := queue.next()) is not None:
            rank, i = found
            keep = due[i] == rank  # others are stale: the pair has changed or gone
            keep[1:] &= i[1:] != i[:-1]
            i = i[keep]
            if not len(i):
                continue
            over = i[1:] == after[i[:-1]]  # pairs that share a symbol: every other one merges, from the left
            if over.any():
                place = np.arange(len(i))
                i = i[(place - np.maximum.accumulate(np.where(np.concatenate([[False], over]), 0, place))) % 2 == 0]
            j = after[i]
            k = after[j]
            symbol[i], alive[j], due[j], after[i], before[k] = self.made[rank], False, -1, k, i
            right = np.full(len(i), -1)
            inside = np.flatnonzero(~starts[k])
            right[inside] = self.pairs(symbol[i[inside]], symbol[k[inside]])
            due[i] = right
            with_left = i[~starts[i]]
            h = before[with_left]
            left = self.pairs(symbol[h], symbol[with_left])
            due[h] = left
            ranks, places = np.concatenate([right, left]), np.concatenate([i, h])
            keep = ranks >= 0
            if keep.any():
                ranks, places = ranks[keep], places[keep]
                if ranks.min() < rank:  # ranks that don't follow the order of merges
                    odd.update(owner[places[ranks < rank]].tolist())
                queue.put(ranks, places)
        ids, many = symbol[alive].astype(np.uint32), np.bincount(owner[alive], minlength=len(raws))
        wrong = {w: self.singly(raws[w].as_py()) for w in odd}
        if wrong:
            parts = np.split(ids, np.cumsum(many)[:-1])
            for w, own in wrong.items():
                parts[w] = own
            ids, many = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, many


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Codec:
    """Encodes texts to ids and back. A pre-token that is a token as a whole is that token, wherever its merges lead."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.of_ranks(load_ranks(path))
        self.raws = self.vocabulary.raws
        self.decimals = pa.array([f"{k}," for k in range(len(self.raws))], pa.large_string())
        self.coder = WordCoder(self._encoded)

    def _encoded(self, pre_tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, many = self.vocabulary.merged(pre_tokens)
        whole = pc.index_in(pc.cast(pre_tokens, pa.large_binary()), value_set=self.raws)
        wrong = np.flatnonzero((many > 1) & whole.is_valid().to_numpy(zero_copy_only=False))
        if len(wrong):
            ids = np.delete(ids, np.concatenate([np.arange(a + 1, a + m) for a, m in zip((np.cumsum(many) - many)[wrong].tolist(), many[wrong].tolist(), strict=True)]))
            many = many.copy()
            many[wrong] = 1
            ids[(np.cumsum(many) - many)[wrong]] = whole.take(pa.array(wrong)).to_numpy()
        return ids, many

    def encode(self, texts: list[str] | pa.Array) -> pa.ListArray:
        ids, first = self.coder.texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))

    def decode(self, ids: pa.ListArray) -> list[bytes | None]:
        """Null ids give null."""
        return [None if x is None else b"".join(self.raws.take(pa.array(x, pa.int64())).to_pylist()) for x in ids.to_pylist()]

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """For each text: number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the bytes that they decode to."""
        ids, first = self.coder.texts(texts)
        many = np.diff(first)
        said = []
        for names, extra in ((self.decimals, 1), (self.raws, 0)):
            out, low = [], 0
            while low < len(many):  # a run of texts at a time, as each id takes up to 80 bytes
                high = max(low + 1, int(np.searchsorted(first, first[low] + (1 << 20), "right")) - 1)
                joined = names.take(pa.array(ids[first[low] : first[high]]))
                offset = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
                ends = offset[first[low : high + 1] - first[low]].tolist()
                raw = memoryview(joined.buffers()[2] or b"")
                out.extend(hashlib.sha256(raw[a : max(a, b - extra)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False))
                low = high
            said.append(out)
        return many, *said


@cache
def codec(path: str) -> Codec:
    """One for each worker process, so that its caches serve all its tasks."""
    return Codec(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), own.encode(part.column(text_col))], [id_col, "ids"])

    return docs.select(id_col, text_col).transform(mapped, run, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, raw binary): the bytes that the ids stand for. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(own.decode(batch.column(ids_col)), pa.binary())], [id_col, "raw"])

    return tokens.select(id_col, ids_col).transform(mapped, run, f"{id_col} {dict(tokens.dtypes)[id_col]}, raw binary")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row; the ids don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                n, ids, raw = own.digests(part.column(text_col))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).transform(mapped, run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
