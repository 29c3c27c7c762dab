"""Collocations: phrases whose words stand together far more often than their parts alone would make them.

1. Words are counted exactly. A table of bounds by the hash of a word (``CELLS`` at most) tells for each word how often it occurs at least
   and at most.
2. A floor for the scores of each group, by the number of its words. A phrase that scores it has at least that share of all occurrences of its
   first word, and of its last: the other part of either cut occurs no less often than the phrase. So where the bounds of its words leave no
   room for that share, or for ``least``, a phrase is not looked at. Groups of few words have no floor.
3. A sketch: each task hashes the phrases of 2 to ``longest`` words that are left into counters, which are summed block by block. A phrase's
   counter is an upper bound of its frequency. What is left of the sketch is a byte for each counter, an upper bound of it in steps of about
   a tenth; its width follows the size of the texts up to ``WIDEST`` (64 MB, which is what the driver gathers and broadcasts at most). Where
   counters are crowded, more phrases pass; that costs time and shuffling, but the counts that follow are exact.
4. Each task compiles the phrases of its shard of texts that pass into an automaton, with a blank as guard on both sides of a phrase, and
   scans the shard with it; all overlapping matches count. A piece's end is a word of its own that is in no phrase, so that none
   reaches over it. Sums over all shards are exact. For groups with a floor a second scan counts, in the same way, the parts of the
   phrases that may score it and the longer phrases around them.
5. Parts of phrases find their frequencies by a join; parts of many phrases are joined by broadcast (at most 1,024 of them), so that
   no key gathers in a task. The first of each group are taken in rounds of ever fewer salts. A group whose last one scores less than its
   floor, or which has too few, is done again with a lower floor, in the end with none: what is returned never depends on the floors.

The arithmetic is in whole decimals of 38 digits. Null texts are empty; a null group is ``und``; repeated rows count each. Ties go by
frequency, then by the phrase in the order of its UTF-8 bytes. Texts are read whole, whatever their length. An empty table, or one
without phrases that are frequent enough, gives no rows. Only the text and the group take part, so that no other column can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .shared import cut, give_back, hot_join, mapped, mix, or_empty, slices, spread, table

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2_000
#: Counters of the sketch: at most, at least, and bytes of text for each.
WIDEST, NARROWEST, BYTES_A_COUNTER = 1 << 26, 1 << 16, 4
#: Cells of the table of words' bounds at most; cells for each word.
CELLS, CELLS_A_WORD = 1 << 22, 4
#: Counters of a block, in which they are sent and added.
BLOCK = 1 << 20
#: Bytes of text of a shard that is scanned at once; numbers that a task holds before it sends them.
SHARD, HELD = 6 << 20, 4 << 20
#: Words of a group from which it starts with a floor for its scores, in millionths as scores are; the highest first.
FLOORS = [(20_000_000, 125_000), (3_000_000, 8_000)]
#: What a byte of text counts as: letters in lower case, one blank for all, and one end of a piece for all.
_BLANK, _END = 0x20, 0x0A
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[0x09], _SEEN[[*b".,;:!?\n\x0b\f\r"]] = _BLANK, _END
_BETWEEN = np.flatnonzero(np.isin(_SEEN, [_BLANK, _END])).astype(np.uint8).tobytes()
#: Frequencies and bounds are told up to here; beyond, as this.
_MOST = (1 << 32) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Flags of phrases that the second scan looks for.
_AROUND, _PART = 1, 2


def seed_of(group: str) -> np.uint64:
    return np.uint64(xxh3_64_intdigest(group))


def hashes_of(words: pa.Array) -> np.ndarray:
    """A hash of each word, none of them empty: the sum of a number for each of its bytes at its place."""
    words = pc.cast(words, pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts = offsets[:-1] - offsets[0]
    places = np.arange(len(letters), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), np.diff(offsets))
    return mix(np.add.reduceat(mix(_BASE + (places << np.uint64(8)) + letters), starts))


def phrase_hash(seed: np.ndarray | np.uint64, hashes: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(hashes[0]), np.uint64) + seed + np.uint64(len(hashes))
    for own in hashes:
        h = mix(h + own)
    return h


def _width(most: int, wanted: int) -> int:
    """A power of two from NARROWEST on, about as many as wanted."""
    width = NARROWEST
    while width < min(most, wanted):
        width *= 2
    return width


def levels(least: int) -> np.ndarray:
    """The frequencies that a byte of the sketch stands for: below ``least`` at first, then in steps of about a tenth."""
    return np.array([least - 1, *np.ceil(np.geomspace(least, 1 << 40, 254)).astype(np.int64), np.iinfo(np.int64).max], np.int64)


class Shard:
    """The words of some texts of one group as numbers of distinct words, with the number of the piece that each stands in."""

    def __init__(self, texts: pa.Array):
        texts = pc.cast(texts, pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
        seen = np.insert(np.frombuffer(data.translate(_SEEN.tobytes()), np.uint8), offsets - offsets[0], _END)  # an end first and last
        inside = (seen != _BLANK) & (seen != _END)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.sizes = edges[1::2] - edges[::2]
        self.pieces = np.cumsum(seen == _END, dtype=np.int32)[edges[::2]]
        self.letters = np.frombuffer(data.translate(_SEEN.tobytes(), _BETWEEN), np.uint8)
        starts = np.zeros(len(self.sizes) + 1, np.int64)
        np.cumsum(self.sizes, out=starts[1:])
        coded = pa.LargeStringArray.from_buffers(len(self.sizes), pa.py_buffer(starts), pa.py_buffer(self.letters)).dictionary_encode()
        self.words, self.numbers = coded.dictionary, coded.indices.to_numpy()

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashes_of(self.words)

    def text(self, taken: np.ndarray) -> str:
        """The words that are taken with a blank on both sides of each; between pieces and where words are left out, an end with blanks as well."""
        at = np.flatnonzero(taken)
        ends = np.append((np.diff(self.pieces[at]) > 0) | (np.diff(at) > 1), False)
        sizes, gaps = self.sizes[at], 1 + 2 * ends.astype(np.int64)
        before = np.cumsum(gaps) - gaps + 1
        letters = self.letters if len(at) == len(taken) else self.letters[np.repeat(taken, self.sizes)]
        out = np.full(int(gaps.sum()) + len(letters) + 1, _BLANK, np.uint8)
        out[np.arange(len(letters)) + np.repeat(before, sizes)] = letters
        out[(np.cumsum(sizes) + before + 1)[ends]] = _END
        return out.tobytes().decode()

    def whole(self, size: int) -> np.ndarray:
        """Whether a phrase of that many words starts at each place, as far as there may be one."""
        n = max(0, len(self.numbers) - size + 1)
        return self.pieces[:n] == self.pieces[size - 1 :][:n]

    def phrases(self, at: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
        """The hashes of the phrases of that many words at those places."""
        return phrase_hash(seed, [self.hashes[self.numbers[at + k]] for k in range(size)])

    def distinct(self, at: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
        """One place of each distinct phrase; equal hashes of different ones would lose one, so the words decide."""
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        new = np.ones(len(at), bool)
        same = h[1:] == h[:-1]
        for k in range(size):
            same &= self.numbers[at[1:] + k] == self.numbers[at[:-1] + k]
        new[1:] = ~same
        return at[new]

    def spelled(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases at those places, with a blank on both sides."""
        parts = [self.words.take(pa.array(self.numbers[at + k])) for k in range(size)]
        blank = pa.scalar("", pa.large_string())
        return pc.binary_join_element_wise(blank, *parts, blank, pa.scalar(" ", pa.large_string()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """(group, shard) of the batches' texts, gathered up to about SHARD bytes."""

    def told(held: list[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        groups, texts = rows.column("group"), rows.column("text")
        for group in pc.unique(groups).to_pylist():
            yield group, Shard(pa.concat_arrays(texts.filter(pc.equal(groups, group)).chunks))
        give_back()

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", SHARD):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= SHARD:
                yield from told(held)
                held, size = [], 0
    if held:
        yield from told(held)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(group, phrase, n) of the words that occur ``least`` times; the number of all words of a group stands there as that of the empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            yield from pa.concat_tables(held).group_by(["group", "phrase"]).aggregate([("n", "sum")]).rename_columns(["group", "phrase", "n"]).to_batches()

        for group, shard in _shards(batches):
            times = np.bincount(shard.numbers, minlength=len(shard.words))
            names = pa.concat_arrays([shard.words, pa.array([""], pa.large_string())])
            held.append(pa.table({"group": pa.array([group] * len(names), pa.string()), "phrase": pc.cast(names, pa.string()), "n": np.append(times, times.sum()).astype(np.int64)}))
            size += len(names)
            if size >= HELD // 8:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    summed = texts.transform(mapped, count, "group string, phrase string, n long").groupBy("group", "phrase").agg(F.sum("n").alias("n"))
    return cut(summed.where((F.col("phrase") == "") | (F.col("n") >= least)))


def gathered(parts: DataFrame, width: int, kind: str, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], start: int, told: Callable[[np.ndarray], np.ndarray], tasks: int) -> np.ndarray:
    """An array of ``width`` cells, made block by block. parts: (block, cells), see :func:`_packed`. ``add`` takes what a block has so far, places
    in it (each once) and their numbers; ``told`` makes the bytes that the driver gathers of what it has in the end."""
    size = min(BLOCK, width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        row = lambda: pa.RecordBatch.from_pydict({"block": pa.array([current], pa.int32()), "cells": [told(total).astype(kind).tobytes()]})
        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if k != current:
                    if current is not None:
                        yield row()
                    current, total = k, np.full(size, start, np.int64)
                n = int.from_bytes(packed[:4], "little")
                both = np.frombuffer(pa.decompress(packed[4:], 8 * n, "zstd", asbytes=True), np.uint32)
                add(total, both[:n], both[n:].astype(np.int64))
        if current is not None:
            yield row()

    blocks = width // size
    dealt = parts.repartition(min(blocks, tasks), "block").sortWithinPartitions("block")
    cells = np.tile(told(np.full(size, start, np.int64)).astype(kind), (blocks, 1))
    for row in dealt.transform(mapped, summed, "block int, cells binary").toLocalIterator():
        cells[row["block"]] = np.frombuffer(row["cells"], kind)
    return cells.reshape(-1)


def _packed(cells: np.ndarray, numbers: np.ndarray, width: int, size: int) -> Iterator[pa.RecordBatch]:
    """(block, cells) of distinct cells in order and their numbers, by blocks of a size."""
    bounds = np.searchsorted(cells, np.arange(width // size + 1, dtype=np.uint64) * np.uint64(size))
    for k in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[k], bounds[k + 1])
        both = np.concatenate([cells[own] - np.uint64(k * size), np.minimum(numbers[own], _MOST)]).astype(np.uint32)
        packed = (len(both) // 2).to_bytes(4, "little") + pa.compress(both.tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "cells": [packed]})


PACKED = "block int, cells binary"


def _by_cell(cells: np.ndarray, numbers: np.ndarray, fold: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the numbers of each folded."""
    order = np.argsort(cells, kind="stable")
    cells, numbers = cells[order], numbers[order]
    first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + np.uint64(1)))
    return cells[first], fold.reduceat(numbers, first) if len(first) else numbers


def _keys(batch: pa.RecordBatch) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of the phrases of a batch (group, phrase, n), the seeds of their groups, and n."""
    seeds = {g: seed_of(g) for g in pc.unique(batch.column("group")).to_pylist()}
    return [x.split(" ") for x in batch.column("phrase").to_pylist()], np.array([seeds[g] for g in batch.column("group").to_pylist()], np.uint64), batch.column("n").to_numpy()


def bounds_of_words(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(at least, at most): bounds for the frequency of each word of :func:`word_counts` by its cell, 0 for a cell without any. They hold for all
    words that occur often enough, and no phrase of another word is a candidate."""
    width = _width(CELLS, CELLS_A_WORD * counted.count())
    size = min(BLOCK, width)

    def cells(fold: np.ufunc) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, seeds, n = _keys(batch)
                yield from _packed(*_by_cell(_cell(hashes_of(batch.column("phrase")), seeds, width), n, fold), width, size)

        return run

    words, tasks = counted.where("phrase <> ''"), spread(counted)

    def lower(total: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        total[at] = np.minimum(total[at], n)

    def higher(total: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        total[at] = np.maximum(total[at], n)

    low = gathered(words.transform(mapped, cells(np.minimum), PACKED), width, "<u4", lower, _MOST + 1, lambda x: np.where(x > _MOST, 0, x), tasks)
    return low, gathered(words.transform(mapped, cells(np.maximum), PACKED), width, "<u4", higher, 0, lambda x: x, tasks)


def _cell(hashes: np.ndarray, seed: np.ndarray | np.uint64, width: int) -> np.ndarray:
    return mix(hashes + seed) & np.uint64(width - 1)


class Bounds:
    """What the bounds of its words leave of a phrase. floors: by group, 0 for others."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floors: dict[str, int], least: int):
        self.low, self.high, self.floors, self.least = low, high, floors, least

    def needed(self, first: np.ndarray, last: np.ndarray, floor: int) -> np.ndarray:
        """How often a phrase must occur that may score the floor, by lower bounds of its first and last word."""
        return np.maximum(self.least, -(-np.maximum(first, last) * floor // 10**6))

    def places(self, shard: Shard, group: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, place, needed) of the phrases of 2 to ``longest`` words that are left."""
        cells = _cell(shard.hashes, seed_of(group), len(self.low))
        low, high = self.low[cells].astype(np.int64)[shard.numbers], self.high[cells].astype(np.int64)[shard.numbers]
        for size in range(2, longest + 1):
            n, floor = len(shard.whole(size)), self.floors.get(group, 0)
            rarest = high[:n]
            for k in range(1, size):
                rarest = np.minimum(rarest, high[k : k + n])
            needed = self.needed(low[:n], low[size - 1 :][:n], floor)
            at = np.flatnonzero(shard.whole(size) & (rarest >= needed))
            yield size, at, needed[at]


def sketch(texts: DataFrame, width: int, longest: int, bounds) -> np.ndarray:
    """A byte for each of ``width`` counters (a power of two): the level, of :func:`levels`, of the number of phrases that fell into it.
    bounds: broadcast."""

    block = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            yield from _packed(*np.unique(np.concatenate(held), return_counts=True), width, block)

        for group, shard in _shards(batches):
            for k, at, _ in bounds.value.places(shard, group, longest):
                held.append(shard.phrases(at, k, seed_of(group)) & np.uint64(width - 1))
                size += len(at)
            if size >= HELD:
                yield from told()
                held, size = [], 0
        if size:
            yield from told()

    def add(total: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        total[at] += n

    steps = levels(bounds.value.least)
    return gathered(texts.transform(mapped, count, PACKED), width, "u1", add, 0, lambda x: np.searchsorted(steps, x), spread(texts))


def scanned(texts: DataFrame, wanted: Callable[[Shard, str], list[tuple[int, np.ndarray, np.ndarray]]], least: int) -> DataFrame:
    """(group, phrase, n) of the phrases that occur ``least`` times among those wanted: (size, place, hash) in a shard of a group. Whether a
    phrase is wanted must not depend on the shard. All of its places are, so only words of such places are scanned."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, shard in _shards(batches):
            found, taken = [pa.array([], pa.large_string())], np.zeros(len(shard.numbers), bool)
            for k, at, h in wanted(shard, group):
                found.append(shard.spelled(shard.distinct(at, k, h), k))
                for j in range(k):
                    taken[at + j] = True
            phrases = pa.concat_arrays(found)
            if not len(phrases):
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, phrase in enumerate(phrases.to_pylist()):
                automaton.add_word(phrase, number)
            automaton.make_automaton()
            counts = np.bincount(np.fromiter((number for _, number in automaton.iter(shard.text(taken))), np.int64), minlength=len(phrases))
            names = pc.cast(pc.utf8_slice_codeunits(phrases, 1, -1), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(names), pa.string()), names, pa.array(counts)], ["group", "phrase", "n"])

    summed = texts.transform(mapped, scan, "group string, phrase string, n long").groupBy("group", "phrase").agg(F.sum("n").alias("n"))
    return cut(summed.where(F.col("n") >= least))


def phrase_counts(texts: DataFrame, width: int, longest: int, low: np.ndarray, high: np.ndarray, floors: dict[str, int], least: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, counted), both (group, phrase, n) of phrases of 2 to ``longest`` words that occur ``least`` times. The candidates are, at
    least, all that score the floor of their group; all of their parts, and of the longer phrases around them, are counted."""
    spark = texts.sparkSession.sparkContext
    bounds = spark.broadcast(Bounds(low, high, floors, least))
    shared = spark.broadcast(sketch(texts, width, longest, bounds))

    def likely(shard: Shard, group: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
        found, steps = [], levels(least)
        for k, at, needed in bounds.value.places(shard, group, longest):
            h = shard.phrases(at, k, seed_of(group))
            some = steps[shared.value[h & np.uint64(width - 1)]] >= needed
            found.append((k, at[some], h[some]))
        return found

    first = scanned(texts, likely, least)
    if not floors:
        return first, first

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, seeds, n = _keys(batch)
            ends = [bounds.value.low[_cell(hashes_of(pa.array([w[at] for w in words], pa.string())), seeds, len(low))].astype(np.int64) for at in (0, -1)]
            floor = np.array([floors.get(g, 0) for g in batch.column("group").to_pylist()], np.int64)
            yield batch.filter(pa.array(n >= bounds.value.needed(*ends, floor)))

    candidates = cut(first.transform(mapped, chosen, "group string, phrase string, n long"))
    own = candidates.where(F.col("group").isin(list(floors)))
    space = _width(WIDEST, 64 * own.count())
    block = min(BLOCK, space)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looked = []
            for w, seed in zip(*_keys(batch)[:2], strict=True):
                looked += [(len(w), seed, w, _AROUND)] * (len(w) < longest) + [(len(x), seed, x, _PART) for k in range(1, len(w)) for x in (w[:k], w[k:]) if len(x) > 1]
            for size in range(2, longest):
                own = [x for x in looked if x[0] == size]
                if own:
                    hashes = hashes_of(pa.array([y for x in own for y in x[2]], pa.string())).reshape(-1, size)
                    cells = phrase_hash(np.array([x[1] for x in own], np.uint64), list(hashes.T)) & np.uint64(space - 1)
                    yield from _packed(*_by_cell(cells, np.array([x[3] for x in own], np.int64), np.bitwise_or), space, block)

    def add(total: np.ndarray, at: np.ndarray, flag: np.ndarray) -> None:
        total[at] |= flag

    marks = spark.broadcast(gathered(own.transform(mapped, flagged, PACKED), space, "u1", add, 0, lambda x: x, spread(texts)))

    def beside(shard: Shard, group: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
        cells = _cell(shard.hashes, seed_of(group), len(low))
        frequent = (bounds.value.high[cells] >= least)[shard.numbers]
        whole = {k: shard.whole(k) for k in range(2, longest + 1)}
        for k, own in whole.items():
            for j in range(k):
                own &= frequent[j : j + len(own)]
        taken = {k: np.zeros(len(own), bool) for k, own in whole.items()}
        for k in range(2, longest):
            at = np.flatnonzero(whole[k])
            flag = marks.value[shard.phrases(at, k, seed_of(group)) & np.uint64(space - 1)]
            taken[k][at[flag & _PART > 0]] = True
            inner = at[flag & _AROUND > 0]
            for m in range(k + 1, longest + 1):
                for start in range(m - k + 1):
                    around = inner - start
                    around = around[(around >= 0) & (around < len(taken[m]))]
                    taken[m][around] = True
        found = []
        for k, own in taken.items():
            at = np.flatnonzero(own & whole[k])
            found.append((k, at, shard.phrases(at, k, seed_of(group))))
        return found

    second = scanned(texts.where(F.col("group").isin(list(floors))), beside, least)
    return candidates, first.unionByName(second).groupBy("group", "phrase").agg(F.max("n").alias("n"))


def first_of_groups(rows: DataFrame, group: str, order: list, many: int) -> DataFrame:
    """The first ``many`` rows of each group, with ``rank`` from 1; dealt out by a salt in rounds, so that no task sorts a whole group."""
    salts, salt = spread(rows), F.col("__salt")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    while salts > 1:
        part = Window.partitionBy(group, salt).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= many).drop("rank")
        salts //= 16
        rows = rows.withColumn("__salt", salt % max(1, salts))
    return rows.drop("__salt").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= many)


def score() -> Column:
    """floor(1000000 * a * a / (l * r)), exactly."""
    whole = "cast({} as decimal(19, 0))".format
    return F.expr(f"{whole('a')} * {whole('a')} * 1000000 div ({whole('l')} * {whole('r')})")


def collocations(
    docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each group. ``covered``: the percentage
    of a phrase's occurrences from which a longer phrase around it replaces it."""
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"), or_empty(F.col(text_col)).alias("text"))
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = _width(WIDEST, bytes_ // BYTES_A_COUNTER)
    counted = word_counts(texts, least)
    low, high = bounds_of_words(counted)
    words, sizes = counted.where("phrase <> ''"), counted.where("phrase = ''").select("group", "n")
    # few groups have so many words
    floors = {r["group"]: next(floor for some, floor in FLOORS if r["n"] >= some) for r in sizes.where(F.col("n") >= FLOORS[-1][0]).toLocalIterator()}
    done, left = [], texts
    while True:
        best = best_of_groups(left, words, width, longest, low, high, floors, least, covered, top)
        if not floors:
            break
        best = cut(best)
        whole = [r["group"] for r in best.where((F.col("rank") == top) & F.col("group").isin(list(floors))).toLocalIterator() if r["score"] >= floors[r["group"]]]
        lower = [*[floor for _, floor in FLOORS], 0]
        floors = {group: lower[lower.index(floor) + 1] for group, floor in floors.items() if group not in whole}
        done.append(best.where(~F.col("group").isin(list(floors))))
        if not floors:
            best = None
            break
        left = texts.where(F.col("group").isin(list(floors)))
        floors = {group: floor for group, floor in floors.items() if floor}
    for part in done:
        best = part if best is None else best.unionByName(part)
    return best.join(sizes, "group").select(F.col("group").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")


def best_of_groups(
    texts: DataFrame, words: DataFrame, width: int, longest: int, low: np.ndarray, high: np.ndarray, floors: dict[str, int], least: int, covered: int, top: int
) -> DataFrame:
    """(group, rank, phrase, a, l, r, score) of the first ``top`` phrases among those that may score their group's floor."""
    candidates, longer = phrase_counts(texts, width, longest, low, high, floors, least)
    counted = words.unionByName(longer)
    own = candidates.withColumn("w", F.split("phrase", " ")).withColumnRenamed("n", "a")
    joined = lambda at, many: F.array_join(F.slice("w", at, many), " ")
    # both parts of each cut, with the frequency of each
    halves = lambda k: F.array(F.struct(k.alias("k"), F.lit(True).alias("is_left"), joined(1, k).alias("part")), F.struct(k.alias("k"), F.lit(False).alias("is_left"), joined(k + 1, F.size("w") - k).alias("part")))
    cuts = own.select("group", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), halves))).alias("x")).select("group", "phrase", "a", "x.*")
    sizes = cuts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("__n")).join(counted.withColumnRenamed("phrase", "part"), ["group", "part"])
    valued = hot_join(cuts, sizes, ["group", "part"], "__n")
    side = lambda left: F.max(F.when(F.col("is_left") == left, F.col("n")))
    scored = valued.groupBy("group", "phrase", "k").agg(F.max("a").alias("a"), side(True).alias("l"), side(False).alias("r"))
    scored = scored.withColumn("score", score())
    best = scored.groupBy("group", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("x")).select("group", "phrase", "a", "x.*")
    # the most frequent longer phrase around each
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda at: joined(at, m))))
    around = longer.withColumn("w", F.split("phrase", " ")).withColumnRenamed("n", "a").where(F.size("w") > 2).select("group", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("group", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["group", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    return first_of_groups(kept, "group", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
spoken as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) as n from spoken group by lang),
phrases as (
  select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, count(*) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from spoken, (values (1), (2), (3)) sizes(m))
  group by all having count(*) >= 10),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from phrases where m > 1),
cuts as (select lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as p, array_to_string(list_slice(w, k + 1, m), ' ') as q
  from (select *, unnest(range(1, m)) as k from candidates)),
scored as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r,
         cast((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as bigint) as score
  from cuts c join phrases x on x.lang = c.lang and x.phrase = c.p join phrases y on y.lang = c.lang and y.phrase = c.q),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
around as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) as phrase from candidates where m = 3)
  group by all),
kept as (select b.* from best b left join around o on o.lang = b.lang and o.phrase = b.phrase where o.longer is null or 100 * o.longer < 50 * b.a)
select kept.lang, rank, phrase, a, l, r, total.n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) kept
join total on total.lang = kept.lang where rank <= 2000
"""
