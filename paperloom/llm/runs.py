"""Periodic runs of words, by Lyndon words under both orders.

A run is a stretch of words with a smallest period q that no neighbouring word extends, and of length max(LEAST, EXPONENT * q) at
least. Every run holds, under the order of words or under its reverse, the longest Lyndon word that starts at a place as one of its
periods. So a stack of Lyndon words is filled from right to left under each order; each place's longest Lyndon word gives a period,
and the places that keep it are followed to either side. Suffixes are compared, and runs extended, by their longest common
extensions: a few words are compared directly, then lengths by bisection over rolling hashes (modulo 2^61 - 1); an extension at the
same distance as at the place before is one longer. Each run's words are compared directly in the end, and a text where that or the
word after an extension disagrees with a hash is read again with extensions by words alone.

The scan is spent where a run can be: in a run, windows of three words recur at the distance of its period, so stretches of windows
whose last equal window is near enough bound the places (a superset, found for all texts of a batch at once). Other words of the
text are in no run.

Null texts have no words and no run; so do empty texts and those of white space. Texts are read whole, whatever their length.
Repeated rows each keep their row, and equal texts have equal runs; of runs of equal length the first start, then the smallest period,
counts as the longest. An empty table gives an empty table. Only the columns that are named take part, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, mapped, mix, or_empty, slices, table, words_of

EXPONENT, LEAST = 4, 6
#: Words compared directly before hashes are asked.
DIRECT = 4
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E689 % ((1 << 61) - 1)


class HashesDisagree(Exception):
    """Words differ where hashes are equal, or the other way round."""


class _Extensions:
    """Longest common extensions of one sequence of word numbers."""

    def __init__(self, words: list[int], hashes: bool = True):
        self.words, self.hashes = words, hashes
        sums, powers = [0], [1]
        if hashes:
            for x in words:
                sums.append((sums[-1] * _BASE + x + 1) % _PRIME)
                powers.append(powers[-1] * _BASE % _PRIME)
        self.sums, self.powers = sums, powers

    def _equal(self, i: int, j: int, many: int) -> bool:
        if not self.hashes:
            return self.words[i : i + many] == self.words[j : j + many]
        s, p = self.sums, self.powers[many]
        return (s[i + many] - s[i] * p - s[j + many] + s[j] * p) % _PRIME == 0

    def right(self, i: int, j: int) -> int:
        """Equal words from i and j (i < j) on."""
        words, n = self.words, len(self.words)
        most = n - j
        k = 0
        while k < most and k < DIRECT:
            if words[i + k] != words[j + k]:
                return k
            k += 1
        if k == most:
            return k
        step = DIRECT
        while k + step <= most and self._equal(i + k, j + k, step):
            k += step
            step *= 2
        low, high = 0, min(step, most - k + 1)  # equal over low, not over high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._equal(i + k, j + k, middle) else (low, middle)
        k += low
        if k < most and words[i + k] == words[j + k]:
            raise HashesDisagree
        return k

    def left(self, i: int, j: int) -> int:
        """Equal words before i and j (i < j)."""
        words, k = self.words, 0
        while k < i and k < DIRECT:
            if words[i - 1 - k] != words[j - 1 - k]:
                return k
            k += 1
        if k == i:
            return k
        step = DIRECT
        while k + step <= i and self._equal(i - k - step, j - k - step, step):
            k += step
            step *= 2
        low, high = 0, min(step, i - k + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._equal(i - k - middle, j - k - middle, middle) else (low, middle)
        k += low
        if k < i and words[i - 1 - k] == words[j - 1 - k]:
            raise HashesDisagree
        return k


def _scan(words: list[int], ext: _Extensions, sign: int, found: set[tuple[int, int, int]], exponent: int, least: int) -> None:
    """Adds the runs (start, period, length) that the Lyndon words of one order (sign 1 or -1) show."""
    n = len(words)
    ends: list[int] = []  # of the Lyndon words that the rest of the sequence is made of, the first on top
    recent: dict[int, int] = {}  # period: start of the last run seen with it
    near: dict[int, tuple[int, int]] = {}  # distance: (place, extension) seen last
    for i in range(n - 1, -1, -1):
        j, x = i + 1, words[i]
        while j < n:
            # a suffix that is a prefix of another comes first, under either order
            y = words[j]
            if x != y:
                if (x > y) == (sign > 0):
                    break
            else:
                place, k = near.get(j - i, (-1, 0))
                k = k + 1 if place == i + 1 else ext.right(i, j)
                near[j - i] = i, k
                if j + k == n or (words[i + k] > words[j + k]) == (sign > 0):
                    break
            j = ends.pop()
        ends.append(j)
        period = j - i
        if j < n and x == words[j] and not recent.get(period, n) <= i:
            place, k = near.get(period, (-1, 0))
            if place != i:
                k = k + 1 if place == i + 1 else ext.right(i, j)
                near[period] = i, k
            if k >= period:  # of a run of three periods, some Lyndon word has this
                start = i - ext.left(i, j)
                length = j + k - start
                recent[period] = start
                if length >= max(least, exponent * period):
                    found.add((start, period, length))


def lyndon_runs(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs (start, period, length) of a sequence of word numbers, by start, then period. exponent: 3 at the least."""
    for hashes in (True, False):
        found: set[tuple[int, int, int]] = set()
        try:
            ext = _Extensions(words, hashes)
            _scan(words, ext, 1, found, exponent, least)
            _scan(words, ext, -1, found, exponent, least)
            for start, period, length in found:
                if words[start : start + length - period] != words[start + period : start + length]:
                    raise HashesDisagree
            break
        except HashesDisagree:
            continue
    return sorted(found)


def places(words: np.ndarray, first: np.ndarray, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(text, from, to) of stretches of the texts' words, end to end, outside which no run is, with a word more on either side.

    A run of period q has (exponent - 1) * q - 2 windows of three words in a row, or more, whose last equal window is q words back
    or nearer; so n such windows in a row have room for periods up to (n + 2) / (exponent - 1) only."""
    n = len(words) - 2
    if n <= 0:
        return []
    window = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(window, kind="stable")
    a, b = order[:-1], order[1:]
    again = (window[a] == window[b]) & (owner[a] == owner[b + 2]) & (owner[a] == owner[a + 2])
    last = np.zeros(n, np.int64)
    last[b[again]] = (b - a)[again]
    at = np.flatnonzero(last)
    back = last[at]
    while True:
        if not len(at):
            return []
        low = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        many = np.diff(low, append=len(at))
        room = (many + 2) // (exponent - 1)
        near = back <= np.repeat(room, many)
        if near.all():
            break
        at, back = at[near], back[near]
    out: list[tuple[int, int, int]] = []
    begin, text = at[low], owner[at[low]]
    begin, end = np.maximum(begin - room - 1, first[text]), np.minimum(begin + many + 3, first[text + 1])
    for k, x, y in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
        while out and out[-1][0] == k and x <= out[-1][2]:
            x, y = min(x, out[-1][1]), max(y, out.pop()[2])
        out.append((k, x, y))
    return out


def texts_runs(texts: pa.Array, exponent: int = EXPONENT, least: int = LEAST) -> tuple[pa.Array, np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """(words of all texts, how many stand before each text, runs (start, period, length) of the texts that have any)."""
    words, first = words_of(texts)
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for text, low, high in places(numbers, first, exponent):
        runs = lyndon_runs(numbers[low:high].tolist(), exponent, least)
        if runs:
            found.setdefault(text, []).extend((low - int(first[text]) + start, period, length) for start, period, length in runs)
    return words, first, {text: sorted(set(runs)) for text, runs in found.items()}


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", kept_col: str = "collapsed", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The rows with the runs of each text, by start, then period, and the text that is left, its words joined by one space, when each
    run keeps its first period alone (null for null). Of other columns those called like the results are replaced.

    exponent: 3 at the least; least: 4 at the least."""
    kept = [c for c in docs.columns if c.lower() not in (runs_col.lower(), kept_col.lower())]
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast(kind).alias(runs_col), F.lit(None).cast("string").alias(kept_col)).schema
    inner = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                texts = part.column(text_col)
                words, first, found = texts_runs(texts, exponent, least)
                stays = np.ones(len(words) + 1, np.int64)
                for text, runs in found.items():
                    for start, period, length in runs:
                        stays[first[text] + start + period : first[text] + start + length] = 0
                offsets = np.concatenate([[0], np.cumsum(stays[:-1])])[first]
                left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.cast(words.filter(pa.array(stays[:-1] > 0)), pa.string()))
                joined = pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), pc.binary_join(left, " "))
                rows = [[{"start": x, "length": z, "period": y} for x, y, z in found.get(k, ())] for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(rows, inner), joined], [*kept, runs_col, kept_col])

    return docs.transform(mapped, run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the contract makes the end of every tenth text or so periodic
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACE + "+"), lambda x: x != "")
    turned = docs.select("doc_id", "text", (crc % 10 == 0).alias("turns"), F.floor(crc / 10).cast("long").alias("g"))
    turned = turned.withColumn("w", F.when(F.col("turns"), words)).withColumn("n", F.size("w").cast("long"))
    turned = turned.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    turned = turned.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    turned = turned.select("doc_id", F.when(F.col("turns") & (F.col("n") > 0), new).otherwise(F.col("text")).alias("text"))
    told = with_runs(turned)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(or_empty(F.col("collapsed")), 256).alias("collapsed_sha256"))
    length, period = F.col("most.length"), -F.col("most.period")
    return told.select(
        "doc_id", "n_runs", (-F.col("most.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
