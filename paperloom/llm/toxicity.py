"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The unit is a word in lower case without punctuation. Runs of three or more single characters ("i d i o t") also make a
word; words of one or two characters get a blank on each side; long words, and runs in scripts that are written without
spaces, are read in overlapping windows. The kernel of two words is the gap-weighted count of common subsequences of three
characters, where each character spanned costs a factor ``DECAY``, scaled to 1 for equal words. Inserted characters
only stretch the gaps, so that "id.io-t" stays near "idiot".

Training reads a bounded sample of the labelled rows. A document label says that some words of the text are toxic, so the
bags are opened first (multiple-instance learning): a word counts by the texts of either label that hold it, and so does a stem
that begins two different words of a text. Those are witnesses whose likelihood ratio against the common share of toxic texts
chance doesn't explain among all units that are as frequent. What no witness explains is looked at again, in up to ``ROUNDS``
rounds, so that rare insults, or those of rarely labelled languages, aren't outvoted. Witnesses, and the words of toxic texts
that begin with one of the stems, train a squared-hinge SVM on Nyström features against words of clean texts; clean words that it
takes for toxic join them for a second turn. A text has the values of its highest and second highest word, the number of words
above 0 and its length; a logistic function of them, fitted on the sample, turns them into a score.

As the landmarks are few and fixed, the trained function is a weight for each three characters: a word's value is the sum of
these weights over its subsequences, divided by its norm. So scoring takes no kernel with each landmark.

Null and empty texts have the values of words that share nothing with any landmark, so they have a low score.
Without labelled rows of both kinds, or where no word stands out in toxic texts, every score is 0. Texts are read whole. Repeated rows each keep their row (equal texts have
equal scores, so there are no ties to break); an empty table gives an empty table; only the id and text columns take part in
:func:`scored`, and :func:`without_toxic` passes all other columns on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import compact, cut, mapped, slices, table

DECAY, LENGTH, WINDOW = 0.7, 3, 24
#: Characters of a window in scripts without spaces.
UNSPACED_WINDOW = 4
#: Labelled rows of each label that training reads at most (about: rows are drawn by a hash of their id).
TRAINING_ROWS = 4_000
#: Nyström landmarks, and clean words that the SVM is trained against (besides those it takes for toxic).
LANDMARKS, CLEAN_WORDS = 96, 2_500
#: Lengths of stems; rounds in which bags are opened; how far a log likelihood ratio must exceed what chance makes among its like,
#: and what it must be in any case; the share of a unit's texts that must be toxic.
STEMS, ROUNDS, MARGIN, LEAST_RATIO, LEAST_SHARE = range(3, 8), 3, 2.0, 7.0, 0.5
#: Words of the short texts that are added to the sample as clean ones, so many and fewer.
SHORT = 30
#: Words that a worker remembers, and numbers of a block of a kernel.
CACHE_WORDS, BLOCK = 250_000, 1 << 18
_INNER = re.compile(r"[\W_]+")
_SINGLES = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
#: The same for RE2, at least as wide.
_SINGLES_SEEN = r"(?:^|\s)[^\s](?:\s[^\s]){2,}(?:\s|$)"
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text in lower case, between white space, and joined runs of single characters. Null: none."""
    low = pc.utf8_lower(compact(texts))
    lists = pc.utf8_split_whitespace(low)
    rows = np.flatnonzero(pc.match_substring_regex(low, _SINGLES_SEEN).to_numpy(zero_copy_only=False))
    if len(rows):
        more = [x.split() + [_INNER.sub("", run) for run in _SINGLES.findall(x)] for x in low.take(pa.array(rows)).to_pylist()]
        at = np.arange(len(texts))
        at[rows] = len(texts) + np.arange(len(rows))
        lists = pa.concat_arrays([lists, pa.array(more, lists.type)]).take(pa.array(at))
    return lists


def units_of(token: str) -> list[str]:
    """The units of a word."""
    x = token if token.isalpha() else _INNER.sub("", token)
    parts = [x]
    if _UNSPACED.search(x):
        parts = [y for y in _UNSPACED.split(x) if y]
        for run in _UNSPACED.findall(x):
            parts.extend(run[at : at + UNSPACED_WINDOW] for at in range(max(1, len(run) - UNSPACED_WINDOW + 1)))
    out = []
    for y in parts:
        if len(y) > WINDOW:
            out.extend(y[at : at + WINDOW] for at in range(0, len(y) - WINDOW // 2, WINDOW // 2))
        elif y:
            out.append(y if len(y) >= LENGTH else f" {y} ")
    return out


def codes(words: list[str]) -> np.ndarray:
    """Code points by place and word, -1 beyond a word's end."""
    size = np.array([len(x) for x in words], np.int64)
    out = np.full((size.max(initial=0), len(words)), -1, np.int32)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    word = np.repeat(np.arange(len(words)), size)
    out[np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size), word] = points
    return out


def _common(same: np.ndarray) -> np.ndarray:
    """Gap-weighted count of common subsequences; same[i, j, ...]: whether place i of one word equals place j of the other."""
    rows, columns, *rest = same.shape
    ends = same.astype(np.float32)
    prefix, run, decay = np.zeros_like(ends), np.zeros(rest, np.float32), np.float32(DECAY)
    for _ in range(LENGTH - 1):
        # what ended before place (i, j), each place in between costing a factor
        for i in range(1, rows):
            run[...] = 0
            for j in range(1, columns):
                run *= decay
                run += ends[i - 1, j - 1]
                np.multiply(prefix[i - 1, j], decay, out=prefix[i, j])
                prefix[i, j] += run
        np.multiply(prefix, same, out=ends)
    return ends.sum(axis=(0, 1)) * np.float32(DECAY ** (2 * LENGTH))


def _blocks(words: list[str], marks: int, longest: int) -> Iterator[list[int]]:
    """Places of the words, by length, as many at once as ``BLOCK`` allows for."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        many = max(1, BLOCK // (max(1, len(words[order[at]]) + 1) * (longest or len(words[order[at]]) + 1) * marks))
        part = order[at : at + many]
        if not longest:  # equal lengths only
            size = len(words[part[0]])
            part = [k for k in part if len(words[k]) == size]
        yield part
        at += len(part)


def norms(code: np.ndarray) -> np.ndarray:
    """The square root of each word's kernel with itself."""
    return np.sqrt(np.maximum(_common((code[:, None] == code[None]) & (code >= 0)[:, None]), 1e-12))


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of each word with each mark, from 0 to 1."""
    out = np.zeros((len(words), len(marks)), np.float32)
    b = codes(marks)
    mark_size = norms(b)
    for part in _blocks(words, len(marks), len(b)):
        a = codes([words[k] for k in part])
        out[part] = _common(a[:, None, :, None] == np.where(b < 0, -2, b)[None, :, None, :]) / norms(a)[:, None] / mark_size
    return out


class Model:
    """f(word) = kernel(word, landmarks) @ weights + bias; score(text) = logistic(curve @ features of the text)."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float):
        self.landmarks, self.bias = landmarks, bias
        self.curve = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
        letters = sorted({ord(c) for x in landmarks for c in x})
        self.letters = np.array(letters, np.int32)
        number = {chr(c): k + 1 for k, c in enumerate(letters)}
        weight: dict[tuple[int, int, int], float] = {}
        for x, w in zip(landmarks, (weights / norms(codes(landmarks))).tolist(), strict=True):
            for i, j, k in combinations(range(len(x)), LENGTH):
                key = number[x[i]], number[x[j]], number[x[k]]
                weight[key] = weight.get(key, 0.0) + w * DECAY ** (k - i + 1)
        pairs = {x: k + 1 for k, x in enumerate(dict.fromkeys((a, b) for a, b, _ in weight))}
        self.pair = np.zeros((len(letters) + 1, len(letters) + 1), np.int32)  # 0: a pair of no landmark
        self.third = np.zeros((len(pairs) + 1, len(letters) + 1), np.float32)
        for (a, b, c), w in weight.items():
            self.pair[a, b] = pairs[a, b]
            self.third[pairs[a, b], c] = w
        self._forget()

    def _forget(self) -> None:
        self.known, self.value = pa.array([], pa.string()), np.zeros(0, np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "value")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def decision(self, words: list[str]) -> np.ndarray:
        """f of each word."""
        out = np.zeros(len(words), np.float32)
        width = self.third.shape[1]
        third = self.third.reshape(-1)
        for part in _blocks(words, 1, 0):
            a = codes([words[k] for k in part])
            at = np.minimum(np.searchsorted(self.letters, a), len(self.letters) - 1)
            own = np.where(self.letters[at] == a, at + 1, 0)
            n = len(own)
            total = np.zeros(len(part), np.float32)
            for i, j in combinations(range(n - 1), 2):
                base = self.pair[own[i], own[j]]
                seen = np.flatnonzero(base)
                if len(seen):
                    fade = np.power(DECAY, np.arange(j - i + 2, n - i + 1), dtype=np.float32)
                    total[seen] += fade @ third[base[seen] * width + own[j + 1 :, seen]]
            out[part] = total / norms(a)
        return out + np.float32(self.bias)

    def token_values(self, tokens: pa.StringArray) -> np.ndarray:
        """The highest value among each distinct word's units."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        found = pc.index_in(tokens, value_set=self.known)
        new = tokens.filter(pc.is_null(found))
        if len(new):
            units = [units_of(x) for x in new.to_pylist()]
            distinct = list(dict.fromkeys(x for xs in units for x in xs))
            number = {x: k for k, x in enumerate(distinct)}
            values = self.decision(distinct)
            many = np.array([len(xs) for xs in units])
            best = np.full(len(units), self.bias, np.float32)
            flat = np.array([number[x] for xs in units for x in xs], np.int64)
            if len(flat):
                some = np.flatnonzero(many)
                best[some] = np.maximum(best[some], np.maximum.reduceat(values[flat], (np.cumsum(many) - many)[some]))
            self.known, self.value = pa.concat_arrays([self.known, new]), np.concatenate([self.value, best])
            found = pc.index_in(tokens, value_set=self.known)
        return self.value[found.to_numpy()]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(1, highest value, second highest, log(1 + words above 0), log(1 + words)) of each text, and the first word with the highest
        value (null without words)."""
        lists = tokens_of(texts)
        flat = lists.flatten().dictionary_encode()
        values = self.token_values(flat.dictionary)[flat.indices.to_numpy()]
        first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        many = np.diff(first)
        out, place = np.full((len(texts), 2), self.bias, np.float32), np.full(len(texts), -1)
        some = np.flatnonzero(many)
        owner = np.repeat(np.arange(len(texts)), many)
        above = np.bincount(owner[values > 0], minlength=len(texts))
        for k in range(2 if len(some) else 0):
            out[some, k] = np.maximum(np.maximum.reduceat(values, first[some]), self.bias)
            if not k:
                hit = np.flatnonzero(values == out[owner, 0])
                place[owner[hit][::-1]] = hit[::-1]
                values = values.copy()
                values[place[place >= 0]] = self.bias
        indices = pa.array(np.where(place < 0, 0, flat.indices.to_numpy()[place]) if len(values) else np.zeros(len(texts), np.int32), mask=place < 0)
        return np.column_stack([np.ones(len(texts)), out.astype(float), np.log1p(above), np.log1p(many)]), flat.dictionary.take(indices)

    def scores(self, texts: pa.Array | list[str]) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return 1 / (1 + np.exp(-np.clip(self.features(texts)[0] @ self.curve, -40, 40)))


def fit_svm(words: list[str], labels: np.ndarray, weight: np.ndarray, landmarks: list[str], penalty: float = 20.0) -> Model:
    """Squared-hinge SVM on Nyström features, by Newton steps on the words inside the margin."""
    own = kernel(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-3))  # K(x, landmarks) @ root are the features
    x = np.hstack([kernel(words, landmarks) @ root, np.ones((len(words), 1))])
    y, w = np.where(labels > 0, 1.0, -1.0), np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        c = penalty * weight[inside, None]
        new = np.linalg.solve(ridge + x[inside].T @ (c * x[inside]), x[inside].T @ (c[:, 0] * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return Model(landmarks, root @ w[:-1], float(w[-1]))


def fit_logistic(x: np.ndarray, label: np.ndarray, signs: list[int]) -> np.ndarray:
    """Weights of the features, lightly regularised, by Newton steps; a feature whose weight goes against its sign is left out."""
    own = list(range(x.shape[1]))
    while True:
        z, w, ridge = x[:, own], np.zeros(len(own)), 1e-2 * np.eye(len(own))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (label - p) - ridge @ w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        wrong = [(w[k] * signs[f], f) for k, f in enumerate(own) if w[k] * signs[f] < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[own] = w
            return out
        own.remove(min(wrong)[1])


def spread_out(words: list[str], many: int) -> list[str]:
    """The first word, then always the one farthest from those chosen."""
    if len(words) <= many:
        return words
    chosen, nearest = [0], kernel(words, [words[0]])[:, 0]
    while len(chosen) < many:
        k = int(nearest.argmin())
        chosen.append(k)
        nearest = np.maximum(nearest, kernel(words, [words[k]])[:, 0])
    return [words[k] for k in chosen]


def units_in(tokens: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """(word: what stands before it first, stem: the words that begin with it) of a text; stems of two words or more."""
    words: dict[str, str] = {}
    before = ""
    for token in tokens:
        for x in units_of(token):
            words.setdefault(x, before)
            before = x
    stems: dict[str, list[str]] = {}
    for x in sorted(words):
        for k in STEMS:
            if len(x) > k:
                stems.setdefault(x[:k], []).append(x)
    return words, {stem: " ".join(own) for stem, own in stems.items() if len(own) > 1}


def _rows(tokens: list[str]) -> list[tuple[str, bool, str]]:
    """(unit, is a stem, its context) of a text."""
    words, stems = units_in(tokens)
    return [(x, False, c) for x, c in words.items()] + [(x, True, c) for x, c in stems.items()]


def _explained(tokens: list[str], words: set[str], stems: set[str]) -> bool:
    """Whether a text holds a witness: one of the words, or two words with one of the stems."""
    own, of_stem = units_in(tokens)
    return not words.isdisjoint(own) or not stems.isdisjoint(of_stem)


def _counted(sample: DataFrame, words: set[str], stems: set[str]) -> DataFrame:
    """(unit, stem, toxic, clean): the texts of either label that hold a unit, without the toxic ones that witnesses explain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                count: dict[tuple[str, bool], list[int]] = {}
                for label, tokens in zip(part.column("label").to_pylist(), tokens_of(part.column("text")).to_pylist(), strict=True):
                    if label and _explained(tokens, words, stems):
                        continue
                    for unit, stem, _ in _rows(tokens):
                        count.setdefault((unit, stem), [0, 0])[1 - label] += 1
                yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in count], pa.string()), "stem": pa.array([x for _, x in count], pa.bool_()), "toxic": pa.array([n for n, _ in count.values()], pa.int64()), "clean": pa.array([n for _, n in count.values()], pa.int64())})

    rows = sample.transform(mapped, run, "unit string, stem boolean, toxic long, clean long")
    return rows.groupBy("unit", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _told_apart(sample: DataFrame, suspects: list[tuple[str, bool]], words: set[str], stems: set[str]) -> dict[tuple[str, bool], list[int]]:
    """(toxic, clean) of each suspect, where texts count once that have it in the same context, as copies do."""
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(suspects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for label, tokens in zip(part.column("label").to_pylist(), tokens_of(part.column("text")).to_pylist(), strict=True):
                    if not (label and _explained(tokens, words, stems)):
                        rows += [(label, *x) for x in _rows(tokens) if x[:2] in shared.value]
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                kinds = (pa.int32(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["label", "unit", "stem", "context"])

    out: dict[tuple[str, bool], list[int]] = {}
    for r in sample.transform(mapped, run, "label int, unit string, stem boolean, context string").distinct().groupBy("unit", "stem", "label").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        out.setdefault((r["unit"], r["stem"]), [0, 0])[1 - r["label"]] = r["n"]
    return out


def _surplus(toxic: Column, clean: Column, share: Column) -> Column:
    """The log likelihood ratio of a unit's own share of toxic texts against the common one; 0 where it isn't higher."""
    n = toxic + clean
    own = toxic * F.log(toxic / n / share) + F.when(clean > 0, clean * F.log(clean / n / (1 - share))).otherwise(0.0)
    return F.when((toxic / n >= LEAST_SHARE) & (toxic / n > share), own).otherwise(0.0)


def witnesses(sample: DataFrame) -> tuple[set[str], set[str]]:
    """(words, stems) that tell toxic texts of a sample of (text, label)."""
    words: set[str] = set()
    stems: set[str] = set()
    for _ in range(ROUNDS):
        counted = cut(_counted(sample, words, stems))
        told = counted.groupBy("stem").agg((F.sum("toxic") / F.sum(F.col("toxic") + F.col("clean"))).alias("share"))
        like = F.floor(F.log2((F.col("toxic") + F.col("clean")).cast("double"))).cast("int")
        valued = counted.withColumn("like", like).join(F.broadcast(told), "stem").withColumn("surplus", _surplus(F.col("toxic"), F.col("clean"), F.col("share")))
        # what chance makes: one of n units of about that frequency exceeds log(n)
        many = {(r["stem"], r["like"]): r["n"] for r in valued.groupBy("stem", "like").agg(F.count(F.lit(1)).alias("n")).collect()}
        shares = {r["stem"]: r["share"] for r in told.collect()}
        bound = lambda *key: max(LEAST_RATIO, np.log(many.get(key, 1)) + MARGIN)
        found = [(r["unit"], r["stem"]) for r in valued.where(F.col("surplus") >= LEAST_RATIO).toLocalIterator() if r["surplus"] >= bound(r["stem"], r["like"])]
        new, begins = 0, {}
        for (unit, stem), (toxic, clean) in sorted(_told_apart(sample, found, words, stems).items()):
            n, share = toxic + clean, shares[stem]
            if toxic / n < LEAST_SHARE or toxic / n <= share:
                continue
            surplus = toxic * np.log(toxic / n / share) + (clean * np.log(clean / n / (1 - share)) if clean else 0.0)
            if surplus >= bound(stem, int(np.log2(n))):
                new += 1
                if stem:
                    begins[unit] = surplus
                else:
                    words.add(unit)
        # of stems that begin one another, the shorter ones only where they tell more
        stems |= {x for x, n in begins.items() if not any(y != x and y.startswith(x) and own >= n for y, own in begins.items())}
        if not new:
            break
    return words, stems


def _words_of_sample(sample: DataFrame, stems: set[str]) -> DataFrame:
    """(unit, toxic, clean, of_stem): all words of the sample with the texts of either label that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                count: dict[str, list[int]] = {}
                for label, tokens in zip(part.column("label").to_pylist(), tokens_of(part.column("text")).to_pylist(), strict=True):
                    for unit in {x for token in tokens for x in units_of(token)}:
                        count.setdefault(unit, [0, 0])[1 - label] += 1
                of_stem = [any(u[:k] in stems for k in STEMS if len(u) > k) for u in count]
                yield pa.RecordBatch.from_pydict({"unit": pa.array(count, pa.string()), "toxic": pa.array([n for n, _ in count.values()], pa.int64()), "clean": pa.array([n for _, n in count.values()], pa.int64()), "of_stem": pa.array(of_stem, pa.bool_())})

    rows = sample.transform(mapped, run, "unit string, toxic long, clean long, of_stem boolean")
    return rows.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("of_stem").alias("of_stem"))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame | None:
    """(text, label) of at most about ``rows`` rows of each label; None without rows of both. Only ids are shuffled."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("label"))
    usable = usable.join(docs.select(id_col), id_col, "left_semi")
    count = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return None
    # a share of the range of 64-bit hashes, so that the sample is no emptier for larger tables
    bound = {y: min((1 << 63) - 1, int(min(1.0, rows / n) * 2**64) - (1 << 63)) for y, n in count.items()}
    drawn = usable.where(F.xxhash64(F.lit("toxicity"), id_col) <= F.when(F.col("label") == 1, F.lit(bound[1])).otherwise(F.lit(bound[0]))).limit(4 * rows)
    sample = cut(docs.select(id_col, text_col).join(F.broadcast(drawn), id_col).select(F.col(text_col).alias("text"), "label"))
    return sample if sample.select("label").distinct().count() == 2 else None


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model | None:
    """A model of the documents that ``labels`` (or a column of their own) marks, or None without rows of both labels."""
    sample = _sampled(docs, docs if labels is None else labels, id_col, text_col, label_col, rows)
    if sample is None:
        return None
    told, stems = witnesses(sample)
    by_unit = cut(_words_of_sample(sample, stems))
    # a stem's words are toxic unless they stand in clean texts more often, and clean ones where they do so by far
    told |= {r["unit"] for r in by_unit.where("of_stem and toxic > 0 and toxic >= clean").select("unit").toLocalIterator()}
    clean_units = by_unit.where("clean > 0 and (not of_stem or clean > 3 * toxic + 3)")
    common = clean_units.orderBy(F.desc("clean"), "unit").limit(CLEAN_WORDS // 2).select("unit")
    others = clean_units.orderBy(F.xxhash64(F.lit("clean"), "unit")).limit(CLEAN_WORDS).select("unit")
    clean = [r["unit"] for r in common.union(others).distinct().orderBy("unit").collect() if r["unit"] not in told]
    toxic = sorted(told)
    if not toxic or not clean:
        return None
    for turn in range(2):
        words = toxic + clean
        labels = np.array([1] * len(toxic) + [0] * len(clean))
        weight = np.where(labels > 0, 0.5 / len(toxic), 0.5 / len(clean)) * len(words)
        landmarks = spread_out(toxic, LANDMARKS * 3 // 4) + spread_out(clean[:: max(1, len(clean) // 400)], LANDMARKS // 4)
        model = fit_svm(words, labels, weight, landmarks)
        # words of clean texts that look toxic are the hardest examples
        hard = set()
        if not turn:
            clear = {r["unit"] for r in clean_units.where("of_stem").select("unit").toLocalIterator()}
            for r in _valued(sample.where("label = 0"), model).where("value > -0.5").select("token").distinct().toLocalIterator():
                hard.update(x for x in units_of(r["token"]) if x in clear or not any(x[:k] in stems for k in STEMS if len(x) > k))
        if not (hard := sorted(hard.difference(words))):
            break
        clean += hard
    valued = _valued(sample, model).select("label", "features").toPandas()
    # short texts whose words share nothing with any landmark stand by as clean ones, as the sample may hold none
    blank = [[1.0, model.bias, model.bias, 0.0, np.log1p(n)] for n in range(SHORT)]
    x, label = np.array(valued.features.tolist() + blank, float), np.append(valued.label.to_numpy(float), np.zeros(SHORT))
    model.curve = fit_logistic(x, label, [0, 1, 1, 1, -1])
    return model


def _valued(sample: DataFrame, model: Model) -> DataFrame:
    """(label, token, value, features) of each text: its highest word, that word's value, and all features."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, token = own.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), token, pa.array(x[:, 1]), pa.array(list(x), pa.list_(pa.float64()))], ["label", "token", "value", "features"])

    return sample.select("label", "text").transform(mapped, run, "label int, token string, value double, features array<double>").where("token is not null")


def scored(docs: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    base = docs.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), text_col)
    if model is None:
        return base.select(id_col, "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                score = own.scores(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("held_out"), pa.array(score)], [id_col, "held_out", "score"])

    rows = base.transform(mapped, run, f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def fit_on_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    """A model of the rows of docs that ``labels`` marks, without the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out_fold()).select("doc_id", "toxic")
    return train(docs.select("doc_id", "text"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_on_tables(spark, docs, sf_dir), held_out_fold())


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose score is below a half, with their columns; scored in place, without a join."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                yield part.filter(pa.array(own.scores(part.column(text_col)) < 0.5))

    return docs.transform(mapped, run, docs.schema)
