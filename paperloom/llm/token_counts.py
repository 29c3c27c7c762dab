"""Token counts of whole texts by a tokenizer that is compiled into a finite-state transducer.

The tokenizer is a score-ordered piece BPE with byte fallback. Two facts make it finite-state:

* A row of tokens is the encoding of its text exactly if each two neighbours are the encoding of the two alone, as merges inside
  a token never depend on what stands beside it. So the encoding of every prefix ends in exactly one token, and only which token
  stood before a possible token has to be remembered.
* No two characters merge that stand side by side in no piece.

A state therefore holds the last token of the prefix and, for each end of the prefix that some piece goes on from, the token
before that end. A transition on a character gives the next state and is annotated with the tokens it adds to the count of the
prefix (it may take some back). The transducer is deterministic; its states are compiled when a text first needs them and kept in
a table of bounded size.

Texts are read in chunks. A chunk's map from the state before it to (state after it, tokens) is constant from its first reset point
on: a word start, or the end of a character that no piece holds. A prefix scan composes the maps: the constant parts of all chunks
run side by side from the initial state, one character of each at a time in numpy; then the heads, from the states that their
predecessors end in, again side by side. Chunks without any reset point are all head and take their turn after their predecessor.

Null and empty texts have no tokens; special strings inside a text are ordinary text; texts are read whole, whatever their length.
Repeated rows each keep their row, equal texts have equal counts (there are no ties to break); an empty table gives an empty table.
Only the text takes part and all other columns are passed on; one called like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mapped, or_empty, slices, table

MODEL = "piece_bpe_32k.model"
#: Tokens beyond which a text is over the limit.
LIMIT = 4096
#: Characters of a chunk; transitions that a worker keeps; lanes below which a plain walk is faster.
CHUNK, TRANSITIONS, FEW = 256, 1 << 20, 8
#: Pieces below an end up to which tokens before it are told apart only by what they let go on.
COMPARED = 12
#: Pairs of tokens that a worker remembers.
PAIRS = 300_000
NEVER = float("inf")
#: The space of the pieces.
SPACE = "▁"
#: Classes below it are characters that no piece holds, by their bytes.
UNKNOWN = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """The compiled tokenizer; ``counts`` reads texts."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: each piece's score; of two possible merges, the higher score comes first, then the left one."""
        self.pieces = pieces
        self.bigrams = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in self.bigrams):
            raise ValueError("a piece goes on past the end of a word")
        letters = sorted({c for p in pieces for c in p})
        self.letter_of = dict(zip(letters, range(UNKNOWN, UNKNOWN + len(letters)), strict=True))
        self.letters = dict(zip(self.letter_of.values(), letters, strict=True))
        self.bits = np.uint64((UNKNOWN + len(letters)).bit_length())
        points = np.arange(0x110000)
        self.class_of = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int16)
        self.class_of[[ord(c) for c in letters]] = list(self.letter_of.values())
        self.space = self.letter_of.get(SPACE, 0)
        self.child: dict[tuple[int, str], int] = {}
        self.piece_at: dict[int, str] = {}
        for p in pieces:
            node = 0
            for c in p:
                node = self.child.setdefault((node, c), len(self.child) + 1)
            self.piece_at[node] = p
        for c in letters:  # a letter that is no piece of its own falls back to its bytes
            self.piece_at.setdefault(self.child.setdefault((0, c), len(self.child) + 1), c)
        below: dict[int, list[str]] = {}
        for p in pieces:
            node = 0
            for c in p[:-1]:
                node = self.child[node, c]
                below.setdefault(node, []).append(p)
        self.made: dict[str, list[tuple[float, str, str]]] = {}
        self.whole: dict[str, bool] = {}
        #: Ends that pieces go on from: those pieces, or None where they are many.
        self.below = {node: tuple(own) if len(own) <= COMPARED else None for node, own in below.items()}
        self.forget()

    def forget(self) -> None:
        """Drops all compiled states but the initial one, number 0."""
        self.states: list[tuple] = [(None, ())]
        self.number = {self.states[0]: 0}
        self.agree: dict[tuple[str, str], bool] = {}
        self.alike: dict[tuple[int, str | None], str | None | bool] = {}
        self.first_of: dict[tuple[int, tuple[bool, ...]], str | None] = {}
        self.used = 0
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        old = (self.key, self.next, self.adds) if self.used else None
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.key, self.next, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        if old is not None:
            some = np.flatnonzero(old[0] >= 0)
            self._insert(old[0][some].tolist(), list(zip(old[1][some].tolist(), old[2][some].tolist(), strict=True)))

    def _insert(self, keys: list[int], found: list[tuple[int, int]]) -> None:
        most = len(self.key) - 1
        places = ((np.array(keys, np.int64).view(np.uint64) * _MIX) >> self.shift).tolist()
        for place, key, (state, adds) in zip(places, keys, found, strict=True):
            while self.key[place] >= 0:
                place = (place + 1) & most
            self.key[place], self.next[place], self.adds[place] = key, state, adds

    def _merges(self, token: str) -> list[tuple[float, str, str]]:
        """How merging makes up a token of its letters: (merge's rank, first part, last part) as it goes, and the end, which never comes."""
        known = self.made.get(token)
        if known is None:
            parts, known = list(token), []
            while True:
                options = [(-self.pieces[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.pieces]
                rank, k = min(options, default=(NEVER, 0))
                known.append((rank, parts[0], parts[-1]))
                if not options:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.made[token] = known
            self.whole[token] = len(parts) == 1
        return known

    def _agrees(self, before: str | None, token: str) -> bool:
        """Whether the two tokens are the encoding of their joined text: each is its own, and as the merges of both go on in the
        order of their ranks, left ones first, none across the border comes up before those that are left to do."""
        own = self._merges(token)
        if before is None:
            return self.whole[token]
        key = (before, token)
        known = self.agree.get(key)
        if known is None:
            left = self._merges(before)
            known, i, j = self.whole[token] and self.whole[before], 0, 0
            while known:
                (first, _, edge), (second, start, _) = left[i], own[j]
                across = -self.pieces.get(edge + start, -NEVER)
                if across < first and across <= second:
                    known = False
                elif first <= second:
                    if first == NEVER:
                        break
                    i += 1
                else:
                    j += 1
            if len(self.agree) > PAIRS:
                self.agree.clear()
            self.agree[key] = known
        return known

    def _standing(self, node: int, before: str | None) -> str | None | bool:
        """The first seen of the tokens before an end after which the same pieces can go on; False if none can."""
        own = self.below[node]
        if own is None:
            return before
        key = (node, before)
        known = self.alike.get(key)
        if known is None:
            able = tuple(self._agrees(before, x) for x in own)
            known = self.alike[key] = (self.first_of.setdefault((node, able), before) or "") if any(able) else False
        return known or (False if known is False else None)

    def _step(self, state: int, letter: str) -> tuple[int, int]:
        """Compiles a transition: (state after it, tokens it adds)."""
        last, ends = self.states[state]
        start = last if last is not None and last[-1] + letter in self.bigrams else None
        chosen, reached = None, []
        for node, before, count in (*ends, (0, start, 0)):
            to = self.child.get((node, letter))
            if to is None:
                continue
            token = self.piece_at.get(to)
            if chosen is None and token is not None and self._agrees(before, token):
                chosen = token, count + (1 if token in self.pieces else len(token.encode()))
            if to in self.below and (before := self._standing(to, before)) is not False:
                reached.append((to, before, count))
        token, adds = chosen
        new = (token, tuple((node, before, count - adds) for node, before, count in reached))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, adds

    def _compile(self, keys: np.ndarray) -> None:
        keys = np.unique(keys).tolist()
        bits, mask = int(self.bits), (1 << int(self.bits)) - 1
        found = [self._step(k >> bits, self.letters[k & mask]) for k in keys]
        if 2 * (self.used + len(keys)) > len(self.key):
            self._table(4 * len(self.key))
        self._insert(keys, found)
        self.used += len(keys)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions of those keys are in the table; missing ones are compiled."""
        most = len(self.key) - 1
        at = ((keys.view(np.uint64) * _MIX) >> self.shift).view(np.int64)
        off = np.flatnonzero(self.key[at] != keys)
        while len(off):
            own, want = at[off], keys[off]
            free = self.key[own] < 0
            if free.any():
                self._compile(want[free])
                return self._places(keys)
            own = (own + 1) & most
            at[off] = own
            off = off[self.key[own] != want]
        return at

    def _run(self, classes: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens added) of each stretch of characters, read from the given states, all side by side."""
        order = np.argsort(-length, kind="stable")
        first, length, state = first[order], length[order], state[order].astype(np.int64)
        added = np.zeros(len(first), np.int64)
        active, j = len(first), 0
        while active and length[0] > j:
            active = int(np.searchsorted(-length[:active], -j, "left"))
            if active < FEW:
                for k in range(active):
                    state[k], more = self._walk(classes[first[k] + j : first[k] + length[k]].tolist(), int(state[k]))
                    added[k] += more
                break
            c = classes[first[:active] + j].astype(np.int64)
            known = np.flatnonzero(c >= UNKNOWN)
            if len(known) == active:
                at = self._places(state[:active] << np.int64(self.bits) | c)
                state[:active] = self.next[at]
                added[:active] += self.adds[at]
            else:
                at = self._places(state[known] << np.int64(self.bits) | c[known])
                strange = c < UNKNOWN
                added[:active] += np.where(strange, c, 0)
                added[known] += self.adds[at]
                state[:active] = 0
                state[known] = self.next[at]
            j += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], added[back]

    def _walk(self, classes: list[int], state: int) -> tuple[int, int]:
        """One stretch of characters, one after the other."""
        added, bits = 0, int(self.bits)
        known: dict[int, tuple[int, int]] = {}
        for c in classes:
            if c < UNKNOWN:
                state, added = 0, added + c
                continue
            key = state << bits | c
            if key not in known:
                at = self._places(np.array([key]))[0]
                known[key] = int(self.next[at]), int(self.adds[at])
            state, more = known[key]
            added += more
        return state, added

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if self.used > TRANSITIONS:
            self.forget()
        texts = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
        size = np.array([len(x) for x in texts], np.int64)
        total = int(size.sum())
        if not total:
            return np.zeros(len(texts), np.int64)
        classes = self.class_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(size) - size
        chunks = -(-size // CHUNK)  # of each text
        owner = np.repeat(np.arange(len(texts)), chunks)
        first = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        end = np.minimum(first + CHUNK, begin[owner] + size[owner])
        reset = np.empty(total, bool)
        reset[0] = True
        reset[1:] = (classes[:-1] < UNKNOWN) | ((classes[1:] == self.space) & (classes[:-1] != self.space))
        reset[begin[size > 0]] = True
        at = np.flatnonzero(reset)
        # the constant part of each chunk's map: from its first reset point on, from the initial state
        tail = np.append(at, total)[np.searchsorted(at, first)]
        constant = tail < end
        after, added = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        after[constant], added[constant] = self._run(classes, tail[constant], (end - tail)[constant], np.zeros(int(constant.sum()), np.int64))
        # the scan: how far each chunk is from the last constant one tells in which turn the state before it is known
        many = np.arange(len(first))
        turn = many - np.maximum.accumulate(np.where(constant, many, 0))
        turn = np.where(constant, np.append(0, turn[:-1]), turn - 1)  # of the head: that of the chunk before it
        head = np.where(constant, tail, end) - first
        waiting = np.flatnonzero(head > 0)
        waiting = waiting[np.argsort(turn[waiting], kind="stable")]
        turns = turn[waiting]
        low = 0
        while low < len(waiting):
            high = int(np.searchsorted(turns, turns[low], "right"))
            own = waiting[low:high]
            state, more = self._run(classes, first[own], head[own], after[own - 1])
            added[own] += more
            after[own] = np.where(constant[own], after[own], state)
            low = high
        return np.bincount(owner, added, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a model file, once in a worker; its states are compiled as texts need them."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return Transducer({model.id_to_piece(k): model.get_score(k) for k in own})


def token_counts(docs: DataFrame, text_col: str = "text", count_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The rows with the number of tokens of each text. ``path``: the model's file, the same on all executors."""
    path = path or public_tokenizers.path(MODEL)
    kept = [c for c in docs.columns if c.lower() != count_col.lower()]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(count_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(path)
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                found = own.counts([x or "" for x in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found)], [*kept, count_col])

    return docs.transform(mapped, run, schema)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.octet_length(or_empty(F.col("text"))).cast("long")
    counted = token_counts(docs.select("doc_id", text.alias("n_bytes"), "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
