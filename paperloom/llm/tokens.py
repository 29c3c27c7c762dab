"""Cutting texts into pre-tokens and looking their ids up, for the byte-level BPE operators.

Byte-level BPE attaches a space to the word that follows it, and a line feed between two words stands alone. So a text
without other white space, and with no two white space characters in a row, is cut before each of them, and every piece
can be encoded on its own. Other texts are cut by the full pattern. Both ways give the same pre-tokens, and a piece cut
again gives its own pre-tokens.

A slice of texts is cut and its pieces made distinct in Arrow; Python sees each distinct piece once, and ids are
gathered with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import compact

#: For texts in ASCII, the public pattern with its Unicode classes spelled out; the standard module is faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)
#: White space to Python's modules alone.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Letters that every version of Unicode knows (RE2), one pre-token at first sight, and a boundary after a word.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_SINGLE, _AFTER_WORD = rf"^(?: ?[{_LETTERS}]+|[ \n.,;:!?])$", rf"([{_LETTERS}])([.,;:!?])"
#: What a text that is cut at its spaces and line feeds must not hold (RE2).
_ODD = r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
#: Bytes of a cache before it is emptied, so that a worker's memory is bounded.
CACHE_BYTES = 32 << 20
#: Characters of a text that are cut at once.
SEGMENT = 4 << 20


def pre_tokens(text: str) -> list[str]:
    """The matches of the public pattern."""
    return (_ASCII if text.isascii() and not _SEPARATORS.search(text) else _FULL).findall(text)


def pieces_of(texts: pa.Array) -> pa.ListArray:
    """The pieces of each text, in order; some may be empty."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.if_else(odd, "", texts)
    plain = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
    lists = pc.split_pattern(pc.replace_substring_regex(plain, _AFTER_WORD, "\\1\0\\2"), "\0")
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(rows):
        at = np.arange(len(texts))
        at[rows] = len(texts) + np.arange(len(rows))
        lists = pa.concat_arrays([lists, pa.array([pre_tokens(x) for x in texts.take(pa.array(rows)).to_pylist()], lists.type)]).take(pa.array(at))
    return lists


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts, long ones in parts that start at a single space after a word, and each part's text number."""
    if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= SEGMENT:
        return texts, np.arange(len(texts))
    out, owner = [], []
    for k, text in enumerate(texts.to_pylist()):
        at = 0
        while len(text) - at > SEGMENT:
            cut = next((x.start() + 1 for x in re.finditer(r"[A-Za-z] (?=[A-Za-z])", text[at + SEGMENT : at + 2 * SEGMENT])), None)
            if cut is None:
                break
            out.append(text[at : at + SEGMENT + cut])
            owner.append(k)
            at += SEGMENT + cut
        out.append(text[at:])
        owner.append(k)
    return pa.array(out, pa.string()), np.array(owner)


def gathered(ids: np.ndarray, first: np.ndarray, many: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces of those numbers, end to end, and how many ids come up to each one's end."""
    many = many[at]
    ends = np.cumsum(many)
    place = np.repeat(first[at] - (ends - many), many)
    place += np.arange(len(place))
    return ids[place], ends


class WordCoder:
    """Encodes texts piece by piece; ``encode`` gives the ids of all of some pre-tokens, end to end, and how many each has."""

    def __init__(self, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([""], pa.string())
        self.ids, self.first, self.many = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, pieces: pa.StringArray, ids: np.ndarray, many: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """The numbers of distinct pieces, new ones among them."""
        found = pc.index_in(pieces, value_set=self.known)
        if not found.null_count:
            return found.to_numpy()
        places = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        rows = np.flatnonzero(places < 0)
        new = pieces.take(pa.array(rows))
        single = pc.match_substring_regex(new, _SINGLE)
        is_single = single.to_numpy(zero_copy_only=False)
        words, others = new.filter(single), new.filter(pc.invert(single))
        places[rows[is_single]] = len(self.known) + np.arange(len(words))
        places[rows[~is_single]] = len(self.known) + len(words) + np.arange(len(others))
        if len(words):
            self._add(words, *self.encode(words))
        if len(others):
            cut = [pre_tokens(x) for x in others.to_pylist()]
            parts = {x: k for k, x in enumerate(dict.fromkeys(y for xs in cut for y in xs))}
            ids, many = self.encode(pa.array(parts, pa.string()))
            at = np.array([parts[y] for xs in cut for y in xs], np.int64)
            ids, ends = gathered(ids, np.cumsum(many) - many, many, at)
            self._add(others, ids, np.diff(np.concatenate([[0], ends])[np.cumsum([len(xs) for xs in cut])], prepend=0))
        return places

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text k are ids[first[k]:first[k + 1]]. Null counts as empty."""
        parts, owner = segments(compact(texts))
        out, many = [], np.zeros(len(texts), np.int64)
        sizes = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(parts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + 2 * SEGMENT, "right")))
            ids, count = self._some(parts.take(pa.array(np.arange(low, high))))
            out.append(ids)
            np.add.at(many, owner[low:high], count)
            low = high
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(many)])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        if self.known.nbytes + self.ids.nbytes + self.first.nbytes + self.many.nbytes > CACHE_BYTES:
            self._empty()
        lists = pieces_of(texts)
        distinct = lists.flatten().dictionary_encode()
        places = self._places(distinct.dictionary)
        ids, ends = gathered(self.ids, self.first, self.many, places[distinct.indices.to_numpy()])
        count = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(count)
