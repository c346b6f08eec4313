"""Splitting texts for byte-level BPE into pieces that can be memoised, and counting tokens by merging.

A byte-level BPE splits a text into words before it merges, and no word goes across a space that follows a
character other than white space. So a text can be cut before such spaces and each piece handled alone, once per
distinct piece. Texts with other runs of white space around a space are cut at wider points (``pieces``).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A space between white space, or at the end after white space: there the run of white space is one word.
_RUN = re.compile(r" (?=\s|\Z)(?<=\s )")
_WIDE = re.compile(r"(?<=\S) (?=\S)")
#: The word pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ``_RUN`` for Arrow's expressions, whose classes of white space know ASCII only.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_RUN_ARROW = rf"{_SPACE} (?:{_SPACE}|\z)"
#: A word never goes on from a letter to one of these marks or a line feed, nor from a line feed to a letter; there a
#: batch is cut too, by a space and ``JOINED``. The letters are such under every version of Unicode.
_LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{1EA0}-\x{1EF9}]"
_MARKS = rf"({_LETTER})([!-/:-@\[-`{{-~\n])"
JOINED = "\x01"
_LINES = rf"([{JOINED}!-~]\n)({_LETTER})"
#: Text that is cut at once, in bytes, and distinct pieces that a worker keeps.
SLICE, KEPT = 40 << 20, 1_000_000


def pieces(text: str) -> list[str]:
    """Pieces of a text without the space that was before each but the first: joined by spaces they are the text."""
    return _WIDE.split(text) if _RUN.search(text) else text.split(" ")


class Memo(dict):
    """A bounded memo: computes what it lacks, and starts afresh when it is full."""

    def __init__(self, compute, limit: int = 500_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.compute(key)
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def specification(path: str) -> dict:
    """A vocabulary file, if it is one of byte-level BPE that cuts texts by ``PATTERN``; else raises ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"not a byte-level BPE vocabulary without normalizer: {path}")
    return spec


class Cut:
    """Cuts a batch of texts into pieces in native code and hands out a row number for each distinct piece.

    ``odd`` tells texts that hold a special string, ``JOINED`` or a run of white space; they have one piece, the empty
    one, and the caller works them out alone. ``learn(pieces, inner)`` is called with pieces that have no row yet;
    ``inner`` ones have a space before them, or begin with ``JOINED`` if they have none. After ``KEPT`` pieces the table
    starts afresh (``clear``).
    """

    def __init__(self, specials: list[str], learn: Callable[[list[str], bool], None], clear: Callable[[], None]):
        self.unfit = "|".join([_RUN_ARROW, JOINED, *map(re.escape, specials)])
        self.learn, self.clear = learn, clear
        self.rows: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def numbers(self, pieces: list[str], inner: bool) -> np.ndarray:
        rows = self.rows[inner]
        known = list(map(rows.get, pieces))
        if None not in known:
            return np.array(known, np.int64)
        new = [p for p, row in zip(pieces, known) if row is None]
        if inner and rows and sum(map(len, self.rows)) + len(new) > KEPT:
            self.rows[0].clear()
            self.rows[1].clear()
            self.clear()
            new = pieces
        if new:
            held = sum(map(len, self.rows))
            self.learn(new, inner)
            rows.update(zip(new, range(held, held + len(new))))
        return np.fromiter(map(rows.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Of slices of the texts (without null): the slice, which are odd, the row of each piece, and the number of
        pieces before each text and in all."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = [0, *np.flatnonzero(np.diff(size // SLICE, prepend=0)).tolist(), len(texts)]
        for a, b in zip(ends, ends[1:]):
            if a == b:
                continue
            part = texts.slice(a, b - a)
            odd = pc.match_substring_regex(part, self.unfit)
            own = pc.replace_substring_regex(pc.if_else(odd, "", part), _MARKS, rf"\1 {JOINED}\2")
            own = pc.replace_substring_regex(own, _LINES, rf"\1 {JOINED}\2")
            cut = pc.split_pattern(own, " ")
            own = cut.flatten().dictionary_encode()
            offsets = cut.offsets.to_numpy().astype(np.int64)
            pieces = own.dictionary.to_pylist()
            rows = self.numbers(pieces, True)[own.indices.to_numpy()]
            heads = [pieces[i] for i in own.indices.to_numpy()[offsets[:-1]].tolist()]
            of_heads = self.numbers(list(dict.fromkeys(heads)), False)  # learns them
            rows[offsets[:-1]] = of_heads if len(of_heads) == len(heads) else np.fromiter(map(self.rows[False].__getitem__, heads), np.int64, len(heads))
            odd = odd.to_numpy(zero_copy_only=False)
            del cut, own, pieces, heads, of_heads  # not held while the caller works
            yield part, odd, rows, offsets


class MergeCounter:
    """Token counts of a byte-level BPE vocabulary file, without token ids.

    ``word`` keeps the symbols of one word in a doubly linked list and the ranks of adjacent pairs in a heap, pops the
    lowest rank (the leftmost of equals), merges, and pushes the two new pairs. The count is the number of bytes
    less the number of merges.
    """

    def __init__(self, path: str):
        spec = specification(path)
        self.alphabet = byte_alphabet()
        number = {c: b for b, c in self.alphabet.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        for i, (a, b) in enumerate(merges):
            number.setdefault(a + b, 256 + i)
        self.width = 256 + len(merges)
        self.ranks = {}
        for i, (a, b) in enumerate(merges):
            self.ranks.setdefault(number[a] * self.width + number[b], (i, number[a + b]))
        special = [x["content"] for x in spec.get("added_tokens", []) if x.get("content")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.strings = special
        self.pattern = regex.compile(PATTERN)
        self.words = Memo(self.word, 400_000)
        self.pieces = Memo(self.piece, 400_000)
        self.clear()
        self.cut = Cut(special, self.learn, self.clear)

    def clear(self):
        self.table = np.zeros(0, np.int64)

    def learn(self, pieces: list[str], inner: bool) -> None:
        counts = [self.plain(p) if not inner else self.plain(p[1:]) if p.startswith(JOINED) else self.piece(p) for p in pieces]
        self.table = np.concatenate([self.table, np.array(counts, np.int64)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Of a batch of texts without null; each distinct piece is merged once while it is kept."""
        out = [np.zeros(0, np.int64)]
        for part, odd, rows, offsets in self.cut(texts):
            own = np.add.reduceat(self.table[rows], offsets[:-1])
            for i in np.flatnonzero(odd).tolist():
                own[i] = self.count(part[i].as_py())
            out.append(own)
        return np.concatenate(out)

    def word(self, word: str) -> int:
        symbols = list(word.encode())
        n, ranks, width = len(symbols), self.ranks, self.width
        if n == 1:
            return 1
        heap = [r[0] * n + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair[0] * width + pair[1]))]
        heapq.heapify(heap)
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            r = ranks.get(symbols[i] * width + symbols[j])
            if r is None or r[0] != rank:
                continue
            symbols[i], symbols[j] = r[1], -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if r := ranks.get(symbols[i] * width + symbols[k]):
                    heapq.heappush(heap, r[0] * n + i)
            if (k := before[i]) >= 0 and (r := ranks.get(symbols[k] * width + symbols[i])):
                heapq.heappush(heap, r[0] * n + k)
        return count

    def piece(self, piece: str) -> int:
        """Tokens of a piece that has a space before it."""
        return sum(map(self.words.__getitem__, self.pattern.findall(" " + piece)))

    def plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = pieces(text)
        return sum(map(self.words.__getitem__, self.pattern.findall(first))) + sum(map(self.pieces.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string in it is one token."""
        if self.special is None or not any(s in text for s in self.strings):
            return self.plain(text)
        between = self.special.split(text)
        return sum(map(self.plain, between)) + len(between) - 1


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)
