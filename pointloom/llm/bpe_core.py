"""Byte-pair encoding on flat numpy arrays, shared by the encoder, the counter and the binary writer.

Texts are cut into *chunks* that encode independently of what surrounds them (runs without white
space, with or without the blank before them); chunks recur, so each worker keeps a bounded table
of the chunks it has seen and only new ones go through the merge rounds.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable
from itertools import islice, repeat

import numpy as np
import regex

#: Published pre-tokenisation patterns of the two supported kinds of file (fixed values).
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 40

#: A pre-token above this many bytes has rounds of its own (``merge_long``); together with the others
#: each round would scan it whole.
LONG = 400


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, every other byte for the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[s : s + n]`` end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(total)]


class Vocabulary:
    """Merges of a tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)  # the kind with word ends, lower case and no white space
        self.size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.token = [""] * self.size
        for t, i in [*self.ids.items(), *self.specials.items()]:
            self.token[i] = t
        alphabet = byte_alphabet()
        self.of_byte = np.array([self.ids[c] for c in alphabet], np.int64)
        self.of_last = np.array([self.ids[c + self.suffix] for c in alphabet], np.int64)
        left, right, new = [], [], []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            left.append(self.ids[a])
            right.append(self.ids[b])
            new.append(self.ids[a + b])
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(new, np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        # all places of a rank may be merged at once only if no merge makes a pair of a lower rank
        made_at = np.full(self.size, -1)
        made_at[self.made] = np.arange(len(new))
        if len(np.unique(self.made)) < len(new) or (np.maximum(made_at[self.left], made_at[self.right]) > np.arange(len(new))).any():
            raise ValueError("a merge comes before the symbols it needs")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials))) + ")") if self.specials else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys; NONE where there is no merge."""
        want = left * self.size + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all pieces in one flat array, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        out = self.of_byte[raw]
        if self.suffix and len(raw):
            last = np.cumsum(sizes)[sizes > 0] - 1
            out[last] = self.of_last[raw[last]]
        return out, sizes


def merge_long(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """One long sequence after all merges.

    The places of every known pair are kept by rank.  A round takes the lowest rank, merges all its
    places at once, links the neighbours over the gaps and ranks only the pairs that changed, so a
    round costs its own merges and not the sequence's length.
    """
    n, sym = len(symbols), symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def add(at: np.ndarray) -> None:
        rank = v.rank(sym[at], sym[after[at]])
        at, rank = at[rank < NONE], rank[rank < NONE]
        order = np.argsort(rank, kind="stable")
        own, firsts = np.unique(rank[order], return_index=True)
        for r, part in zip(own.tolist(), np.split(at[order], firsts[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(part)

    add(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[(sym[at] == v.left[r]) & (after[at] < n)]
        at = at[sym[after[at]] == v.right[r]]
        if v.left[r] == v.right[r] and len(at) > 1:  # in a run of overlapping pairs every second one
            first = np.ones(len(at), bool)
            first[1:] = after[at[:-1]] != at[1:]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        gone = after[at]
        sym[at], sym[gone] = v.made[r], -1
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at[inner]]] = at[inner]
        add(np.unique(np.concatenate([at[inner], before[at[before[at] >= 0]]])))
    return sym[sym >= 0]


def pretokens(v: Vocabulary, chunk: str) -> list[bytes]:
    """The pieces of a chunk that merges don't cross."""
    if v.words:
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [x.encode() for x in WORD_PIECES.findall(chunk)]
    return [x.encode() for x in BYTE_PIECES.findall(chunk)]


BYTE_PIECES = regex.compile(BYTE_PATTERN)
WORD_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+""")
#: Characters that Python's split() takes for white space and the patterns don't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def plain(text: str) -> bool:
    """Whether all white space is single blanks and single line feeds between other characters."""
    words = text.split()
    gaps = text.count(" ") + text.count("\n")
    return len(words) == gaps + 1 and len(text) - sum(map(len, words)) == gaps and "\0" not in text


def chunks_of(v: Vocabulary, text: str) -> list[str]:
    """Chunks of a text without special strings, in order; each encodes the same wherever it stands.

    With word ends, white space only separates.  At byte level a chunk is a run without white space
    with the blank before it, or a line feed; where white space comes in longer runs or other
    characters, the pre-tokens themselves are the chunks.
    """
    if v.words:
        return regex.split(r"\s+", text) if any(c in text for c in ODD_SPACE) else text.split()
    if plain(text):  # split before blanks and around line feeds
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return BYTE_PIECES.findall(text)


class ChunkTable:
    """Encoded chunks of one worker, at most ``limit`` of them.  When full, the later half goes:
    frequent chunks are met early.

    ``encode`` maps a list of new chunks to (flat ids, lengths).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000, dtype=np.int32):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def halve(self) -> None:
        n = min(self.limit // 2, len(self.index) // 2)
        self.index = dict(islice(self.index.items(), n))
        self.used = int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0

    def lookup(self, chunks: list[str]) -> np.ndarray:
        """Row of each chunk in ``starts`` and ``lengths``; valid until the next call."""
        rows = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            lost = [chunks[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lost))
            if len(self.index) + len(new) > self.limit and self.index:
                self.halve()
                return self.lookup(chunks)
            self.add(new)
            rows[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int64, len(lost))
        return rows

    def add(self, new: list[str]) -> None:
        ids, lengths = self.encode(new)
        n = len(self.index)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(new)] = lengths
        self.used += len(ids)
        self.index.update(zip(new, range(n, n + len(new))))

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return ragged_take(self.flat, self.starts[rows], self.lengths[rows])


def gathered(v: Vocabulary, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray]:
    """Chunks of many texts end to end and how many each text has; special strings are chunks."""
    chunks: list[str] = []
    counts = []
    for text in texts:
        before = len(chunks)
        if text:
            if any(s in text for s in v.specials):
                for i, part in enumerate(v.special.split(text)):
                    if part:
                        chunks += [part] if i % 2 else chunks_of(v, part)
            else:
                chunks += chunks_of(v, text)
        counts.append(len(chunks) - before)
    return chunks, np.array(counts, np.int64)


def by_pretoken(v: Vocabulary, merge: Callable[[Vocabulary, list[bytes]], tuple[np.ndarray, np.ndarray]]):
    """An ``encode`` for ChunkTable: cut chunks into pre-tokens, merge the distinct ones, lay them out again."""

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[bytes] = []
        counts = []
        for c in new:
            own = [] if c in v.specials else pretokens(v, c)
            pieces += own
            counts.append(len(own))
        distinct = dict.fromkeys(pieces)
        flat, lengths = merge(v, list(distinct))
        where = {p: i for i, p in enumerate(distinct)}
        at = np.fromiter(map(where.__getitem__, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        own = lengths[at]
        ids = ragged_take(flat, starts[at], own)
        of = np.repeat(np.arange(len(new)), counts)
        total = np.bincount(of, weights=own, minlength=len(new)).astype(np.int64) if len(new) else np.zeros(0, np.int64)
        special = [i for i, c in enumerate(new) if c in v.specials]
        if special:  # each gets its one id at its place
            place = (np.cumsum(total) - total)[special]
            ids = np.insert(ids, place, [v.specials[new[i]] for i in special])
            total[special] = 1
        return ids, total

    return encode


def slices(counts: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows whose counts add up to about ``most``."""
    if not len(counts):
        return
    group = (np.cumsum(counts) - counts) // max(1, most)
    edges = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *edges.tolist(), len(counts)]
    yield from zip(bounds[:-1], bounds[1:])
