"""Chunks of byte-level text found and looked up without a Python object for each.

Works on the bytes of an Arrow string column.  In a *plain* text all white space is single blanks
and line feeds between other characters; there a chunk is a run of other bytes with the blank
before it, a line feed, or a comma or full stop between an ASCII letter and white space.  Such
chunks encode the same wherever they stand.  All other texts (and chunks of over 24 bytes) take the
slower way through strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pointloom.llm.bpe_core import ragged_take

WIDE = 24
#: First bytes of UTF-8 sequences that may be white space, with the bytes that may follow (fixed values).
SPACES = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
ODD_BYTES = (0x09, 0x0B, 0x0C, 0x0D)


def flags(values: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


LETTER = flags((*range(65, 91), *range(97, 123)))
TAIL = flags((0x2C, 0x2E))
ODD = flags(ODD_BYTES)
GAP = flags((0x20, 0x0A))
MULTI = flags(tuple({k[0] for k in SPACES}))


class Batch:
    """Plain texts of a string array as chunks: start, size and text number of each."""

    def __init__(self, texts: pa.Array, specials: list[str]):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = int(bounds[0]), int(bounds[-1])
        self.bytes = np.zeros(high - low + 40, np.uint8)  # room for whole words behind the end
        if high > low:
            self.bytes[: high - low] = np.frombuffer(data, np.uint8)[low:high]
        self.bounds = bounds - low
        b, n = self.bytes[: high - low], high - low
        gap = GAP[b]
        filled = np.flatnonzero(np.diff(self.bounds) > 0)
        odd = [np.flatnonzero(ODD[b]), np.flatnonzero(gap[:-1] & gap[1:])]
        lead = np.flatnonzero(MULTI[b])
        for head, tails in SPACES.items():
            at = lead[b[lead] == head[0]]
            for k, byte in enumerate(head[1:], 1):
                at = at[self.bytes[at + k] == byte]
            odd.append(at[np.isin(self.bytes[at + len(head)], tails)])
        for s in specials:  # where one may begin
            first = s.encode()[:2]
            at = np.flatnonzero(b == first[0])
            odd.append(at[self.bytes[at + 1] == first[1]] if len(first) > 1 else at)
        self.slow = np.zeros(len(texts), bool)
        at = np.concatenate(odd)
        self.slow[np.searchsorted(self.bounds, at, "right") - 1] = True
        firsts, lasts = self.bounds[filled], self.bounds[filled + 1] - 1
        self.slow[filled[gap[firsts] | gap[lasts]]] = True
        begins = gap.copy()
        feeds = np.flatnonzero(b == 0x0A) + 1
        begins[feeds[feeds < n]] = True
        begins[firsts] = True
        if n > 1:
            tails = np.flatnonzero(TAIL[b])
            ends = np.zeros(n + 1, bool)
            ends[self.bounds] = True
            ends[:n] |= gap
            tails = tails[(tails > 0) & ends[tails + 1]]
            begins[tails[LETTER[b[tails - 1]]]] = True  # a letter of another text before it changes nothing: texts begin chunks anyway
        self.starts = np.flatnonzero(begins)
        self.sizes = np.diff(self.starts, append=n)
        self.of = np.searchsorted(self.bounds, self.starts, "right") - 1
        if self.slow.any():
            keep = ~self.slow[self.of]
            self.starts, self.sizes, self.of = self.starts[keep], self.sizes[keep], self.of[keep]

    def keys(self) -> list[np.ndarray]:
        """Each chunk's first 24 bytes as three words, zero behind its end."""
        words = np.ndarray((len(self.bytes) - 7,), "<u8", buffer=self.bytes, strides=(1,))
        out = []
        for k in range(0, WIDE, 8):
            left = np.clip(self.sizes - k, 0, 8)
            w = words[np.minimum(self.starts + k, len(words) - 1)]
            out.append(np.where(left > 0, w & (~np.uint64(0) >> (np.uint64(64) - 8 * np.maximum(left, 1).astype(np.uint64))), np.uint64(0)))
        return out

    def texts(self, chunks: np.ndarray) -> list[str]:
        data = self.bytes.data
        starts = self.starts[chunks]
        return [str(data[a:b], "utf-8") for a, b in zip(starts.tolist(), (starts + self.sizes[chunks]).tolist())]


class ByteTable:
    """Encoded chunks by their bytes in an open hash table of numpy arrays; at most ``limit``, of
    which the later half goes when full."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 3_000_000):
        self.encode, self.limit = encode, limit
        self.slots = np.full(1 << (2 * limit - 1).bit_length(), -1, np.int32)
        self.words = [np.zeros(1 << 14, np.uint64) for _ in range(WIDE // 8)]
        self.size_of = np.zeros(1 << 14, np.uint8)
        self.starts, self.lengths = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint8)
        self.flat = np.zeros(1 << 16, dtype)
        self.n = self.used = 0

    def place(self, words: list[np.ndarray]) -> np.ndarray:
        h = words[0] * np.uint64(0x9E3779B97F4A7C15)
        for w in words[1:]:
            h = (h ^ (h >> np.uint64(29)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, words: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Row of each chunk, -1 where it is new."""
        out = np.full(len(sizes), -1, np.int32)
        left, slot = np.arange(len(sizes)), self.place(words)
        while len(left):
            row = self.slots[slot]
            there = row >= 0
            left, slot, row = left[there], slot[there], row[there]
            same = self.words[0][row] == words[0][left]
            for own, w in zip(self.words[1:], words[1:]):
                same &= own[row] == w[left]
            same &= self.size_of[row] == sizes[left]
            out[left[same]] = row[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def insert(self, rows: np.ndarray) -> None:
        slot = self.place([w[rows] for w in self.words])
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            lost = self.slots[slot] != rows
            rows, slot = rows[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def grown(self, a: np.ndarray, n: int) -> np.ndarray:
        while len(a) < n:
            a = np.concatenate([a, np.zeros_like(a)])
        return a

    def lookup(self, batch: Batch, words: list[np.ndarray]) -> np.ndarray:
        rows = self.find(words, batch.sizes)
        while len(missing := np.flatnonzero(rows < 0)):
            pick = np.unique(self.place([w[missing] for w in words]) * 32 + batch.sizes[missing], return_index=True)[1]
            new = missing[np.sort(pick)]  # of chunks that collide the first; the others come in the next turn
            if self.n and self.n + len(new) > self.limit:
                self.n = min(self.n // 2, self.limit // 2)
                self.used = int(self.starts[self.n - 1]) + int(self.lengths[self.n - 1]) if self.n else 0
                self.slots.fill(-1)
                self.insert(np.arange(self.n, dtype=np.int32))
                return self.lookup(batch, words)
            ids, lengths = self.encode(batch.texts(new))
            n, m = self.n + len(new), self.used + len(ids)
            self.words = [self.grown(a, n) for a in self.words]
            self.size_of, self.starts, self.lengths, self.flat = self.grown(self.size_of, n), self.grown(self.starts, n), self.grown(self.lengths, n), self.grown(self.flat, m)
            for a, w in zip(self.words, words):
                a[self.n : n] = w[new]
            self.size_of[self.n : n], self.lengths[self.n : n] = batch.sizes[new], lengths
            self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : m] = ids
            added = np.arange(self.n, n, dtype=np.int32)
            self.n, self.used = n, m
            self.insert(added)
            rows[missing] = self.find([w[missing] for w in words], batch.sizes[missing])
        return rows


def encoded(table: ByteTable, texts: pa.Array, specials: list[str], slow: Callable[[list[str]], list[np.ndarray]], long: Callable[[list[str]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and their lengths; null texts are empty.

    ``slow`` encodes whole texts that aren't plain, ``long`` chunks of over 24 bytes.
    """
    texts = texts.fill_null("")
    batch = Batch(texts, specials)
    lengths = np.zeros(len(texts), np.int64)
    wide = np.flatnonzero(batch.sizes > WIDE)
    odd_ids = long(batch.texts(wide))
    kept = batch.sizes <= WIDE
    if len(wide):
        starts, sizes, of = batch.starts, batch.sizes, batch.of
        batch.starts, batch.sizes, batch.of = starts[kept], sizes[kept], of[kept]
    rows = table.lookup(batch, batch.keys())
    own_starts, own_lengths, flat = table.starts[rows].astype(np.int64), table.lengths[rows].astype(np.int64), table.flat
    if len(wide):  # chunks of any length in their order again, long ones behind the table's ids
        extra = np.array([len(x) for x in odd_ids], np.int64)
        all_starts, all_lengths = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        all_starts[kept], all_lengths[kept] = own_starts, own_lengths
        all_starts[wide], all_lengths[wide] = table.used + np.cumsum(extra) - extra, extra
        flat = np.concatenate([flat[: table.used], *odd_ids])
        own_starts, own_lengths, batch.of = all_starts, all_lengths, of
    ids = ragged_take(flat, own_starts, own_lengths)
    lengths = np.bincount(batch.of, weights=own_lengths, minlength=len(texts)).astype(np.int64)
    at = np.flatnonzero(batch.slow)
    if len(at):
        parts = slow(texts.take(pa.array(at)).to_pylist())
        place = (np.cumsum(lengths) - lengths)[at]
        pieces, before = [], 0
        for i, p in zip(place.tolist(), parts):
            pieces += [ids[before:i], p]
            before = i
        ids = np.concatenate([*pieces, ids[before:]])
        lengths[at] = [len(p) for p in parts]
    return ids, lengths


def counted(table: ByteTable, texts: pa.Array, specials: list[str], plain_count: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """Tokens of each text, from a table that holds lengths alone; null texts have none.
    ``plain_count`` counts texts that aren't plain, and chunks of over 24 bytes."""
    texts = texts.fill_null("")
    batch = Batch(texts, specials)
    own = np.zeros(len(batch.sizes), np.int64)
    wide, kept = np.flatnonzero(batch.sizes > WIDE), batch.sizes <= WIDE
    of = batch.of
    if len(wide):
        own[wide] = plain_count(batch.texts(wide))
        batch.starts, batch.sizes, batch.of = batch.starts[kept], batch.sizes[kept], batch.of[kept]
    rows = table.lookup(batch, batch.keys())
    own[kept] = table.lengths[rows]
    out = np.bincount(of, weights=own, minlength=len(texts)).astype(np.int64)
    at = np.flatnonzero(batch.slow)
    if len(at):
        out[at] = plain_count(texts.take(pa.array(at)).to_pylist())
    return out
