"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Every round finds the ranks of the pairs that
changed by binary search over the sorted pair keys, takes each word's lowest rank, merges all its
occurrences and closes the gaps; words without a known pair leave the array.

A word of over ``LONG`` bytes has rounds of its own, which touch only the places that change.

Nulls and empty texts encode to no ids (and decode to an empty text); repeated rows give repeated
results; extra columns are not read; texts of any length are read whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointloom.llm.bpe_core import LONG, NONE, ChunkTable, Vocabulary, by_pretoken, gathered, merge_long, ragged_take, slices

#: Chunks that one merge batch lays out at once; bounds a worker's memory whatever the texts' length.
BATCH_CHUNKS = 400_000


def alternate(hit: np.ndarray) -> np.ndarray:
    """Of runs of overlapping hits every second one, from the first (a a a a: two merges, not three)."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros_like(hit)
    out[at[(at - first) % 2 == 0]] = True
    return out


def merge_rounds(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one flat array, and how many each has."""
    symbols, sizes = v.symbols(pieces)
    done_words, done_sizes, done_symbols = [], [], []
    starts = np.cumsum(sizes) - sizes
    for w in np.flatnonzero(sizes > LONG):
        ids = merge_long(v, symbols[starts[w] : starts[w] + sizes[w]])
        done_words.append([w])
        done_sizes.append([len(ids)])
        done_symbols.append(ids)
    words = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    sym = ragged_take(symbols, starts[words], sizes[words])
    size = sizes[words]
    rank = np.full(len(sym), NONE)
    if len(sym) > 1:
        inner = np.ones(len(sym) - 1, bool)
        inner[np.cumsum(size)[:-1] - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = v.rank(sym[at], sym[at + 1])
    while len(words):
        best = np.minimum.reduceat(rank, np.cumsum(size) - size)
        live = best < NONE
        if not live.all():
            of = np.repeat(live, size)
            done_words.append(words[~live])
            done_sizes.append(size[~live])
            done_symbols.append(sym[~of])
            words, size, best, sym, rank = words[live], size[live], best[live], sym[of], rank[of]
            if not len(words):
                break
        hit = alternate(rank == np.repeat(best, size))
        at = np.flatnonzero(hit)
        word_of = np.repeat(np.arange(len(words)), size)
        sym[at] = v.made[rank[at]]
        last = np.zeros(len(sym), bool)  # where a word ends
        last[np.cumsum(size) - 1] = True
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        changed = hit.copy()
        before = np.maximum(at - 1, 0)
        before = np.where(keep[before], before, np.maximum(before - 1, 0))  # over the symbol that the merge before took
        changed[before] = True
        size = size - np.bincount(word_of[at], minlength=len(words))
        sym, rank, last, changed = sym[keep], rank[keep], last[keep], changed[keep]
        rank[last] = NONE
        again = np.flatnonzero(changed & ~last)
        rank[again] = v.rank(sym[again], sym[again + 1])
    counts = np.zeros(len(pieces), np.int64)
    where = np.zeros(len(pieces), np.int64)
    if not done_words:
        return np.zeros(0, np.int64), counts
    order, flat = np.concatenate(done_words).astype(np.int64), np.concatenate(done_symbols).astype(np.int64)
    own = np.concatenate(done_sizes).astype(np.int64)
    counts[order], where[order] = own, np.cumsum(own) - own
    return ragged_take(flat, where, counts), counts


class Codec:
    """Encoder and decoder for one tokenizer file; keeps a bounded table of chunks."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.table = ChunkTable(by_pretoken(self.vocabulary, merge_rounds), limit=200_000)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        texts = list(texts)
        for a, b in slices(np.array([len(t or "") for t in texts], np.int64), 2_000_000):
            chunks, counts = gathered(self.vocabulary, texts[a:b])
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):  # whole texts of about BATCH_CHUNKS chunks; a larger one alone
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHUNKS, "right")))
                low, high = int(ends[at - 1]) if at else 0, int(ends[to - 1])
                rows = self.table.lookup(chunks[low:high])
                ids = self.table.ids(rows)
                per_chunk = np.concatenate([[0], np.cumsum(self.table.lengths[rows])])
                cuts = per_chunk[ends[at:to] - low]
                yield from np.split(ids, cuts[:-1])
                at = to

    def decode(self, ids: np.ndarray) -> str:
        """Tokens of the ids joined as the library does for a file without a decoder: by blanks."""
        token = self.vocabulary.token
        return " ".join([token[i] for i in ids.tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file, made once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids and decoded.
    Each row stands alone, so there is no exchange and a lost task is simply run again.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, sha, back, all_ids, all_texts = [], [], [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                text = own.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                    all_texts.append(text)
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *more],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep_ids],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
