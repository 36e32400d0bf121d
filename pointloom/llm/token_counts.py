"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged arrays, batched by length.  A round applies to every sequence of a
batch its own lowest-rank pair (the leftmost, if it occurs more than once) at the same time, so all
sequences still merging shrink by one symbol together; those without a known pair leave, and the
symbols that survive are the count.  No ids are laid out.  In a sequence of over ``LONG`` bytes a
round merges all places of its lowest-rank pair and touches only what changes.

Nulls and empty texts count zero tokens; repeated rows stay; extra columns are not read; texts are
counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

from pointloom.llm.bpe_core import LONG, NONE, ChunkTable, Vocabulary, gathered, merge_long, pretokens, ragged_take, slices
from pointloom.llm.byte_chunks import ByteTable, counted

#: Symbols that one batch of equal lengths holds at most; bounds memory.
BATCH_SYMBOLS = 2_000_000


def surviving(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Symbols left of each row of ``sym`` (rows of equal length) after all merges."""
    left = np.full(len(sym), sym.shape[1], np.int64)
    rows = np.arange(len(sym))
    rank = v.rank(sym[:, :-1], sym[:, 1:])
    while rank.shape[1] and len(rows):
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(rows)), at]
        live = best < NONE
        left[rows[~live]] = sym.shape[1]
        rows, sym, rank, at, best = rows[live], sym[live], rank[live], at[live], best[live]
        if not len(rows):
            break
        line = np.arange(len(rows))
        sym[line, at] = v.made[best]
        width = sym.shape[1] - 1
        column = np.arange(width)
        take = column + (column > at[:, None])  # the symbol right of the merged one goes
        sym = np.take_along_axis(sym, take, axis=1)
        column = column[: width - 1]
        take = column + (column >= at[:, None])
        rank = np.take_along_axis(rank, take, axis=1)
        for where in (at - 1, at):
            ok = (where >= 0) & (where < width - 1)
            i, c = line[ok], where[ok]
            rank[i, c] = v.rank(sym[i, c], sym[i, c + 1])
        left[rows] = width
    return left


def count_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """An empty array (no ids are needed) and the tokens of each piece."""
    symbols, sizes = v.symbols(pieces)
    starts = np.cumsum(sizes) - sizes
    out = sizes.copy()
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes):
        own = order[np.searchsorted(sizes[order], n, "left") : np.searchsorted(sizes[order], n, "right")]
        if n < 2:
            continue
        if n > LONG:
            for i in own:
                out[i] = len(merge_long(v, symbols[starts[i] : starts[i] + n]))
            continue
        step = max(1, BATCH_SYMBOLS // int(n))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            flat = ragged_take(symbols, starts[part], sizes[part])
            out[part] = surviving(v, flat.reshape(len(part), int(n)))
    return np.zeros(0, np.int64), out


class Counter:
    """Counts tokens of texts for one tokenizer file; keeps a bounded table of chunks."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        encode = by_pretoken_counts(self.vocabulary)
        self.table = ChunkTable(encode, limit=100_000 if not self.vocabulary.words else 500_000)
        self.bytes = None if self.vocabulary.words else ByteTable(encode, np.uint8)

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array."""
        if self.bytes is None:
            return self.count(texts.to_pylist())
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        parts = [counted(self.bytes, texts.slice(a, b - a), list(self.vocabulary.specials), self.count) for a, b in slices(sizes, 4_000_000)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(np.array([len(t or "") for t in texts], np.int64), 4_000_000):
            chunks, counts = gathered(self.vocabulary, texts[a:b])
            if chunks:
                rows = self.table.lookup(chunks)
                own = self.table.lengths[rows]
                before = np.concatenate([[0], np.cumsum(own)])
                ends = np.cumsum(counts)
                out[a:b] = before[ends] - before[ends - counts]
        return out


def by_pretoken_counts(v: Vocabulary):
    """``by_pretoken`` for counts alone: a chunk has the tokens of its pieces, a special string one."""

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = [], []
        for c in new:
            own = [] if c in v.specials else pretokens(v, c)
            pieces += own
            counts.append(len(own))
        distinct = list(dict.fromkeys(pieces))
        tokens = dict(zip(distinct, count_pieces(v, distinct)[1].tolist()))
        per = np.concatenate([[0], np.cumsum(np.fromiter(map(tokens.__getitem__, pieces), np.int64, len(pieces)))]).astype(np.int64)
        ends = np.cumsum(counts).astype(np.int64)
        total = per[ends] - per[ends - np.array(counts, np.int64)]
        for i, c in enumerate(new):
            if c in v.specials:
                total[i] = 1
        return np.zeros(0, np.int64), total

    return encode


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for batch in batches:
            n = _counters[path].count_array(batch.column(1))
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
