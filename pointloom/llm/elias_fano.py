"""Token ids as binary shards: one concatenated id array with Elias-Fano coded document boundaries.

A shard file holds

    magic "PLEF", version, bytes per id, flags, documents n, ids m          (32 byte head)
    the n + 1 boundaries (0 .. m), Elias-Fano coded
    the n doc_ids less the smallest, Elias-Fano coded, and the number of null ones before them
    the m ids as little-endian unsigned integers

Elias-Fano keeps the low l bits of each value packed, and the high parts in unary in a bit vector
of at most 3 n bits; with a sample of every 256th one-bit, ``select`` finds any value by reading a
few words.  That is about 2 + log2(m / n) bits a document where a 64-bit table takes 64.

Documents are dealt by range of doc_id, so shards follow each other in ascending doc_id order and
a manifest of shards (one short row each) gives every shard's first id position.  A shard is
written under a name of its own attempt and counts only if its row reaches the manifest: a task run
again after a lost executor, or twice by speculation, leaves nothing that is read.

Reading goes through the sampled ``select``: the boundaries of ``READ`` documents at a time, never a
table of all.

Null texts are empty documents with the end id alone; texts of any length are encoded whole; null doc_ids sort first; equal doc_ids stay
apart rows in the order of their texts' hashes; extra columns are not read; an empty table gives no
shards.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.bpe_core import ChunkTable, Vocabulary, byte_alphabet, gathered, slices
from pointloom.llm.byte_chunks import ByteTable, encoded
from pointloom.llm.common import fresh_path, written

MAGIC = b"PLEF"
SAMPLE = 256
#: Ids in a shard: more begin a new file, so that neither writer nor reader holds more.
SHARD_IDS = 4_000_000
#: Documents whose boundaries are decoded at once on reading.
READ = 1024


class EliasFano:
    """A rising sequence of unsigned integers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits and n:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n) if n else np.zeros(0, np.int64)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.range(i, i + 1)[0])

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: one-bit a is looked for from the sample before it, and the high parts
        are read on from there; value i is the place of one-bit i less i, with its low bits."""
        if not 0 <= a < b <= self.n:
            raise IndexError((a, b))
        start = int(self.samples[a // SAMPLE])
        skip = a % SAMPLE  # ones still to pass
        byte = start // 8
        skip += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: start % 8].sum())
        places, missing, step = [], b - a, 64
        while missing:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + step], bitorder="little"))
            own = ones[skip : skip + missing] + byte * 8
            places.append(own)
            skip, missing, byte, step = max(0, skip - len(ones)), missing - len(own), byte + step, 1024
        place = np.concatenate(places)
        out = (place - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first, last = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first].reshape(b - a, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def parts(self, size: int) -> Iterator[np.ndarray]:
        """All values, ``size`` at a time."""
        for a in range(0, self.n, size):
            yield self.range(a, min(a + size, self.n))

    def all(self) -> np.ndarray:
        """Every value."""
        return self.range(0, self.n) if self.n else np.zeros(0, np.uint64)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high, samples = np.frombuffer(data, "<u8", 5, at).tolist()
        at += 40
        a = np.frombuffer(data, np.uint8, low, at)
        b = np.frombuffer(data, np.uint8, high, at + low)
        c = np.frombuffer(data, "<u8", samples, at + low + high)
        return cls(n, low_bits, a, b, c), at + low + high + 8 * samples


class Shard:
    """A shard as read: ids of any document by ``select`` on its boundaries."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token shard")
        width, nulls, self.n, self.m, least = view[5], *np.frombuffer(view, "<i8", 4, 8).tolist()
        self.bounds, at = EliasFano.read(view, 40)
        self.keys, at = EliasFano.read(view, at)
        self.nulls, self.least = nulls, np.uint64(least & (2**64 - 1))
        self.ids = np.frombuffer(view, f"<u{width}", self.m, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self, a: int, b: int) -> pa.Array:
        """The ids of documents a to b - 1, nulls first."""
        nulls = max(0, min(b, self.nulls) - a)
        known = (self.keys.range(a + nulls - self.nulls, b - self.nulls) + self.least).astype(np.int64) if a + nulls < b else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known, pa.int64())])


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One file's content; ``doc_ids`` ascend with nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    keys = known.astype(np.uint64) - np.uint64(least & (2**64 - 1))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    head = MAGIC + bytes([1, width, 0, 0]) + np.array([nulls, len(doc_ids), len(ids), least], "<i8").tobytes()
    return head + EliasFano.of(bounds).to_bytes() + EliasFano.of(keys).to_bytes() + np.asarray(ids, f"<u{width}").tobytes()


class LibraryEncoder:
    """Ids as the tokenizers library gives them, for chunks seen before from a bounded table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        if self.vocabulary.words:
            raise ValueError("byte-level files only")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.vocabulary.size <= 1 << 16 else 4
        self.feed = self.vocabulary.ids[chr(266)]  # the line feed's id
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet()) if b != 10}
        dtype = np.uint16 if self.width == 2 else np.int32
        self.table = ByteTable(self.encode_new, dtype)
        self.strings = ChunkTable(self.encode_new, limit=100_000, dtype=dtype)

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of new chunks.

        A chunk of letters is one pre-token and goes straight to the library's model, in the
        model's alphabet.  Others are given to the library as lines of one text, as a line feed
        between them is always a token of its own; those of white space alone and special strings
        go one by one.
        """
        parts: dict[str, list[int]] = {}
        letters = [c for c in new if c.isalpha() or c[0] == " " and c[1:].isalpha()]
        if letters:
            tokenize = self.library.model.tokenize
            mapped = "\n".join(letters).encode().decode("latin-1").translate(self.alphabet).split("\n")
            parts.update((c, [t.id for t in tokenize(m)]) for c, m in zip(letters, mapped))
        rest = [c for c in new if c not in parts]
        alone = [c for c in rest if c.isspace() or c in self.vocabulary.specials]
        if alone:
            parts.update((c, e.ids) for c, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False)))
        lined = [c for c in rest if c not in parts]
        for a in range(0, len(lined), 200):
            own = lined[a : a + 200]
            ids = self.library.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids
            at = np.flatnonzero(np.array(ids) == self.feed).tolist()
            if len(at) != len(own) - 1:
                raise AssertionError("a line feed was merged")
            parts.update((c, ids[x:y]) for c, x, y in zip(own, [0, *[i + 1 for i in at]], [*at, len(ids)]))
        flat: list[int] = []
        ends = []
        for c in new:
            flat += parts[c]
            ends.append(len(flat))
        return np.array(flat, np.int64), np.diff(np.array(ends, np.int64), prepend=0)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that need the patterns' own pre-tokens."""
        out = []
        for a, b in slices(np.array(list(map(len, texts)), np.int64), 2_000_000):
            chunks, counts = gathered(self.vocabulary, texts[a:b])
            rows = self.strings.lookup(chunks)
            sizes = np.concatenate([[0], np.cumsum(self.strings.lengths[rows])])
            out += np.split(self.strings.ids(rows), sizes[np.cumsum(counts)][:-1])
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts with the end id after each, and lengths."""
        flat, lengths = [], []
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes, 4_000_000):
            ids, own = encoded(self.table, texts.slice(a, b - a), list(self.vocabulary.specials), self.whole, self.whole)
            flat.append(np.insert(ids.astype(f"<u{self.width}"), np.cumsum(own), end_id))
            lengths.append(own + 1)
        return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.zeros(0, f"<u{self.width}"), np.zeros(0, np.int64))


_encoders: dict[str, LibraryEncoder] = {}


def _store(uri: str):
    """File system and path of a URI, for Python on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write shards of all documents to ``folder``; gives the stored manifest
    (part, seq, path, n_docs, n_ids, start), where ``start`` counts the ids of all shards before."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = LibraryEncoder(tokenizer)
        own = _encoders[tokenizer]
        part, seq = TaskContext.get().partitionId(), 0
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.plef"
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            with store.open_output_stream(name) as f:
                f.write(shard_bytes(keys, sizes, flat, own.width))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name.rpartition("/")[2]], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64())})

        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 8_000_000):
                flat, sizes = own.encode(texts.slice(a, b - a), end_id)
                keys += docs_[a:b]
                ids.append(flat)
                lengths.append(sizes)
                held += len(flat)
                if held >= shard_ids:
                    yield flush()
                    keys, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield flush()

    manifest = written(dealt.drop("tie").mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "manifest")
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, whatever its documents
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    32-bit integers); with ``keep_ids`` also ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n, READ):  # offsets of so many documents at a time, by select
                    b = min(a + READ, shard.n)
                    bounds = shard.bounds.range(a, b + 1).astype(np.int64)
                    wide = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    own = bounds - bounds[0]
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist())]
                    more = [pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(wide.astype(np.int32)))] if keep_ids else []
                    yield pa.RecordBatch.from_arrays([shard.doc_ids(a, b), pa.array(start + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), *more], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(run, schema)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back from the files."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_documents(write_shards(docs, tokenizer, end_id, folder), folder)
