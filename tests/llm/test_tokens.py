import hashlib
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import bpe_codec, elias_fano, token_counts
from pointloom.llm.bpe_core import merge_long
from pointloom.llm.queries import tokenizer
from tests.llm.cases import documents

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: tokenizers.Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def odd_texts(n=3000):
    rng = random.Random(1)
    parts = list(" \n\t \x1c\x85ab AB'sTre123é́ΣσςİΑ.,!?# \u3000\u200b\xadß日本語🙂\0_") + ["<|endoftext|>", "word, ", "word. ", "a.\n", "  ", "it's", "THE ", "hello world"]
    return [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)], "x" * 3000 + " " + "ab" * 2000, "a" * 30 + ", b" * 50]


def test_round_trip_matches_the_library(spark, library):
    df = documents(spark)
    got = [r for r in bpe_codec.round_trip(df, WORDS, keep_ids=True).collect()]
    lib = library[WORDS]
    want = sorted((r["doc_id"] is None, r["doc_id"], hashlib.sha256(np.array(e := lib.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest(), len(e)) for r in df.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in got) == want
    assert bpe_codec.round_trip(documents(spark, empty=True), WORDS).count() == 0


def test_rounds_match_the_library_on_odd_texts(library):
    texts = odd_texts()
    for path in (BYTES, WORDS):
        own = list(bpe_codec.Codec(path).encode(texts))
        assert all(a.tolist() == library[path].encode(t or "", add_special_tokens=False).ids for a, t in zip(own, texts))


def merge_with_heap(v, symbols: list[int]) -> list[int]:
    """One pair at a time: a linked list and a heap of (rank, place)."""
    n, sym = len(symbols), list(symbols)
    table = dict(zip(v.keys.tolist(), v.ranks.tolist()))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = lambda i: table.get(sym[i] * v.size + sym[after[i]]) if after[i] < n else None
    heap = [(r, i) for i in range(n) if (r := rank_of(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if sym[i] < 0 or rank_of(i) != r:
            continue
        j = after[i]
        sym[i], sym[j] = int(v.made[r]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and (x := rank_of(k)) is not None:
                heapq.heappush(heap, (x, k))
    return [x for x in sym if x >= 0]


def test_long_sequences_match_pair_by_pair():
    v = bpe_codec.Codec(BYTES).vocabulary
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("a", "ab", "aabbth", "etaoinshrdlu", "0123456789abcdef") for n in (1, 2, 3, 401, 5000)]
    for t in texts:
        own = v.of_byte[np.frombuffer(t.encode(), np.uint8)]
        assert merge_long(v, own).tolist() == merge_with_heap(v, own.tolist())


def test_heap_and_rounds_agree():
    v = bpe_codec.Codec(BYTES).vocabulary
    rng = random.Random(2)
    pieces = ["".join(rng.choice("aabcdeth") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    flat, counts = bpe_codec.merge_rounds(v, pieces)
    ends = np.cumsum(counts)
    for p, a, b in zip(pieces, ends - counts, ends):
        assert flat[a:b].tolist() == merge_with_heap(v, v.of_byte[np.frombuffer(p, np.uint8)].tolist())


def test_counts_match_the_library(spark, library):
    df = documents(spark)
    got = token_counts.token_counts(df, BYTES, 100).collect()
    lib = library[BYTES]
    want = sorted((r["doc_id"] is None, r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in df.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    texts = odd_texts()
    counter = token_counts.Counter(BYTES)
    assert counter.count(texts).tolist() == counter.count_array(pa.array(texts)).tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.token_counts(documents(spark, empty=True), BYTES).count() == 0


def test_small_table_of_chunks_changes_nothing(library):
    texts = odd_texts(400)
    codec = bpe_codec.Codec(BYTES)
    codec.table.limit = 50
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library[BYTES].encode(text or "", add_special_tokens=False).ids
    own = elias_fano.LibraryEncoder(BYTES)
    own.table.limit = own.strings.limit = 50
    flat, lengths = own.encode(pa.array(texts), 2)
    for text, ids in zip(texts, np.split(flat, np.cumsum(lengths)[:-1])):
        assert ids.tolist() == [*library[BYTES].encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2**62], sorted(random.Random(3).sample(range(10**6), 1000)), [0] * 700 + [10**12] * 700, list(range(2000))])
def test_elias_fano(values):
    ef = elias_fano.EliasFano.of(np.array(values, np.uint64))
    back, _ = elias_fano.EliasFano.read(memoryview(ef.to_bytes()), 0)
    assert back.all().tolist() == values
    assert [x for part in back.parts(7) for x in part.tolist()] == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 1600, 10_000)).astype(np.uint64)
    assert len(elias_fano.EliasFano.of(bounds).to_bytes()) < 0.25 * 8 * len(bounds)


def test_shard_with_null_and_equal_ids():
    data = elias_fano.shard_bytes([None, -5, 3, 3, 2**62], np.array([1, 0, 3, 2, 1]), np.arange(7), 2)
    s = elias_fano.Shard(data)
    assert s.nulls == 1 and s.doc_ids(0, 5).to_pylist() == [None, -5, 3, 3, 2**62]
    assert s.doc_ids(0, 1).to_pylist() == [None] and s.doc_ids(2, 4).to_pylist() == [3, 3]
    assert [s.document(i).tolist() for i in range(5)] == [[0], [], [1, 2, 3], [4, 5], [6]]
    with pytest.raises(ValueError):
        elias_fano.Shard(b"nonsense" * 10)


def test_token_files_round_trip(spark, library, tmp_path):
    df = documents(spark).repartition(3)
    folder = f"file://{tmp_path}/tokens"
    manifest = elias_fano.write_shards(df, BYTES, 2, folder, partitions=3, shard_ids=1000)
    got = elias_fano.read_documents(manifest, folder, keep_ids=True).orderBy("start").collect()
    assert manifest.count() == 3
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    lib = library[BYTES]
    assert sorted(r["ids"] for r in got) == sorted([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect())
    assert elias_fano.token_file(documents(spark, empty=True), BYTES).count() == 0
    assert elias_fano.token_file(df.where(F.lit(False)), BYTES).count() == 0
