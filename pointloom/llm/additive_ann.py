"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one codeword from each of ``M`` full-dimensional
codebooks.  The codebooks are fitted on residuals, then improved together by least squares; codes are
found by beam search over the partial sums.  An index row is its codes, the stored squared norm of its
sum, the cosine between sum and vector, and the vector itself.  A query scores rows from lookup
tables, |sum|^2 - 2 <q, sum>, without decoding, and reranks them exactly, by cosine in double precision.

*How deep to rerank.*  With a the angle between query and sum and t the stored angle between sum and
vector, the query's cosine is at most cos(a - t); a is taken as an interval, by the error of its table sums.  A block's nearest by score are reranked first; then
every row of it whose bound reaches their k-th exact cosine.  So in the blocks a query meets the result
is exact, and no number of candidates is fixed, however many near copies there are.

*What meets what.*  The first two codebooks deal the index into cells, a cell a pair of codewords, about
the square root of the rows many; each of the two has the square root of that, so a bounded sample is
enough to fit them at any size.  How many cells, in order of their distance, a query visits is measured: ``CHECKED`` queries are
searched exactly over all rows, and the fewest cells that hold ``RECALL`` of their nearest are taken.
Cells with more rows than a block of ``BLOCK`` bytes holds are cut by hash, so a cell with a third of all
vectors is only more blocks; any other is one, and a query's vector is sent to it once.  A task reads a block and then the queries that visit it, sorted behind it, in batches;
each block gives the best k of a query, and their best k are the result.

The codebooks are fitted on at most ``TRAIN`` vectors, chosen by a hash of vec_id; every vector is
indexed.  Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
with a null vec_id; a shorter vector counts as ending in zeros; very long or large ones are read whole
(cosines are taken of vectors scaled by a power of two).  Ties in the cosine go to the smaller vec_id.
Rows equal in vec_id and vector are one; rows with one vec_id and different vectors are each other's
candidates.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import written

#: Codebooks, codewords of each from the third on, partial sums kept.
M, K, BEAM = 24, 128, 4
TRAIN = 10_000
#: Queries that are searched exactly to choose the number of cells visited, and the share of their
#: nearest that those must hold.
CHECKED, RECALL = 200, 0.97
#: Bytes of a block's vectors, rows of it that are reranked first, and queries scored at once.
BLOCK, FIRST, QUERIES = 32 << 20, 32, 64
#: Error of a cosine from the tables, which are sums of ``M`` products in single precision.
SLACK = 4e-6


def nearest_codewords(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest_codewords(x, book)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(book)
        total[n > 0] = np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(n) - n)[n > 0])
        book[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty codeword moves to a random row
            book[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return book


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes (rows, M) by beam search: each level extends every kept partial sum by every codeword
    and keeps the ``beam`` with the smallest remaining error."""
    n, m = len(x), len(books)
    out = np.zeros((n, m), np.int16)
    for a in range(0, n, 1024):
        rest = x[a : a + 1024, None, :]  # rows, kept, dims
        codes = np.zeros((len(rest), 1, 0), np.int16)
        for level in range(m):
            book = books[level]
            error = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(axis=1)
            flat = error.reshape(len(rest), -1)
            keep = min(beam if level < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            before, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, before[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], axis=1), word[:, :, None].astype(np.int16)], axis=2)
        out[a : a + 1024] = codes[:, 0]
    return out


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def fit_codebooks(x: np.ndarray, cells: int, m: int = M, k: int = K, seed: int = 7) -> list[np.ndarray]:
    """``m`` codebooks for unit rows ``x``; pairs of the first two's codewords make at least ``cells`` cells."""
    rng = np.random.default_rng(seed)
    k, side = min(k, max(1, len(x))), int(np.ceil(np.sqrt(cells)))
    books, rest = [], x.copy()
    for level in range(m):
        book = k_means(rest, k if level > 1 else side, rng)
        rest = rest - book[nearest_codewords(rest, book)]
        books.append(book)
    # least squares: all codewords together, the codes as they are, from the third book on; the
    # first two stay, as they deal the cells
    codes = encode(x, books)
    cols = codes[:, 2:].astype(np.int64)
    wide = (m - 2) * k
    gram = np.zeros((m - 2, k, m - 2, k))
    right = np.zeros((wide, x.shape[1]))
    target = x - books[0][codes[:, 0]] - books[1][codes[:, 1]]
    for i in range(m - 2):
        for j in range(m - 2):
            gram[i, :, j] = np.bincount(cols[:, i] * k + cols[:, j], minlength=k * k).reshape(k, k)
        n = np.bincount(cols[:, i], minlength=k)
        right[np.flatnonzero(n) + i * k] = np.add.reduceat(target[np.argsort(cols[:, i], kind="stable")], (np.cumsum(n) - n)[n > 0])
    gram = gram.reshape(wide, wide)
    old = np.concatenate(books[2:]).astype(np.float64)
    better = old + np.linalg.solve(gram + 0.5 * np.eye(wide), right - gram @ old)
    return [books[0].astype(np.float32), books[1].astype(np.float32), *better.reshape(m - 2, k, -1).astype(np.float32)]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, with largest components from a half to one; cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, h, v array<double>) of the vectors that take part, all of one length; vec_id and h, a
    hash of the vector, name a row."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(fine)
    width = v.agg(F.max(F.size("v"))).first()[0] or 0
    v = v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    return v.groupBy("vec_id", F.xxhash64("v").alias("h")).agg(F.first("v").alias("v"))


def index(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, h, v, cell, codes, norm, near) of every vector; near is the cosine to its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = unit(matrix(b.column(2)))
            codes = encode(x, books)
            sums = decoded(codes, books)
            sums, exact = sums.astype(np.float64), scaled(matrix(b.column(2)))
            norm = (sums**2).sum(axis=1)
            near = (sums * exact).sum(axis=1) / np.sqrt(np.maximum(norm, 1e-30)) / np.linalg.norm(exact, axis=1)
            packed = pa.array([c.tobytes() for c in codes[:, 2:].astype(np.uint8)], pa.binary())
            cell = codes[:, 0].astype(np.int32) * len(books[1]) + codes[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), packed, pa.array(norm), pa.array(near)], ["vec_id", "h", "v", "cell", "codes", "norm", "near"])

    return vectors.select("vec_id", "h", "v").mapInArrow(run, "vec_id long, h long, v array<double>, cell int, codes binary, norm double, near double")


def cell_order(x: np.ndarray, books: list[np.ndarray], probe: int | None = None) -> np.ndarray:
    """Cells by distance, for every unit row: all, or the ``probe`` nearest."""
    a, b = books[:2]
    norm = ((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) + 2 * a @ b.T).ravel()
    out = []
    for i in range(0, len(x), n := max(1, (1 << 22) // len(norm))):
        rows = x[i : i + n]
        far = norm - 2 * ((rows @ a.T)[:, :, None] + (rows @ b.T)[:, None, :]).reshape(len(rows), -1)
        out.append(np.argsort(far, axis=1, kind="stable")[:, :probe])
    return np.concatenate(out) if out else np.zeros((0, probe or len(norm)), np.int64)


def cells_needed(rows: DataFrame, queries: DataFrame, books: list[np.ndarray], k: int, checked: int, recall: float) -> int:
    """The fewest nearest cells that hold ``recall`` of the exact k nearest of a bounded sample of queries."""
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "h").limit(checked).select("vec_id", "h", "v").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1
    ids, marks, q = (sample.column(0).to_numpy(), sample.column(1).to_numpy(), unit(matrix(sample.column(2).combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch's best k of each query: what is not among them can't be among the whole table's
            if not len(b):
                continue
            own, h, cell = (np.asarray(b.column(i)) for i in (0, 1, 3))
            s = q @ unit(matrix(b.column(2))).T
            s[(ids[:, None] == own) & (marks[:, None] == h)] = -2
            n = min(k, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n), pa.int32()), pa.array(np.take_along_axis(s, best, axis=1).ravel(), pa.float32()), pa.array(own[best].ravel()), pa.array(cell[best].ravel())], ["q", "s", "vec_id", "cell"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    found = rows.select("vec_id", "h", "v", "cell").mapInArrow(run, "q int, s float, vec_id long, cell int").where("s > -2")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "cell").collect()  # at most checked * k short rows
    place = np.argsort(cell_order(q, books), axis=1)
    ranks = np.sort([place[r["q"], r["cell"]] for r in found])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def routed(queries: DataFrame, books: list[np.ndarray], parts: np.ndarray, probe: int) -> DataFrame:
    """(vec_id, h, v, cell, part) for each block that a query visits; ``parts`` are the blocks of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                cells = cell_order(unit(matrix(b.column(2))), books, probe)
                row, cell = np.repeat(np.arange(len(b)), cells.shape[1]), cells.ravel()
                times = parts[cell]  # none of an empty cell
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 4096):
                    own = b.take(pa.array(row[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell[a : a + 4096], pa.int32()), pa.array(part[a : a + 4096], pa.int32())], ["vec_id", "h", "v", "cell", "part"])

    return queries.select("vec_id", "h", "v").mapInArrow(run, "vec_id long, h long, v array<double>, cell int, part int")


class Block:
    """Index rows that queries are scored against."""

    def __init__(self, books: list[np.ndarray], cell: int, rows: pa.Table):
        rows = rows.sort_by("vec_id").combine_chunks()  # equal scores: the smaller id stays
        of = lambda n: rows.column(n).combine_chunks()
        self.books = books
        self.ids, self.marks, self.norm = (of(n).to_numpy() for n in ("vec_id", "h", "norm"))
        self.v = scaled(matrix(of("v")))
        self.length = np.sqrt((self.v * self.v).sum(axis=1))
        self.turn = np.arccos(np.clip(of("near").to_numpy(), -1, 1))
        self.codes = np.frombuffer(b"".join(of("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.middle = books[0][cell // len(books[1])] + books[1][cell % len(books[1])]

    def cosines(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The cosine of query i with row j for each pair, in double precision."""
        length = np.sqrt((q * q).sum(axis=1))
        out = np.empty(len(i))
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            out[a : a + (1 << 15)] = (self.v[y] * q[x]).sum(axis=1) / (self.length[y] * length[x])
        return out

    def best(self, ids: np.ndarray, marks: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, cosine) of each query's k nearest rows of the block."""
        q = scaled(q)
        u = unit(q)
        dots = np.repeat((u @ self.middle)[:, None], len(self.ids), axis=1)
        for j, book in enumerate(self.books[2:]):
            dots += (u @ book.T)[:, self.codes[:, j]]  # the table of <q, codeword>
        score = self.norm - 2 * dots
        own = (ids[:, None] == self.ids) & (marks[:, None] == self.marks)
        score[own] = np.inf
        n = min(FIRST, score.shape[1])
        first = np.argpartition(score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(q), 1))
        i, j = np.repeat(np.arange(len(q)), n), first.ravel()
        exact = self.cosines(q, i, j)
        exact[own[i, j]] = -np.inf
        least = np.partition(exact.reshape(len(q), n), n - k, axis=1)[:, n - k] if n >= k else np.full(len(q), -np.inf)
        if n < score.shape[1]:  # the rest, as far as the bound reaches what is there
            cosine = dots / np.sqrt(np.maximum(self.norm, 1e-30))
            low, high = np.arccos(np.clip(cosine + SLACK, -1, 1)), np.arccos(np.clip(cosine - SLACK, -1, 1))
            apart = np.maximum(0, np.maximum(low - self.turn, self.turn - high))
            more = (np.cos(apart) + 1e-12 >= least[:, None]) & ~own
            more[i, j] = False
            x, y = np.nonzero(more)
            i, j, exact = np.concatenate([i, x]), np.concatenate([j, y]), np.concatenate([exact, self.cosines(q, x, y)])
        i, j, exact = (x[np.isfinite(exact)] for x in (i, j, exact))
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], self.ids[j[keep]], exact[keep]


def searched(rows: DataFrame, asks: DataFrame, books: list[np.ndarray], k: int, tasks: int) -> DataFrame:
    """(query_id, h, vec_id, score): the k nearest of every query in every block that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        name, block = None, None
        for b in batches:
            at = np.stack([np.asarray(b.column(n)) for n in ("cell", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z == a:
                    continue
                cell, part, kind = at[a].tolist()
                own = b.slice(a, z - a)
                if kind == 0:  # the block's rows come before its queries
                    if name != (cell, part):
                        held, block, name = [], None, (cell, part)
                    held.append(pa.Table.from_batches([own]))
                    continue
                if name != (cell, part):
                    raise AssertionError("queries without their block")
                if block is None:
                    block, held = Block(books, cell, pa.concat_tables(held)), []
                for c in range(0, len(own), QUERIES):
                    some = own.slice(c, QUERIES)
                    ids, marks = np.asarray(some.column(0)), np.asarray(some.column(1))
                    place, vec_id, score = block.best(ids, marks, matrix(some.column(2)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(marks[place]), pa.array(vec_id), pa.array(score)], ["query_id", "h", "vec_id", "score"])

    names = ["vec_id", "h", "v", "cell", "part", "kind", "codes", "norm", "near"]
    both = rows.withColumn("kind", F.lit(0)).select(names).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "kind")
    return dealt.select(names).mapInArrow(run, "query_id long, h long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, probe: int | None = None, train: int = TRAIN, checked: int = CHECKED, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every vector whose vec_id is divisible by ``every``.

    ``probe`` cells are visited; if not given, as many as ``recall`` needs on ``checked`` queries.
    """
    spark = vectors.sparkSession
    v = written(sound(vectors), "vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30)
    fitted = v.where(chance < 2 * train / n).orderBy(F.xxhash64("vec_id"), "vec_id", "h").limit(train)  # of about twice as many the first by hash
    x = unit(matrix(fitted.select("v").toArrow().combine_chunks().column(0).combine_chunks()))
    books = fit_codebooks(x, cells=int(np.ceil(np.sqrt(n))))

    rows = written(index(v, books), "index")
    in_cell = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in rows.groupBy("cell").count().collect():  # a row a cell: about the square root of the rows
        in_cell[r["cell"]] = r["count"]
    parts = -(-in_cell // max(1024, BLOCK // (8 * x.shape[1])))
    queries = rows.where(F.col("vec_id") % every == 0)
    if probe is None:
        probe = cells_needed(rows, queries, books, k, checked, recall)
    asks = routed(queries, books, parts, probe)
    several = [(int(c), int(parts[c])) for c in np.flatnonzero(parts > 1)]
    per_cell = spark.createDataFrame(several, "cell int, parts int")
    dealt = rows.join(F.broadcast(per_cell), "cell", "left").withColumn("part", F.pmod(F.xxhash64("vec_id", "h"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(min(parts.sum(), 20_000)))
    short = searched(dealt, asks, books, k, tasks)
    w = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return short.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
