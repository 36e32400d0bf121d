"""Quality classifier by co-training.

Two views of a document: its *text* (which words and symbol runs occur) and its page *metadata*
(source, language, length).  Each view has a logistic model.  Over ``ROUNDS`` rounds each model scores
all documents without a label, and those it is surest of become training rows of the other.  At the
end the two views' logits are combined and calibrated on labelled rows that took no part in fitting.
Two judgements are made this way, quality (labels.quality) and harmlessness (labels.toxic = 0); the
score is the product of both probabilities and ``kept`` needs each of them.

*What is bounded.*  Models are fitted on the driver, on at most ``MAX_LABELLED`` labelled rows, chosen
by a hash of doc_id, with at most ``MAX_SIZE`` features together (a document that would go beyond is passed
over, not those after it), on at most ``MAX_FEATURES`` features a view, those that tell the classes apart
best (a guard of the driver's memory), and on the pseudo-labels: at most ``PER_ROUND`` a view and round.  Everything else covers the table: each text is read once, whole, for
its features; every round scores every document without a label on the executors, a task gives back
its surest ones, and the surest of all are taken; every document gets its score.

Null and empty texts have no words and are judged by metadata and bias; very long ones are read
whole; null metadata are values of their own; repeated rows score alike, and of rows with one doc_id
that with the smallest text hash is fitted on; a null doc_id has no label and gives none; extra columns
are not read; without labels of both kinds a judgement is 1 for all; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import written

#: Labelled rows to fit on, and features of all of them together.
MAX_LABELLED, MAX_SIZE = 9_000, 8_000_000
ROUNDS = 3
#: A pseudo-label needs this probability, and each view gives at most so many a round, in the classes' proportions.
SURE, PER_ROUND = 0.97, 600
#: A word must occur in so many of the documents fitted on.
LEAST_DOCS = 4
#: And tell the classes apart by so many standard errors.
LEAST_Z = 3.0
#: Features of a view at most, the most telling ones.
MAX_FEATURES = 50_000
#: Share of labelled rows held out for calibration.
HELD_OUT = 0.3
#: A judgement's name, the label's column, and whether 1 is bad there.
JUDGEMENTS = (("quality", "quality", False), ("harmless", "toxic", True))
SYMBOLS = "#*$%&|<>!"
CAPITALS = bytes(range(65, 91))


def text_features(text: str | None, seen: dict[bytes, int]) -> set[int]:
    """Hashes of the distinct words, of the symbol runs that end words and of the text's shape
    (tenths of distinct words and of capitals); ``seen`` caches words."""
    data = (text or "").encode()
    words = data.lower().split()
    distinct = set(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    out = {zlib.crc32(b"shape d%d" % (10 * len(distinct) // len(words))), zlib.crc32(b"shape c%d" % (10 * capitals // len(data)))} if words else set()
    for w in distinct:
        h = seen.get(w)
        if h is None:
            if len(seen) > 500_000:
                seen.clear()
            stem = w.strip(b".,;:?\"'()[]")
            tail = stem.rstrip(SYMBOLS.encode())
            h = seen[w] = zlib.crc32(b"~" + stem[len(tail) :] if len(tail) < len(stem) else stem)
        out.add(h)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    size = "?" if n_chars is None else str(max(0, n_chars).bit_length())
    return [zlib.crc32(x.encode()) for x in (f"s{source!r}", f"l{lang!r}", f"n{size}", f"ln{lang!r}{size}")]


@dataclass
class Rows:
    """Sparse rows of ones."""

    index: np.ndarray
    ends: np.ndarray
    width: int

    @classmethod
    def of(cls, lists: list[np.ndarray], width: int) -> Rows:
        return cls(np.concatenate(lists) if lists else np.zeros(0, np.int64), np.cumsum([len(x) for x in lists]), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return total[self.ends] - total[np.concatenate([[0], self.ends[:-1]]).astype(np.int64)] if len(self.ends) else np.zeros(0)

    @classmethod
    def stored(cls, lists: pa.ListArray, width: int) -> Rows:
        ends = np.asarray(lists.offsets, np.int64)[1:] - lists.offsets[0].as_py()
        return cls(np.asarray(lists.flatten()), ends, width)

    def back(self, g: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.concatenate([[0], self.ends])).astype(np.int64)
        return np.bincount(self.index, weights=np.repeat(g, sizes), minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(rows: Rows, y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float, steps: int = 80, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam over all rows, from (w, bias)."""
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        g = weight * (sigmoid(rows.times(w) + bias) - y) / total
        gw, gb = rows.back(g) + ridge * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def combined(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of both views' logits and a bias: Platt scaling over two scores, with its smoothed
    targets, by Newton steps that are halved until they help."""
    scale = z.std(axis=0) + 1e-9
    x = np.column_stack([z / scale, np.ones(len(z))])
    good = y.sum()
    y = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    w = np.zeros(3)

    def loss(w: np.ndarray) -> float:
        t = np.clip(x @ w, -500, 500)
        return float((np.logaddexp(0, t) - y * t).sum() + 0.01 * (w**2).sum())

    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3), x.T @ (p - y) + 0.02 * w)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return np.array([w[0] / scale[0], w[1] / scale[1], w[2]])


def telling(lists: list[np.ndarray], y: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """The features that occur in enough documents and in one class more often than chance allows
    (by ``LEAST_Z`` standard errors); the others would only add noise to long texts.
    At most ``MAX_FEATURES``, the most telling ones."""
    own = np.flatnonzero(fitted)
    sizes = [len(lists[k]) for k in own]
    known, at, counts = np.unique(np.concatenate([lists[k] for k in own]), return_inverse=True, return_counts=True)
    good = np.bincount(at, weights=np.repeat(y[own], sizes), minlength=len(known))
    n, n1 = len(own), float(y[own].sum())
    share = counts / n
    gap = good / n1 - (counts - good) / (n - n1)
    z = gap / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    z[(counts < LEAST_DOCS) | (np.abs(z) < LEAST_Z)] = 0
    strongest = np.lexsort((known, -np.abs(z)))[:MAX_FEATURES]
    return np.sort(known[strongest][z[strongest] != 0])


@dataclass
class Head:
    """One judgement while it is fitted: the rows it learns from and a model of each view.

    Features are places in the views' vocabularies; ``own`` marks those that tell this judgement's
    classes apart."""

    own: list[np.ndarray] = field(default_factory=list)
    rows: list[list[list[np.ndarray]]] = field(default_factory=list)  # of each view's learner: text and metadata features
    y: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    held: list[list[np.ndarray]] = field(default_factory=list)
    held_y: np.ndarray | None = None
    models: list[tuple[np.ndarray, float]] = field(default_factory=list)
    taken: list[np.ndarray] = field(default_factory=list)
    mix: np.ndarray | None = None

    @property
    def fitted(self) -> bool:
        return bool(self.models)

    def learn(self, steps: int) -> None:
        for i in (0, 1):
            rows = Rows.of([x[self.own[i][x]] for x in self.rows[i][i]], len(self.own[i]))
            self.models[i] = logistic(rows, self.y[i], self.weight[i], *self.models[i], steps=steps)

    def held_logits(self) -> np.ndarray:
        """Logits of the held-out rows in both views."""
        out = [Rows.of([x[self.own[i][x]] for x in self.held[i]], len(self.own[i])).times(self.models[i][0]) + self.models[i][1] for i in (0, 1)]
        return np.column_stack(out)

    def calibrated(self) -> list[tuple[np.ndarray, float, float, float]]:
        """Each view's weights, bias, and the scaling that makes a probability of its logit alone."""
        z = self.held_logits()
        out = []
        for i in (0, 1):
            w = combined(np.column_stack([z[:, i], np.zeros(len(z))]), self.held_y)
            out.append((self.models[i][0], self.models[i][1], w[0], w[2]))
        return out


def start_head(views: list[list[np.ndarray]], known: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> Head:
    """A head fitted on labelled rows alone; ``views`` are features as places in the vocabularies."""
    fit = np.flatnonzero(~np.isnan(y) & ~held)
    out = np.flatnonzero(~np.isnan(y) & held)
    if len(np.unique(y[fit])) < 2 or not len(out):
        return Head()
    own = [np.isin(np.arange(len(k)), telling(v, y, ~np.isnan(y) & ~held)) for v, k in zip(views, known)]
    learns = [[v[k] for k in fit] for v in views]
    return Head(own, [learns, [list(x) for x in learns]], [y[fit], y[fit]], [np.ones(len(fit))] * 2, [[v[k] for k in out] for v in views], y[out], [(np.zeros(len(k)), 0.0) for k in known], [np.zeros(0, np.int64)] * 2)


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_size: int = MAX_SIZE) -> pa.Table:
    """(doc_id, quality, toxic, t, m): features of a bounded choice of labelled rows, in order of doc_id."""
    order = F.xxhash64("doc_id")
    chosen = known_labels(labels).orderBy(order, "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = [sorted(text_features(t.as_py(), seen)) for t in c["text"]]
            metas = [meta_features(*x) for x in zip(c["source"].to_pylist(), c["lang"].to_pylist(), c["n_chars"].to_pylist())]
            as_lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            size = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([c["doc_id"], c["h"], c["quality"], c["toxic"], as_lists(texts), as_lists(metas), size], ["doc_id", "h", "quality", "toxic", "t", "m", "size"])

    rows = documents(docs).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` short rows
    rows = rows.selectExpr("doc_id", "h", "cast(quality as int) quality", "cast(toxic as int) toxic", "text", "source", "lang", "n_chars")
    rows = written(rows.mapInArrow(run, "doc_id long, h long, quality int, toxic int, t array<long>, m array<long>, size long"), "labelled")
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct("h", "size")).alias("one")).select("doc_id", "one.*").orderBy(order, "doc_id").collect()  # at most ``most`` short rows
    taken, total = [], 0
    for r in sizes:
        if total + r["size"] <= most_size:
            taken.append((r["doc_id"], r["h"]))
            total += r["size"]
    spark = docs.sparkSession
    ids = spark.createDataFrame(taken, "doc_id long, h long")
    got = rows.join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "quality", "toxic", "t", "m").toArrow()
    return got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))  # as read, the order is the tasks'


def known_labels(labels: DataFrame) -> DataFrame:
    """One row a doc_id."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def documents(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "source", "lang", "cast(n_chars as long) n_chars")


def featured(docs: DataFrame, labels: DataFrame, words: np.ndarray, about: np.ndarray) -> DataFrame:
    """(doc_id, t, m, quality, toxic) of every document, stored: which features of the vocabularies it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        place, meta_place = ({int(x): i for i, x in enumerate(known)} for known in (words, about))
        for b in batches:
            t = [sorted(place[w] for w in text_features(x.as_py(), seen) if w in place) for x in b.column(1)]
            m = [[meta_place[x] for x in meta_features(*row) if x in meta_place] for row in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.list_(pa.int32())), pa.array(m, pa.list_(pa.int32()))], ["doc_id", "t", "m"])

    rows = documents(docs).mapInArrow(run, "doc_id long, t array<int>, m array<int>")
    return written(rows.join(known_labels(labels), "doc_id", "left").selectExpr("doc_id", "t", "m", "cast(quality as int) quality", "cast(toxic as int) toxic"), "features")


def tie_order(ids: np.ndarray) -> np.ndarray:
    """A mixed order of ids, for documents that are equally sure."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)


def surest(rows: DataFrame, heads: list[Head], most: int) -> pa.Table:
    """(head, view, value, doc_id, t, m): of all documents without a label the ``most`` (times the class's
    share) that each view is surest of, for each class; none that it has given before."""
    views = [h.calibrated() if h.fitted else [] for h in heads]
    taken = [h.taken for h in heads]
    room = [[max(1, int(most * (1 - s))), max(1, int(most * s))] for s in (float(h.y[0][: len(h.y[0])].mean()) if h.fitted else 0.5 for h in heads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            given = ~b.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, own in enumerate(views):
                free = given & b.column(3 + i).is_null().to_numpy(zero_copy_only=False)
                for j, (w, bias, scale, shift) in enumerate(own):
                    p = sigmoid(scale * (Rows.stored(b.column(1 + j), len(w)).times(w) + bias) + shift)
                    new = free & ~np.isin(ids, taken[i][j])
                    for value, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(new & (sure >= SURE))
                        x, s = best.get((i, j, value), (np.zeros(0, np.int64), np.zeros(0)))
                        x, s = np.concatenate([x, ids[at]]), np.concatenate([s, sure[at]])
                        x, first = np.unique(x, return_index=True)
                        keep = np.lexsort((tie_order(x), -s[first]))[: room[i][value]]
                        best[i, j, value] = x[keep], s[first][keep]
        for (i, j, value), (x, s) in best.items():
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(x), v), pa.int32()) for v in (i, j, value)), pa.array(x), pa.array(s), pa.array(tie_order(x))], ["head", "view", "value", "doc_id", "sure", "tie"])

    key = ["head", "view", "value"]
    some = rows.select("doc_id", "t", "m", *[c for _, c, _ in JUDGEMENTS]).mapInArrow(run, "head int, view int, value int, doc_id long, sure double, tie long")
    some = some.groupBy(*key, "doc_id", "tie").agg(F.max("sure").alias("sure"))
    limits = F.create_map(*[F.lit(v) for i, r in enumerate(room) for value, n in enumerate(r) for v in (2 * i + value, n)])
    room_here = limits[2 * F.col("head") + F.col("value")]
    # the best of each of 64 parts first, so that the last order has a bounded number of rows, whatever the tasks before
    for part in ([*key, F.pmod("tie", F.lit(64))], key):
        nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("sure"), "tie"))
        some = some.withColumn("nth", nth).where(F.col("nth") <= room_here).drop("nth")
    chosen = written(some.select(*key, "doc_id"), "surest")
    one = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "m")).alias("f"))  # at most ``most`` a view and judgement
    return chosen.join(F.broadcast(one), "doc_id").select(*key, "doc_id", "f.t", "f.m").orderBy(*key, "doc_id").toArrow()


def co_trained(rows: DataFrame, heads: list[Head], rounds: int = ROUNDS, most: int = PER_ROUND) -> None:
    """Rounds in which what one view is sure of teaches the other, then the views' combination."""
    live = any(h.fitted for h in heads)
    for r in range(rounds + 1 if live else 0):
        for h in heads:
            if h.fitted:
                h.learn(80 if r == 0 else 30)
        if r == rounds:
            break
        got = surest(rows, heads, most)
        which = np.stack([got.column(c).to_numpy() for c in ("head", "view", "value")], axis=1) if got.num_rows else np.zeros((0, 3), int)
        ids = got.column("doc_id").to_numpy()
        lists = [[np.asarray(x, np.int64) for x in got.column(c).to_pylist()] for c in ("t", "m")]
        for i, h in enumerate(heads):
            for j in (0, 1):
                at = np.flatnonzero((which[:, 0] == i) & (which[:, 1] == j))
                if not len(at):
                    continue
                k = 1 - j  # the view that learns
                for view in (0, 1):
                    h.rows[k][view] = h.rows[k][view] + [lists[view][x] for x in at]
                h.y[k] = np.concatenate([h.y[k], which[at, 2].astype(float)])
                h.weight[k] = np.concatenate([h.weight[k], np.full(len(at), 0.3)])
                h.taken[j] = np.concatenate([h.taken[j], ids[at]])
    for h in heads:
        if h.fitted:
            h.mix = combined(h.held_logits(), h.held_y)


def score(rows: DataFrame, heads: list[Head], limit: float = 0.5) -> DataFrame:
    """doc_id, score, quality, harmless (probabilities) and kept of every document of ``featured``."""
    names = [n for n, _, _ in JUDGEMENTS]
    models = [(h.models, h.mix) if h.fitted else None for h in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.ones((len(names), len(b)))
            for i, own in enumerate(models):
                if own is not None:
                    (wt, bt), (wm, bm) = own[0]
                    z = own[1][0] * (Rows.stored(b.column(1), len(wt)).times(wt) + bt) + own[1][1] * (Rows.stored(b.column(2), len(wm)).times(wm) + bm) + own[1][2]
                    p[i] = np.round(sigmoid(z), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.prod(axis=0)), *map(pa.array, p), pa.array((p >= limit).all(axis=0))], ["doc_id", "score", *names, "kept"])

    schema = "doc_id long, score double, " + "".join(f"{n} double, " for n in names) + "kept boolean"
    return rows.select("doc_id", "t", "m").mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> DataFrame:
    """Fit on a bounded choice of labelled rows, co-train over all documents without a label, score every document."""
    got = labelled_rows(docs, labels, max_labelled)
    lists = [[np.asarray(x, np.int64) for x in got.column(c).to_pylist()] for c in ("t", "m")]
    held = np.array([zlib.crc32(b"held %d" % i) % 1000 for i in got.column("doc_id").to_pylist()], int) < 1000 * HELD_OUT
    truth = []
    for _, column, flip in JUDGEMENTS:
        y = got.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        truth.append(1 - y if flip else y)
    known = []
    for view in lists:  # what tells the classes of any judgement apart
        use = [(y, ~np.isnan(y) & ~held) for y in truth]
        parts = [telling(view, y, fit) for y, fit in use if len(np.unique(y[fit])) == 2]
        known.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64))
    placed = [[np.flatnonzero(np.isin(k, x)) for x in view] for view, k in zip(lists, known)]
    heads = [start_head(placed, known, y, held) for y in truth]
    rows = featured(docs, labels, *known)
    co_trained(rows, heads, rounds, per_round)
    return score(rows, heads)
