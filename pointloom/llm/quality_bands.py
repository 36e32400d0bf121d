"""Quality rules with compression bands.

The zstandard ratio (bytes before over bytes after) of a whole document and of its fixed chunks
must lie in a band: text that compresses too well repeats itself, text that hardly compresses is
not language.  Short texts compress less than long ones, so the limits depend on the length.  They are
those of the corpus at hand, from its labelled good rows (``fitted``); without labels they are wide ones.

Each row stands alone: one pass, no exchange of texts, after a pass over all labelled good rows that sets the limits.  Null and empty texts have no words and fail the
base rule; repeated rows are judged alike; long texts are compressed whole; extra columns are not
read by ``quality_rules`` and kept by ``passing``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pointloom.llm.common import discard, written

#: (bytes from which a line holds, least ratio, largest ratio) of whole documents, for a corpus without
#: labels: wide enough for prose, code, licences and tables in any script.  With labels, ``fitted`` sets them.
BANDS = (
    (0, 0.3, 2.2), (256, 1.0, 2.6), (512, 1.2, 3.0), (1024, 1.25, 3.6), (2048, 1.35, 4.2), (4096, 1.4, 5.0), (16384, 1.45, 6.0), (65536, 1.5, 7.0),
)
#: Lines that are fitted, from these bytes on.
EDGES = (0, 256, 384, 512, 640, 768, 1024, 1280, 1536, 2048, 2560, 3072, 4096, 5120, 6144, 8192, 12288, 16384, 32768)
#: Bytes of a chunk; a rest under half of that belongs to the chunk before it.
CHUNK = 4096
#: Band of one chunk and the share of chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = (1.3, 5.0), 0.34
#: Fitting: the share of labelled good rows each end of a band may cut off, the margins added below and above,
#: the rows a line needs for limits of its own, and the digits of a ratio that are told apart.
TAIL, MARGINS, LEAST_ROWS, DIGITS = 0.003, (0.05, 0.03), 20, 4
LEVEL = 3
SYMBOLS = "#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks int, n_chunks_outside int, reason string, n_bytes long"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    pair = ids[:-1] * k + ids[1:]
    if k > 1 << 20:  # three ids in one 64-bit key would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    data = text.encode()
    words = data.split()
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = repeated_words(words)
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)


class Bands:
    """Verdicts by compression; one compressor a worker."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, level: int = LEVEL):
        import zstandard

        self.bands, self.chunk, self.chunk_band, self.share = bands, chunk, chunk_band, share
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 0.0

    def chunk_ratios(self, data: bytes) -> list[float]:
        """Of the chunks of a document that has several."""
        n = max(1, len(data) // self.chunk + (len(data) % self.chunk >= self.chunk // 2))
        view = memoryview(data)
        return [self.ratio(bytes(view[k * self.chunk : (k + 1) * self.chunk if k < n - 1 else len(data)])) for k in range(n)] if n > 1 else []

    def verdict(self, text: str | None) -> tuple[float, int, int, str | None]:
        """ratio, chunks, chunks outside the band, and why the method rejects (null: it doesn't)."""
        data = (text or "").encode()
        ratio = self.ratio(data)
        low, high = next((lo, hi) for least, lo, hi in reversed(self.bands) if len(data) >= least)
        chunks = self.chunk_ratios(data)
        n, outside = max(1, len(chunks)), sum(not self.chunk_band[0] <= x <= self.chunk_band[1] for x in chunks)
        why = "repetitive" if ratio > high else "incompressible" if ratio < low else "chunks" if outside > self.share * n else None
        return ratio, n, outside, why


def quality_rules(docs: DataFrame, chunks: bool = False, **settings) -> DataFrame:
    """Base figures, compression figures and verdict of every document (with ``chunks`` also the ratios
    of its chunks); ``settings`` go to Bands."""
    schema = SCHEMA + (", chunk_ratios array<double>" if chunks else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(**settings)
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        kinds = [types[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                base = base_figures(text)
                ratio, n, outside, why = bands.verdict(text)
                data = (text or "").encode()
                own = (bands.chunk_ratios(data),) if chunks else ()
                rows.append((doc_id.as_py(), *base, not base[-1] and why is None, ratio, n, outside, "base" if base[-1] else why, len(data), *own))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def good_figures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality_rules`` with chunk ratios of all rows with quality 1.  Figures are joined with labels, so no
    text crosses the exchange; they are stored, as several sums read them."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return written(quality_rules(docs, chunks=True).join(good, "doc_id", "left_semi"), "good-figures")


def ends(values: DataFrame, by: list[str]) -> list[Row]:
    """(by.., rows, ends) of ratios x: how many, and their quantiles at ``TAIL`` from either end.  Equal ratios
    (of ``DIGITS`` digits) are counted first, so a group holds its distinct ratios and not its rows."""
    counts = values.groupBy(*by, F.round("x", DIGITS).alias("x")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.percentile("x", [TAIL, 1 - TAIL], F.col("n")).alias("ends")).collect()


def fitted(docs: DataFrame, labels: DataFrame | None, edges: tuple[int, ...] = EDGES) -> dict:
    """Settings of Bands for a corpus: the limits that its own labelled good rows keep.

    Of all those that pass the base rule: by length, the quantiles of the ratio at ``TAIL``
    from either end, with ``MARGINS``; ratios grow with length, so no limit is below that of a shorter line, and a
    line with under ``LEAST_ROWS`` rows takes those of the line before (before the first such line, its own
    least and that line's largest).  Likewise one band for chunks.  Without labels, or with no line that has rows
    enough, there are no settings and the wide ``BANDS`` hold.  One row a line comes to the driver.
    """
    if labels is None:
        return {}
    figures = good_figures(docs, labels)
    rows = figures.where("not base_failed")
    line = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n_bytes"))) - 1
    got = {r["line"]: r for r in ends(rows.select(line.alias("line"), F.col("ratio").alias("x")), ["line"]) if r["rows"] >= LEAST_ROWS}
    chunks = ends(rows.where("n_chunks > 1").select(F.explode("chunk_ratios").alias("x")), [])
    discard(figures)
    if not got:
        return {}
    first = min(got)
    out, low, high = [], BANDS[0][1], got[first]["ends"][1] + MARGINS[1]
    for i, edge in enumerate(edges):
        if i in got:
            low, high = max(low, got[i]["ends"][0] - MARGINS[0]), max(high, got[i]["ends"][1] + MARGINS[1])
        out.append((edge, round(low, 3), round(high, 3)))
    settings = {"bands": tuple(out)}
    if chunks and (chunks[0]["rows"] or 0) >= LEAST_ROWS:
        settings["chunk_band"] = (round(chunks[0]["ends"][0] - MARGINS[0], 3), round(chunks[0]["ends"][1] + MARGINS[1], 3))
    return settings


def passing(docs: DataFrame, **settings) -> DataFrame:
    """The documents that neither the base rule nor the bands reject, with all their columns.

    The verdict is taken beside the row itself, so nothing is joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(**settings)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = []
            for text in texts:
                text = text.as_py()
                keep.append(not base_figures(text)[-1] and bands.verdict(text)[-1] is None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
