"""Operator 3: quality rules with compression bands.

Base rule: the counts below, and ``base_failed`` for texts of under 50 words or with over half of
their words in repeated three-word windows. Method: zstandard's ratio (bytes over compressed bytes)
of the whole text and of fixed chunks. Repetitive text compresses too well, random text hardly at
all; how well prose compresses depends on how much of it there is, so the limits belong to bands of
length, two for each doubling from 300 bytes on, without an end. They are lines over the logarithm of the length, drawn
with a margin around public prose: licence texts of Debian's common-licenses and Python's reference
manual give 1.2 to 2.0 at 300 bytes, 1.6 to 2.3 at 1,000, 2.0 to 2.8 at 4,000, 2.5 to 3.2 at 16,000, 2.7 to 3.5 at
64,000 and 3.4 to 4.2 beyond. Scripts of several bytes a letter widen them: the upper limit holds for bytes over
compressed bytes and bytes a letter, the lower is divided by the root of the latter. ``fit`` narrows the limits to
what all labelled good documents of a corpus show.

A document is rejected when its whole ratio leaves its band's limits, or when the chunks
that leave the limits of their length hold more than ``chunk_share`` of its bytes. Every byte is in a chunk: what
is left at the end is judged with as many bytes before it as make a whole chunk, and counts by its own
bytes. A text of less than a chunk is its only chunk.

A null or empty text has no words and fails the base rule. Texts shorter than the first band are
not judged by compression. Lines and windows are counted over the whole text, whatever its length;
rows are independent, so ties, repeated rows and further columns need no care."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import gathered, slices, stage, table, work_dir

SYMBOLS = "#*$%&|<>"


def band(n_bytes: int) -> int:
    """The band of a length: half doublings from 300 bytes; below 0 for shorter ones."""
    return math.floor(2 * math.log2(n_bytes / 300)) if n_bytes else -1


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio. ``fitted`` replaces the general ones in some bands: (band, least, greatest)."""

    fitted: tuple[tuple[int, float, float], ...] = ()
    chunk: int = 4096
    chunk_share: float = 0.5
    chunk_margin: float = 0.1
    level: int = 3

    def limits(self, n_bytes: int, letter: float = 1.0) -> tuple[float, float]:
        """Least and greatest ratio of a text of ``n_bytes``, of ``letter`` bytes a letter."""
        k = band(n_bytes)
        for at, low, high in self.fitted:
            if at == k:
                break
        else:
            doublings = k / 2
            low, high = min(1.8, 1.1 + 0.12 * doublings), 2.3 + 0.22 * doublings
        return low / math.sqrt(letter), high * letter


def window_repeats(words: list, size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    base = len(ids)
    if base**size < 1 << 62:
        code = w[:n].copy()
        for k in range(1, size):
            code = code * base + w[k : n + k]
        _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    else:
        _, place, count = np.unique(np.stack([w[k : n + k] for k in range(size)], 1), axis=0, return_inverse=True, return_counts=True)
    twice = count[place.ravel()] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : n + k] |= twice
    return int(covered.sum())


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()  # bytes split at ASCII white space alone
    n_dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return len(words), chars, sum(map(text.count, SYMBOLS)), n_dup, window_repeats(words)


def figures(text: str, raw: bytes, bands: Bands, compressor) -> tuple[int, float, float, list[float]]:
    """Bytes, bytes a letter, ratio of the whole, ratios of the chunks: none of a text below the bands or of less than a chunk."""
    ratio = len(raw) / max(1, len(compressor.compress(raw)))
    chunks = []
    if band(len(raw)) >= 0 and len(raw) >= bands.chunk:
        ends = [min(at + bands.chunk, len(raw)) for at in range(0, len(raw), bands.chunk)]
        chunks = [bands.chunk / len(compressor.compress(raw[end - bands.chunk : end])) for end in ends]
    return len(raw), len(raw) / len(text) if text else 1.0, ratio, chunks


def verdict(n_bytes: int, letter: float, ratio: float, chunks: list[float], bands: Bands) -> tuple[float, bool]:
    """Share of bytes in chunks out of limits, and whether a text with these figures stays."""
    if band(n_bytes) < 0:
        return 0.0, True
    low, high = bands.limits(n_bytes, letter)
    odd = 0
    if n_bytes < bands.chunk:
        odd = n_bytes * (not low <= ratio <= high)
    else:
        least, most = bands.limits(bands.chunk, letter)
        for k, r in enumerate(chunks):
            size = min(bands.chunk, n_bytes - k * bands.chunk)
            odd += size * (not least * (1 - bands.chunk_margin) <= r <= most * (1 + bands.chunk_margin))
    share = odd / n_bytes
    return share, low <= ratio <= high and share <= bands.chunk_share


def compression(text: str, raw: bytes, bands: Bands, compressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks out of limits, verdict."""
    known = figures(text, raw, bands, compressor)
    return known[2], *verdict(*known, bands)


_COUNTS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_FIGURES = "band int, n_bytes bigint, letter double, ratio double, chunks array<double>"


def measure(docs: DataFrame, bands: Bands = Bands(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and figures of every row, without its text: all that limits are fitted on and verdicts need."""
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.float64()] * 2 + [pa.list_(pa.float64())]
    names = [x.split()[0] for x in f"{_COUNTS}, {_FIGURES}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for b in slices(batches):
            rows = []
            for t in b.column("text"):
                t = t.as_py() or ""
                raw = t.encode()
                rows.append((*base_counts(t, raw), band(len(raw)), *figures(t, raw, bands, compressor)))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{_COUNTS}, {_FIGURES}")


def decide(measured: DataFrame, bands: Bands) -> DataFrame:
    """``measured`` rows with odd_share, in_band, base_failed and kept."""
    keep = _COUNTS.replace(" bigint", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [verdict(*x, bands) for x in zip(*(b.column(k).to_pylist() for k in ("n_bytes", "letter", "ratio", "chunks")))]
            share, held = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (*keep, "ratio")), pa.array(share, pa.float64()), pa.array(held, pa.bool_())], names=[*keep, "ratio", "odd_share", "in_band"])

    rows = measured.mapInArrow(run, f"{_COUNTS}, ratio double, odd_share double, in_band boolean")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_band"))


def judge(docs: DataFrame, bands: Bands = Bands(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, compression figures, base_failed and kept for every row."""
    return decide(measure(docs, bands, text, key), bands)


def fit(docs: DataFrame, good: DataFrame, least: int = 30, margin: tuple[float, float] = (0.15, 0.03), text: str = "text", key: str = "doc_id") -> Bands:
    """Bands whose limits are the extremes of the ratios of documents known to be good (their ids in
    ``good``), with a margin below and above. All of them are read; a
    band with under ``least`` documents that pass the base rule keeps the general limits."""
    return fit_measured(measure(docs, text=text, key=key), good, least, margin, key)


def fit_measured(measured: DataFrame, good: DataFrame, least: int = 30, margin: tuple[float, float] = (0.15, 0.03), key: str = "doc_id") -> Bands:
    """``fit`` over rows of ``measure``: what meets the ids of good documents is a few numbers a document, never its text."""
    ids = good.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    able = measured.where("band >= 0 AND n_words >= 50 AND 2 * n_repeat_words <= n_words")
    rows = able.select(F.col("doc_id").alias("id"), "band", (F.col("ratio") * F.sqrt("letter")).alias("low"), (F.col("ratio") / F.col("letter")).alias("high")).join(ids, "id", "left_semi")
    found = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = sorted((r.band, r.low * (1 - margin[0]), r.high * (1 + margin[1])) for r in found.collect() if r.n >= least)  # a row for each band
    return Bands(fitted=tuple(got))


def op3_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = stage(measure(docs), work_dir(spark, "compression-rules"))
    bands = fit_measured(measured, table(spark, sf_dir, "labels").where("quality = 1"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_share")
    return gathered(decide(measured, bands).select(*columns))
